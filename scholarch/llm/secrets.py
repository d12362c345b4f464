"""Secret scans: candidates by pattern, false positives removed by a random forest.

All of it is column functions: candidates and the text around them come from one pattern, the
forest is trained by Spark ML on labelled findings and its trees are written out as CASE
expressions over the features of each candidate, evaluated inside the row.  A table is scanned,
judged or redacted in one pass, without a shuffle and without Python in tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AROUND = 48  # characters of context on each side
THRESHOLD = 0.5
MASK = "[REDACTED]"
FINDINGS = 6000  # built-in labelled findings
# Names under which secrets are assigned.
_NAMES = r"(?i:api[_-]?key|access[_-]?key|private[_-]?key|secret|token|passw(?:or)?d|pwd|credential|bearer)"
_VALUE = "[A-Za-z0-9_+/=.~!@#$%^&*-]"
# A name may stand inside a longer one (GITHUB_TOKEN, secret_key_base); 'password is' needs a digit in what follows.
_ASSIGNED = (
    r"(?:(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]*?)?" + _NAMES + r"""[A-Za-z0-9_.-]*(?:["']?\s{0,3}(?:=>|:=|[:=])\s{0,3}["']?|\s{1,3}(?i:is|was)\s{1,3}["']?(?=[^\s0-9]*+[0-9]))"""
)
_URL = r"://[^\s/:@\"']*+:"
_BEARER = r"(?i:\bbearer)\s{1,3}(?=[^\s0-9]*+[0-9])"
_BLOCK = r" [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:\s|\\[rn])"
# A key file from its first line to its last, whatever lies between.  One without an end goes over header and base64 lines, and a last
# shorter one.  Possessive repeats run in a loop, so their length is not bounded by a stack.
_KEY_FILE = (
    r"-----BEGIN" + _BLOCK + r"(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END" + _BLOCK
    + "|(?:" + _BREAK + r"*+(?:[A-Za-z0-9+/=]{40,}+|[A-Z][A-Za-z-]++: [^\r\n\\]*+))*+(?:" + _BREAK + r"++[A-Za-z0-9+/=]++(?=[\r\n\\\"']|\z))?+)"
)
# A key file, a value after a name, a password in a URL, a bearer value, or a long unbroken run.
CANDIDATE = (
    _KEY_FILE
    + r"|" + _ASSIGNED + _VALUE + r"{8,}+"
    r"|" + _URL + r"[^\s@\"']{3,}+(?=@)"
    r"|" + _BEARER + r"[A-Za-z0-9_+/=.~-]{8,}+"
    r"|(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}"
)
# What of a candidate comes before its value.
_LEAD = r"\A(?:" + _ASSIGNED + "(?=" + _VALUE + "{8})|" + _URL + "|" + _BEARER + ")"
# Words and syllables of identifiers, placeholders and prose, for dictionary coverage.
DICTIONARY = (
    "the and ing ion ent ter for tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat "
    "user name config file path test example sample value default string number class object module import package system service client server request response session context "
    "token secret password key access private public auth admin root login account project version release build main util utils helper index table column data model view page "
    "your here change placeholder dummy fake todo insert enter replace none null true false"
).split()
_PLACEHOLDER = r"(?i)example|sample|dummy|changeme|change_me|your|placeholder|insert|xxxx|1234567|abcdef|\\*\\*\\*|todo|redacted|fake"

_ISSUERS = "AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk-|sk_live_|eyJ"
# A value longer than LONG is also judged by its windows and by what begins like an issuer's key; the most telling one counts.
LONG, WINDOW, STEP = 120, 48, 24

# Features as SQL over a value {v}, the texts before {b} and after it {a}, and its path {p}.
FEATURES = {
    "length": "length({v})",
    "digits": "(length({v}) - length(regexp_replace({v}, '[0-9]+', ''))) / length({v})",
    "uppers": "(length({v}) - length(regexp_replace({v}, '[A-Z]+', ''))) / length({v})",
    "symbols": "(length({v}) - length(regexp_replace({v}, '[^A-Za-z0-9]+', ''))) / length({v})",
    "hex": "CASE WHEN {v} RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 1 ELSE 0 END",
    "class_changes": "regexp_count({v}, '(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])') / length({v})",
    "syllables": "regexp_count(lower({v}), '[bcdfghjklmnpqrstvwxyz][aeiouy]') / length({v})",
    "hard_runs": "regexp_count(lower({v}), '[bcdfghjklmnpqrstvwxz]{{4,}}') / length({v})",
    "repeats": "regexp_count({v}, '(.)\\\\1\\\\1') / length({v})",
    "distinct": "size(array_distinct(split({v}, ''))) / length({v})",
    "entropy": "aggregate(array_distinct(split({v}, '')), 0D, (e, ch) -> e - CASE WHEN ch = '' THEN 0D ELSE (length({v}) - length(replace({v}, ch, ''))) / length({v}) * log2((length({v}) - length(replace({v}, ch, ''))) / length({v})) END)",
    "dictionary": "(length({v}) - length(regexp_replace(lower({v}), '" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + "', ''))) / length({v})",
    "placeholder": "CASE WHEN {v} RLIKE '" + _PLACEHOLDER + "' THEN 1 ELSE 0 END",
    "dashes": "CASE WHEN {v} RLIKE '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$' THEN 1 ELSE 0 END",
    "issuer": "CASE WHEN {v} RLIKE '^(" + _ISSUERS + "|-----BEGIN)' THEN 1 ELSE 0 END",
    "test_path": "CASE WHEN {p} RLIKE '(?i)(^|[/_.-])(tests?|examples?|samples?|fixtures?|mocks?|docs?)([/_.-]|$)' THEN 1 ELSE 0 END",
    "secret_word": "CASE WHEN {b} RLIKE '(?i)(key|secret|token|passw(or)?d|pwd|credential|bearer|auth)[^a-z0-9]{{0,12}}$' THEN 2 WHEN {b} RLIKE '(?i)(key|secret|token|passw(or)?d|credential|auth)' THEN 1 ELSE 0 END",
    "hash_word": "CASE WHEN {b} RLIKE '(?i)(commit|sha-?[0-9]*|md5|hash|checksum|digest|revision|uuid|guid|etag|version|build)[^a-z0-9]{{0,12}}$' THEN 2 WHEN {b} RLIKE '(?i)(commit|sha-?[0-9]+|md5|hash|checksum|digest|revision|uuid)' THEN 1 ELSE 0 END",
    "assigned": "CASE WHEN {b} RLIKE '[:=]\\\\s{{0,3}}[\\'\\\"]?$' THEN 1 ELSE 0 END",
    "quoted": "CASE WHEN {b} RLIKE '[\\'\\\"]$' AND {a} RLIKE '^[\\'\\\"]' THEN 1 ELSE 0 END",
    "in_url": "CASE WHEN {b} RLIKE '://[^ /:@]*:$' AND {a} RLIKE '^@' THEN 1 ELSE 0 END",
    "called": "CASE WHEN {a} RLIKE '^[(\\\\[.]' THEN 1 ELSE 0 END",
}


def _features(v: str, b: str, a: str, p: str) -> dict[str, str]:
    return {name: "CAST(coalesce(" + sql.format(v=v, b=b, a=a, p=p) + ", 0) AS DOUBLE)" for name, sql in FEATURES.items()}


def labelled_findings(spark: SparkSession, n: int = FINDINGS, first: int = 0) -> DataFrame:
    """Built-in labelled findings: value, before, after, path, label (1: a secret), made from the numbers from `first` on.

    Values are digests of the row number in the alphabets of real credentials; false positives are
    commit and file digests, identifiers, placeholders, long words, rulers, calls and test data.
    """
    rows = spark.range(first, first + n, 1, 4).selectExpr(
        "id % 26 AS kind",
        "sha1(CAST(id AS STRING)) AS h40",
        "sha2(CAST(id AS STRING), 256) AS h64",
        "md5(CAST(id AS STRING)) AS h32",
        "translate(base64(unhex(sha2(concat('b', id), 512))), '+/=\r\n', 'aQ') AS b62",
        "base64(unhex(sha2(concat('c', id), 256))) AS b64",
        "element_at(split('src/config/settings.py,app/main.go,deploy/prod.env,src0,web/index.js,notes.md', ','), CAST(1 + pmod(xxhash64(id), 6) AS INT)) AS plain_path",
        "element_at(split('tests/fixtures/keys.py,docs/example.md,examples/config.yml', ','), CAST(1 + pmod(xxhash64(id, 1), 3) AS INT)) AS test_path",
        "element_at(split('token,secret,api_key,password,access_key,credential,auth token,private_key', ','), CAST(1 + pmod(xxhash64(id, 2), 8) AS INT)) AS word",
        "element_at(array(' = \"', ': \"', '=', ' = ', \": '\", '=\"'), CAST(1 + pmod(xxhash64(id, 3), 6) AS INT)) AS op",
        "element_at(split('the value of,and then,de la,und die,see also,in order to,', ','), CAST(1 + pmod(xxhash64(id, 4), 7) AS INT)) AS prose",
        "array_join(transform(sequence(1, CAST(4 + pmod(xxhash64(id, 5), 6) AS INT)), i -> element_at(split('tion,the,ing,er,and,ver,ent,ha,re,ti,on,ou,st,ich,eau,que,men,ado', ','), CAST(1 + pmod(xxhash64(id, i), 18) AS INT))), '') AS wordy",
        "array_join(transform(sequence(1, CAST(2 + pmod(xxhash64(id, 6), 4) AS INT)), i -> element_at(split('user,config,token,secret,service,request,module,value,default,client,session,path', ','), CAST(1 + pmod(xxhash64(id, i + 20), 12) AS INT))), '_') AS snake",
        "CAST(pmod(xxhash64(id, 7), 30) AS INT) AS r",
    )
    given = "concat(prose, ' ', word, op)"
    quote = "CASE WHEN op RLIKE '\"$' THEN '\" ' WHEN op RLIKE '\\'$' THEN '\\' ' ELSE ' ' END"
    cases = [  # value, before, after, path, label
        ("h40", given, quote, "plain_path", 1),
        ("substr(b62, 1, 24 + r)", given, quote, "plain_path", 1),
        ("h64", given, quote, "plain_path", 1),
        ("concat('AKIA', upper(translate(substr(h40, 1, 16), '018', 'XYZ')))", "concat(prose, ' ')", "' '", "plain_path", 1),
        ("concat('ghp_', substr(b62, 1, 36))", "concat(prose, ' ')", "' '", "plain_path", 1),
        ("concat(substr(b62, 1, 5 + r % 4), '!', substr(b62, 20, 4), '#', r)", "concat(prose, ' password', op)", quote, "plain_path", 1),
        ("b64", "concat(prose, ' Authorization: Bearer ')", "' '", "plain_path", 1),
        ("h32", given, quote, "plain_path", 1),
        ("substr(b62, 1, 32 + r)", "concat(word, ' ', prose, ' ')", "' '", "plain_path", 1),
        ("h40", "concat(prose, ' commit ')", "' '", "plain_path", 0),
        ("CASE WHEN r < 15 THEN h64 ELSE h32 END", "concat(prose, CASE WHEN r % 2 = 0 THEN ' sha256:' ELSE ' checksum ' END)", "' '", "plain_path", 0),
        ("concat_ws('-', substr(h32, 1, 8), substr(h32, 9, 4), substr(h32, 13, 4), substr(h32, 17, 4), substr(h32, 21, 12))", "concat(prose, CASE WHEN r % 2 = 0 THEN ' id=' ELSE ' uuid ' END)", "' '", "plain_path", 0),
        ("element_at(array('your_api_token_here', 'changeme12345678', 'xxxxxxxxxxxxxxxxxxxxxxxx', 'EXAMPLEKEYEXAMPLEKEY', 'insert-your-secret-here', '****************', 'sample_password_1234567', 'placeholder-token-value'), CAST(1 + r % 8 AS INT))", given, quote, "plain_path", 0),
        ("wordy", "concat(prose, ' ')", "' '", "plain_path", 0),
        ("CASE WHEN r % 4 = 3 THEN translate(snake, '_', '.') WHEN r % 4 = 1 THEN concat_ws('.', substr(wordy, 1, 2 + r % 6), substr(wordy, 3, 7), element_at(array('get', 'load', 'value', 'read'), 1 + r % 3)) ELSE snake END", "CASE WHEN r % 2 = 0 THEN concat(prose, ' ') ELSE concat(word, op) END", "CASE WHEN r % 3 = 0 THEN '(' WHEN r % 3 = 1 THEN '[' ELSE ' ' END", "plain_path", 0),
        ("repeat(element_at(array('=', '-', '_', '/', '0', '+='), CAST(1 + r % 6 AS INT)), 20 + r)", "concat(prose, ' ')", "' '", "plain_path", 0),
        ("concat_ws('/', 'src', snake, wordy, 'index')", "concat(prose, ' ')", "' '", "plain_path", 0),
        ("CASE WHEN r < 20 THEN h40 ELSE substr(b62, 1, 40) END", given, quote, "test_path", 0),
        ("concat(wordy, 'ing')", "concat(word, ' ', prose, ': ')", "' '", "plain_path", 0),
        ("concat(conv(substr(h40, 1, 12), 16, 10), conv(substr(h40, 13, 12), 16, 10))", "concat(prose, ' version ')", "' '", "plain_path", 0),
        ("substr(b62, 1, 8 + r % 12)", "concat(prose, CASE WHEN r % 2 = 0 THEN ' postgres://admin:' ELSE ' https://user:' END)", "'@db.host/x'", "plain_path", 1),
        ("concat(substr(b62, 1, 6 + r % 8), r)", "concat(prose, CASE WHEN r % 2 = 0 THEN ' password is ' ELSE ' the token was ' END)", "' '", "plain_path", 1),
        ("concat(substr(b62, 1, 8 + r % 12), r)", "concat(prose, CASE WHEN r % 2 = 0 THEN ' Authorization: Bearer ' ELSE ' Bearer ' END)", "' '", "plain_path", 1),
        ("CASE WHEN r % 3 = 0 THEN concat('ghp_', substr(b62, 1, 36)) WHEN r % 3 = 1 THEN substr(b62, 1, 10 + r) ELSE concat(wordy, r, substr(b62, 1, 4)) END", "concat(prose, ' export ', element_at(split('DB_,GITHUB_,AWS_,MY_APP_', ','), 1 + r % 4), upper(replace(word, ' ', '_')), CASE WHEN r % 2 = 0 THEN '=' ELSE ' = \"' END)", "CASE WHEN r % 2 = 0 THEN ' ' ELSE '\" ' END", "plain_path", 1),
        ("element_at(split('password,changeme,your_password,placeholder,example,secret_here', ','), 1 + r % 6)", "concat(prose, ' postgres://user:')", "'@localhost/x'", "plain_path", 0),
        ("concat(snake, '_', r % 3)", "concat(prose, CASE WHEN r % 2 = 0 THEN ' Bearer ' ELSE ' token is ' END)", "' '", "plain_path", 0),
    ]

    def pick(i: int) -> str:
        return "CASE kind " + " ".join(f"WHEN {k} THEN {case[i]}" for k, case in enumerate(cases)) + " END"

    return rows.selectExpr(f"{pick(0)} AS value", f"{pick(1)} AS before", f"{pick(2)} AS after", f"{pick(3)} AS path", f"{pick(4)} AS label")


def train_model(findings: DataFrame, trees: int = 40, depth: int = 7, seed: int = 13):
    """The random forest of Spark ML from labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    sql = _features("value", "before", "after", "path")
    rows = findings.where("length(value) > 0 AND label IN (0, 1)").selectExpr(*(f"{e} AS {n}" for n, e in sql.items()), "CAST(label AS DOUBLE) AS label")
    if len(rows.select("label").distinct().take(2)) < 2:
        raise ValueError("labelled findings of both kinds are needed")
    ready = VectorAssembler(inputCols=list(sql), outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3).fit(ready)


def train(findings: DataFrame, trees: int = 40, depth: int = 7, seed: int = 13) -> list[str]:
    """A random forest on labelled findings, each tree as SQL over the features of a struct `f`."""
    return [_tree_sql(tree.toDebugString) for tree in train_model(findings, trees, depth, seed).trees]


def _tree_sql(printed: str) -> str:
    """The printed form of a tree as nested CASE expressions."""
    names = list(FEATURES)
    lines = [line.strip() for line in printed.splitlines()[1:] if line.strip()]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if leaf := re.match(r"Predict: ([\d.]+)", line):
            return leaf[1]
        feature, limit = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
        low = node()
        at += 1  # the line of Else
        return f"CASE WHEN f.{names[int(feature)]} <= {float(limit)!r}D THEN {low} ELSE {node()} END"

    return node()


def _judged(docs: DataFrame, forest: list[str], path_col: str | None, text_col: str) -> DataFrame:
    """`docs` with `_pieces`, the text between candidates, and `_found`, the candidates with their scores."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.withColumn("_any", text.rlike(CANDIDATE)).withColumn("_path", path)
    cut = cut.withColumn("_pieces", F.when(F.col("_any"), F.split(text, CANDIDATE, -1)).otherwise(F.array(text)))
    cut = cut.withColumn("_whole", F.when(F.col("_any"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    # pieces and candidates in turn; a candidate has 8 characters or nearly so, so a few neighbours fill the context
    cut = cut.withColumn("_all", F.flatten(F.zip_with("_pieces", F.concat("_whole", F.array(F.lit(""))), lambda p, w: F.array(p, w))))
    lead = "regexp_extract(w, r'" + _LEAD.replace("'", "\\x27") + "', 0)"
    raw = cut.withColumn(
        "_found",
        F.expr(
            f"""transform(_whole, (w, i) -> named_struct(
                'lead', {lead},
                'value', substr(w, 1 + length({lead})),
                'before', concat(right(array_join(transform(slice(_all, greatest(1, 2 * i - 11), least(2 * i + 1, 13)), x -> right(x, {AROUND})), ''), {AROUND}), {lead}),
                'after', left(array_join(transform(slice(_all, 2 * i + 3, 13), x -> left(x, {AROUND})), ''), {AROUND}),
                'gap', length(_pieces[i])))"""
        ),
    )
    features = ", ".join(f"'{n}', {e}" for n, e in _features("v", "c.before", "c.after", "_path").items())
    votes = " + ".join(f"({tree})" for tree in forest)
    windows = f"transform(sequence(1, length(c.value), {STEP}), i -> substr(c.value, i, {WINDOW}))"
    keys = f"regexp_extract_all(c.value, '(?:{_ISSUERS})[A-Za-z0-9_+/=-]{{16,64}}', 0)"
    parts = f"CASE WHEN length(c.value) <= {LONG} OR c.value LIKE '-----BEGIN%' THEN array(c.value) ELSE concat(array(c.value), filter({windows}, w -> length(w) > {STEP}), {keys}) END"
    raw = raw.withColumn("_seen", F.expr(f"transform(_found, c -> named_struct('c', c, 'f', transform({parts}, v -> named_struct({features}))))"))
    scored = f"transform(transform(_seen, s -> named_struct('c', s.c, 'score', array_max(transform(s.f, f -> CAST(({votes}) / {len(forest)} AS DOUBLE))))), s -> named_struct('lead', s.c.lead, 'value', s.c.value, 'gap', s.c.gap, 'score', s.score))"
    return raw.withColumn("_found", F.expr(scored)).drop("_seen", "_whole", "_all", "_any", "_path")


def scan(docs: DataFrame, forest: list[str], threshold: float = THRESHOLD, path_col: str | None = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id, n (from 0 in its text), start (in characters, from 0), value, score, is_secret.

    Candidates below the threshold are the false positives; they are kept and marked.  A value is
    judged as a whole, and a long one by all of its windows as well, of which the most telling one
    counts; texts and values of any length are taken whole.  Null and empty texts have no candidates;
    repeated rows give repeated findings; null ids and null paths are
    allowed; other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), (docs[path_col] if path_col else F.lit("")).alias("_source"))
    found = _judged(own, forest, "_source", "_text").withColumn("_row", F.monotonically_increasing_id())
    each = found.where(F.size("_found") > 0).select("_row", "_id", F.posexplode("_found").alias("n", "c"))
    passed = F.sum(F.col("c.gap") + F.length("c.lead") + F.length("c.value")).over(Window.partitionBy("_row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return each.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n"),
        (passed - F.length("c.value")).alias("start"),
        F.col("c.value").alias("value"),
        F.col("c.score").alias("score"),
        (F.col("c.score") >= threshold).alias("is_secret"),
    )


def redact(docs: DataFrame, forest: list[str], threshold: float = THRESHOLD, path_col: str | None = "source", text_col: str = "text", mask: str = MASK) -> DataFrame:
    """The rows and columns of `docs` with each secret's value replaced by `mask`.

    Texts without a secret stay as they are, nulls included.  Column names that start with an
    underscore are left to the caller except _pieces, _found, _seen, _whole, _all, _any and _path.
    """
    judged = _judged(docs, forest, path_col, text_col)
    kept: Column = F.expr(f"transform(_found, s -> concat(s.lead, CASE WHEN s.score >= {threshold}D THEN '{mask}' ELSE s.value END))")
    joined = F.array_join(F.flatten(F.zip_with("_pieces", F.concat(kept, F.array(F.lit(""))), lambda p, k: F.array(p, k))), "")
    changed = F.exists("_found", lambda s: s["score"] >= threshold)
    return judged.withColumn(text_col, F.when(changed, joined).otherwise(F.col(text_col))).select(*docs.columns)
