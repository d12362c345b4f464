"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarch.llm import bpe_codec, decontaminate, neighbours, periodic_runs, preferences, quality, secrets, simhash, token_counts, toxicity, url_rules, vector_links, whitening
from scholarch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


@query("op4_token_counts")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), vocabulary_path())


@query("op5_simhash")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


CONTAMINATION_SQL = r"""
WITH folded AS (
    SELECT item_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, 'item' AS side FROM benchmark
    UNION ALL
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'doc' FROM documents
),
worded AS (SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM folded),
sized AS (SELECT *, len(words) AS n FROM worded),
grams AS (
    SELECT DISTINCT id AS item_id, least(n, 10) AS size, array_to_string(words[i:i + least(n, 10) - 1], ' ') AS gram
    FROM (SELECT id, words, n, unnest(range(1, n - least(n, 10) + 2)) AS i FROM sized WHERE side = 'item' AND n > 0)
),
spots AS (
    SELECT id, i, size, array_to_string(words[i:i + size - 1], ' ') AS gram
    FROM (
        SELECT id, words, size, unnest(range(1, n - size + 2)) AS i
        FROM sized, (SELECT DISTINCT size FROM grams) WHERE side = 'doc' AND n >= size
    )
),
found AS (SELECT s.id, s.i, s.size, g.item_id FROM spots s JOIN grams g USING (size, gram)),
hits AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS k FROM found) GROUP BY id),
items AS (
    SELECT id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT id, item_id::VARCHAR AS name FROM found) GROUP BY id
)
SELECT d.id AS doc_id, d.n::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM sized d LEFT JOIN hits h ON h.id = d.id LEFT JOIN items i ON i.id = d.id
WHERE d.side = 'doc'
"""

URL_RULES = (
    url_rules.parse_rule("org/", "allow"),
    url_rules.parse_rule("example.org/es/", "block"),
    url_rules.parse_rule("example.org/en/1", "block"),
    url_rules.parse_rule("com/fr/", "allow"),
    url_rules.parse_rule("com/de/", "block"),
)

URL_RULES_SQL = r"""
WITH rules (rhost, rpath, rverdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
),
parsed AS (
    SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages
),
split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parsed
),
judged AS (
    SELECT page_id, host, path,
           (SELECT max_by({'rule': rhost || rpath, 'verdict': rverdict}, length(rhost || rpath))
            FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best
    FROM split
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""


@query("op1_secrets")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"), secrets.train(secrets.labelled_findings(spark)))


@query("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


PREFERENCES_SQL = r"""
WITH own AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
answers AS (SELECT pair_id, turn, coalesce(text, '') AS text FROM own WHERE role = 'assistant' AND turn IS NOT NULL),
lasts AS (SELECT pair_id, max(turn) AS last FROM answers GROUP BY pair_id),
firsts AS (SELECT pair_id, text FROM answers QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn, text) = 1),
sided AS (
    SELECT *, 0 AS side FROM own
    UNION ALL SELECT own.*, 1 FROM own LEFT JOIN lasts USING (pair_id) WHERE last IS NULL OR turn IS NULL OR turn < last
    UNION ALL SELECT l.pair_id, l.last, 'assistant', f.text, 1 FROM lasts l JOIN firsts f ON f.pair_id = xor(l.pair_id, 1)
),
turns AS (SELECT pair_id, side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM sided),
rendered AS (
    SELECT *, '<|' || role || '|>' || chr(10) AS head, replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS body FROM turns
),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS i FROM rendered
),
sizes AS (
    SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM numbered GROUP BY pair_id
),
apart AS (
    SELECT c.pair_id, min(c.i) AS at FROM numbered c JOIN numbered r ON r.pair_id = c.pair_id AND r.i = c.i AND c.side = 0 AND r.side = 1
    WHERE c.role <> r.role OR c.text <> r.text GROUP BY c.pair_id
),
prefixes AS (SELECT s.*, coalesce(a.at - 1, least(nc, nr)) AS n FROM sizes s LEFT JOIN apart a USING (pair_id)),
parts AS (
    SELECT pair_id,
           string_agg(head || body, '' ORDER BY i) FILTER (side = 0 AND i <= n) AS prompt,
           string_agg(head || body, '' ORDER BY i) FILTER (side = 0 AND i > n) AS chosen,
           string_agg(head || body, '' ORDER BY i) FILTER (side = 1 AND i > n) AS rejected,
           string_agg('0:' || length(head) || ',' || (role = 'assistant')::INT || ':' || length(body), ',' ORDER BY i) FILTER (side = 0 AND i > n) AS chosen_mask,
           string_agg('0:' || length(head) || ',' || (role = 'assistant')::INT || ':' || length(body), ',' ORDER BY i) FILTER (side = 1 AND i > n) AS rejected_mask
    FROM numbered JOIN prefixes USING (pair_id) GROUP BY pair_id
)
SELECT pair_id, n::INT AS n_prefix, coalesce(prompt, '') AS prompt,
       CASE WHEN nc > 0 THEN coalesce(chosen, '') END AS chosen, CASE WHEN nr > 0 THEN coalesce(rejected, '') END AS rejected,
       CASE WHEN nc > 0 THEN coalesce(chosen_mask, '') END AS chosen_mask, CASE WHEN nr > 0 THEN coalesce(rejected_mask, '') END AS rejected_mask,
       CASE WHEN nc = 0 OR nr = 0 THEN 'single' WHEN nc = n AND nr = n THEN 'identical' WHEN nc = n OR nr = n THEN 'continued' ELSE 'pair' END AS status
FROM prefixes JOIN parts USING (pair_id)
"""


@query("op3_preferences", PREFERENCES_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pairs = preferences.format_preferences(preferences.answered_otherwise(table(spark, folder, "conversations")))
    masks = {c: preferences.mask_text(pairs[c]) for c in ("chosen_mask", "rejected_mask")}
    return pairs.withColumns(masks)


@query("op8_neighbours")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"))


@query("op6_decontamination", CONTAMINATION_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_url_rules", URL_RULES_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judge(table(spark, folder, "pages"), rules)


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_bpe_codec")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_codec.encode(table(spark, folder, "documents"), vocabulary_path(), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """`deviation` is a long here: null where the exact number does not fit."""
    rows = whitening.whiten(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query("op12_vector_links")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return vector_links.near_duplicates(table(spark, folder, "embeddings"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic_runs.with_planted_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return periodic_runs.report(periodic_runs.collapse(docs))
