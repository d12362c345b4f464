"""Module alignment: choosing the subject table, matching noisy codes, repairing names.

Similarity runs in Python only on DISTINCT (code, code) pairs that share a document, and
the greedy assignment runs per student on at most one page row's worth of modules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarch.functions.numbers import decimal_avg_or_uncertain
from scholarch.functions.similarity import assign_remaining, code_similarity, repaired_names, sequence_ratio
from scholarch.functions.text import normalize_code, trim_ws
from scholarch.operators.grades import averages_match, count_modules, or_uncertain, typed_coefficient
from scholarch.operators.pages import PAGE_KEYS, conform_results

STOP_COUNT = 8  # fast mode; 10 in thorough mode
MIN_CODE_SCORE = 0.72
MIN_NAME_RATIO = 0.75


def subject_tables(pages: DataFrame, *more: Column) -> DataFrame:
    """Every page with its subjects' typed codes and coefficients (null: a page without a table), and further columns."""
    typed = F.transform("result.matieres", lambda m: F.struct(or_uncertain(m["abrev"]).alias("abrev"), typed_coefficient(m).alias("coef")))
    return conform_results(pages).select(*PAGE_KEYS, typed.alias("matieres"), *more)


def _trusted_tables(tables: DataFrame, stop: int) -> DataFrame:
    """Per document the page to trust, of `subject_tables`: one shuffle by document, no join."""
    doc = ["batch_id", "file_name"]
    n = count_modules(F.col("matieres"))
    w = Window.partitionBy(*doc).orderBy("page_number")
    ranked = tables.select(*PAGE_KEYS, "matieres", n.alias("n_modules"), F.row_number().over(w).alias("page_rank"))
    reached = F.col("n_modules") >= stop
    # pages without modules drop out through a null order
    merit = F.when(F.col("n_modules") > 0, F.struct((~reached).alias("later"), F.when(reached, F.lit(0)).otherwise(-F.col("n_modules")).alias("fewer")))
    rows = ranked.withColumn("merit", merit)
    page = F.struct("page_number", "n_modules", "matieres", "merit")
    first = F.min_by(page, F.when(F.col("merit").isNotNull(), F.struct("merit", "page_number"))).alias("first")
    # the second page is visited before all others, so it wins where no page is better
    second = F.max_by(page, F.when(F.col("merit").isNotNull() & (F.col("page_rank") == 2), F.col("page_rank"))).alias("second")
    best = F.when(F.col("second.merit") == F.col("first.merit"), F.col("second")).otherwise(F.col("first")).alias("best")
    return rows.groupBy(*doc).agg(first, second).filter("first is not null").select(*doc, best).select(*doc, "best.page_number", "best.n_modules", "best.matieres")


def select_module_table(pages: DataFrame, stop: int = STOP_COUNT) -> DataFrame:
    """Per document the subject table to trust.

    Pages are visited 2, 1, 3, 4, ... and the visit ends at the first page with at least
    `stop` modules; otherwise the fullest page (earliest visit on ties) wins.  A document
    without any module gives no row.
    """
    return _trusted_tables(subject_tables(pages), stop).select(*PAGE_KEYS, "n_modules")


def distinct_pair_scores(pairs: DataFrame, left: str, right: str, name: bool = False) -> DataFrame:
    """(left, right, score) for the distinct pairs only."""
    distinct = pairs.select(left, right).distinct()
    ratio = sequence_ratio(F.col(left), F.col(right))
    scored = distinct.withColumn("_ratio", ratio)
    score = F.col("_ratio") if name else code_similarity(F.col(left), F.col(right), F.col("_ratio"))
    return scored.select(left, right, score.alias("score"))


def best_fuzzy_code(candidates: DataFrame, keys: list[str], source: str, target: str, position: str) -> DataFrame:
    """Per key the most similar target code; the earliest position wins ties, score 0 gives none."""
    scores = distinct_pair_scores(candidates, source, target)
    return (
        candidates.join(scores, [source, target])
        .filter("score > 0")
        .groupBy(*keys, source)
        .agg(F.max_by(F.struct(target, "score"), F.struct("score", (-F.col(position)).alias("p"))).alias("b"))
        .select(*keys, source, f"b.{target}", "b.score")
    )


def _is_code(key: Column) -> Column:
    return ~key.isin("", "UNCERTAIN")


def exact_positions(codes: str, wanted: str) -> Column:
    """Per wanted code the position of the first module with that code, -1 if there is none."""
    return F.transform(
        wanted,
        lambda w: F.when(_is_code(w), (F.array_position(codes, w) - 1).cast("int")).otherwise(F.lit(-1)),
    )


def _with_keys(df: DataFrame, modules: str, expected: str) -> DataFrame:
    usable = F.filter(expected, lambda c: normalize_code(c) != "")
    return df.withColumn(expected, usable).withColumns(
        {
            "_codes": F.transform(modules, lambda m: normalize_code(m["code"])),
            "_wanted": F.transform(expected, normalize_code),
        }
    )


def _zipped(expected: str, positions: Column) -> Column:
    return F.transform(
        F.arrays_zip(F.col(expected).alias("code"), positions.alias("source_pos")),
        lambda x, i: F.struct(i.alias("epos"), x["code"].alias("code"), x["source_pos"].alias("source_pos")),
    )


def align_modules_exact(df: DataFrame, modules: str, expected: str, output: str = "aligned") -> DataFrame:
    """The exact phase alone: expected order, first module of the same code, -1 = missing."""
    base = _with_keys(df, modules, expected)
    return base.withColumn(output, _zipped(expected, exact_positions("_codes", "_wanted"))).drop("_codes", "_wanted")


def align_modules(df: DataFrame, modules: str, expected: str, output: str = "aligned") -> DataFrame:
    """Align each row's `modules` array with its `expected` code array, both in list order.

    Exact codes first (first module wins), then the remaining modules in order take the
    most similar remaining code with a score of at least 0.72 (earliest code on ties).
    Output array<struct(epos, code, source_pos)> in expected order; source_pos -1 = missing.
    Only the leftover step runs in Python, Arrow-batched; a row is one student of one page,
    so both lists are short and no grouping or shuffle is needed.
    """
    base = _with_keys(df, modules, expected).withColumn("_exact", exact_positions("_codes", "_wanted"))
    listed = F.transform("_codes", lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    rest = F.filter(listed, lambda x: _is_code(x["c"]) & ~F.array_contains("_exact", x["i"]))
    base = base.withColumn("_rest", rest)
    positions = assign_remaining(F.col("_wanted"), F.col("_exact"), F.col("_rest.i"), F.col("_rest.c"))
    return (
        base.withColumn("_positions", positions)
        .withColumn(output, _zipped(expected, F.col("_positions")))
        .drop("_codes", "_wanted", "_exact", "_rest", "_positions")
    )


def with_expected_modules(rows: DataFrame, tables: DataFrame, stop: int = STOP_COUNT) -> DataFrame:
    """Join each document's trusted subject table (of `subject_tables`): `expected` codes and `coefficients`.

    The table side has one row per document, so a document with very many student rows
    stays a plain skew-splittable equi-join.
    """
    doc = ["batch_id", "file_name"]
    chosen = _trusted_tables(tables, stop).select(*doc, F.col("matieres.abrev").alias("expected"), F.col("matieres.coef").alias("coefficients"))
    return rows.join(chosen, doc)


def coefficient_gate(note: Column, note_uncertain: Column, coef: Column, coef_uncertain: Column) -> Column:
    """Tri-state note: no known coefficient -> absent; coefficient but no note -> uncertain."""
    no_coef = coef.isNull() | coef_uncertain
    absent = note.isNull() & ~note_uncertain
    return F.struct(
        F.when(~no_coef, note).alias("value"),
        F.when(no_coef, F.lit(False)).otherwise(note_uncertain | absent).alias("uncertain"),
    )


def _rank_in_document(pages: DataFrame, keep: int, doc: list[str]) -> DataFrame:
    """The first `keep` pages of every document; the limit is applied before the shuffle."""
    w = Window.partitionBy(*doc).orderBy("page_number")
    return pages.withColumn("page_rank", F.row_number().over(w)).filter(F.col("page_rank") <= keep)


def propagate_section(singles: DataFrame) -> DataFrame:
    """Blank sections filled with the section of the document's first, else second, student page."""
    doc = ["batch_id", "file_name"]
    filled = trim_ws(F.col("section")) != ""
    chosen = (
        _rank_in_document(singles, 2, doc)
        .groupBy(*doc)
        .agg(F.min_by("section", F.when(filled, F.col("page_rank"))).alias("chosen"))
    )
    out = F.when(filled, F.col("section")).otherwise(F.coalesce("chosen", "section"))
    return singles.join(chosen, doc, "left").withColumn("section", out).drop("chosen")


def _names(modules: str) -> Column:
    cleaned = F.transform(modules, lambda m: F.upper(trim_ws(F.coalesce(m["name"], F.lit("")))))
    return F.filter(cleaned, lambda n: n != "")


def reference_module_names(singles: DataFrame) -> DataFrame:
    """Module names of the document's first, else second, page with names."""
    doc = ["batch_id", "file_name"]
    return (
        _rank_in_document(singles.select(*PAGE_KEYS, "modules"), 2, doc)
        .withColumn("names", _names("modules"))
        .filter(F.size("names") > 0)
        .groupBy(*doc)
        .agg(F.min_by(F.struct("names", "page_rank"), "page_rank").alias("r"))
        .select(*doc, F.col("r.names").alias("reference"), F.col("r.page_rank").alias("reference_page"))
    )


def flag_module_names(singles: DataFrame) -> DataFrame:
    """Add `modules_match_reference` (documents without any reference are left out)."""
    doc = ["batch_id", "file_name"]
    return singles.join(reference_module_names(singles), doc).withColumn("modules_match_reference", _names("modules") == F.col("reference"))


def repair_module_names(singles: DataFrame) -> DataFrame:
    """Names replaced by close reference names; pages that still differ are marked unsure.

    Same list length: position by position, ratio >= 0.75.  Other length: the closest
    reference name (ties: the larger name), ratio >= 0.75; a page with any hit counts as matched.
    """
    flagged = flag_module_names(singles)
    raw = F.transform("modules", lambda m: trim_ws(F.coalesce(m["name"], F.lit(""))))
    fixed = flagged.withColumn("fix", repaired_names(raw, F.col("reference")))
    n_fixed = F.col("fix.n_fixed")
    matched = F.col("modules_match_reference") | (n_fixed > 0)
    return (
        fixed.withColumn("names", F.col("fix.names"))
        .withColumn("n_fixed", n_fixed)
        .withColumn("modules_match_reference", matched)
        .withColumn("unsure", ~matched)
        .withColumn("unsure_fields", F.when(~matched, F.array(F.lit("modules"))))
        .drop("fix")
    )


def score_student_payload(pages: DataFrame, expected: Column) -> DataFrame:
    """Heuristic quality of one reading of a page; `expected` = array of normalised codes."""
    n_expected = F.size(expected)

    def of_student(s: Column) -> Column:
        codes = F.array_distinct(F.filter(F.transform(s["modules"], lambda m: normalize_code(m["code"])), lambda c: c != ""))
        matched = F.coalesce(F.size(F.array_intersect(codes, expected)), F.lit(0))
        listed = F.coalesce(F.size(s["modules"]), F.lit(0))
        modules = F.when(n_expected > 0, matched * 4 - F.abs(listed - n_expected) * 2).otherwise(0)
        v1, v2, va = (decimal_avg_or_uncertain(s["moyenne"][n])["value"] for n in ("S1", "S2", "annuel"))
        given = sum((v.isNotNull().cast("int") for v in (v1, v2, va)), F.lit(0))
        consistency = F.coalesce(F.when(averages_match(v1, v2, va), 3).when(v1.isNotNull() & v2.isNotNull() & va.isNotNull(), -1), F.lit(0))
        return modules + given + consistency + 6

    r = F.col("result")
    students = F.coalesce(F.aggregate(F.transform(r["students"], of_student), F.lit(0), lambda acc, x: acc + x), F.lit(0))
    headers = sum((F.coalesce(r[n] != "", F.lit(False)).cast("int") for n in ("anneeEtude", "section", "option")), F.lit(0))
    failure = F.when(r["error"] != "", 3).otherwise(0)
    return conform_results(pages).withColumn("score", F.when(r.isNull(), -1).otherwise(students + headers - failure))


def best_attempt_per_page(attempts: DataFrame, keys: list[str], stop_score: float | None = None) -> DataFrame:
    """Among readings of one page the best score, earliest on ties.

    With `stop_score` the readings after the first one that reaches it are not considered.
    An aggregate with map-side combine, so many readings of one page do not meet in one task.
    """
    order = F.struct(F.col("score"), (-F.col("attempt")).alias("earlier"))
    if stop_score is not None:
        reached = F.col("score") >= stop_score
        order = F.struct(
            reached.alias("reached"),
            F.when(reached, -F.col("attempt")).alias("first_reached"),
            F.col("score"),
            (-F.col("attempt")).alias("earlier"),
        )
    rest = [c for c in attempts.columns if c not in keys]
    return (
        attempts.filter("score > -1")
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("best"))
        .select(*keys, "best.*")
    )
