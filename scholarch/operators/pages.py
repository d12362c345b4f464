"""Page documents: reading, flattening, unified student rows, module lists and edit grids.

A page is a bounded document, so everything about one page is computed inside its row with
higher-order functions; only whole-document merges shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from scholarch.functions.labels import KNOWN_MODULE_CODES, is_generic_label, module_coefficient, module_label, page_specialty
from scholarch.functions.numbers import decimal_comma_or_null, finite_or_null, format_academic
from scholarch.functions.text import first_non_empty, normalize_code, split_name, trim_ws
from scholarch.schemas import PAGE_RESULT, STUDENT

PAGE_KEYS = ["batch_id", "file_name", "page_number"]


def conform(col: Column, source: DataType, target: DataType) -> Column:
    """The column reshaped to `target`: missing struct fields become nulls, extra ones vanish."""
    if source == target:
        return col
    if isinstance(target, StructType) and isinstance(source, StructType):
        have = {f.name: f.dataType for f in source.fields}
        fields = [
            (conform(col[f.name], have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in target.fields
        ]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(target, ArrayType) and isinstance(source, ArrayType):
        return F.transform(col, lambda e: conform(e, source.elementType, target.elementType))
    return col.cast(target)


def read_page_results(df: DataFrame, text: str, output: str = "result") -> DataFrame:
    """Parse page JSON text into the superset struct; older key spellings are accepted."""
    json, raw = F.col(text), F.col(text)
    for pattern, name in (
        ('"module"\\s*:\\s*\\[', '"modules":['),
        ('_80%"\\s*:', '_80pct":'),
        ('"moyennePrommo"\\s*:', '"moyennePromotion":'),
        ('"single student"', '"single_student"'),
    ):
        json = F.regexp_replace(json, pattern, name)
    # most texts hold none of the older spellings, and a search for plain words is cheaper than four patterns
    older = reduce(Column.__or__, [F.contains(raw, F.lit(word)) for word in ('"module"', '_80%"', '"moyennePrommo"', '"single student"')])
    json = F.when(older, json).otherwise(raw)
    parsed = F.from_json(json, PAGE_RESULT, {"mode": "PERMISSIVE"})
    # a generator is a barrier for filters: without it every later filter on the result would
    # be pushed below this projection together with a second parse of the text
    return df.select("*", F.explode_outer(F.array(parsed)).alias(output))


def conform_results(pages: DataFrame, column: str = "result") -> DataFrame:
    return pages.withColumn(column, conform(F.col(column), pages.schema[column].dataType, PAGE_RESULT))


def unnest(df: DataFrame, array: str | Column, *keys: str | Column, pos: str = "pos", item: str = "m") -> DataFrame:
    """One row per element of a computed array, with its position.

    The outer form is used and empty arrays dropped afterwards: for the plain form the
    optimizer infers a size filter and pushes a copy of the whole array expression below
    the projection, so that costly arrays would be computed twice.
    """
    return df.select(*keys, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def flatten_pages(records: DataFrame, *keys: str) -> DataFrame:
    """One row per page (records without pages keep one null row); the page number orders them."""
    return records.select(*keys, F.explode_outer("pages").alias("page")).select(*keys, "page.*")


def _module_lists(r: Column) -> Column:
    """array<array<module>>: the module lists of the unified rows of one page, null where it has no such rows."""
    theirs = F.transform(r["students"], lambda s: s["modules"])
    none = F.filter(theirs, lambda m: F.lit(False))
    return F.when(r["type"] == "single_student", F.array(r["modules"])).when(r["type"] == "multiple_students", theirs).when(r["type"] == "resultats_annonce", none)


def _raw_students(r: Column) -> Column:
    """The page's own students behind its unified rows; a null one stands for the single student."""
    nobody = F.array(F.lit(None).cast(STUDENT))
    return F.when(r["type"] == "single_student", nobody).when(r["type"].isin("multiple_students", "resultats_annonce"), r["students"])


def _unified(type_: Column, own: Column, s: Column, strict: bool) -> list[Column]:
    """Columns of the unified row of a student `s`; `own` holds what a single student's page says of it.

    They are plain columns of a row per student, so that a consumer pays for those it reads only.
    """
    single, announced = type_ == "single_student", type_ == "resultats_annonce"
    st, summary = own["student"], own["summary"]
    name = split_name(st["name"])
    none = F.lit(None).cast("string")

    def by_type(one: Column, several: Column, listed: Column) -> Column:
        return F.when(single, one).when(announced, listed).otherwise(several)

    def from_summary(field: str) -> Column:
        return first_non_empty(st[field], summary[field]) if strict else first_non_empty(st[field])

    def number(name: str, field: str, given: Column) -> Column:
        return finite_or_null(by_type(from_summary(field), first_non_empty(given), none)).alias(name)

    plain = F.nullif(s["decision"], F.lit(""))
    averages = zip(("avg_s1", "avg_s2", "annual_avg"), ("semestre1_moyenne", "semestre2_moyenne", "general_moyenne"), ("S1", "S2", "annuel"))
    ranks = zip(("rank_s1", "rank_s2", "annual_rank"), ("semestre1_rang", "semestre2_rang", "general_rang"), ("S1", "S2", "annuel"))
    return [
        F.coalesce(F.when(single, name["nom"]).otherwise(s["nom"]), F.lit("")).alias("nom"),
        F.coalesce(F.when(single, name["prenom"]).otherwise(s["prenom"]), F.lit("")).alias("prenom"),
        F.nullif(by_type(st["matricule"], s["matricule"], none), F.lit("")).alias("matricule"),
        by_type(own["modules"], s["modules"], F.filter(s["modules"], lambda m: F.lit(False))).alias("modules"),
        by_type(
            first_non_empty(st["decisionFinaleDuConseil"], st["decisionDeJuin"], summary["observation"]),
            first_non_empty(s["decisionFinaleDuConseil"], s["decisionDeJuin"], s["decision"]),
            plain,
        ).alias("decision"),
        *[number(n, field, s["moyenne"][given]) for n, field, given in averages],
        *[number(n, field, s["rang"][given]) for n, field, given in ranks],
        by_type(first_non_empty(st["decisionDeJuin"], summary["observation"]), first_non_empty(s["decisionDeJuin"], s["decision"]), plain).alias("decision_june"),
        by_type(first_non_empty(st["decisionFinaleDuConseil"], summary["observation"]), first_non_empty(s["decisionFinaleDuConseil"], s["decision"]), plain).alias("final_decision"),
        by_type(first_non_empty(st["noteDeStage"]), first_non_empty(s["noteDeStage"]), none).alias("stage"),
        by_type(first_non_empty(st["diploma"]), first_non_empty(s["diploma"]), none).alias("diploma"),
    ]


def _student_rows(pages: DataFrame, strict: bool, *keys: str) -> DataFrame:
    """One row per student of conformed pages, in page order: keys, `student_index` and the unified columns."""
    r = F.col("result")
    own = F.when(r["type"] == "single_student", F.struct(r["student"].alias("student"), r["summary"].alias("summary"), r["modules"].alias("modules")))
    rows = unnest(pages, _raw_students(r), *keys, r["type"].alias("_type"), own.alias("_own"), pos="student_index", item="_s")
    return rows.select(*keys, "student_index", *_unified(F.col("_type"), F.col("_own"), F.col("_s"), strict))


def parse_students(pages: DataFrame, strict: bool = False, *extra: str) -> DataFrame:
    """One row per student of a page, in page order (`student_index`).

    `strict` also reads the semester summary of single-student pages.
    """
    return _student_rows(conform_results(pages), strict, *PAGE_KEYS, *extra)


def parse_matieres(pages: DataFrame) -> DataFrame:
    m = F.col("m")
    return (
        unnest(conform_results(pages), "result.matieres", *PAGE_KEYS)
        .select(
            *PAGE_KEYS,
            "pos",
            F.coalesce(m["abrev"], F.lit("")).alias("abrev"),
            F.coalesce(m["libelle"], F.lit("")).alias("libelle"),
            m["coef"]["S1"].alias("coef_s1"),
            m["coef"]["S2"].alias("coef_s2"),
            *[m["moyenne"][n].alias(f"moy_{n.lower()}") for n in ("S1", "S1_80pct", "S2", "S2_80pct", "annuel", "annuel_80pct")],
        )
    )


def module_cell(m: Column) -> Column:
    """struct(code, s1, s2) of a module in either spelling of its keys."""
    code = F.coalesce(F.nullif(m["code"], F.lit("")), F.nullif(m["name"], F.lit("")), F.lit(""))
    return F.struct(
        code.alias("code"),
        F.coalesce(m["noteS1"], m["note_s1"]).alias("s1"),
        F.coalesce(m["noteS2"], m["note_s2"]).alias("s2"),
    )


def flatten_modules(students: DataFrame, *keys: str) -> DataFrame:
    return unnest(students, F.transform("modules", module_cell), *keys).select(*keys, "pos", "m.*")


def _sequences(r: Column) -> Column:
    """Module lists of a page: the page's own list first, then each student's non-empty one."""
    own = F.filter(F.array(r["modules"]), lambda a: a.isNotNull())
    theirs = F.filter(_module_lists(r), lambda a: F.size(a) > 0)
    return F.concat(own, F.coalesce(theirs, F.filter(own, lambda a: F.lit(False))))


def with_module_definitions(pages: DataFrame) -> DataFrame:
    """Add `module_defs`: per position the first usable label and coefficient over all lists."""
    base = conform_results(pages).withColumn("_seqs", _sequences(F.col("result")))
    width = F.coalesce(F.array_max(F.transform("_seqs", lambda s: F.size(s))), F.lit(0))

    def definition(i: Column) -> Column:
        mods = F.filter(F.transform("_seqs", lambda s: F.get(s, i)), lambda m: m.isNotNull())
        labels = F.transform(mods, lambda m: module_label(i, m["code"], m["name"], m["module"], m["libelle"]))
        coefs = F.transform(mods, lambda m: module_coefficient(m["coef"], m["coefficient"], m["credit"], m["credits"]))
        label = F.get(F.filter(labels, lambda x: x != ""), F.lit(0))
        return F.struct(
            F.coalesce(label, F.concat(F.lit("Module "), (i + 1).cast("string"))).alias("label"),
            F.get(F.filter(coefs, lambda x: x.isNotNull()), F.lit(0)).alias("coefficient"),
        )

    defs = F.transform(F.sequence(F.lit(1), width), lambda i: definition(i - 1))
    return base.withColumn("module_defs", F.when(width > 0, defs)).withColumn("module_count", width).drop("_seqs")


def module_definitions(pages: DataFrame) -> DataFrame:
    return (
        unnest(with_module_definitions(pages), "module_defs", *PAGE_KEYS, item="d")
        .select(*PAGE_KEYS, "pos", "d.*")
    )


def generic_module_count(pages: DataFrame) -> DataFrame:
    generic = F.size(F.filter("module_defs", lambda d: is_generic_label(d["label"])))
    return with_module_definitions(pages).select(*PAGE_KEYS, "module_count", F.coalesce(generic, F.lit(0)).alias("generic_count"))


def pad_modules(pages: DataFrame) -> DataFrame:
    """Student rows whose `modules` are cells padded with empty ones up to the page's count."""
    rows = _student_rows(with_module_definitions(pages), False, *PAGE_KEYS, "module_count")
    empty = F.struct(F.lit("").alias("code"), F.lit(None).cast("string").alias("s1"), F.lit(None).cast("string").alias("s2"))
    have = F.size("modules")
    cells = F.transform("modules", module_cell)
    fill = F.array_repeat(empty, F.greatest(F.col("module_count") - have, F.lit(0)))
    return rows.withColumn("modules", F.concat(cells, fill))


def average_of_cells(cells: Column, semester: str) -> Column:
    """Unweighted mean of the finite notes of one semester, null when there is none."""
    notes = F.filter(F.transform(cells, lambda m: finite_or_null(m[semester])), lambda x: x.isNotNull())
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    # one pass: total and count together, since every mention of `notes` reads all of them again
    return F.aggregate(
        notes,
        start,
        lambda acc, x: F.struct((acc["total"] + x).alias("total"), (acc["n"] + 1).alias("n")),
        lambda acc: F.when(acc["n"] > 0, acc["total"] / acc["n"]),
    )


def with_academic_summary(students: DataFrame) -> DataFrame:
    """Averages as given, else from the modules; annual as given, else mean of what exists."""
    s1 = F.coalesce("avg_s1", average_of_cells(F.col("modules"), "s1"))
    s2 = F.coalesce("avg_s2", average_of_cells(F.col("modules"), "s2"))
    return (
        students.withColumns({"avg_s1": s1, "avg_s2": s2})
        .withColumn("annual_avg", F.coalesce("annual_avg", (F.col("avg_s1") + F.col("avg_s2")) / 2, "avg_s1", "avg_s2"))
        .withColumns(
            {
                "decision_june": F.coalesce(first_non_empty(F.col("decision_june"), F.col("decision")), F.lit("")),
                "final_decision": F.coalesce(first_non_empty(F.col("final_decision"), F.col("decision")), F.lit("")),
                "stage": F.coalesce("stage", F.lit("")),
                "diploma": F.coalesce("diploma", F.lit("")),
            }
        )
    )


def student_grid(pages: DataFrame) -> DataFrame:
    """Two rows per student (S1, S2); `notes` holds one text per module of the page, in its order.

    The number of modules is the page's own, so nothing is cut off; no pivot, no shuffle.
    """
    rows = with_academic_summary(pad_modules(pages))
    sem = F.explode(F.array(F.lit("S1"), F.lit("S2"))).alias("sem")
    one = F.col("sem") == "S1"
    return rows.select("*", sem).select(
        *PAGE_KEYS,
        "student_index",
        "sem",
        "nom",
        "prenom",
        F.coalesce("matricule", F.lit("")).alias("matricule"),
        F.transform("modules", lambda m: F.coalesce(F.when(one, m["s1"]).otherwise(m["s2"]), F.lit(""))).alias("notes"),
        format_academic(F.when(one, F.col("avg_s1")).otherwise(F.col("avg_s2"))).alias("avg"),
        F.when(one, F.col("rank_s1")).otherwise(F.col("rank_s2")).alias("rank"),
        format_academic(F.col("annual_avg")).alias("annual_avg"),
        "annual_rank",
        "decision_june",
        format_academic(finite_or_null(F.col("stage"))).alias("stage"),
        "final_decision",
        "diploma",
    )


def grid_to_students(grid: DataFrame) -> DataFrame:
    """The inverse: two grid rows give one student with a map from module position to its notes.

    Both names are required.  A semester with fewer notes than the other has nulls there.
    """

    def of(sem: str, value: Column) -> Column:
        return F.max(F.when(F.col("sem") == sem, value))

    names = [of("S1", trim_ws(F.col(n))).alias(n) for n in ("nom", "prenom", "matricule")]
    folded = grid.groupBy(*PAGE_KEYS, "student_index").agg(*names, of("S1", F.col("notes")).alias("n1"), of("S2", F.col("notes")).alias("n2"))

    def typed(notes: str) -> Column:
        return F.transform(F.coalesce(notes, F.array().cast("array<string>")), lambda x: finite_or_null(trim_ws(x)))

    both = F.zip_with(typed("n1"), typed("n2"), lambda x, y: F.struct(x.alias("S1"), y.alias("S2")))
    return folded.filter("nom <> '' and prenom <> ''").select(
        *PAGE_KEYS,
        "student_index",
        "nom",
        "prenom",
        F.nullif("matricule", F.lit("")).alias("matricule"),
        F.map_from_entries(F.transform(both, lambda x, i: F.struct(i, x))).alias("modules"),
        F.lit(False).alias("is_first_year"),
    )


def grid_to_matieres(cells: DataFrame) -> DataFrame:
    """Edited subject cells to typed subjects; rows with neither code nor title are dropped."""
    numbers = [c for c in cells.columns if c.startswith(("coef_", "moy_"))]
    rest = [c for c in cells.columns if c not in numbers and c not in ("abrev", "libelle")]
    return cells.select(
        *rest,
        trim_ws(F.col("abrev")).alias("abrev"),
        trim_ws(F.col("libelle")).alias("libelle"),
        *[decimal_comma_or_null(trim_ws(F.col(c))).alias(c) for c in numbers],
    ).filter("abrev <> '' or libelle <> ''")


def merge_page_headers(pages: DataFrame) -> DataFrame:
    """Per document: first non-null headers in page order, student count, joined messages.

    Headers and counts are partial aggregates; only pages that carry a message are gathered,
    and a document is bounded by the upload size limit.
    """
    r = F.col("result")

    def first(name: str) -> Column:
        return F.min_by(r[name], F.when(r[name].isNotNull(), F.col("page_number"))).alias(name)

    def joined(name: str, sep: str) -> Column:
        held = F.when(r[name] != "", F.struct("page_number", r[name].alias("text")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(held)), lambda x: x["text"]), sep).alias(name)

    return (
        conform_results(pages)
        .groupBy("batch_id", "file_name")
        .agg(
            first("anneeEtude"),
            first("section"),
            first("option"),
            F.sum(F.coalesce(F.size("result.students"), F.lit(0))).alias("n_students"),
            joined("error", " | "),
            joined("markdown", "\n"),
        )
    )


def merged_students(pages: DataFrame) -> DataFrame:
    """All students of a document in page order, one row each (the merged list, unnested)."""
    return unnest(conform_results(pages), "result.students", *PAGE_KEYS, item="s").select(*PAGE_KEYS, "pos", "s.*")


def page_metadata(pages: DataFrame) -> DataFrame:
    r = F.col("result")
    return conform_results(pages).select(
        *PAGE_KEYS,
        F.coalesce(F.nullif(r["annee"], F.lit("")), F.lit("N/A")).alias("year"),
        F.coalesce(F.nullif(r["anneeEtude"], F.lit("")), F.lit("N/A")).alias("level"),
        F.coalesce(page_specialty(r["section"], r["option"], r["sectionCode"], r["type"]), F.lit("N/A")).alias("spec"),
    )


def split_non_module_columns(pages: DataFrame, known: list[str] = KNOWN_MODULE_CODES) -> DataFrame:
    """Known module codes stay in `modules`; other headers move to a map of raw values."""
    codes = F.array(*[F.lit(c) for c in known])

    def is_known(m: Column) -> Column:
        return F.coalesce(F.array_contains(codes, normalize_code(m["code"])), F.lit(False))

    rows = parse_students(pages).filter(F.size("modules") > 0)
    cells = F.transform("modules", module_cell)
    others = F.filter(cells, lambda m: ~is_known(m) & (m["code"] != ""))
    entries = F.transform(others, lambda m: F.struct(m["code"].alias("key"), F.coalesce(m["s1"], m["s2"]).alias("value")))
    distinct = F.map_from_entries(
        F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda p: p["key"] == e["key"]))
    )
    return rows.withColumn("autresChamps", distinct).withColumn("modules", F.filter(cells, is_known))


def page_type_counts(pages: DataFrame) -> DataFrame:
    """Per page type: pages, students, modules, generic labels and subjects found."""
    generic = F.coalesce(F.size(F.filter("module_defs", lambda d: is_generic_label(d["label"]))), F.lit(0))
    return (
        with_module_definitions(pages)
        .groupBy(F.coalesce("result.type", F.lit("unknown")).alias("type"))
        .agg(
            F.count("*").alias("pages"),
            F.sum(F.coalesce(F.size(_raw_students(F.col("result"))), F.lit(0))).alias("students"),
            F.sum("module_count").alias("modules"),
            F.sum(generic).alias("generic_labels"),
            F.sum(F.coalesce(F.size("result.matieres"), F.lit(0))).alias("matieres"),
        )
    )
