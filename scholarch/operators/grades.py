"""Grade cleaning and consistency rules on page documents, and averages in relational form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarch.functions.numbers import (
    coerce_number,
    coerce_rank,
    decimal_avg_or_uncertain,
    finite_or_null,
    natural_or_uncertain,
    number_or_uncertain,
    tri,
)
from scholarch.operators.pages import PAGE_KEYS, conform_results, unnest

TOLERANCE = 0.011


def averages_match(s1: Column, s2: Column, annual: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs((s1 + s2) / 2 - annual) <= tolerance


def fix_annual_average(s1: Column, s2: Column, annual: Column) -> Column:
    """Tri-state annual average: recomputed when both semesters are known and it is missing or off."""
    v1, v2, va = s1["value"], s2["value"], annual["value"]
    known = v1.isNotNull() & v2.isNotNull()
    keep = va.isNotNull() & averages_match(v1, v2, va)
    return F.when(known & ~F.coalesce(keep, F.lit(False)), tri(F.round((v1 + v2) / 2, 2), F.lit(False))).otherwise(annual)


def annual_rank_only(rang: Column) -> Column:
    absent = tri(F.lit(None), F.lit(False))
    return F.struct(absent.alias("S1"), absent.alias("S2"), natural_or_uncertain(rang["annuel"]).alias("annuel"))


def validate_page(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Add `valid`: a result exists and no top-level note lies outside 0-20.

    `strict` also checks the notes nested in multi-student pages.
    """

    def outside(x: Column) -> Column:
        return F.coalesce(~coerce_number(x).between(0, 20), F.lit(False))

    r = F.col("result")
    bad = F.coalesce(F.exists(r["modules"], lambda m: outside(m["note_s1"]) | outside(m["note_s2"])), F.lit(False))
    if strict:
        nested = F.exists(
            r["students"],
            lambda s: F.coalesce(F.exists(s["modules"], lambda m: outside(m["noteS1"]) | outside(m["noteS2"])), F.lit(False)),
        )
        bad = bad | F.coalesce(nested, F.lit(False))
    return conform_results(pages).withColumn("valid", r.isNotNull() & ~bad)


def postprocess_single(pages: DataFrame) -> DataFrame:
    """Typed module coefficients/notes and a typed summary; every page type gets a summary."""
    r, summary = F.col("result"), F.col("result.summary")
    modules = F.transform(
        r["modules"],
        lambda m: F.struct(
            m["code"].alias("code"),
            m["name"].alias("name"),
            *[coerce_number(m[f]).alias(f) for f in ("coef_s1", "coef_s2", "note_s1", "note_s2")],
        ),
    )
    typed = F.struct(
        *[coerce_number(summary[f]).alias(f) for f in ("semestre1_moyenne", "semestre2_moyenne", "general_moyenne")],
        *[coerce_rank(summary[f]).alias(f) for f in ("semestre1_rang", "semestre2_rang", "general_rang")],
        summary["observation"].alias("observation"),
    )
    return (
        conform_results(pages)
        .filter("result is not null")
        .select(*PAGE_KEYS, r["type"].alias("type"), modules.alias("modules"), typed.alias("summary"))
    )


def or_uncertain(col: Column) -> Column:
    return F.when(col == "", F.lit("uncertain")).otherwise(col)


def _typed_student(s: Column, enforce: bool) -> Column:
    m = s["moyenne"]
    avg = {n: decimal_avg_or_uncertain(m[n]) for n in ("S1", "S2", "annuel")}
    if enforce:
        avg["annuel"] = fix_annual_average(avg["S1"], avg["S2"], avg["annuel"])
        rang = annual_rank_only(s["rang"])
    else:
        rang = F.struct(*[natural_or_uncertain(s["rang"][n]).alias(n) for n in ("S1", "S2", "annuel")])
    return F.struct(
        or_uncertain(s["nom"]).alias("nom"),
        or_uncertain(s["prenom"]).alias("prenom"),
        F.nullif(s["matricule"], F.lit("")).alias("matricule"),
        F.coalesce(
            F.transform(
                s["modules"],
                lambda x: F.struct(
                    or_uncertain(x["code"]).alias("code"),
                    number_or_uncertain(x["noteS1"]).alias("noteS1"),
                    number_or_uncertain(x["noteS2"]).alias("noteS2"),
                ),
            ),
        ).alias("modules"),
        F.struct(*[avg[n].alias(n) for n in ("S1", "S2", "annuel")]).alias("moyenne"),
        rang.alias("rang"),
        s["decisionDeJuin"].alias("decisionDeJuin"),
        natural_or_uncertain(s["nbrAbs"]).alias("nbrAbs"),
        natural_or_uncertain(s["noteDeStage"]).alias("noteDeStage"),
        s["decisionFinaleDuConseil"].alias("decisionFinaleDuConseil"),
    )


def normalize_student_payload(pages: DataFrame, enforce: bool = False) -> DataFrame:
    """Typed copy of every student of a page: one row per page with a clean `students` array.

    `enforce` also applies the summary rules (annual average consistency, annual rank only).
    """
    r = F.col("result")
    return conform_results(pages).select(
        *PAGE_KEYS,
        *[r[n].alias(n) for n in ("anneeEtude", "section", "option", "error", "markdown")],
        F.transform(r["students"], lambda s: _typed_student(s, enforce)).alias("students"),
    )


def normalize_students(pages: DataFrame, enforce: bool = False) -> DataFrame:
    """The same students one row each (`pos`, `st`): fields that are not read are not typed."""
    rows = unnest(conform_results(pages), "result.students", *PAGE_KEYS, item="_s")
    return rows.select(*PAGE_KEYS, "pos", _typed_student(F.col("_s"), enforce).alias("st"))


def typed_coefficient(matiere: Column) -> Column:
    return F.struct(*[natural_or_uncertain(matiere["coef"][n]).alias(n) for n in ("S1", "S2")])


def normalize_module_table(pages: DataFrame) -> DataFrame:
    """Typed subject table of a page and the number of usable modules in it."""

    def six(m: Column) -> Column:
        return F.struct(*[number_or_uncertain(m[n]).alias(n) for n in ("S1", "S1_80pct", "S2", "S2_80pct", "annuel", "annuel_80pct")])

    r = F.col("result")
    rows = F.transform(
        r["matieres"],
        lambda m: F.struct(
            or_uncertain(m["abrev"]).alias("abrev"),
            or_uncertain(m["libelle"]).alias("libelle"),
            typed_coefficient(m).alias("coef"),
            six(m["moyenne"]).alias("moyenne"),
        ),
    )
    return (
        conform_results(pages)
        .filter("result.matieres is not null")
        .select(*PAGE_KEYS, rows.alias("matieres"), six(r["moyennePromotion"]).alias("moyennePromotion"), r["error"].alias("error"))
        .withColumn("n_modules", count_modules(F.col("matieres")))
    )


def count_modules(matieres: Column) -> Column:
    return F.size(F.filter(matieres, lambda m: F.coalesce(m["abrev"] != "", F.lit(False))))


def average_from_modules(notes: DataFrame, keys: list[str], semester: str, note: str) -> DataFrame:
    """Relational form: unweighted mean of the finite notes per key and semester (partial aggregate)."""
    return notes.groupBy(*keys, semester).agg(F.avg(finite_or_null(F.col(note))).alias("average"))
