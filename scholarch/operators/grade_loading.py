"""Grades into the standing tables: natural keys resolved to ids, three tables merged as one version.

A sheet names a student, a programme, a year and a group; its cells name a period, a subject and a
note.  Every name is resolved by an equi-join with a reference table, and what does not resolve comes
out in `rejected` with the first reason that applies.  Batches are folded per key by aggregates with
map-side combine (the last sheet wins), so very many sheets of one student collapse before a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarch.functions.numbers import coerce_number
from scholarch.functions.text import normalize_text
from scholarch.operators.merge import with_dense_ids
from scholarch.session import materialize
from scholarch.sources.versions import TableSet

STANDING = {
    "inscription": "id long, etudiant_id long, formation_id long, groupe_id long, moy double, rang int, decisionJury string, updated_at string",
    "inscription_periode": "id long, inscription_id long, periodepgm_id long, groupe_id long, moy double, updated_at string",
    "resultat": "id long, inscriptionPer_id long, module_id long, moy double, updated_at string",
}
REJECTED = "sheet_id long, pos int, reason string"


def folded_code(x: Column) -> Column:
    return F.upper(F.btrim(x))


def with_join_keys(sheets: DataFrame) -> DataFrame:
    """Sheets with the keys under which their names are looked up.

    A sheet that the join by number or by name does not serve takes a key of its own there: null keys
    would all meet in one task.
    """
    number = F.nullif(F.btrim("matricule"), F.lit(""))
    own = F.concat(F.lit("#"), F.coalesce(F.col("sheet_id").cast("string"), F.lit("")))
    return sheets.withColumns(
        {
            "matricule": number,
            "_number": F.coalesce(F.concat(F.lit("="), number), own),
            # rows that have a number need no name
            "_name": F.when(number.isNull(), normalize_text(F.concat_ws(" ", "nom", "prenom"))).otherwise(own),
            "_code": folded_code(F.col("programme")),
            "_year": F.regexp_replace(F.btrim("annee"), "\\s*/\\s*", "-"),
            "_group": folded_code(F.col("groupe")),
        }
    )


def resolve_sheets(sheets: DataFrame, ref: dict[str, DataFrame]) -> DataFrame:
    """Sheets with etudiant_id, programme_id, formation_id, groupe_id and `reason` (null: all resolved).

    A student is found by number, else by folded name when only one has it.
    """
    people = ref["etudiant"].select("id", "matricule", normalize_text(F.concat_ws(" ", "nom", "prenom")).alias("_name"))
    by_number = people.groupBy(F.concat(F.lit("="), "matricule").alias("_number")).agg(F.min("id").alias("_by_number"))
    by_name = people.groupBy("_name").agg(F.min("id").alias("_by_name"), F.count("*").alias("_namesakes"))
    programme = ref["programme"].select(F.col("id").alias("programme_id"), folded_code(F.col("code")).alias("_code"))
    year = ref["annee_universitaire"].select(F.col("id").alias("_year_id"), F.col("annee").alias("_year"))
    formation = ref["formation"].select(F.col("id").alias("formation_id"), "programme_id", F.col("annee_univ_id").alias("_year_id"))
    group = ref["groupe"].select(F.col("id").alias("groupe_id"), folded_code(F.col("code")).alias("_group"), "formation_id")
    keyed = with_join_keys(sheets)
    found = (
        keyed.join(by_number, "_number", "left")
        .join(by_name, "_name", "left")
        .join(programme, "_code", "left")
        .join(year, "_year", "left")
        .join(formation, ["programme_id", "_year_id"], "left")
        .join(group, ["formation_id", "_group"], "left")
    )
    named = F.when(F.col("matricule").isNotNull(), F.col("_by_number")).otherwise(F.when(F.col("_namesakes") == 1, F.col("_by_name")))
    reason = (
        F.when(F.col("matricule").isNull() & (F.col("_namesakes") > 1), "ambiguous name")
        .when(named.isNull(), "unknown student")
        .when(F.col("programme_id").isNull(), "unknown programme")
        .when(F.col("formation_id").isNull(), "unknown formation")
        .when(F.col("groupe_id").isNull(), "unknown group")
    )
    return found.select("sheet_id", named.alias("etudiant_id"), "programme_id", "formation_id", "groupe_id", "moy", "rang", "decisionJury", reason.alias("reason"))


def resolve_cells(cells: DataFrame, sheets: DataFrame, ref: dict[str, DataFrame]) -> DataFrame:
    """Cells of resolved sheets with the sheet's ids, periodepgm_id, module_id, moy and `reason`."""
    period = ref["periode_programme"].select(F.col("id").alias("periodepgm_id"), F.col("libelle").alias("periode"), "programme_id")
    subject = ref["matiere"].select(F.col("id").alias("matiere_id"), folded_code(F.col("code")).alias("_subject"))
    module = ref["module"].select(F.col("id").alias("module_id"), "matiere_id", F.col("periode_id").alias("periodepgm_id"))
    own = sheets.where("reason IS NULL").select("sheet_id", "etudiant_id", "formation_id", "programme_id", "groupe_id")
    read = cells.select("sheet_id", "pos", folded_code(F.col("periode")).alias("periode"), folded_code(F.col("code")).alias("_subject"), coerce_number(F.col("note")).alias("moy"))
    found = read.join(own, "sheet_id").join(period, ["programme_id", "periode"], "left").join(subject, "_subject", "left").join(module, ["matiere_id", "periodepgm_id"], "left")
    reason = (
        F.when(F.col("periodepgm_id").isNull(), "unknown period")
        .when(F.col("matiere_id").isNull(), "unknown subject")
        .when(F.col("module_id").isNull(), "subject not taught in the period")
        .when(F.col("moy").isNull(), "unreadable note")
        .when(~F.col("moy").between(0, 20), "note outside 0-20")
    )
    return found.select("sheet_id", "pos", "etudiant_id", "formation_id", "groupe_id", "periodepgm_id", "module_id", "moy", reason.alias("reason"))


def merge_keyed(standing: DataFrame, batch: DataFrame, key: list[str], now: str) -> DataFrame:
    """The next version of `standing`: rows of `batch` (one per key) replace values in place or are added.

    Ids stay; new ones follow the highest in the order of the key.  `updated_at` moves only where a
    value differs.
    """
    values = [c for c in batch.columns if c not in key]
    given = batch.select(*key, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_given"))
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    kept = standing.join(given, key, "left").select(
        "id",
        *key,
        *[F.when(F.col("_given"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values],
        F.when(F.col("_given") & differs, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    top = standing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    fresh = batch.join(standing.select(*key), key, "left_anti").withColumn("_order", F.struct(*key))
    added = with_dense_ids(fresh, "_order", "id", int(top)).withColumn("updated_at", F.lit(now))
    return kept.select(*standing.columns).union(added.select(*standing.columns))


def load_grade_tables(sheets: DataFrame, cells: DataFrame, ref: dict[str, DataFrame], tables: TableSet, now: str) -> int:
    """Load a batch into `inscription`, `inscription_periode` and `resultat`; the number of the new version.

    `sheets` has sheet_id, matricule, nom, prenom, programme, annee, groupe, moy, rang, decisionJury;
    `cells` has sheet_id, pos, periode, code, note.  A null in any of them is a name that does not
    resolve.  Of several sheets of one student and formation the one with the highest sheet_id wins,
    of several notes of one module the last cell (sheet_id, pos, note).  The average of a period is
    that of its notes in the batch.  The version holds the three tables and `rejected` (sheet_id,
    pos: null for a whole sheet, reason); all of them become visible together or not at all.  The
    same batch loaded again changes nothing but the version's number.
    """
    base = tables.version()
    resolved = materialize(resolve_sheets(sheets, ref), "sheets")
    placed = materialize(resolve_cells(cells, resolved, ref), "cells")
    person = ["etudiant_id", "formation_id"]
    values = ["groupe_id", "moy", "rang", "decisionJury"]
    heads = resolved.where("reason IS NULL").groupBy(*person).agg(F.max_by(F.struct(*values), "sheet_id").alias("v")).select(*person, "v.*")
    standing = {name: tables.read(name, base) for name in STANDING}
    inscription = materialize(merge_keyed(standing["inscription"], heads, person, now), "inscription")

    last = F.struct("sheet_id", "pos", "moy")
    notes = placed.where("reason IS NULL").groupBy(*person, "periodepgm_id", "module_id").agg(F.max_by(F.struct("moy", "groupe_id"), last).alias("v"), F.max(last).alias("at"))
    notes = materialize(notes.select(*person, "periodepgm_id", "module_id", "v.moy", "v.groupe_id", "at"), "notes")
    ids = inscription.select(F.col("id").alias("inscription_id"), *person)
    # whole hundredths add up alike in any order
    hundredths = F.sum(F.round(F.col("moy") * 100).cast("long"))
    periods = notes.groupBy(*person, "periodepgm_id").agg(F.max_by("groupe_id", "at").alias("groupe_id"), (hundredths / (100.0 * F.count("*"))).alias("moy"))
    period_key = ["inscription_id", "periodepgm_id"]
    period_rows = periods.join(ids, person).select(*period_key, "groupe_id", "moy")
    period_table = materialize(merge_keyed(standing["inscription_periode"], period_rows, period_key, now), "periods")

    period_ids = period_table.select(F.col("id").alias("inscriptionPer_id"), *period_key)
    results = notes.join(ids, person).join(period_ids, period_key).select("inscriptionPer_id", "module_id", "moy")
    result_table = merge_keyed(standing["resultat"], results, ["inscriptionPer_id", "module_id"], now)
    rejected = resolved.where("reason IS NOT NULL").select("sheet_id", F.lit(None).cast("int").alias("pos"), "reason").union(
        placed.where("reason IS NOT NULL").select("sheet_id", "pos", "reason")
    )
    return tables.commit(base, {"inscription": inscription, "inscription_periode": period_table, "resultat": result_table, "rejected": rejected})
