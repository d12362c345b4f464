"""Relational views, progress and performance aggregates, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarch.functions.labels import is_transient_error, transient_class

PASS_MARK = 10.0  # assumption stated in the README: a grade of 10 or more is a success


def current_inscriptions(t: dict[str, DataFrame], today: str) -> DataFrame:
    """Inscriptions of years not yet over, with student, programme, year and group."""
    i, e, f, p, a, g = (t[n].alias(n[0] if n != "annee_universitaire" else "a") for n in ("inscription", "etudiant", "formation", "programme", "annee_universitaire", "groupe"))
    # the date filter on the smallest table and its chain of joins come first
    formations = (
        f.join(a.filter(F.col("date_fin") >= F.lit(today).cast("date")), F.col("f.annee_univ_id") == F.col("a.id"))
        .join(p, F.col("f.programme_id") == F.col("p.id"))
        .select(F.col("f.id").alias("formation_id"), F.col("p.code").alias("programme_code"), F.col("p.titre").alias("programme_titre"), F.col("a.annee").alias("annee_universitaire"))
    )
    groups = g.select(F.col("id").alias("groupe_id"), F.col("code").alias("groupe"))
    people = e.select(F.col("id").alias("etudiant_id"), "nom", "prenom", "matricule")
    return (
        i.select(F.col("id").alias("inscription_id"), "etudiant_id", "formation_id", "groupe_id", F.col("moy").alias("moyenne_generale"), "decisionJury", "rang")
        .join(formations, "formation_id")
        .join(groups, "groupe_id")
        .join(people, "etudiant_id")
        .drop("groupe_id")
    )


def student_grades(t: dict[str, DataFrame]) -> DataFrame:
    """Grades with student, year, period and subject (nine tables)."""
    years = t["annee_universitaire"].select(F.col("id").alias("annee_univ_id"), F.col("annee").alias("annee_univ"))
    formations = t["formation"].select(F.col("id").alias("formation_id"), "annee_univ_id").join(years, "annee_univ_id").drop("annee_univ_id")
    people = t["etudiant"].select(F.col("id").alias("etudiant_id"), "nom", "prenom")
    enrolled = t["inscription"].select(F.col("id").alias("inscription_id"), "etudiant_id", "formation_id").join(formations, "formation_id").join(people, "etudiant_id")
    periods = t["periode_programme"].select(F.col("id").alias("periodepgm_id"), F.col("libelle").alias("periode"))
    halves = t["inscription_periode"].select(F.col("id").alias("inscriptionPer_id"), "inscription_id", "periodepgm_id").join(periods, "periodepgm_id")
    subjects = t["matiere"].select(F.col("id").alias("matiere_id"), F.col("code").alias("matiere_code"), F.col("title").alias("matiere_title"))
    modules = t["module"].select(F.col("id").alias("module_id"), "matiere_id").join(subjects, "matiere_id").drop("matiere_id")
    return (
        t["resultat"]
        .select("inscriptionPer_id", "module_id", F.col("moy").alias("note"), "note_cc", "note_exam")
        .join(modules, "module_id")
        .join(halves.join(enrolled, "inscription_id"), "inscriptionPer_id")
        .select("etudiant_id", "nom", "prenom", "annee_univ", "periode", "matiere_code", "matiere_title", "note", "note_cc", "note_exam")
    )


def search_analytics(log: DataFrame) -> DataFrame:
    corrected = F.sum(F.when(F.col("correction_utilisateur") != 0, 1).otherwise(0))
    return log.groupBy("type_recherche", F.to_date("date_recherche").alias("search_date")).agg(
        F.count("*").alias("total_searches"),
        F.avg("resultats_trouves").alias("avg_results"),
        corrected.alias("corrections"),
        F.round(corrected * 100.0 / F.count("*"), 2).alias("correction_rate"),
    )


def percent_of(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / F.nullif(total, F.lit(0)) * 100, 2)).otherwise(0.0)


def progress_columns(ok: Column, failed: Column, total: Column) -> list[Column]:
    percent = percent_of(ok + failed, total)
    whole = F.bround(percent).cast("int").cast("string")
    message = F.concat(whole, F.lit("% pages processed ("), ok.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))
    return [percent.alias("processed_percentage"), message.alias("message")]


def file_progress(pages: DataFrame, *keys: str) -> DataFrame:
    """Per file: pages read, failed, total, percent done and the message."""
    counts = pages.groupBy(*keys).agg(
        F.count_if(F.col("status") == "ok").alias("processed_pages"),
        F.count_if(F.col("status") != "ok").alias("failed_pages"),
        F.count("*").alias("total_pages"),
    )
    return counts.select("*", *progress_columns(F.col("processed_pages"), F.col("failed_pages"), F.col("total_pages")))


def batch_progress(pages: DataFrame) -> DataFrame:
    """Files and their batch in one rollup; batch rows have a null file name and count files."""
    files = file_progress(pages, "batch_id", "file_name")
    sums = files.rollup("batch_id", "file_name").agg(
        *[F.sum(c).alias(c) for c in ("processed_pages", "failed_pages", "total_pages")],
        F.count_if(F.col("failed_pages") == 0).alias("processed_files"),
        F.count_if(F.col("failed_pages") > 0).alias("failed_files"),
    )
    return sums.filter("batch_id is not null").select("*", *progress_columns(F.col("processed_pages"), F.col("failed_pages"), F.col("total_pages")))


def queue_progress(records: DataFrame) -> DataFrame:
    percent = F.when(F.col("total_pages") > 0, F.round(F.col("ok_pages") / F.col("total_pages") * 100)).otherwise(0)
    return records.withColumn("percent", percent.cast("int"))


def completion_percent(records: DataFrame) -> DataFrame:
    done = F.round((F.col("ok_pages") + F.col("failed_pages")) / F.nullif("total_pages", F.lit(0)) * 100)
    percent = F.when(F.col("total_pages") > 0, F.greatest(F.lit(0), F.least(F.lit(100), done))).otherwise(0)
    return records.withColumn("percent", percent.cast("int"))


def performance(grades: DataFrame, by: str, student: str, grade: str) -> DataFrame:
    """Students, average, success and failure percentages and sample deviation per `by`."""
    g = F.col(grade)
    passed = F.avg(F.when(g >= PASS_MARK, 100.0).when(g.isNotNull(), 0.0))
    return grades.groupBy(by).agg(
        F.count_distinct(student).alias("students"),
        F.round(F.avg(g), 4).alias("average"),
        F.round(passed, 4).alias("success"),
        F.round(100.0 - passed, 4).alias("failure"),
        F.round(F.stddev_samp(g), 4).alias("dispersion"),
    )


def promo_performance(finals: DataFrame) -> DataFrame:
    """Per promotion and overall (null promotion): success, failure and average final grade."""
    passed = F.avg(F.when(F.col("moy") >= PASS_MARK, 100.0).when(F.col("moy").isNotNull(), 0.0))
    return finals.rollup("promo").agg(
        F.count("*").alias("n"), F.round(passed, 4).alias("success"), F.round(100.0 - passed, 4).alias("failure"), F.round(F.avg("moy"), 4).alias("average")
    )


def gender_split(students: DataFrame) -> DataFrame:
    """Count and share per sexe: the total is summed over the few group rows."""
    groups = students.groupBy(F.coalesce("sexe", F.lit("Autre")).alias("sexe")).agg(F.count("*").alias("n"))
    return groups.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def graduate_status(average: Column) -> Column:
    return F.when(average >= PASS_MARK, "Graduate").otherwise("Non-Graduate")


def grade_band(average: Column) -> Column:
    return F.when(average >= 14, "high").when(average >= 10, "middle").otherwise("low")


def error_summary(pages: DataFrame) -> DataFrame:
    """Failed pages by transient flag and error class."""
    e = F.col("error")
    return pages.filter("status = 'failed'").groupBy(F.coalesce(is_transient_error(e), F.lit(False)).alias("transient"), F.coalesce(transient_class(e), F.lit("other")).alias("class")).agg(F.count("*").alias("n"))


def top_students(rows: DataFrame, score: str, key: str, n: int = 10) -> DataFrame:
    """First n by score descending (a top-k, ties by key), numbered; equal scores share `dense`.

    The windows run over the n rows kept, not over the table.
    """
    best = rows.filter(F.col(score).isNotNull()).orderBy(F.desc(score), F.asc(key)).limit(n)
    w = Window.orderBy(F.desc(score))
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key)))).withColumn("dense", F.dense_rank().over(w))


def compute_ranks(rows: DataFrame, group: list[str], score: str, output: str = "rank") -> DataFrame:
    """Competition rank of the score inside each group.

    A rank is one plus the number of rows with a higher score, so rows are first counted per
    distinct score; the window then runs over the distinct scores of a group, which keeps a
    very large group cheap, and the ranks are joined back.
    """
    graded = rows.filter(F.col(score).isNotNull())
    counted = graded.groupBy(*group, score).agg(F.count("*").alias("_n"))
    above = Window.partitionBy(*group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counted.withColumn(output, (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("long")).drop("_n")
    return graded.join(ranks, [*group, score])


def rank_mismatch_audit(rows: DataFrame, group: list[str], score: str, stored: str) -> DataFrame:
    return compute_ranks(rows, group, score, "computed_rank").filter(F.col(stored) != F.col("computed_rank"))
