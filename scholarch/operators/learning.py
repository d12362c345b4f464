"""Learning from confirmed choices: variations and correction log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarch.functions.text import full_search_term, normalize_text


def _confirmed(confirmations: DataFrame) -> DataFrame:
    term = full_search_term(F.col("searched_nom"), F.col("searched_prenom"), F.col("searched_matricule"))
    return confirmations.withColumn("terme_recherche", term).withColumn("terme_normalise", normalize_text(term))


def known_confirmations(confirmations: DataFrame, students: DataFrame) -> DataFrame:
    names = students.select(F.col("id").alias("selected_student_id"), F.concat_ws(" ", "nom", "prenom").alias("canonical"))
    return _confirmed(confirmations).join(names, "selected_student_id")


def confirmation_errors(confirmations: DataFrame, students: DataFrame) -> DataFrame:
    """Confirmations that name an unknown student."""
    lost = confirmations.join(students.select(F.col("id").alias("selected_student_id")), "selected_student_id", "left_anti")
    text = F.concat(F.lit("Student with id="), F.col("selected_student_id").cast("string"), F.lit(" was not found"))
    return lost.select("conf_id", "selected_student_id", text.alias("error"))


def confirm_selection(confirmations: DataFrame, students: DataFrame, variations: DataFrame, trigger: bool = False) -> DataFrame:
    """The variation table after a batch of confirmations.

    Confirmations are first counted per (student, term), so a term confirmed millions of
    times is one row in the merge.  Service rule: a new variation starts at 1.  `trigger`
    keeps the raw term and counts a new variation twice for its first confirmation.
    """
    term = F.col("terme_recherche") if trigger else F.col("terme_normalise")
    name = F.col("canonical") if trigger else normalize_text(F.col("canonical"))
    counted = (
        known_confirmations(confirmations, students)
        .groupBy(F.col("selected_student_id").alias("etudiant_id"), term.alias("variation"))
        .agg(F.count("*").alias("added"), F.first(name).alias("nom_canonique"), F.max("confirmed_at").alias("last_used"))
    )
    new = F.col("added") + 1 if trigger else F.col("added")
    return variations.join(counted, ["etudiant_id", "variation"], "full_outer").select(
        "etudiant_id",
        "variation",
        F.when(F.col("frequence").isNull(), new).otherwise(F.greatest("frequence", F.lit(1)) + F.coalesce("added", F.lit(0))).cast("long").alias("frequence"),
        F.col("added").isNotNull().alias("changed"),
        "nom_canonique",
        "last_used",
    )


def confirmation_log(confirmations: DataFrame, students: DataFrame) -> DataFrame:
    """Log rows of accepted confirmations (correction flag 1)."""
    return known_confirmations(confirmations, students).select(
        "conf_id",
        F.col("selected_student_id").alias("etudiant_id"),
        "terme_recherche",
        "terme_normalise",
        F.lit("fuzzy_suggestion_selection").alias("type_recherche"),
        F.greatest(F.coalesce("result_count", F.lit(0)), F.lit(0)).alias("resultats_trouves"),
        F.lit(1).alias("correction_utilisateur"),
    )
