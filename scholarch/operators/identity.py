"""Identity numbers: lookup, repeatable generation, batch resolution and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarch.functions.labels import parse_birth_date
from scholarch.functions.text import normalize_ws_lower, safe_token, trim_ws, year_token
from scholarch.operators.merge import ranks_within
from scholarch.operators.quality import validate_required_names
from scholarch.session import materialize

DIGITS = (5, 10, 15)  # of a number, and of the longer forms that rows beyond it take


def _name_key(df: DataFrame, stored: bool) -> DataFrame:
    fold = (lambda c: F.lower(F.trim(F.col(c)))) if stored else (lambda c: normalize_ws_lower(F.col(c)))
    return df.withColumns({"nom_k": fold("nom"), "prenom_k": fold("prenom")})


def known_matricules(students: DataFrame, *by: str) -> DataFrame:
    """Per name key (and `by`) the matricule of the lowest id; null when that one is empty."""
    return (
        _name_key(students, stored=True)
        .groupBy("nom_k", "prenom_k", *by)
        .agg(F.nullif(F.min_by("matricule", "id"), F.lit("")).alias("found"))
    )


def find_existing_matricule(rows: DataFrame, students: DataFrame) -> DataFrame:
    """Add `found`: matricule of the lowest-id student of the same name (and birth date if given).

    Students are reduced to one row per name first, so a common name cannot multiply rows.
    """
    keyed = _name_key(rows, stored=False)
    named = keyed.join(known_matricules(students), ["nom_k", "prenom_k"], "left")
    if "birth" not in rows.columns:
        return named.drop("nom_k", "prenom_k")
    dated = known_matricules(students.withColumnRenamed("date_naissance", "birth"), "birth").withColumnRenamed("found", "found_dated")
    both = named.join(dated, ["nom_k", "prenom_k", "birth"], "left")
    found = F.when(F.col("birth").isNull(), F.col("found")).otherwise(F.col("found_dated"))
    return both.withColumn("found", found).drop("found_dated", "nom_k", "prenom_k")


def _multiplier(digits: int) -> int:
    """Odd, so that it only permutes the slots of that many hexadecimal digits."""
    return int("9E3779B97F4A7C15"[:digits], 16) | 1


def _shift(stem: Column, digits: int, salt: str) -> Column:
    """Where the numbers of a stem start, by a salted hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), stem), 256), 1, digits), 16, 10).cast("long")


def _product(x: Column, by: int, digits: int) -> Column:
    """x * by modulo 16^digits; whole numbers of up to 30 digits."""
    whole = x.cast("decimal(19,0)") * F.lit(by).cast("decimal(19,0)")
    return (whole % F.lit(16**digits).cast("decimal(19,0)")).cast("long")


def _allocated(asked: DataFrame, key: str, used: DataFrame, digits: int, salt: str) -> DataFrame:
    """`asked` (key, stem) with `slot`: the free slot of the stem that the row's rank comes to, null beyond the last.

    A row's rank among the rows of its stem counts free slots.  Taken slot t, the i-th of its stem,
    has t - i free ones before it, so in the common order of ranks and of t - i (taken ones first) the
    place of a row is its slot.
    """
    space = 16**digits
    back = pow(_multiplier(digits), -1, space)
    number = F.regexp_extract("matricule", f"^(.*)-([0-9A-F]{{{digits}}})$", 1)
    suffix = F.conv(F.regexp_extract("matricule", f"-([0-9A-F]{{{digits}}})$", 1), 16, 10).cast("long")
    stems = asked.select("stem").distinct()
    held = used.select(number.alias("stem"), suffix.alias("suffix")).where("stem <> ''").distinct().join(stems, "stem", "left_semi")
    taken = held.select("stem", _product(F.pmod(F.col("suffix") - _shift(F.col("stem"), digits, salt), F.lit(space)), back, digits).alias("t"))
    ranked_taken = ranks_within(taken, "stem", ["t"], "i")
    order = F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")), 256)
    ranked = ranks_within(asked.withColumn("_lot", order), "stem", ["_lot", key], "pos")
    # a key comes once: `t` tells taken slots with the same number of free ones before them apart
    rows = ranked.select("stem", "pos", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("t"), F.col(key))
    busy = ranked_taken.select("stem", (F.col("t") - F.col("i")).alias("pos"), F.lit(0).alias("kind"), "t", F.lit(None).cast(asked.schema[key].dataType).alias(key))
    placed = ranks_within(rows.union(busy), "stem", ["pos", "kind", "t"], "slot").where("kind = 1")
    return placed.select(key, "stem", F.when(F.col("slot") < space, F.col("slot")).alias("slot"))


def generate_matricules(rows: DataFrame, key: str, stem: Column, taken: DataFrame, salt: str) -> DataFrame:
    """(key, generated): numbers unique against `taken` and inside the batch; keys must be unique.

    A number is its stem and five hexadecimal digits.  The rows of a stem are ranked by a salted hash
    and take its free slots by rank, at once; slots are scattered over the digits by a permutation, so
    a retried job gives the same numbers and neighbours do not look alike.  Rows beyond the 16^5 slots
    of a stem go on to the form of ten digits behind the first six characters, and beyond 16^10 to
    fifteen.  The work does not depend on how full a stem is.
    """
    asked = materialize(rows.select(F.col(key), stem.alias("stem")), "asked-numbers")
    done = None
    for digits in DIGITS:
        placed = materialize(_allocated(asked, key, taken, digits, salt), "numbers")
        at = F.pmod(_product(F.col("slot"), _multiplier(digits), digits) + _shift(F.col("stem"), digits, salt), F.lit(16**digits))
        given = placed.where("slot IS NOT NULL").select(key, F.concat("stem", F.lit("-"), F.lpad(F.hex(at), digits, "0")).alias("generated"))
        done = given if done is None else done.union(given)
        asked = placed.where("slot IS NULL").select(key, F.substring("stem", 1, 6).alias("stem"))
        if asked.isEmpty():
            break
    return done


def matricule_stem(nom: Column, prenom: Column, annee_univ: Column, temporary: Column, run_year: str) -> Column:
    return F.concat_ws(
        "-",
        F.when(temporary, F.lit("TMP")).otherwise(F.lit("ETU")),
        year_token(annee_univ, run_year),
        F.concat(safe_token(nom, 3), safe_token(prenom, 2)),
    )


def acceptable_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with trimmed names and `birth`, failed): blank names and bad dates fail the row."""
    named, unnamed = validate_required_names(rows)
    dated = named.withColumn("_d", parse_birth_date(F.col("date_naissance")))
    bad = dated.filter("_d.error is not null").select("index", F.lit("failed").alias("status"), F.col("_d.error").alias("error"))
    good = dated.filter("_d.error is null").withColumns(
        {"birth": F.col("_d.value"), "nom": trim_ws(F.col("nom")), "prenom": trim_ws(F.col("prenom"))}
    )
    return good.drop("_d"), unnamed.union(bad)


def resolve_matricule(rows: DataFrame, students: DataFrame, salt: str = "run", run_year: str = "2000") -> DataFrame:
    """Accepted rows with `matricule`, `source` and `needs_review`.

    provided -> history (table first, then the earliest earlier row of the batch with the
    same name, and birth date if given) -> temporary number, or a final one for first years.
    The table is read as of the start of the batch: a row that renames an existing student
    is not seen by later rows of the same batch.
    """
    base = find_existing_matricule(rows, students)
    given = F.nullif(trim_ws(F.col("matricule")), F.lit(""))
    base = _name_key(base.withColumn("given", given), stored=False)
    # the first row of every (name) and (name, birth date) is the one later rows can find
    by_name = base.groupBy("nom_k", "prenom_k").agg(F.min("index").alias("lead"))
    by_date = base.filter("birth is not null").groupBy("nom_k", "prenom_k", "birth").agg(F.min("index").alias("lead_dated"))
    led = base.join(by_name, ["nom_k", "prenom_k"]).join(by_date, ["nom_k", "prenom_k", "birth"], "left")
    lead = F.when(F.col("birth").isNull(), F.col("lead")).otherwise(F.col("lead_dated"))
    led = led.withColumn("lead", lead).drop("lead_dated", "nom_k", "prenom_k")
    led = led.withColumn(
        "source",
        F.when(F.col("given").isNotNull(), "provided")
        .when(F.col("is_first_year"), "generated_first_year")
        .when(F.col("found").isNotNull() | (F.col("lead") < F.col("index")), "history")
        .otherwise("generated_temporary"),
    )
    led = materialize(led, "resolve")
    new = led.filter("source in ('generated_temporary', 'generated_first_year')")
    stem = matricule_stem(F.col("nom"), F.col("prenom"), F.col("annee_univ"), F.col("source") == "generated_temporary", run_year)
    numbers = generate_matricules(new, "index", stem, students.select("matricule").union(led.filter("given is not null").select("given")), salt)
    own = led.join(numbers, "index", "left").withColumn("own", F.coalesce("given", "found", "generated"))
    leads = own.select(F.col("index").alias("lead"), F.coalesce("given", "generated").alias("lead_number"))
    followed = own.join(leads, "lead", "left")
    number = F.when(F.col("source") == "history", F.coalesce("found", "lead_number")).when(F.col("source") == "provided", F.col("given")).otherwise(F.col("generated"))
    return followed.withColumn("matricule", number).withColumn("needs_review", F.col("source") == "generated_temporary").drop("given", "found", "lead", "generated", "own", "lead_number")


def pending_cases(resolved: DataFrame, created_at: str) -> DataFrame:
    """One pending case per temporary number; the student id is left for reconciliation."""
    return resolved.filter("source = 'generated_temporary'").select(
        F.sha2(F.concat_ws("|", "matricule", F.col("index").cast("string")), 256).alias("case_id"),
        F.lit(created_at).alias("created_at"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("long").alias("student_id"),
        "nom",
        "prenom",
        "annee_univ",
        F.col("matricule").alias("generated_matricule"),
        F.to_json(F.struct("index", "nom", "prenom", "date_naissance", "lieu_naissance", "sexe")).alias("source"),
        F.col("index"),
    )


def check_pending(cases: DataFrame, students: DataFrame) -> DataFrame:
    """Pending cases with `found` and `matched` (found and different from the generated number)."""
    found = find_existing_matricule(cases.filter("status = 'pending'"), students)
    return found.withColumn("matched", F.coalesce(F.col("found") != F.col("generated_matricule"), F.lit(False)))


def check_pending_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count("*").alias("total_pending"),
        F.count_if("matched").alias("matches_found"),
        F.count_if(~F.col("matched")).alias("unresolved_count"),
    )


def _owner(students: DataFrame, number: str, owner: str) -> DataFrame:
    return students.groupBy(F.col("matricule").alias(number)).agg(F.min("id").alias(owner))


def reconcile_pending(cases: DataFrame, students: DataFrame) -> DataFrame:
    """Each pending case with one of five outcomes and the ids involved."""
    found = find_existing_matricule(cases.filter("status = 'pending'"), students)
    joined = found.join(_owner(students, "generated_matricule", "temporary_student_id"), "generated_matricule", "left").join(
        _owner(students, "found", "existing_student_id"), "found", "left"
    )
    outcome = (
        F.when(F.col("found").isNull(), "no_match_found")
        .when(F.col("found") == F.col("generated_matricule"), "already_same_matricule")
        .when(F.col("temporary_student_id").isNull(), "temporary_student_not_found")
        .when(F.col("existing_student_id") != F.col("temporary_student_id"), "real_matricule_already_assigned")
        .otherwise("update")
    )
    return joined.select("case_id", F.col("generated_matricule").alias("temporary_matricule"), F.col("found").alias("found_matricule"), "temporary_student_id", "existing_student_id", outcome.alias("outcome"))


def conflict_report(reconciled: DataFrame) -> DataFrame:
    return reconciled.filter("outcome in ('temporary_student_not_found', 'real_matricule_already_assigned')")


def apply_reconciliation(
    reconciled: DataFrame, cases: DataFrame, students: DataFrame, now: str, preview: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(students, cases) after writing the new numbers; unchanged when `preview`."""
    if preview:
        return students, cases
    updates = reconciled.filter("outcome = 'update'").select("case_id", "temporary_student_id", "found_matricule")
    per_student = updates.groupBy(F.col("temporary_student_id").alias("id")).agg(F.max_by("found_matricule", "case_id").alias("_new"))
    new_students = students.join(per_student, "id", "left").withColumn("matricule", F.coalesce("_new", "matricule")).drop("_new")
    done = updates.select("case_id", F.col("found_matricule").alias("resolved_matricule"))
    kept = cases.drop("resolved_at", "resolved_matricule").join(done, "case_id", "left")
    resolved = F.col("resolved_matricule").isNotNull()
    new_cases = kept.withColumn("status", F.when(resolved, "resolved").otherwise(F.col("status"))).withColumn("resolved_at", F.when(resolved, F.lit(now)))
    return new_students, new_cases
