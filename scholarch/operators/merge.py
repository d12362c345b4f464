"""Merging batches into versioned tables: upsert, patch, delete, grade loading, document registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarch.functions.numbers import coerce_number
from scholarch.functions.text import normalize_text
from scholarch.session import materialize


def with_dense_ids(rows: DataFrame, order: str, output: str, start: int) -> DataFrame:
    """Consecutive ids in the order of a column without a single-partition window.

    Rows are range partitioned and written once; the offsets come from one count per
    partition, a table as small as the number of partitions.
    """
    parts = rows.sparkSession.sparkContext.defaultParallelism
    placed = materialize(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    numbered = placed.withColumn("_at", inside).join(offsets, "_part")
    return numbered.withColumn(output, (F.lit(start) + F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def ranks_within(rows: DataFrame, group: str, order: list[str], output: str) -> DataFrame:
    """Rank from 0 of every row inside its group, in the order of columns that tell its rows apart.

    Rows are range partitioned by group and order and written once, so a group that holds a third of
    all rows is many tasks; what comes before a row in earlier ones is one count per group and task.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    placed = materialize(rows.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    return placed.withColumn("_at", inside).join(offsets, [group, "_part"]).withColumn(output, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def _last(column: str, keep: Column | None = None) -> Column:
    given = F.col(column).isNotNull() if keep is None else keep
    return F.max_by(column, F.when(given, F.col("index"))).alias(column)


def upsert_students(resolved: DataFrame, students: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(new student version, saved rows): rows folded per matricule in index order.

    Names are always replaced; sexe, lieu and birth date only when given.  Folding is an
    aggregate with map-side combine, so very many rows for one number collapse early.
    """
    resolved = materialize(resolved, "resolved")
    folded = resolved.groupBy("matricule").agg(
        F.min("index").alias("first_index"),
        F.max_by("nom", "index").alias("nom"),
        F.max_by("prenom", "index").alias("prenom"),
        _last("sexe"),
        _last("lieu_naissance"),
        _last("birth"),
    )
    owners = students.groupBy("matricule").agg(F.min("id").alias("id"))
    known = materialize(folded.join(owners, "matricule", "left"), "folded")
    top = students.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    created = with_dense_ids(known.filter("id is null").drop("id"), "first_index", "id", int(top))
    patch = known.filter("id is not null").select("id", *[F.col(c).alias(f"_{c}") for c in ("nom", "prenom", "sexe", "lieu_naissance", "birth")])
    kept = students.join(patch, "id", "left")
    merged = kept.select(
        "id",
        F.coalesce("_nom", "nom").alias("nom"),
        F.coalesce("_prenom", "prenom").alias("prenom"),
        "matricule",
        F.coalesce("_sexe", "sexe").alias("sexe"),
        F.coalesce("_birth", "date_naissance").alias("date_naissance"),
        F.coalesce("_lieu_naissance", "lieu_naissance").alias("lieu_naissance"),
        F.when(F.col("_nom").isNotNull(), F.lit(now)).alias("updated_at"),
    )
    added = created.select("id", "nom", "prenom", "matricule", "sexe", F.col("birth").alias("date_naissance"), "lieu_naissance", F.lit(now).alias("updated_at"))
    version = merged.union(added)
    ids = known.filter("id is not null").select("matricule", "id", F.lit(False).alias("new"), "first_index").union(
        created.select("matricule", "id", F.lit(True).alias("new"), "first_index")
    )
    saved = resolved.join(ids, "matricule").select(
        "index",
        F.lit("ok").alias("status"),
        F.when(F.col("new") & (F.col("index") == F.col("first_index")), "created").otherwise("updated").alias("action"),
        F.col("id").alias("student_id"),
        "nom",
        "prenom",
        "matricule",
        "source",
        "needs_review",
    )
    return version, saved


def touch_updated_at(old: DataFrame, new: DataFrame, key: str, columns: list[str], now: str) -> DataFrame:
    """Rows of `new` with `updated_at` = `now` where any listed column differs from `old`."""
    before = old.select(key, F.lit(True).alias("_was"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = new.join(before, key, "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    stamp = F.when(F.col("_was") & ~same, F.lit(now))
    return joined.withColumn("updated_at", stamp).select(*new.columns, "updated_at") if "updated_at" not in new.columns else joined.withColumn(
        "updated_at", F.coalesce(stamp, "updated_at")
    ).select(*new.columns)


def generic_update(table: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Known columns of the patch replace the table's where the patch has a value."""
    columns = [c for c in patch.columns if c != key and c in table.columns]
    renamed = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def delete_by_id(table: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(remaining rows, report of each id with whether it was found)."""
    wanted = ids.select(key).distinct()
    report = wanted.join(table.select(key).distinct().withColumn("_f", F.lit(True)), key, "left")
    return table.join(wanted, key, "left_anti"), report.select(key, F.coalesce("_f", F.lit(False)).alias("found"))


def load_grades(students: DataFrame, cells: DataFrame, year: str = "annee") -> dict[str, DataFrame]:
    """Flattened student and module rows as inscription, period and grade tables.

    A person is the matricule, else the folded name.  On repeated keys the lowest page wins
    (aggregates with map-side combine); `n` counts the rows behind an inscription.  Notes outside
    0-20 and notes without a code are not graded: they come out as `rejected`, with the reason.
    """
    person = F.coalesce(F.col("matricule"), normalize_text(F.concat_ws(" ", "nom", "prenom"))).alias("etudiant")
    order = F.struct("page_number", "student_index")
    base = students.select(person, F.col(year).alias("annee"), "page_number", "student_index", "avg_s1", "avg_s2", "annual_avg", "annual_rank", "final_decision")
    # one aggregate for each value (all take the same row), so that a reader pays for those it reads
    chosen = [F.min_by(c, order).alias(name) for c, name in (("annual_avg", "moy"), ("annual_rank", "rang"), ("final_decision", "decisionJury"))]
    inscription = base.groupBy("etudiant", "annee").agg(*chosen, F.count("*").alias("n"))
    halves = F.explode(F.array(F.struct(F.lit("S1").alias("periode"), F.col("avg_s1").alias("moy")), F.struct(F.lit("S2").alias("periode"), F.col("avg_s2").alias("moy"))))
    periods = base.select("*", halves.alias("h")).groupBy("etudiant", "annee", F.col("h.periode").alias("periode")).agg(F.min_by("h.moy", order).alias("moy"))
    # numbers and names are worked out inside generators: filters on plain columns would repeat them below
    notes = F.explode(F.array(*[F.struct(F.lit(half.upper()).alias("periode"), coerce_number(F.col(half)).alias("moy")) for half in ("s1", "s2")]))
    graded = (
        cells.select(F.explode(F.array(person)).alias("etudiant"), F.col(year).alias("annee"), "page_number", "student_index", "pos", "code", "s1", "s2")
        .select("etudiant", "annee", "page_number", "student_index", "pos", "code", notes.alias("x"))
        .select("*", F.col("x.moy").alias("moy"))
        .filter("moy is not null")
        .withColumn("reason", F.when(F.col("code") == "", "module without a code").when(~F.col("moy").between(0, 20), "note outside 0-20"))
    )
    rejected = graded.filter("reason is not null").select("etudiant", "annee", F.col("x.periode").alias("periode"), "code", "page_number", "student_index", "pos", "moy", "reason")
    results = graded.filter("reason is null").groupBy("etudiant", "annee", F.col("x.periode").alias("periode"), "code").agg(
        F.min_by("moy", F.struct("page_number", "student_index", "pos")).alias("moy")
    )
    return {"inscription": inscription, "inscription_periode": periods, "resultat": results, "rejected": rejected}


def document_from_record(records: DataFrame) -> DataFrame:
    """Registry view of completed records: name, page counts, progress, status and error."""
    total, ok, failed = F.col("total_pages"), F.col("ok_pages"), F.col("failed_pages")
    whole = (failed == 0) & (total > 0) & (ok >= total)
    percent = F.when(total > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.round((ok + failed) / F.nullif(total, F.lit(0)) * 100)))).otherwise(0).cast("int")
    short = F.concat(F.lit("Only "), ok.cast("string"), F.lit("/"), total.cast("string"), F.lit(" pages processed."))
    return records.select(
        F.col("id").alias("record_id"),
        "file_name",
        F.greatest(total, F.lit(1)).alias("pages"),
        F.when(whole, "completed").otherwise("failed").alias("status"),
        percent.alias("progress"),
        F.when(~whole, F.coalesce(F.nullif(F.trim("error"), F.lit("")), short)).alias("error"),
    )


def merge_documents(registry: DataFrame, records: DataFrame, order: str) -> DataFrame:
    """Registry after merging completed records: matched by record id, else by lower file name.

    When several records hit one document the last in record order wins; unmatched records
    become new documents, one per lower file name.
    """
    cols = document_from_record(records.filter("file_name <> ''")).columns
    docs = document_from_record(records.filter("file_name <> ''")).join(records.select(F.col("id").alias("record_id"), F.col(order).alias("_o")), "record_id")
    names = registry.groupBy(F.lower("name").alias("_name")).agg(F.max("doc_id").alias("by_name"))
    ids = registry.filter(F.contains("doc_id", F.lit("::"))).select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("by_id"))
    hit = docs.join(ids, "record_id", "left").withColumn("_name", F.lower("file_name")).join(names, "_name", "left")
    hit = hit.withColumn("target", F.coalesce("by_id", "by_name"))
    packed = F.struct(*cols).alias("d")
    last = hit.filter("target is not null").groupBy(F.col("target").alias("doc_id")).agg(F.max_by(packed, "_o").alias("d"))
    fresh = hit.filter("target is null").groupBy("_name").agg(F.max_by(packed, "_o").alias("d"))
    kept = registry.join(last, "doc_id", "left").select(
        F.coalesce("d.record_id", "doc_id").alias("doc_id"), "name",
        F.coalesce("d.status", "status").alias("status"), F.when(F.col("d").isNull(), F.lit(None)).otherwise(F.col("d.progress")).alias("progress"),
        F.when(F.col("d").isNotNull(), F.col("d.error")).alias("error"),
    )
    new = fresh.select(F.col("d.record_id").alias("doc_id"), F.col("d.file_name").alias("name"), "d.status", "d.progress", "d.error")
    return kept.union(new)


def merge_recent_cap(new: DataFrame, old: DataFrame, order: str, cap: int) -> DataFrame:
    """New records before old ones, the first `cap` kept (a top-k, no full sort)."""
    both = new.withColumn("_src", F.lit(0)).unionByName(old.withColumn("_src", F.lit(1)))
    return both.orderBy("_src", order).limit(cap).drop("_src")
