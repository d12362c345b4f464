"""Projections, lookups, filters and selections over records, students and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES = 100 * 1024 * 1024


def base_name(path: str):
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def project_completed_record(runs: DataFrame) -> DataFrame:
    """Run result -> completed record; attempt and key suffix leave the pages, counts default to 0."""
    name = F.coalesce(F.nullif(base_name("file_path"), F.lit("")), F.lit("unknown.pdf"))
    have = set(runs.schema["pages"].dataType.elementType.names)
    keep = [c for c in ("page_number", "status", "image_path", "result", "kind", "error") if c in have]
    pages = F.transform("pages", lambda p: F.struct(*[F.coalesce(p[c], F.lit(0)).alias(c) if c == "page_number" else p[c].alias(c) for c in keep]))
    return runs.select(
        *[c for c in ("k",) if c in runs.columns],
        F.concat_ws("::", "batch_id", name).alias("id"),
        "batch_id",
        name.alias("file_name"),
        "processed_at",
        "status",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_pages", "ok_pages", "failed_pages")],
        pages.alias("pages"),
    )


def lookup_by_key(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows of the table whose key columns equal one of the given keys (semi join)."""
    return table.join(keys.select(*on).distinct(), list(on), "left_semi")


def search_by_name(students: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """Lower-case substring on nom, prenom or matricule; ordered by nom, prenom; blank gives nothing."""
    text = (term or "").strip().lower()
    if not text:
        return students.limit(0)
    hit = F.lit(False)
    for c in ("nom", "prenom", "matricule"):
        hit = hit | F.contains(F.lower(c), F.lit(text))
    return students.filter(hit).orderBy("nom", "prenom", "id").limit(limit)


def browse_filter(rows: DataFrame, text: str = "", promo: str = "All Promotions", status: str = "All Status") -> DataFrame:
    """Name substring (any case) or exact-case matricule substring, and promotion, and status."""
    wanted = text.lower().strip()
    out = rows
    if wanted:
        out = out.filter(F.contains(F.lower("name"), F.lit(wanted)) | F.contains("mat", F.lit(wanted)))
    if not promo.startswith("All"):
        out = out.filter(F.col("promo") == promo)
    if not status.startswith("All"):
        out = out.filter(F.col("status") == status)
    return out


def dashboard_search(rows: DataFrame, text: str, order: str, limit: int = 20) -> DataFrame:
    """First 20 rows (in list order) whose name or matricule contains the text; blank gives none."""
    if not text.strip():
        return rows.limit(0)
    hit = F.contains(F.lower("name"), F.lit(text.lower())) | F.contains("mat", F.lit(text))
    return rows.filter(hit).orderBy(order).limit(limit)


def browse_page(rows: DataFrame, order: list, page: int, size: int = 10) -> tuple[DataFrame, int]:
    """(rows of the page, number of pages): the page index is clamped, there is at least one page."""
    total = max(1, -(-rows.count() // size))
    at = min(max(1, page), total)
    return rows.orderBy(*order).offset((at - 1) * size).limit(size), total


def document_manifest(uploads: DataFrame) -> DataFrame:
    """Every upload with `reason`: null = accepted, else why it is refused (first rule that fires)."""
    name = base_name("file_name")
    is_pdf = (F.col("mime_type") == "application/pdf") | F.endswith(F.lower("file_name"), F.lit(".pdf"))
    reason = (
        F.when(F.coalesce(name, F.lit("")) == "", "Missing filename")
        .when(~is_pdf, "Only PDF files are supported")
        .when(F.col("bytes") <= 0, "Uploaded file is empty")
        .when(F.col("bytes") > MAX_UPLOAD_BYTES, "File is too large")
    )
    return uploads.withColumn("reason", reason)


def folder_manifest(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Files of a folder (`scan_uploads`) with `reason`: null = accepted, else the first rule that refuses the file."""
    reason = (
        F.when(~F.endswith(F.lower("file_name"), F.lit(".pdf")), "Only PDF files are supported")
        .when(F.col("bytes") <= 0, "Uploaded file is empty")
        .when(F.col("bytes") > max_bytes, "File is too large")
        .when(~F.coalesce("signed", F.lit(False)), "Not a PDF document")
    )
    return files.select("path", "file_name", "bytes", reason.alias("reason"))


def _first_by(df: DataFrame, by: str, *order) -> DataFrame:
    """The first row per key: prunes inside every map task before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def find_completed_record(operations: DataFrame, records: DataFrame, recent: int | None = None) -> DataFrame:
    """Per operation the record of its file: inside its batch if it has one, else of any batch.

    With `recent` only that many of the newest records are looked at for operations without a batch.

    Records are reduced to one per (batch, name) and the recent ones to one per name first,
    so each operation joins at most one row.
    """
    named = records.withColumn("_name", F.lower(F.trim("file_name")))
    ops = operations.withColumn("_name", F.lower(base_name("saved_path"))).filter("_name <> ''")
    in_batch = named.groupBy("batch_id", "_name").agg(F.min_by("id", "pos").alias("record_id"))
    newest = named if recent is None else named.orderBy(F.desc("processed_at"), "pos").limit(recent)
    anywhere = newest.groupBy("_name").agg(F.min_by("id", F.struct((-F.unix_timestamp("processed_at")).alias("t"), "pos")).alias("record_id"))
    a = ops.filter("batch_id is not null").join(in_batch, ["batch_id", "_name"]).select("operation_id", "record_id")
    b = ops.filter("batch_id is null").join(anywhere, "_name").select("operation_id", "record_id")
    return a.union(b)


def find_source_document(records: DataFrame, uploads: DataFrame) -> DataFrame:
    """Per record the newest upload of its file name, in its batch first, else anywhere."""
    files = uploads.withColumn("_name", base_name("file_name"))
    newest = F.max_by("upload_id", F.struct("mtime", (-F.col("upload_id")).alias("t"))).alias("upload_id")
    in_batch = files.groupBy("batch_id", F.col("_name").alias("file_name")).agg(newest)
    anywhere = files.groupBy(F.col("_name").alias("file_name")).agg(newest.alias("any_id"))
    joined = records.join(in_batch, ["batch_id", "file_name"], "left").join(anywhere, "file_name")
    return joined.select("id", F.coalesce("upload_id", "any_id").alias("upload_id"))


def match_record_selection(selections: DataFrame, records: DataFrame) -> DataFrame:
    """Per selection the first record in list order with the same id or the same lower file name.

    Both rules are equi-joins against one row per id / per name.
    """
    named = records.select("id", "pos", F.lower(F.trim("file_name")).alias("_name"))
    by_name = named.filter("_name <> ''").groupBy("_name").agg(F.min(F.struct("pos", "id")).alias("n"))
    by_id = named.groupBy(F.trim("id").alias("record_id")).agg(F.min(F.struct("pos", "id")).alias("i"))
    asked = selections.withColumn("_name", F.lower(F.trim("file_name")))
    joined = asked.join(by_id, "record_id", "left").join(by_name, "_name", "left")
    best = F.array_min(F.filter(F.array("i", "n"), lambda x: x.isNotNull()))
    return joined.select("selection_id", best["id"].alias("matched_id")).filter("matched_id is not null")


def student_summary(students: DataFrame) -> DataFrame:
    return students.select("id", "nom", "prenom", F.concat_ws(" ", "nom", "prenom").alias("full_name"), "matricule", "date_naissance", "sexe")


def latest_per_key(rows: DataFrame, key: list[str], order) -> DataFrame:
    """Newest row per key as an aggregate (map-side combine, no sort)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
