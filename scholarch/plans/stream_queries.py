"""Streaming jobs drained over whole tables and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarch.operators import learning as Le
from scholarch.plans.catalog import register
from scholarch.plans.linkage_queries import CONF
from scholarch.plans.table_queries import _conversation_pages
from scholarch.sources.adapters import Archive
from scholarch.streaming import jobs as J


class StreamArchive(Archive):
    """The same academic views with one table read as a stream."""

    def __init__(self, spark, folder, streamed):
        super().__init__(spark, folder)
        self.streamed = streamed

    def table(self, name):
        static = super().table(name)
        if name != self.streamed:
            return static
        return J.read_table_stream(self.spark, self.folder, name, static.schema)


def _drain(a, streamed, build, mode="append"):
    out, checkpoint = J.locations(a.spark, streamed)
    session = J.isolated_session(a.spark)
    J.run_available(build(StreamArchive(session, a.folder, streamed)), out, checkpoint, mode)
    return a.spark.read.parquet(out)


STATE = """
  SELECT operation_id, event_id, status, stage, updated_at FROM (SELECT e.*, row_number() OVER (PARTITION BY operation_id ORDER BY CASE WHEN status = 'cancelled' THEN 0 ELSE 1 END, CASE WHEN status = 'cancelled' THEN epoch_us(updated_at) ELSE -epoch_us(updated_at) END, CASE WHEN status = 'cancelled' THEN event_id ELSE -event_id END) AS rn FROM operation_event e) WHERE rn = 1"""


def _write_runs(folder, runs, files):
    """Run documents as indented JSON arrays, one file each."""
    whole = runs.groupBy(F.pmod(F.xxhash64("file_path"), F.lit(files)).alias("part")).agg(F.collect_list(F.struct(*runs.columns)).alias("all"))
    whole.select("part", F.to_json("all", {"pretty": "true"}).alias("value")).write.partitionBy("part").text(folder)


@register("stream_ingest_runs", "SELECT k AS run, page_number, status, image_path FROM record_page")
def stream_ingest_runs(a):
    """Multi-line run files and a broken one, picked up by the file stream, stopped in mid-input and gone on from the checkpoint."""
    from scholarch.session import new_location

    folder = new_location(a.spark, "runs")
    run = a.record().withColumn("pages", F.transform("pages", lambda p: p.dropFields("kind"))).select("file_path", "total_pages", "ok_pages", "failed_pages", "pages")
    # about 500 documents a file
    _write_runs(f"{folder}/good", run, max(6, run.count() // 500))
    a.spark.createDataFrame([('[{"file_path": "cut off", "pages": [',)], "value string").coalesce(1).write.text(f"{folder}/broken")
    session = J.isolated_session(a.spark)
    out, checkpoint = J.locations(a.spark, "ingest")
    J.run_some(J.ingest_runs(J.read_runs(session, folder, files_at_once=2)), out, checkpoint, batches=1)
    J.run_available(J.ingest_runs(J.read_runs(session, folder)), out, checkpoint)
    number = F.regexp_extract("file_path", "([0-9]+)\\.pdf$", 1).cast("long")
    return a.spark.read.parquet(out).select(number.alias("run"), "page_number", "status", "image_path")


@register(
    "stream_progress",
    "SELECT 'batch_' || (conv_id % 20)::VARCHAR AS batch_id, count(*) FILTER (role <> 'system') AS processed_pages, count(*) FILTER (role = 'system') AS failed_pages, count(*) AS total_pages FROM conversations GROUP BY 1",
)
def stream_progress(a):
    rows = _drain(a, "conversations", lambda s: J.page_progress(_conversation_pages(s), "batch_id"), mode="update")
    last = rows.groupBy("batch_id").agg(F.max_by(F.struct("processed_pages", "failed_pages", "total_pages"), "_epoch").alias("r"))
    return last.select("batch_id", "r.*")


@register("stream_operation_state", "SELECT operation_id, event_id, status, stage FROM state", state=STATE)
def stream_operation_state(a):
    """Batch twin of the keyed state."""
    return J.operation_state(a.operation_event()).select("operation_id", "event_id", "status", "stage")


SLICES = 3
LATENESS = 60  # seconds


def _drain_slices(a, build, mode="update"):
    """Operation events written in slices of time, each drained by a new run of the stream from one checkpoint."""
    folder = J.new_location(a.spark, "slices")
    out, checkpoint = J.locations(a.spark, "operations")
    events = a.operation_event().withColumn("updated_at", F.col("updated_at").cast("timestamp")).withColumn("batch_id", F.concat(F.lit("batch_"), (F.col("operation_id") % 20).cast("string")))
    ends = events.agg(F.min("updated_at").cast("double").alias("a"), F.max("updated_at").cast("double").alias("b")).first()
    cuts = [ends.a + (ends.b - ends.a) * i / SLICES for i in range(1, SLICES)]
    at = F.col("updated_at").cast("double")
    number = sum((F.when(at >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    session = J.isolated_session(a.spark)
    for i in range(SLICES):
        events.where(number == i).write.mode("append").parquet(folder)
        J.run_available(build(session.readStream.schema(events.schema).parquet(folder)), out, checkpoint, mode)
    return a.spark.read.parquet(out)


KEYED = f"""
  SELECT s.operation_id, s.event_id, CASE WHEN old THEN 'failed' ELSE status END AS status, CASE WHEN old THEN 'stale' ELSE stage END AS stage
  FROM (SELECT *, status = 'processing' AND stage <> 'timeout_waiting' AND epoch_ms(updated_at) + 43200000 <= (SELECT max(epoch_ms(ts)) - {LATENESS * 1000} FROM events) AS old FROM state) s"""


@register("stream_operation_state_keyed", KEYED, state=STATE)
def stream_operation_state_keyed(a):
    """The state processor from a standing table (the first event of each operation), over several runs; the last row per operation."""
    first = a.operation_event().groupBy("operation_id").agg(F.min_by(F.struct(*J.OPERATION.names[1:]), F.struct("updated_at", "event_id")).alias("e")).select("operation_id", "e.*")
    # a cancellation outlasts this table
    rows = _drain_slices(a, lambda events: J.operation_state_stream(events, lateness=f"{LATENESS} seconds", keep_seconds=90 * 86_400, initial=first))
    return _last_rows(rows.select(*J.OPERATION.names).union(first.select(*J.OPERATION.names)))


def _last_rows(rows):
    rest = [c for c in J.OPERATION.names if c != "operation_id"]
    order = F.struct("updated_at", "event_id", F.col("stage") == "stale")
    return rows.groupBy("operation_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("operation_id", "r.event_id", "r.status", "r.stage")


# events in order per operation: one is heard unless a cancellation within the last two days is remembered
HEARD = """
  WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY operation_id ORDER BY updated_at, event_id) AS n FROM operation_event),
  walk AS (
    SELECT operation_id, n, event_id, status, stage, updated_at, true AS heard, CASE WHEN status = 'cancelled' THEN updated_at END AS cancelled FROM ordered WHERE n = 1
    UNION ALL
    SELECT o.operation_id, o.n, o.event_id, o.status, o.stage, o.updated_at, w.cancelled IS NULL OR o.updated_at > w.cancelled + INTERVAL 2 DAY,
           CASE WHEN w.cancelled IS NULL OR o.updated_at > w.cancelled + INTERVAL 2 DAY THEN CASE WHEN o.status = 'cancelled' THEN o.updated_at END ELSE w.cancelled END
    FROM walk w JOIN ordered o ON o.operation_id = w.operation_id AND o.n = w.n + 1)
  SELECT operation_id, event_id, status, stage, updated_at, lead(updated_at) OVER (PARTITION BY operation_id ORDER BY updated_at, event_id) AS following FROM walk WHERE heard"""


@register("stream_operation_expiry", "SELECT operation_id, event_id, status, stage FROM heard", heard=HEARD)
def stream_operation_expiry(a):
    """Every event that the operations heard, a cancellation being remembered for two days: what the store's expiry leaves."""
    rows = _drain_slices(a, lambda events: J.operation_state_stream(events, lateness=f"{LATENESS} seconds", keep_seconds=2 * 86_400, every=True))
    return rows.where("stage <> 'stale'").select("operation_id", "event_id", "status", "stage")


@register(
    "stream_stale_timeout",
    f"""SELECT operation_id, event_id, epoch_us(updated_at) + 43200000000 AS stale_at_us FROM heard
        WHERE status = 'processing' AND stage <> 'timeout_waiting' AND (following >= updated_at + INTERVAL 12 HOUR OR (following IS NULL AND epoch_ms(updated_at) + 43200000 <= (SELECT max(epoch_ms(ts)) - {LATENESS * 1000} FROM events)))""",
    heard=HEARD,
)
def stream_stale_timeout(a):
    """Operations closed by their timers as the watermark advances over several runs, with the moment."""
    rows = _drain_slices(a, lambda events: J.operation_state_stream(events, lateness=f"{LATENESS} seconds", keep_seconds=2 * 86_400))
    return rows.where("stage = 'stale'").select("operation_id", "event_id", F.unix_micros("updated_at").alias("stale_at_us"))


@register(
    "stale_operations",
    "SELECT operation_id, CASE WHEN old THEN 'failed' ELSE status END AS status, CASE WHEN old THEN 'stale' ELSE stage END AS stage FROM (SELECT *, status = 'processing' AND stage <> 'timeout_waiting' AND epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(updated_at)) >= 43200 AS old FROM state)",
    state=STATE,
)
def stale_operations(a):
    state = J.operation_state(a.operation_event())
    return J.stale_operations(state, "2024-01-31 00:00:00").select("operation_id", "status", "stage")


LEVELS = """
  SELECT 'batch_' || (operation_id % 20)::VARCHAR AS batch_id, operation_id, updated_at::DATE AS day, max(processed_pages) AS processed_pages, max(failed_pages) AS failed_pages, max(total_pages) AS total_pages
  FROM operation_event WHERE epoch_ms((updated_at::DATE + 1)::TIMESTAMP) <= (SELECT max(epoch_ms(ts)) - 60000 FROM events) GROUP BY ALL"""


@register(
    "stream_progress_levels",
    """SELECT 'file' AS level, day, batch_id, operation_id, processed_pages, failed_pages, total_pages, 1::BIGINT AS files FROM levels
       UNION ALL SELECT 'batch', day, batch_id, NULL, sum(processed_pages)::BIGINT, sum(failed_pages)::BIGINT, sum(total_pages)::BIGINT, count(*) FROM levels GROUP BY day, batch_id""",
    levels=LEVELS,
)
def stream_progress_levels(a):
    """Finished days per file and per batch from one stream of chained aggregates."""
    return _drain_slices(a, lambda events: J.progress_levels(events, f"{LATENESS} seconds"), mode="append")


@register(
    "stream_search_analytics",
    "SELECT type_recherche, d AS search_date, count(*) AS total_searches, avg(resultats_trouves) AS avg_results, sum(correction_utilisateur)::BIGINT AS corrections FROM (SELECT *, date_recherche::DATE AS d FROM recherche_log) GROUP BY ALL",
)
def stream_search_analytics(a):
    """Every day: an open one counts with its last update, a closed one does not change again."""
    rows = _drain(a, "events", lambda s: J.search_analytics_stream(s.recherche_log()), mode="update")
    last = rows.groupBy("type_recherche", "search_date").agg(F.max_by(F.struct("total_searches", "avg_results", "corrections"), "_epoch").alias("r"))
    return last.select("type_recherche", "search_date", "r.*")


@register(
    "stream_confirmations",
    """SELECT coalesce(v.etudiant_id, k.sid) AS etudiant_id, coalesce(v.variation, k.normed) AS variation, (coalesce(v.frequence, 0) + coalesce(k.n, 0))::BIGINT AS frequence
       FROM variation_nom v FULL JOIN (SELECT sid, normed, count(*) AS n FROM conf GROUP BY ALL) k ON k.sid = v.etudiant_id AND k.normed = v.variation""",
    conf=CONF,
)
def stream_confirmations(a):
    """Each micro-batch merged into the standing variations; the table after the last one."""
    out, checkpoint = J.locations(a.spark, "confirmations")
    session = J.isolated_session(a.spark)
    stream = StreamArchive(session, a.folder, "events").confirmation()
    standing = Archive(a.spark, a.folder)
    names = ["etudiant_id", "variation", "frequence"]
    standing.variation_nom().select(names).write.parquet(f"{out}/version=0")

    def learn(batch, epoch):
        # a version per micro-batch, made from the one before it: writing it again changes nothing
        own = batch.sparkSession
        before = own.read.parquet(f"{out}/version={epoch}")
        merged = Le.confirm_selection(batch, Archive(own, a.folder).etudiant(), before)
        merged.select(names).write.mode("overwrite").parquet(f"{out}/version={epoch + 1}")

    query = J.confirmations_stream(stream, learn, checkpoint)
    query.awaitTermination()
    last = query.lastProgress
    version = 0 if last is None else last.batchId + 1
    return a.spark.read.parquet(f"{out}/version={version}").select("etudiant_id", "variation", F.col("frequence").cast("long").alias("frequence"))
