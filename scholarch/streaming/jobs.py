"""Streaming jobs.

Every job takes a streaming DataFrame and shared-folder locations, so it can run for ever on
a cluster; `run_available` drains what is there (availableNow) for back-fills and tests.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from scholarch.functions.labels import TERMINAL_STATUSES
from scholarch.operators.reporting import progress_columns
from scholarch.schemas import RUN
from scholarch.session import new_location

STALE_SECONDS = 43_200
STALE_STAGE_EXEMPT = "timeout_waiting"
CANCELLED = ("cancelled", "canceled")
KEEP_SECONDS = 604_800  # how long a cancellation, or a wait on a timeout, is remembered


def read_runs(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """Extraction runs as they appear below a folder: files of one JSON document or an array of them, over any lines.

    A file that is not JSON is passed over; `files_at_once` bounds a micro-batch.
    """
    reader = spark.readStream.schema(RUN).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True)
    return (reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)).json(folder)


def read_table_stream(spark: SparkSession, folder: str, table: str, schema: StructType) -> DataFrame:
    """A table as a stream: one Parquet file or a folder of part files.

    The pattern makes the source list what it names; a plain path would have to be a folder.
    """
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


def run_available(stream: DataFrame, output: str, checkpoint: str, mode: str = "append") -> list:
    """Drain the available input into Parquet; the checkpoint makes reruns exactly-once.

    Returns the progress reports of the micro-batches.
    """
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", output)
    else:
        # update/complete results replace the former ones per micro-batch, under the batch id
        def write(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{output}/epoch={epoch}")

        query = stream.writeStream.foreachBatch(write)
    running = query.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return running.recentProgress


def run_some(stream: DataFrame, output: str, checkpoint: str, batches: int, wait_seconds: float = 120.0) -> int:
    """Run a stream into Parquet and stop it after `batches` micro-batches at least, in the middle of its input.

    A later run with the same checkpoint goes on from there.  Returns the number of the last batch
    known to be done; -1 if none was within the wait.
    """
    running = stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    end = time.monotonic() + wait_seconds
    done = -1
    while done + 1 < batches and time.monotonic() < end and running.isActive:
        time.sleep(0.05)
        done = max([done, *(p["batchId"] for p in running.recentProgress if p["numInputRows"] > 0)])
    running.stop()
    return done


def ingest_runs(runs: DataFrame) -> DataFrame:
    """One row per page of every new run (append)."""
    return runs.select("file_path", F.explode("pages").alias("p")).select("file_path", "p.page_number", "p.status", "p.image_path", "p.error")


def page_progress(pages: DataFrame, key: str) -> DataFrame:
    """Running page counts per key with percent and message (update mode)."""
    counts = pages.groupBy(key).agg(
        F.count_if(F.col("status") == "ok").alias("processed_pages"),
        F.count_if(F.col("status") != "ok").alias("failed_pages"),
        F.count("*").alias("total_pages"),
    )
    return counts.select("*", *progress_columns(F.col("processed_pages"), F.col("failed_pages"), F.col("total_pages")))


def search_analytics_stream(log: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Daily search metrics per type; state of a day goes when the watermark passes it (update or append)."""
    corrected = F.sum(F.when(F.col("correction_utilisateur") != 0, 1).otherwise(0))
    return (
        log.withColumn("date_recherche", F.col("date_recherche").cast("timestamp"))
        .withWatermark("date_recherche", lateness)
        .groupBy(F.window("date_recherche", "1 day").alias("w"), "type_recherche")
        .agg(F.count("*").alias("total_searches"), F.avg("resultats_trouves").alias("avg_results"), corrected.alias("corrections"))
        .select("type_recherche", F.to_date("w.start").alias("search_date"), "total_searches", "avg_results", "corrections")
    )


def confirmations_stream(confirmations: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Feed each micro-batch of confirmations to `apply(batch, epoch)`, e.g. a variation merge.

    `apply` must be idempotent per epoch (write under the epoch), since a batch can be
    delivered again after a failure.
    """
    return confirmations.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- operation state ----------------------------------------------------------------------------
OPERATION = StructType(
    [
        StructField("operation_id", LongType()),
        StructField("event_id", LongType()),
        StructField("status", StringType()),
        StructField("stage", StringType()),
        StructField("total_pages", LongType()),
        StructField("processed_pages", LongType()),
        StructField("failed_pages", LongType()),
        StructField("updated_at", TimestampType()),
    ]
)
_STATE = StructType(OPERATION.fields[1:])


class OperationTracker(StatefulProcessor):
    """Last write wins per operation; a cancelled operation ignores what follows for `keep_seconds`.

    A processing operation (unless waiting on a timeout) without an update for `stale_seconds` of
    event time is emitted once as failed/stale, as of the moment its time ran out: by a timer when
    the watermark passes that moment, or before the next update where both come in one micro-batch.

    The store holds open operations and recent cancellations only.  Completed, failed and stale
    operations leave it at once, since any later update would replace them anyway; a cancellation
    and an operation waiting on a timeout leave after `keep_seconds` by a timer, without a row.
    """

    def __init__(self, stale_seconds: int = STALE_SECONDS, keep_seconds: int = KEEP_SECONDS, every: bool = False):
        self.every = every  # emit each event that is heard, not the last one of a micro-batch only
        self.stale = pd.Timedelta(seconds=stale_seconds)
        self.keep = pd.Timedelta(seconds=keep_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("operation", _STATE)

    def _held(self) -> dict | None:
        kept = self.state.get()
        if kept is None:
            return None
        held = dict(zip(_STATE.names, kept, strict=True))
        held["updated_at"] = pd.Timestamp(held["updated_at"])
        return held

    def _expires(self, held: dict) -> bool:
        """Whether silence ends this operation."""
        return held["status"] not in TERMINAL_STATUSES and held["stage"] != STALE_STAGE_EXEMPT

    def _closed(self, held: dict) -> dict:
        return {**held, "status": "failed", "stage": "stale", "updated_at": held["updated_at"] + self.stale}

    def _end(self, held: dict) -> int | None:
        """When the timer of this operation runs out; None: it is not kept at all."""
        if held["status"] in TERMINAL_STATUSES and held["status"] not in CANCELLED:
            return None
        return int((held["updated_at"] + (self.stale if self._expires(held) else self.keep)).timestamp() * 1000)

    def _hold(self, held: dict, before: dict | None) -> None:
        """Keep `held` in the place of what the store held; a kept operation has the one timer that follows from it.

        Every call of the store or the timers is a message to the executor, so none is made for what is known.
        """
        end, old = self._end(held), None if before is None else self._end(before)
        if old is not None and old != end:
            self.handle.deleteTimer(old)
        if end is None:
            if before is not None:
                self.state.clear()
            return
        plain = {n: held[n] if n in ("status", "stage") else held[n].to_pydatetime() if n == "updated_at" else int(held[n]) for n in _STATE.names}
        self.state.update(tuple(plain[n] for n in _STATE.names))
        if old != end:
            self.handle.registerTimer(end)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.sort_values(["updated_at", "event_id"], kind="stable").iloc[-1]
        self._hold({n: last[n] for n in _STATE.names}, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, out, changed = self._held(), [], False
        held = before
        events = [dict(zip(_STATE.names, e)) for part in rows for e in zip(*(part[n].tolist() for n in _STATE.names))]
        for event in sorted(events, key=lambda e: (e["updated_at"], e["event_id"])):
            if held is not None:
                if (event["updated_at"], event["event_id"]) <= (held["updated_at"], held["event_id"]):
                    continue
                if held["status"] in CANCELLED and event["updated_at"] <= held["updated_at"] + self.keep:
                    continue
                if self._expires(held) and event["updated_at"] >= held["updated_at"] + self.stale:
                    out.append(self._closed(held))
            held, changed = event, True
            if self.every:
                out.append(held)
        if changed:
            if not self.every:
                out.append(held)
            self._hold(held, before)
        if out:
            yield pd.DataFrame([[key[0], *(o[n] for n in _STATE.names)] for o in out], columns=OPERATION.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held is None:
            return
        self.state.clear()
        if self._expires(held):
            closed = self._closed(held)
            yield pd.DataFrame([[key[0], *(closed[n] for n in _STATE.names)]], columns=OPERATION.names)

    def close(self) -> None:
        pass


def operation_state_stream(
    events: DataFrame, stale_seconds: int = STALE_SECONDS, lateness: str = "1 minute", keep_seconds: int = KEEP_SECONDS, initial: DataFrame | None = None, every: bool = False
) -> DataFrame:
    """Keyed operation state with event-time staleness (update mode); rows as they are written or run out.

    `initial` (columns of OPERATION, one row per operation) is the state to start from, e.g. a
    standing table; it is read once, when the checkpoint is new.  With `every`, all updates that an
    operation heard come out, not only the last one of a micro-batch.
    """
    start = None if initial is None else initial.select(*OPERATION.names).withColumn("updated_at", F.col("updated_at").cast("timestamp")).groupBy("operation_id")
    return (
        events.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
        .withWatermark("updated_at", lateness)
        .groupBy("operation_id")
        .transformWithStateInPandas(
            statefulProcessor=OperationTracker(stale_seconds, keep_seconds, every), outputStructType=OPERATION, outputMode="Update", timeMode="EventTime", initialState=start
        )
    )


def progress_levels(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Daily page counts per file (operation) and, on top of those, per batch, in one stream (append).

    The counters of a file are running totals, so its day has their highest values; a batch's day adds
    up its files.  Rows come when the watermark passes the day, and their state ends with them.
    """
    timed = events.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", lateness)
    pages = ("processed_pages", "failed_pages", "total_pages")
    files = timed.groupBy(F.window("updated_at", "1 day").alias("w"), "batch_id", "operation_id").agg(*[F.max(c).alias(c) for c in pages])
    batches = files.groupBy(F.window("w", "1 day").alias("w"), "batch_id").agg(*[F.sum(c).alias(c) for c in pages], F.count("*").alias("files"))
    day = F.to_date("w.start").alias("day")
    one = files.select(F.lit("file").alias("level"), day, "batch_id", "operation_id", *pages, F.lit(1).cast("long").alias("files"))
    return one.unionByName(batches.select(F.lit("batch").alias("level"), day, "batch_id", F.lit(None).cast("long").alias("operation_id"), *pages, "files"))


def operation_state(events: DataFrame) -> DataFrame:
    """Batch twin: the first cancellation if any, else the last event; an aggregate with map-side combine."""
    rest = [c for c in events.columns if c != "operation_id"]
    at = F.struct("updated_at", "event_id")
    packed = F.struct(*rest)
    cancelled = F.col("status").isin(*CANCELLED)
    return (
        events.groupBy("operation_id")
        .agg(F.min_by(packed, F.when(cancelled, at)).alias("c"), F.max_by(packed, at).alias("l"))
        .select("operation_id", F.coalesce("c", "l").alias("s"))
        .select("operation_id", "s.*")
        .withColumn("terminal", F.col("status").isin(*TERMINAL_STATUSES))
    )


def stale_operations(state: DataFrame, now: str, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """Batch twin of the timer: state as of `now`, silent processing operations marked failed/stale."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("updated_at")
    stale = (F.col("status") == "processing") & (F.col("stage") != STALE_STAGE_EXEMPT) & (age >= stale_seconds)
    text = F.lit(f"No update within {stale_seconds} s: closed as failed.")
    return state.withColumns(
        {
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            "stage": F.when(stale, "stale").otherwise(F.col("stage")),
            "error": F.when(stale, text),
        }
    )


def isolated_session(spark: SparkSession) -> SparkSession:
    """A session of its own for a drained stream: state stores sized to the cores, not to 200."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone",):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def locations(spark: SparkSession, label: str) -> tuple[str, str]:
    return new_location(spark, f"{label}-out"), new_location(spark, f"{label}-checkpoint")
