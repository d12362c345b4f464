"""Helpers shared by the corpus operators."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# characters of text handled at once inside a Python task
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def collect_garbage(spark: SparkSession) -> None:
    """Let go of what finished jobs left: Spark frees shuffle files and broadcasts when the driver's JVM collects what named them.

    A long chain of small jobs fills neither heap nor disk fast enough to cause that by itself, and a
    heap that has grown is not given back.
    """
    spark.sparkContext._jvm.System.gc()


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Split Arrow batches so that one slice holds about `chars` characters; null texts become ''."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = size = 0
        texts: list[str] = []
        for i in range(batch.num_rows):
            value = column[i].as_py() or ""
            texts.append(value)
            size += len(value)
            if size >= chars:
                yield batch.slice(start, i + 1 - start), texts
                start, size, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start), texts


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def held_out(doc_id="doc_id"):
    """True for the fifth of all ids whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """Texts and labels of at most `limit` labelled documents outside the held-out fifth.

    The sample is the `limit` lowest hashes of doc_id, so it is the same on every run and does
    not follow the order of the table.  A doc_id labelled twice counts with its lower label, one
    that occurs twice among the documents with its smaller text.  At most `limit` rows are
    broadcast or returned, whatever the size of the tables.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )


def chunked(items: Iterable, n: int) -> Iterator[list]:
    it = iter(items)
    while part := list(itertools.islice(it, n)):
        yield part
