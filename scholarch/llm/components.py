"""Connected components of a link table.

Links of a counted and bounded number are solved in one task of a few dozen megabytes; more of
them by large-star and small-star rounds, whatever their number.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarch.llm.common import column
from scholarch.session import materialize

ONE_TASK = 1_000_000  # links


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each connected set after adding the links (i, j)."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != root[root]).any():
            root = root[root]


def _solved(links: DataFrame) -> DataFrame:
    """(node, component) of links that fit one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(column(b, "u").to_numpy(), column(b, "v").to_numpy()) for b in batches]
        if ends:
            u, v = (np.concatenate(c) for c in zip(*ends, strict=True))
            nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
            root = joined(np.arange(len(nodes)), at[: len(u)], at[len(u) :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])

    return links.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Connect every smaller neighbour of a node, and the node, to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, one_task: int = ONE_TASK, written: bool = False) -> DataFrame:
    """(node, component) for all nodes of `links` (u, v: long); component is the smallest node.

    `written` says that `links` only reads tables, so it is counted and read as it stands.

    Each round writes its links to the shared folder, so lineage stays short and lost executors
    cost one round.  The rounds needed grow with the logarithm of the longest chain.  Only counts
    and a checksum of the links return to the driver.
    """
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if not written:
        now = materialize(now, "links")
    if now.count() <= one_task:
        return _solved(now)
    now = materialize(now.distinct(), "links")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = mark
        now = materialize(_small_star(_large_star(now)), "links")
