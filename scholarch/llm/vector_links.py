"""Near-duplicate vectors by quantised tile products.

Vectors of one label are dealt into tiles of bounded size, and every two tiles of a label meet in
one task.  A unit vector x is quantised to 8-bit integers q with x = s*q + e, |e| <= err, so that
for two of them x.y differs from s*t*(q.r) by at most |s*q|*err' + err*|t*r| + err*err'.  The
product of two tiles is taken over the integers (exact), and only pairs whose upper bound reaches
the threshold are computed again in double precision from the original vectors.  No link is lost
and none is made by the estimate.

A task gives one row for each vector that has a link in its two tiles: how many, and the smallest
member of what they connect there.  Pairs are never listed, so a family of near copies costs a row
a member and tile pair.  Copies of a vector are one entry with a count.

The work grows with the square of a label's different vectors, as the method has it; the tasks,
of at most `ROWS` x `ROWS` pairs each, are dealt evenly whatever share of the rows one label holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarch.llm.common import column
from scholarch.llm.components import components, joined
from scholarch.session import materialize

LEAST = 0.98
ROWS = 8192  # vectors of a tile, at most about
TILE_BYTES = 1 << 24  # and bytes of its vectors
STRIP = 512  # rows of a tile multiplied at a time
DENSE = 0.05  # pairs of a strip are computed again as a matrix product from this share on
EXACT_SUM = 1024  # columns whose products of 8-bit integers add up exactly in single precision
SLACK = 1e-12  # above the rounding of the norms and bounds themselves


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by a power of two first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Tile:
    """Unit vectors, their 8-bit forms (held as floats for the product) and error bounds."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, node: np.ndarray):
        order = np.argsort(node)
        self.node, self.copies = node[order], copies[order]
        self.unit = unit(x[order])
        self.scale = np.abs(self.unit).max(axis=1) / 127
        q = np.rint(self.unit / self.scale[:, None])
        self.codes = q.astype(np.int8).astype(np.float32)
        self.err = np.sqrt(((self.unit - self.scale[:, None] * q) ** 2).sum(axis=1)) + SLACK
        self.size = self.scale * np.sqrt((q * q).sum(axis=1)) + SLACK

    def __len__(self) -> int:
        return len(self.node)


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of 8-bit integers, exact."""
    if a.shape[1] <= EXACT_SUM:
        return a @ b.T
    return sum((a[:, c : c + EXACT_SUM] @ b[:, c : c + EXACT_SUM].T).astype(np.float64) for c in range(0, a.shape[1], EXACT_SUM))


def strip_links(a: Tile, b: Tile, rows: slice, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (in a, in b) of this strip of rows whose cosine is at least `least`."""
    slack = a.size[rows] * b.err.max() + a.err[rows] * (b.size.max() + b.err.max())
    # coarse bound with the tile's largest errors, a little low for single precision
    low = (least - slack) / a.scale[rows]
    estimate = integer_products(a.codes[rows], b.codes) * b.scale[None, :].astype(np.float32)
    i, j = np.nonzero(estimate >= (low - 1e-5 * np.abs(low))[:, None].astype(np.float32))
    i += rows.start
    if same:
        i, j = i[i < j], j[i < j]
    dots = estimate[i - rows.start, j] * a.scale[i]
    bound = dots + 1e-5 * np.abs(dots) + a.size[i] * b.err[j] + a.err[i] * (b.size[j] + b.err[j])
    i, j = i[bound >= least], j[bound >= least]
    if len(i) > DENSE * estimate.size:
        real = (a.unit[rows] @ b.unit.T)[i - rows.start, j]
    else:
        pieces = [(a.unit[i[c : c + 32768]] * b.unit[j[c : c + 32768]]).sum(axis=1) for c in range(0, len(i), 32768)]
        real = np.concatenate(pieces) if pieces else np.zeros(0)
    return i[real >= least], j[real >= least]


def tile_links(a: Tile, b: Tile | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of the nodes that have links between the tiles, or inside `a` without `b`."""
    same, b = b is None, a if b is None else b
    shift = 0 if same else len(a)
    node = a.node if same else np.concatenate((a.node, b.node))
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    for at in range(0, len(a), STRIP):
        i, j = strip_links(a, b, slice(at, min(at + STRIP, len(a))), least, same)
        np.add.at(links, i, b.copies[j])
        np.add.at(links, j + shift, a.copies[i])
        root = joined(root, i, j + shift)
    found = np.flatnonzero(links)
    return node[found], links[found], node[root[found]]


def entries(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows as id, label, vec; one entry per different vector of a label as node, label, d, vec, least, copies).

    The second holds only vectors that can link: those with a label, without null or non-finite
    components, and not zero.
    """
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("vec"))
    taking = own.where(
        F.col("label").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("vec", lambda c: c != 0)
    )
    alike = taking.groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    # the number is given once, when the table is written
    return own, materialize(alike.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vec").alias("d"), "vec", "least", "copies"), "vector-entries")


def links_by_tiles(nodes: DataFrame, least: float = LEAST, rows: int = ROWS) -> DataFrame:
    """(node, links, root) per linked node and tile pair, written.

    `nodes` has node, label, d, vec, copies.  `links` counts rows linked in that pair of tiles, a
    copy each; `root` is a node that it is connected with.
    """

    def solve(group: pa.Table) -> pa.Table:
        tile = group["tile"].to_numpy()
        dim, lo, hi = group["d"][0].as_py(), group["lo"][0].as_py(), group["hi"][0].as_py()
        x = group["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        copies, node = group["copies"].to_numpy(), group["node"].to_numpy()
        sides = [Tile(x[tile == t], copies[tile == t], node[tile == t]) for t in ([lo] if lo == hi else [lo, hi])]
        out = tile_links(sides[0], sides[1] if len(sides) > 1 else None, least) if all(map(len, sides)) else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("node", "links", "root"), out, strict=True)})

    spark = nodes.sparkSession
    most = F.greatest(F.lit(1), F.least(F.lit(rows), (F.lit(TILE_BYTES) / (F.col("d") * 8)).cast("int")))
    sizes = nodes.groupBy("label", "d").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / most).cast("int"))
    dealt = nodes.join(sizes, ["label", "d"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = met.select("label", "d", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "node", "vec", "copies")
    keys = ["label", "d", "lo", "hi"]
    # few bytes, much work: a fixed number of tasks that is not merged by size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return materialize(pairs.repartition(tasks, *keys).groupBy(*keys).applyInArrow(solve, "node long, links long, root long"), "tile-links")


def near_duplicates(vectors: DataFrame, least: float = LEAST, rows: int = ROWS, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null, they are of one length, and their
    cosine is at least `least`.  `n_links` counts the other rows linked directly, `component_id` is
    the smallest id reachable.  Null, empty and zero vectors, those with a null or non-finite
    component and those without a label link with nothing and stand for themselves.  Rows with a
    repeated id are vectors of their own.  A row with a null id takes part but names no component:
    one that only null ids share is null, and such rows are kept.  Other columns are ignored; an
    empty table gives no rows.
    """
    own, nodes = entries(vectors, id_col, label_col, vector_col)
    found = links_by_tiles(nodes, least, rows)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = nodes.select("node", "least").join(linked, "node")
    first = placed.groupBy("component").agg(F.min("least").alias("first"))
    named = materialize(placed.join(first, "component").select("node", "first").join(counts, "node"), "linked-vectors")
    whole = nodes.join(named, "node", "left").select(
        "label",
        "vec",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("first", "least").alias("component_id"),
    )
    # a row that is alone needs no second look at its vector
    busy = whole.where("n_links > 0")
    out = own.join(busy, ["label", "vec"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))
