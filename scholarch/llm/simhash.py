"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32.  If two fingerprints differ in at most
three bits, one of the segments differs in at most one.  So each fingerprint is indexed under both
segments as they are and under the 32 variants of each with one bit made a wildcard, and equal
keys meet.  A bucket of an exact segment links any two members; a bucket of a wildcard needs to
link only members that differ in that bit, because the others meet in the exact bucket as well.

Only different fingerprints take part, so copies of a text count once however many there are.  A
bucket keeps few links, enough to connect what it holds: nothing emits all its pairs.  A bucket of
more than BUCKET members is not compared as a whole: its members are indexed anew by the same rule
over the halves of their other segment (32 bits, then 16), which leaves at most 2^(8+3) members
that a last bucket can hold.  No bucket is capped and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarch.llm.common import column, text_slices
from scholarch.llm.components import components
from scholarch.session import materialize

SEED = 42
BUCKET = 2048
SMALL = 12  # buckets up to this size are compared by shifted copies of the whole batch


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits set in more than half of the shingles' XXH64 values; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.concatenate(([0], ends[:-shingle]))
        digest = xxhash.xxh64_intdigest
        spans = zip(begins.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(begins))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: long with the 64 bits) per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "_text"):
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(run, schema)


def _unary(fn):
    """Hide default arguments from Spark, which counts the parameters of a lambda."""
    return lambda x: fn(x)


def _indexed(rows: DataFrame, start: int, width: int) -> DataFrame:
    """Rows (base, fp) under the keys of both halves of bits [start, start + width).

    A half is indexed as it is and with each of its bits cleared in turn; `wild` is the cleared
    bit of the fingerprint (-1: none) and `rest` where the other half starts.
    """
    half = width // 2
    parts = []
    for low in (start, start + half):
        rest = start + half if low == start else start
        segment = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(low)).bitwiseAND(F.lit((1 << half) - 1))

        def variant(p, segment=segment, low=low):
            cleared = segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(p, F.lit(0)))))
            return F.struct(
                F.xxhash64("base", F.lit(low), p, F.when(p < 0, segment).otherwise(cleared)).alias("key"),
                F.when(p < 0, p).otherwise(p + F.lit(low)).cast("tinyint").alias("wild"),
            )

        keys = F.transform(F.sequence(F.lit(-1), F.lit(half - 1)), _unary(variant))
        parts.append(rows.select(F.explode(keys).alias("v"), "fp").select("v.key", "v.wild", F.lit(rest).cast("tinyint").alias("rest"), "fp"))
    return parts[0].union(parts[1])


def _spanning(fp: np.ndarray, wild: int, most: int) -> list[tuple[int, int]]:
    """Index pairs that connect all linked members of one bucket, found by growing each cluster.

    Each member is compared once with the members not reached yet.
    """
    links = []
    if wild >= 0:  # only links across the wildcard bit are this bucket's own
        side = (fp >> np.uint64(wild)) & np.uint64(1)
    left = np.arange(len(fp))
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= most
            if wild >= 0:
                near &= side[left] != side[i]
            if near.any():
                found = left[near]
                links.extend((int(i), int(j)) for j in found)
                stack.extend(found)
                left = left[~near]
    return links


def _bucket_links(keyed: DataFrame, most: int, bucket: int) -> DataFrame:
    """Rows of (u, v) links, and of (base, fp, rest) for members of buckets over `bucket`.

    Rows are dealt by key and sorted; a task reads them as a stream and holds at most one batch
    and `bucket` further rows.
    """

    def emit(links: list[tuple[np.ndarray, np.ndarray]], overflow: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        us, vs = [], []
        for a, b in links:
            for u, v in zip(a.tolist(), b.tolist(), strict=True):
                ru, rv = find(u), find(v)
                if ru != rv:  # links that close a circle connect nothing new
                    parent[max(ru, rv)] = min(ru, rv)
                    us.append(u)
                    vs.append(v)
        over = [np.concatenate(c) for c in zip(*overflow, strict=True)] if overflow else [np.zeros(0, np.int64)] * 3
        n, m = len(us), len(over[0])
        no_link, no_row = np.arange(n + m) >= n, np.arange(n + m) < n
        ends = [pa.array(np.concatenate((np.array(c, np.int64), np.zeros(m, np.int64))), mask=no_link) for c in (us, vs)]
        rows = [pa.array(np.concatenate((np.zeros(n, np.int64), c)), mask=no_row) for c in over]
        return pa.RecordBatch.from_arrays(ends + rows, names=["u", "v", "base", "fp", "rest"])

    def solve(key, wild, rest, fp, links, overflow) -> None:
        """Work off the buckets of these sorted rows, all of them whole."""
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(begins, len(key)))
        size_of = np.repeat(sizes, sizes)
        u64 = fp.view(np.uint64)
        rows = np.flatnonzero((size_of > 1) & (size_of <= SMALL))
        for shift in range(1, SMALL):
            i = rows[rows + shift < len(key)]
            i = i[key[i] == key[i + shift]]
            if not len(i):
                break
            near = i[(np.bitwise_count(u64[i] ^ u64[i + shift]) <= most) & (fp[i] != fp[i + shift])]
            links.append((fp[near], fp[near + shift]))
        for b, n in zip(begins[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            part = slice(b, b + n)
            if n > bucket:
                overflow.append((key[part], fp[part], rest[part].astype(np.int64)))
            elif pairs := _spanning(u64[part], int(wild[b]), most):
                ends = np.array(pairs)
                links.append((fp[part][ends[:, 0]], fp[part][ends[:, 1]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last bucket so far, which may go on
        passing = None  # key of a bucket that is passed on because it is too large
        for batch in batches:
            cols = [column(batch, n).to_numpy(zero_copy_only=False) for n in ("key", "wild", "rest", "fp")]
            links: list = []
            overflow: list = []
            if held is not None:
                cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
                held = None
            if passing is not None and len(cols[0]):
                other = cols[0] != passing
                n = int(other.argmax()) if other.any() else len(other)
                overflow.append((cols[0][:n], cols[3][:n], cols[2][:n].astype(np.int64)))
                if n < len(other):
                    passing = None
                cols = [c[n:] for c in cols]
            if len(cols[0]):
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                if cut:
                    solve(*(c[:cut] for c in cols), links, overflow)
                tail = [c[cut:] for c in cols]
                if len(tail[0]) > bucket:
                    passing = tail[0][0]
                    overflow.append((tail[0], tail[3], tail[2].astype(np.int64)))
                else:
                    held = tail
            if links or overflow:
                yield emit(links, overflow)
        if held is not None and len(held[0]) > 1:
            links, overflow = [], []
            solve(*held, links, overflow)
            yield emit(links, overflow)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long, base long, fp long, rest long")


def fingerprint_links(prints: DataFrame, most: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between the fingerprints of `prints` (fp: long, all different).

    Any two within `most` bits are connected, directly or over others; no link joins fingerprints
    further apart than that.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments serve at most 3 differing bits")
    keyed = _indexed(prints.select(F.lit(0).cast("long").alias("base"), "fp"), 0, 64)
    links = None
    for width in (64, 32, 16):
        last = width == 16
        out = materialize(_bucket_links(keyed, most, 1 << 30 if last else bucket), "bucket-links")
        found = out.where("u is not null").select("u", "v")
        links = found if links is None else links.union(found)
        over = out.where("base is not null").select("base", "fp", "rest")
        if last or over.isEmpty():
            break
        # index the part of the fingerprint that the bucket's key does not hold; its start has few values
        parts = [_indexed(over.where(F.col("rest") == at), at, width // 2) for at in range(0, 64, width // 2)]
        keyed = parts[0]
        for more in parts[1:]:
            keyed = keyed.union(more)
    return links.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over fingerprints that differ in at most `most`
    bits.  Null and empty texts and those of white space have fingerprint zero and are linked
    like any other.  Repeated rows are kept and share a component; an id with several texts may
    be in several.  Rows with a null id take part but never name a component: one of null ids
    only has a null component_id.  Other columns are ignored; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    linked = components(fingerprint_links(nodes.select("fp"), most, bucket))
    # only fingerprints that have a neighbour are in `linked`
    placed = materialize(linked.join(nodes, linked.node == nodes.fp).select("fp", "component", "least"), "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(placed.join(least, "component").select("fp", F.col("component_id").alias("found"), F.lit(True).alias("hit")), "fp", "left").select(
        "fp", F.when(F.col("hit"), F.col("found")).otherwise(F.col("least")).alias("component_id")
    )
    return prints.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
