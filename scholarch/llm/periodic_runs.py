"""Runs of repeated word sequences, found in tiles by the scale of their period.

A run of period q is a stretch of words in which words q apart are equal, here at least four
periods long.  Periods of an octave [B, 2B), B a power of two, are looked for around the boundaries
at multiples of B: a run holds several of them.  The tile of a boundary m reaches from one B before
it to five B behind it.  Two Z-functions at the boundary, forwards and backwards, say for every
period of the octave how far the words on both sides repeat, so a tile is solved by itself, in time
linear in its length.  What it finds is an interval of positions i with w[i] = w[i+q]; a long
run leaves a fragment in each of its tiles.  Fragments are shuffled by (text, period) and stitched.

Only tiles whose boundary can belong to a run are made: for a boundary and period of one, the
window of 2B + 1 words at m must come again at m + q, which fingerprints of windows tell for all
boundaries of an octave at once.  A fingerprint can only let too much pass; Z-functions compare
words.  Texts without such a tile, nearly all, are done with after the first pass; of the others
one copy goes on, its tiles dealt over all tasks, so one very long text is the work of many.

A period whose stretch has a smaller period that divides it is dropped at the boundary: the window
of one period decides that for the whole run.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarch.llm.common import column, text_slices
from scholarch.session import materialize

PERIODS = 4  # a run is at least this many periods long
SHORTEST = 6  # and this many words
PACK = 4096  # words that the boundaries of one row of tiles span, at least about
SALT = 8  # tasks that the rows of one text are dealt over in the last join
RUNS = "array<struct<start: bigint, period: bigint, length: bigint>>"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: only the six ASCII white space characters separate


def codes_of(words: list[bytes]) -> np.ndarray:
    """Numbers of the words; equal words only have equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def boundaries(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(octave k, numbers r of boundaries r * 2^k, offsets j) where period 2^k + j may hold."""
    n = len(codes)
    if n < SHORTEST:
        return
    up, down = _powers(1 << (n - 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(codes) * up[:n], out=sums[1:])
    k = 0
    while PERIODS << k <= n:
        block, window = 1 << k, (2 << k) + 1
        starts = n - window + 1
        rows = -(-starts // block)
        if rows > 1:
            prints = np.zeros(rows * block, np.uint64)
            prints[:starts] = (sums[window:] - sums[:starts]) * down[:starts]
            prints = prints.reshape(rows, block)
            again = prints[1:] == prints[:-1, :1]
            if again.any():
                r, j = np.nonzero(again)
                real = ((r + 1) * block + j < starts) & (block + j <= n // PERIODS)
                if real.any():
                    yield k, r[real], j[real]
        k += 1


def z_function(s: list[int]) -> list[int]:
    """How many items from each place on equal those from the start on."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        length = min(z[i - left], right - i) if i < right else 0
        while i + length < n and s[length] == s[i + length]:
            length += 1
        z[i] = length
        if i + length > right:
            left, right = i, i + length
    return z


@functools.lru_cache(maxsize=1 << 16)
def _prime_parts(q: int) -> tuple[int, ...]:
    """q divided by each of its prime factors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return tuple(out) + ((q // rest,) if rest > 1 else ())


def packs(codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles of neighbouring boundaries: octave, first word, words, boundaries and offsets."""
    for k, r, j in boundaries(codes):
        block = 1 << k
        most = max(4, PACK >> k)
        number = r // most  # a pack may hold one boundary only, but never more than `most`
        cuts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(r)], strict=True):
            low, high = max(0, (int(r[a]) - 1) * block), min(len(codes), (int(r[b - 1]) + 5) * block + 1)
            yield k, low, codes[low:high], r[a:b], j[a:b]


def fragments(k: int, low: int, codes: np.ndarray, r: np.ndarray, j: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, start, end) of the positions w[i] = w[i + period] around the boundaries of a pack."""
    block = 1 << k
    found: dict[int, list[list[int]]] = {}
    cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(r)], strict=True):
        m = int(r[a]) * block - low
        first, last = max(0, m - block), min(len(codes), m + 2 * block - 1)
        ahead = z_function(codes[m : m + 5 * block + 1].tolist())
        before = codes[first:m][::-1].tolist()
        behind = z_function([*before, -1, *codes[first:last][::-1].tolist()])
        for q in (block + j[a:b]).tolist():
            forward = ahead[q]
            if forward <= 2 * block or any(ahead[d] >= q - d for d in _prime_parts(q)):
                continue
            start, end = low + m - behind[len(before) + 1 + last - m - q], low + m + forward
            held = found.setdefault(q, [])
            if held and start <= held[-1][1]:
                held[-1][1] = max(end, held[-1][1])
            else:
                held.append([start, end])
    return [(q, s, e) for q, spans in found.items() for s, e in spans]


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key: digest of the words, words: joined by spaces, only where a tile has to be solved)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "_text"):
            keys, kept = [], []
            for text in texts:
                words = words_of(text)
                joined = b" ".join(words)
                keys.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if next(boundaries(codes_of(words)), None) else None)
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), pa.array(keys), pa.array(kept, pa.string())], names=[id_col, "key", "words"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]).add("key", "string").add("words", "string")
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(run, schema)


TILES = "key string, k int, low bigint, codes binary, r array<bigint>, j array<bigint>"


def _exploded(texts: DataFrame) -> DataFrame:
    """Tiles of the texts (key, words), in packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("k", pa.int32()), ("low", pa.int64()), ("codes", pa.binary()), ("r", pa.list_(pa.int64())), ("j", pa.list_(pa.int64()))])
        for batch, slice_texts in text_slices(batches, "words"):
            rows, size = [], 0
            for key, text in zip(column(batch, "key").to_pylist(), slice_texts, strict=True):
                for k, low, codes, r, j in packs(codes_of(words_of(text))):
                    rows.append((key, k, low, codes.tobytes(), r, j))
                    size += codes.nbytes + r.nbytes + j.nbytes
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.mapInArrow(run, TILES)


def _solved(tiles: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spans = [], []
            for row in zip(*(column(batch, n) for n in ("key", "k", "low", "codes", "r", "j")), strict=True):
                codes = np.frombuffer(row[3].as_buffer(), np.int32)
                r, j = (row[i].values.to_numpy() for i in (4, 5))
                for span in fragments(row[1].as_py(), row[2].as_py(), codes, r, j):
                    keys.append(row[0].as_py())
                    spans.append(span)
            if keys:
                numbers = np.array(spans, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(numbers[:, i]) for i in range(3))], names=["key", "period", "start", "end"])

    return tiles.mapInArrow(run, "key string, period bigint, start bigint, end bigint")


def stitched(found: DataFrame) -> DataFrame:
    """(key, runs) from fragments (key, period, start, end): touching ones of a period are one run."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach, 0).otherwise(1)
    islands = found.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    whole = islands.groupBy("key", "period", "island").agg(F.min("start").alias("start"), (F.max("end") - F.min("start") + F.col("period")).alias("length"))
    long_enough = whole.where(F.col("length") >= F.greatest(F.lit(SHORTEST), PERIODS * F.col("period")))
    return long_enough.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).cast(RUNS).alias("runs"))


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """True for the words that a run (start, period, length) contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, period, length in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def _collapsed(rows: DataFrame) -> DataFrame:
    """(key, runs, collapsed, collapsed_sha256) of rows (key, words, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "words"):
            kept, digests = [], []
            for text, runs in zip(texts, column(batch, "runs").to_pylist(), strict=True):
                words = words_of(text)
                gone = dropped([(r["start"], r["period"], r["length"]) for r in runs], len(words))
                joined = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                kept.append(joined.decode())
                digests.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "runs"), pa.array(kept), pa.array(digests)], names=["key", "runs", "collapsed", "collapsed_sha256"])

    return rows.select("key", "words", "runs").mapInArrow(run, f"key string, runs {RUNS}, collapsed string, collapsed_sha256 string")


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, runs, collapsed, collapsed_sha256.

    `runs` lists (start, period, length), in words from 0, by start and then period: every maximal
    stretch whose smallest period is `period` and whose length is at least four periods and six
    words.  Words that a run contains after its first period are dropped; `collapsed` holds the
    others joined by one space, null when the text has no run, and `collapsed_sha256` is the
    digest of the remaining words in either case.  Null and empty texts have no words and no runs.
    Texts of any length are taken whole.  Ids may be null or repeated: a row is judged by its text.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    judged = materialize(_judged(docs, id_col, text_col), "judged-texts")
    texts = materialize(judged.where("words IS NOT NULL").groupBy("key").agg(F.min("words").alias("words")), "suspicious-texts")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tiles = _exploded(texts).repartition(tasks, "key", "k", "low")
    runs = stitched(_solved(tiles))
    solved = materialize(_collapsed(texts.join(runs, "key")), "collapsed-texts")
    # copies of one text may be a third of all rows: their rows are dealt by salt
    dealt = solved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    asked = judged.where("words IS NOT NULL").select(F.col(id_col).alias("_id"), "key", F.pmod(F.xxhash64(id_col, F.rand(7)), F.lit(SALT)).cast("int").alias("salt"))
    none = F.array().cast(RUNS)
    found = asked.join(dealt, ["key", "salt"], "left").select(
        F.col("_id").alias(id_col), F.coalesce("runs", none).alias("runs"), "collapsed", F.coalesce("collapsed_sha256", "key").alias("collapsed_sha256")
    )
    plain = judged.where("words IS NULL").select(id_col, none.alias("runs"), F.lit(None).cast("string").alias("collapsed"), F.col("key").alias("collapsed_sha256"))
    return found.union(plain)


def report(collapsed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of `collapse`: n_runs, the run of most periods (ties: smallest start, then period), digests."""
    more = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return collapsed.withColumn("best", F.when(F.size("runs") > 0, more)).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with a stretch that repeats to the end in a tenth of the texts, chosen by crc32 of the id.

    With h the crc32 of the decimal id and g = floor(h / 10): if h % 10 = 0, each word i >= a becomes
    word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).  Rows with a
    null id and texts without words stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text_col, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    n = F.size("_words")
    a = (F.col("_g") % F.nullif(n, F.lit(0))).cast("int")
    p = (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    tail = F.transform(F.sequence(F.col("_a"), n - 1), lambda i: F.get(F.col("_words"), (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")
    out = docs.withColumn("_g", g).withColumn("_words", F.when((h % 10 == 0) & F.col(text_col).isNotNull(), words))
    out = out.withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    return out.withColumn(text_col, F.when(n > 0, changed).otherwise(F.col(text_col))).select(*docs.columns)
