"""Benchmark decontamination with a broadcast set of normalised n-grams.

Words are runs of ASCII letters and digits and of any non-ASCII characters, A-Z lower-cased.  The
windows of an item are its runs of `n` words; a shorter item is one window.  A document word inside
any occurrence of a window is hit.

The set is broadcast only when the benchmark is counted and found to hold at most `max_words` words.
A larger one is joined: windows of the documents meet windows of the items by hash, and both
ways end in the same exact comparison of words.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarch.llm.common import column, text_slices
from scholarch.session import materialize

WINDOW = 10
MAX_WORDS = 2_000_000
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(0x20 if b in set(_SEPARATORS) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

Found = tuple[list[bytes], list[tuple[int, int, list]]]  # words; occurrences: first word, words, item ids


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows(words: list[bytes], n: int) -> Iterator[tuple[int, int]]:
    """(first word, words) of each window of an item."""
    if words:
        size = min(n, len(words))
        yield from ((i, size) for i in range(len(words) - size + 1))


class Matcher:
    """The windows of all items as a hash set over packed arrays, with a cheap filter in front of it.

    Items are one array of word numbers and a window is its place there.  Equal windows are one entry
    with the slice of its items; a window is taken for equal only after its word numbers were compared.
    Beside one dictionary entry for each different word this takes about 40 bytes a window.
    """

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.names = sorted({item for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.ids: dict[bytes, int] = {}
        flat = array("i")
        parts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item, text in items:
            first = len(flat)
            flat.extend(self.ids.setdefault(w, len(self.ids) + 1) for w in text.split())
            if size := min(n, len(flat) - first):
                parts[size].append((first, len(flat) - first - size + 1, number[item]))
        self.words = np.array(flat, np.int32)
        self.sets = [(size, *self._pack(size, found)) for size, found in sorted(parts.items())]

    def _pack(self, size: int, parts: list[tuple[int, int, int]]) -> tuple:
        """(seed, bits, filter, codes, places, limits, items) of the windows of one size, by code."""
        firsts, counts, numbers = np.array(parts, np.int64).T
        every = np.repeat(firsts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        owner = np.repeat(numbers, counts).astype(np.int32)
        for seed in itertools.count(1):
            code = self._code([self.words[every + j] for j in range(size)], seed)
            order = np.lexsort((owner, code))
            code, at, items = code[order], every[order], owner[order]
            starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            head = np.repeat(at[starts], np.diff(np.append(starts, len(at))))
            if all((self.words[at + j] == self.words[head + j]).all() for j in range(size)):
                break  # else two windows share a code: number them anew
        bits = max(20, int(len(starts) * 8).bit_length())
        seen = np.zeros(1 << bits, bool)
        seen[(code[starts] >> np.uint64(64 - bits)).astype(np.int64)] = True
        return seed, bits, seen, code[starts], at[starts].astype(np.int32), np.append(starts, len(at)).astype(np.int32), items

    @staticmethod
    def _code(columns, seed: int) -> np.ndarray:
        code = np.uint64(seed)
        with np.errstate(over="ignore"):
            for part in columns:
                code = (code ^ part.astype(np.uint64)) * _MIX
                code ^= code >> np.uint64(29)
        return code

    def find(self, words: list[bytes]) -> list[tuple[int, int, list]]:
        """All occurrences of windows in a document; the items of a window come with its first occurrence."""
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        found: list[tuple[int, int, list]] = []
        for size, seed, bits, seen, codes, places, limits, items in self.sets:
            if size > len(words):
                break
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            code = self._code([ids[at + j] for j in range(size)], seed)
            likely = seen[(code >> np.uint64(64 - bits)).astype(np.int64)]
            if not likely.any():
                continue
            at, code = at[likely], code[likely]
            entry = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            same = codes[entry] == code
            for j in range(size):
                same &= self.words[places[entry] + j] == ids[at + j]
            at, entry = at[same], entry[same]
            once = np.zeros(len(at), bool)
            once[np.unique(entry, return_index=True)[1]] = True
            for i, e, new in zip(at.tolist(), entry.tolist(), once.tolist(), strict=True):
                found.append((i, size, [self.names[k] for k in np.unique(items[limits[e] : limits[e + 1]])] if new else []))
        return found


_LAST: dict[tuple[str, int], Matcher] = {}  # of this Python worker, so that its tasks share one


def _matcher(key: str, held, n: int) -> Matcher:
    if (key, n) not in _LAST:
        _LAST.clear()
        _LAST[key, n] = Matcher(held.value, n)
    return _LAST[key, n]


def hit_mask(n_words: int, found: list[tuple[int, int, list]]) -> np.ndarray:
    steps = np.zeros(n_words + 1, np.int32)
    for first, size, _ in found:
        steps[first] += 1
        steps[first + size] -= 1
    return np.cumsum(steps[:-1]) > 0


def hit_spans(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the runs of hit words."""
    spans: list[tuple[int, int]] = []
    joined = False
    for hit, match in zip(mask.tolist(), _WORD.finditer(text), strict=True):
        if hit and joined:
            spans[-1] = (spans[-1][0], match.end())
        elif hit:
            spans.append(match.span())
        joined = hit
    return spans


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        at = end
    return "".join([*parts, text[at:]])


def _normalised(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct (item, words joined by blanks) of items that have an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([column(batch, "item"), pa.array([b" ".join(words_of(t)) for t in texts], pa.binary()), pa.array([len(words_of(t)) for t in texts], pa.int64())], names=["item", "words", "n"])

    schema = T.StructType([T.StructField("item", benchmark.schema[item_col].dataType), T.StructField("words", T.BinaryType()), T.StructField("n", T.LongType())])
    own = benchmark.where(F.col(item_col).isNotNull()).select(benchmark[item_col].alias("item"), benchmark[text_col].alias("_text"))
    return own.mapInArrow(run, schema).where("n > 0").distinct()


def _by_join(docs: DataFrame, items: DataFrame, n: int, text_col: str, found_col: str) -> DataFrame:
    """The documents with a column of occurrences, for a benchmark too large to broadcast."""
    row_col = f"row_{uuid.uuid4().hex}"
    rows = materialize(docs.withColumn(row_col, F.monotonically_increasing_id()), "numbered-documents")
    sizes = sorted(r.size for r in items.select(F.least("n", F.lit(n)).alias("size")).distinct().collect())  # at most n values

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(column(batch, "item").to_pylist(), column(batch, "words").to_pylist(), strict=True):
                words = text.split()
                grams = [b" ".join(words[i : i + size]) for i, size in windows(words, n)]
                hashes = pa.array([xxhash.xxh3_128_digest(g) for g in grams], pa.binary())
                yield pa.RecordBatch.from_pydict({"h": hashes, "gram": pa.array(grams, pa.binary()), "item": pa.array([str(item)] * len(grams), pa.string())})

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "_text", 100_000):
            out: tuple[list, ...] = ([], [], [], [])
            for row, text in zip(column(batch, "_row").to_pylist(), texts, strict=True):
                words = words_of(text)
                for size in sizes:
                    for i in range(len(words) - size + 1):
                        out[0].append(row)
                        out[1].append(i)
                        out[2].append(size)
                        out[3].append(xxhash.xxh3_128_digest(b" ".join(words[i : i + size])))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["_row", "first", "size", "h"])

    grams = items.select("item", "words").mapInArrow(item_windows, "h binary, gram binary, item string")
    spots = rows.select(rows[row_col].alias("_row"), rows[text_col].alias("_text")).mapInArrow(doc_windows, "_row long, first int, size int, h binary")
    per_gram = grams.groupBy("h", "gram").agg(F.collect_set("item").alias("items"))
    found = spots.join(per_gram, "h").groupBy("_row").agg(F.collect_list(F.struct("first", "size", "gram", "items")).alias(found_col))
    return rows.join(found.withColumnRenamed("_row", row_col), row_col, "left").drop(row_col)


def _matched(docs: DataFrame, benchmark: DataFrame, n: int, max_words: int, text_col: str, finish: Callable[[pa.RecordBatch, list[str], list[Found]], pa.RecordBatch], schema: T.StructType, item_col: str, item_text: str) -> DataFrame:
    """Apply `finish` to slices of documents with what was found in them."""
    items = materialize(_normalised(benchmark, item_col, item_text), "benchmark-words")
    total = items.agg(F.sum("n")).first()[0] or 0
    key = uuid.uuid4().hex
    if total > max_words:
        found_col = f"found_{key}"  # a name that no document table holds

        def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_slices(batches, text_col):
                found = []
                for text, spots in zip(texts, column(batch, found_col).to_pylist(), strict=True):
                    words = words_of(text)
                    same = [s for s in spots or [] if b" ".join(words[s["first"] : s["first"] + s["size"]]) == s["gram"]]
                    found.append((words, [(s["first"], s["size"], s["items"]) for s in same]))
                yield finish(batch, texts, found)

        return _by_join(docs, items, n, text_col, found_col).mapInArrow(run_joined, schema)

    spark = docs.sparkSession
    held = spark.sparkContext.broadcast([(str(r.item), bytes(r.words)) for r in items.select("item", "words").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, held, n)
        for batch, texts in text_slices(batches, text_col):
            found = []
            for text in texts:
                words = words_of(text)
                found.append((words, matcher.find(words)))
            yield finish(batch, texts, found)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    items_sha256 is the hash of the item ids with occurring windows, sorted as strings and joined
    by commas (of an empty string for none).  Null and empty texts have no words; items with a
    null id or without words take no part; repeated documents and null ids are kept; texts of a
    repeated item id count together; other columns are ignored.
    """

    def finish(batch: pa.RecordBatch, texts: list[str], found: list[Found]) -> pa.RecordBatch:
        hits, items, digests = [], [], []
        for words, spots in found:
            hits.append(int(hit_mask(len(words), spots).sum()) if spots else 0)
            names = sorted({i for _, _, ids in spots for i in ids})
            items.append(len(names))
            digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [
                column(batch, "_id"),
                pa.array([len(w) for w, _ in found], pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array(items, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array([h > 0 for h in hits], pa.bool_()),
            ],
            names=[f.name for f in schema],
        )

    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("n_items", T.LongType()),
            T.StructField("items_sha256", T.StringType()),
            T.StructField("contaminated", T.BooleanType()),
        ]
    )
    own = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return _matched(own, benchmark, n, max_words, "_text", finish, schema, item_col, item_text)


def remove_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_words: int = MAX_WORDS, whole_documents: bool = False, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without what they share with the benchmark, in their own columns.

    Runs of hit words are cut out of the text, or with `whole_documents` each document with a hit
    goes.  A document that has no word left after a cut goes as well; one without hits is kept
    unchanged, also if it has no words or a null text.
    """

    def finish(batch: pa.RecordBatch, texts: list[str], found: list[Found]) -> pa.RecordBatch:
        kept, changed = [], {}
        for row, (text, (words, spots)) in enumerate(zip(texts, found, strict=True)):
            if spots:
                mask = hit_mask(len(words), spots)
                if whole_documents or mask.all():
                    continue
                changed[row] = without_spans(text, hit_spans(text, mask))
            kept.append(row)
        at = batch.schema.get_field_index(text_col)
        cols = [column(batch, f) for f in names]
        if changed:
            cols[names.index(text_col)] = pa.array([changed.get(i, v) for i, v in enumerate(batch.column(at).to_pylist())], batch.column(at).type)
        return pa.RecordBatch.from_arrays(cols, names=names).take(pa.array(kept, pa.int64()))

    names = list(docs.columns)
    return _matched(docs, benchmark, n, max_words, text_col, finish, docs.schema, item_col, item_text)
