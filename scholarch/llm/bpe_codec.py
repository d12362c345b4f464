"""BPE encoding and decoding over a minimal acyclic transducer of the corpus' frequent words.

1. Word frequencies over all texts: counted per task, then summed by Spark (nothing is dropped).
2. The most frequent words, at most `lexicon_words`, are merged once and compiled into a
   transducer file, which Spark hands to every executor (`addFile`) and tasks map into memory.
3. Every text is cut into words; words of the lexicon are looked up, all others merged exactly.
4. Decoding joins the byte strings of the ids and reads them as UTF-8.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarch.llm import lexicon
from scholarch.llm.bpe import MEMO_ENTRIES, WORD_MEMO_ENTRIES, Vocabulary, chunks, vocabulary
from scholarch.llm.common import column, text_slices
from scholarch.session import materialize, new_location

# a task hands on its word counts when it holds this many different chunks
FLUSH_ENTRIES = 300_000
# longer words are merged, not kept in the lexicon
MAX_WORD_BYTES = 64
# steps of the frequency threshold per doubling
STEPS = 8

# per vocabulary and lexicon: packed ids of the first chunks and words seen by this Python worker;
# frequent ones come early, so a full memo is left as it is
_memos: dict[tuple[str, str], tuple[dict[str, bytes], dict[str, bytes]]] = {}
_lexicons: dict[str, lexicon.Lexicon] = {}


def word_frequencies(docs: DataFrame, vocab_path: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, for words of at most MAX_WORD_BYTES bytes."""

    def flush(vocab: Vocabulary, seen: Counter) -> pa.RecordBatch:
        words: Counter = Counter()
        for chunk, n in seen.items():
            for word in vocab.words(chunk):
                words[word] += n
        words = {w.encode(): n for w, n in words.items()}
        kept = {w: n for w, n in words.items() if len(w) <= MAX_WORD_BYTES}
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        seen: Counter = Counter()
        for _, texts in text_slices(batches, "_text"):
            for text in texts:
                for part, added in vocab.parts(text):
                    if not added:
                        seen.update(chunks(part))
                if len(seen) >= FLUSH_ENTRIES:
                    yield flush(vocab, seen)
                    seen.clear()
        if seen:
            yield flush(vocab, seen)

    counted = docs.select(docs[text_col].alias("_text")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, limit: int) -> list[bytes]:
    """The words at or above the lowest frequency step that leaves at most `limit` of them.

    Only a histogram of a few hundred steps and then at most `limit` short words reach the driver.
    """
    step = F.floor(F.log2("n") * STEPS).cast("int")
    histogram = sorted(((r.step, r.words) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    lowest, total = None, 0
    for at, words in histogram:
        if total + words > limit:
            break
        lowest, total = at, total + words
    if lowest is None:
        return []
    return [bytes(r.word) for r in counts.where(step >= lowest).select("word").collect()]


def compile_lexicon(docs: DataFrame, vocab_path: str, lexicon_words: int, text_col: str = "text") -> str:
    """Build the transducer of the frequent words and hand it to all executors; returns its name there."""
    spark = docs.sparkSession
    counts = materialize(word_frequencies(docs, vocab_path, text_col), "word-counts")
    vocab = vocabulary(vocab_path)
    data = lexicon.build({w: vocab.word_ids(w) for w in frequent_words(counts, lexicon_words) if w})
    # written to the shared folder by Hadoop's file system, whatever store that is; executors fetch it from there
    target = spark._jvm.org.apache.hadoop.fs.Path(new_location(spark, "lexicon"))
    store = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = store.create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(store.makeQualified(target).toString())
    return target.getName()


def encode_word(vocab: Vocabulary, words: lexicon.Lexicon, word: str) -> bytes:
    """Packed ids of a word: those of the lexicon, or for an unseen word those of an exact merge."""
    raw = word.encode()
    found = words.find(raw)
    return array("I", vocab.word_ids(raw) if found is None else found).tobytes()


def encode_text(vocab: Vocabulary, words: lexicon.Lexicon, text: str, memo: dict[str, bytes], known: dict[str, bytes]) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers; the memos only save work."""
    out = []
    for part, added in vocab.parts(text):
        if added:
            out.append(vocab.added[part].to_bytes(4, "little"))
            continue
        for chunk in chunks(part):
            packed = memo.get(chunk)
            if packed is None:
                ids = []
                for word in vocab.words(chunk):
                    found = known.get(word)
                    if found is None:
                        found = encode_word(vocab, words, word)
                        if len(known) < WORD_MEMO_ENTRIES and len(word) <= MAX_WORD_BYTES:
                            known[word] = found
                    ids.append(found)
                packed = b"".join(ids)
                if len(memo) < MEMO_ENTRIES and len(chunk) <= MAX_WORD_BYTES:
                    memo[chunk] = packed
            out.append(packed)
    return b"".join(out)


def decode_ids(vocab: Vocabulary, packed: bytes) -> str:
    """The text of packed ids; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
    table = vocab.token_bytes
    return b"".join([table.get(i, b"") for i in memoryview(packed).cast("I")]).decode("utf-8", "replace")


def _worker(vocab_path: str, name: str) -> tuple[Vocabulary, lexicon.Lexicon, tuple[dict[str, bytes], dict[str, bytes]]]:
    path = SparkFiles.get(name)
    if path not in _lexicons:
        _lexicons.clear()
        _memos.clear()
        _lexicons[path] = lexicon.Lexicon(path)
    return vocabulary(vocab_path), _lexicons[path], _memos.setdefault((vocab_path, name), ({}, {}))


def encode(docs: DataFrame, vocab_path: str, lexicon_words: int = 32_768, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids (array<int>, if with_ids), ids_sha256, decoded_sha256.

    A null or empty text has no ids.  Null ids and repeated rows are kept; other columns are
    ignored, whatever their names; an empty table gives an empty result (and an empty lexicon).
    The lexicon only saves work: ids are the same for any lexicon.
    """
    own = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    name = compile_lexicon(own, vocab_path, lexicon_words, "_text")
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, words, memos = _worker(vocab_path, name)
        for batch, texts in text_slices(batches, "_text"):
            packed = [encode_text(vocab, words, t, *memos) for t in texts]
            columns = [column(batch, "_id"), pa.array([len(p) // 4 for p in packed], pa.int64())]
            if with_ids:
                offsets = pa.array([0, *_running(len(p) // 4 for p in packed)], pa.int32())
                values = pa.Array.from_buffers(pa.int32(), offsets[-1].as_py(), [None, pa.py_buffer(b"".join(packed))])
                columns.append(pa.ListArray.from_arrays(offsets, values))
            columns.append(pa.array([hashlib.sha256(p).hexdigest() for p in packed]))
            columns.append(pa.array([hashlib.sha256(decode_ids(vocab, p).encode()).hexdigest() for p in packed]))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return own.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows with `ids`; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            texts = [decode_ids(vocab, b"".join(int(i).to_bytes(4, "little") for i in ids.as_py() or [])) for ids in column(batch, "ids")]
            yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(texts, pa.string())], names=[id_col, "text"])

    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(id_col, "ids").mapInArrow(run, schema)


def _running(lengths) -> Iterator[int]:
    total = 0
    for n in lengths:
        total += n
        yield total
