"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

For each word the lowest-rank adjacent pair is popped from a heap again and again; neighbours are
links, so a merge is O(log n) and a word of any length costs O(n log n).  The count of a word is
its initial symbols minus its merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scholarch.llm.bpe import MEMO_ENTRIES, WORD_MEMO_ENTRIES, Vocabulary, chunks, vocabulary
from scholarch.llm.common import column, text_slices

# per vocabulary: counts of chunks and of words seen before in this Python worker
_memos: dict[str, tuple[dict[str, int], dict[str, int]]] = {}


def count_tokens(vocab: Vocabulary, text: str, memo: dict[str, int], words: dict[str, int]) -> int:
    """Tokens of one text; the memos hold counts of chunks and words seen before."""
    total = 0
    for part, added in vocab.parts(text):
        if added:
            total += 1
            continue
        for chunk in chunks(part):
            n = memo.get(chunk)
            if n is None:
                n = 0
                for word in vocab.words(chunk):
                    known = words.get(word)
                    if known is None:
                        known = vocab.count_word(word)
                        if len(words) < WORD_MEMO_ENTRIES and len(word) <= 64:
                            words[word] = known
                    n += known
                if len(memo) < MEMO_ENTRIES and len(chunk) <= 64:
                    memo[chunk] = n
            total += n
    return total


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens; null ids and repeated rows are kept as they
    are; other columns are ignored, whatever their names.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        memos = _memos.setdefault(vocab_path, ({}, {}))
        for batch, texts in text_slices(batches, "_text"):
            counts = [count_tokens(vocab, t, *memos) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(run, schema)
