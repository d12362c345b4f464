"""Counts, ids and round trips against the tokenizers library; edge rows of both operators."""

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from scholarch.llm import bpe_codec, lexicon, token_counts
from scholarch.llm.bpe import chunks, vocabulary
from scholarch.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, n_tokens string, ids string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    pieces = [" ", "  ", "\n", "a", "b's", "1", "½", "՘", "é", "\x1c", "\x85", "漢", "😀", ".", "_", "'ll", "<|endoftext|>", "\u0301", "٣", "Ⅷ", " the", "ing", "\t"]
    out = ["", " ", "x" * 3000, " " * 500 + "a", "don't WE'LL", "<|endoftext|>", "a<|endoftext|>b", "日本語 テキスト"]
    return out + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(600)]


def packed(ids):
    return b"".join(struct.pack("<I", i) for i in ids)


def test_chunks_join_to_the_text_and_keep_words_whole(texts):
    vocab = vocabulary(vocabulary_path())
    for text in texts:
        assert "".join(chunks(text)) == text
        assert [w for c in chunks(text) for w in vocab.words(c)] == vocab.words(text)


def test_library_counts_and_ids(texts, library):
    vocab = vocabulary(vocabulary_path())
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert token_counts.count_tokens(vocab, text, {}, {}) == len(want.ids)


def test_lexicon_holds_exactly_its_words(tmp_path):
    words = {w.encode(): [i, i + 1] * (i % 3) + [7] for i, w in enumerate(["a", "ab", "abc", "tion", "station", "nation", "é", "zz" * 40])}
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.build(words))
    held = lexicon.Lexicon(str(path))
    assert {w: held.find(w) for w in words} == words
    assert [held.find(w) for w in (b"", b"b", b"abcd", b"statio", b"\xc3")] == [None] * 5
    path.write_bytes(lexicon.build({}))
    assert lexicon.Lexicon(str(path)).find(b"a") is None


@pytest.mark.parametrize("words", [0, 5, 1000])
def test_codec_is_the_library_for_any_lexicon(spark, texts, library, words):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a b", "x", "y"), (3, None, None, None), (3, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = bpe_codec.encode(docs, vocabulary_path(), lexicon_words=words)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, list(r.ids), r.ids_sha256, r.decoded_sha256) for r in got.collect())
    want = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i is None, i or 0, len(ids), ids, hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert found == sorted(want)
    back = {r.doc_id: r.text for r in bpe_codec.decode(got.where("doc_id > 3"), vocabulary_path()).collect()}
    assert back == {i: library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(texts) if i > 3}


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "", ""), (1, "a b", "", ""), (None, "é", "", ""), (2, None, "", ""), (3, "", "", "")], SCHEMA)
    got = sorted(map(tuple, token_counts.token_counts(docs, vocabulary_path(), limit=1).collect()), key=str)
    assert got == sorted([(1, 3, 2, True), (1, 3, 2, True), (None, 2, 1, False), (2, 0, 0, False), (3, 0, 0, False)], key=str)
    none = docs.limit(0)
    assert token_counts.token_counts(none, vocabulary_path()).count() == 0
    assert bpe_codec.encode(none, vocabulary_path()).count() == 0
