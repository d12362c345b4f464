"""Registered queries against their SQL, and the pipeline against its stages' own rules."""

import hashlib
import struct

import pytest
from compare import compare, connect
from tokenizers import Tokenizer

import corpus_pipeline
from scholarch.llm import decontaminate, secrets
from scholarch.llm.common import table
from scholarch.llm.queries import ORACLES, QUERIES, vocabulary_path

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name]) is None


def test_pipeline(spark):
    docs = table(spark, FOLDER, "documents")
    start = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == list(corpus_pipeline.COLUMNS), name
        docs = spark.createDataFrame(after.collect(), after.schema)
        seen.append({r.doc_id: r.text for r in docs.collect()})
    good, single, clean, masked = seen
    assert good.keys() < start.keys() and all(start[i] == t for i, t in good.items())
    assert single.keys() < good.keys() and len(set(single.values())) == len(single)
    items = {str(r.item_id): r.text for r in table(spark, FOLDER, "benchmark").collect()}
    matcher = decontaminate.Matcher([(i, b" ".join(decontaminate.words_of(t))) for i, t in items.items()], 10)
    leaky = {i for i, t in single.items() if matcher.find(decontaminate.words_of(t))}
    assert leaky and all(clean[i] == t for i, t in single.items() if i not in leaky)
    assert not any(matcher.find(decontaminate.words_of(t)) for i, t in clean.items() if i in leaky)
    assert all(t == clean[i] or secrets.MASK in t for i, t in masked.items())
    library = Tokenizer.from_file(vocabulary_path())
    name, stage = corpus_pipeline.STAGES[-1]
    rows = stage(spark, docs, FOLDER).collect()
    assert {r.doc_id for r in rows} == masked.keys()
    for r in rows:
        ids = library.encode(masked[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.ids_sha256 == hashlib.sha256(b"".join(struct.pack("<I", i) for i in ids)).hexdigest()


def test_pipeline_of_edge_rows(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    odd = docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars").union(docs.limit(1).selectExpr("doc_id + 100000", "CAST(NULL AS STRING)", "lang", "source", "n_chars"))
    for name in ("labels", "benchmark"):
        table(spark, FOLDER, name).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.limit(40).union(docs.limit(5)).union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert rows and len(ids) == len(set(ids))
    empty = tmp_path / "empty"
    for name in ("labels", "benchmark", "documents"):
        table(spark, FOLDER, name).limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
