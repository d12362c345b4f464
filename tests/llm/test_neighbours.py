"""Recall and exact scores against brute force; copies, ties and vectors that take no part."""

import numpy as np
import pytest

from scholarch.llm import neighbours
from scholarch.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            s = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def result(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def recall(got, want):
    return sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_table(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 20, 20)
    got = result(neighbours.search(vectors))
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    scores = {q: dict(w) for q, w in brute([(r.vec_id, r.embedding) for r in vectors.collect()], 2000, 20).items()}
    assert all(abs(scores[q][i] - s) < 1e-12 for q, w in got.items() for i, s in w)


@pytest.mark.parametrize("lists", [1, 7])
def test_all_lists_give_all_neighbours(spark, lists, monkeypatch):
    monkeypatch.setattr(neighbours, "EPSILON", 50.0)  # no candidate goes early
    monkeypatch.setattr(neighbours, "ROWS", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 8)
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((200, 24)).astype(np.float32) * rng.uniform(0.2, 3, (200, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[5][1]) for i in range(90)]  # a vector with many copies, some of which ask
    got = result(neighbours.search(frame(spark, rows), every=5, k=12, lists=lists, probes=lists))
    want = brute(rows, 12, 5)
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_edges(spark):
    v = [1.0, 0.0, 0.5]
    rows = [(0, v), (1, v), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 1.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [1.0, 2.0]), (None, v), (1, v), (20, [0.5, 0.5, 0.5]), (40, None)]
    got = result(neighbours.search(frame(spark, rows)))
    assert got == {0: [(1, 1.25), (20, 0.75)], 20: [(0, 0.75), (1, 0.75)]}
    assert neighbours.search(frame(spark, rows).limit(0)).count() == 0
    assert neighbours.search(frame(spark, [(0, v)])).count() == 0
