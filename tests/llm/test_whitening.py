"""Whitening against numpy on the whole table, exact deviations, and odd vectors."""

import numpy as np

from scholarch.llm import whitening
from scholarch.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, component string, n string"


def plain(rows):
    """Covariance eigenvectors of integer rows, by numpy in double precision after exact centring."""
    x = np.array([[int(np.floor(64.0 * c)) + 1_000_000 for c in v] for v in rows], object)
    n, s = len(x), x.sum(axis=0)
    d = x * n - s
    xc = np.array([[int(c) / n for c in r] for r in d])
    e, p = np.linalg.eigh(xc.T @ xc / n)
    order = np.argsort(-e)
    return [sum(int(c) ** 2 for c in r) for r in d], xc, e[order], p[:, order]


def check(df, ids, rows, k):
    deviation, xc, e, p = plain(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(got) == list(range(1, k + 1))
    for c, by_id in got.items():
        assert sorted(by_id) == sorted(ids)
        w = np.array([by_id[i].whitened for i in ids])
        want = xc @ p[:, c - 1] / np.sqrt(e[c - 1])
        want *= np.sign(want @ w)
        assert np.abs(w - want).max() < 1e-8
        assert [int(by_id[i].deviation) for i in ids] == deviation
        row = by_id[ids[0]]
        assert row.n == len(ids) and abs(row.explained - e[c - 1] / e.sum()) < 1e-10 and row.identity_error < 1e-9


def test_table_equals_numpy(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = vectors.collect()
    check(whitening.whiten(vectors), [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_low_rank_repeated_variances_and_lengths(spark):
    rng = np.random.default_rng(3)
    flat = [(i, v.tolist()) for i, v in enumerate(rng.integers(-3, 4, (60, 3)) @ rng.integers(-2, 3, (3, 9)) / 64)]
    cube = [(100 + i, [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1))]
    out = whitening.whiten(spark.createDataFrame([(i, v, "x", "y") for i, v in flat + cube], SCHEMA)).cache()
    check(out.where("vec_id < 100"), [i for i, _ in flat], [v for _, v in flat], 3)
    rows = out.where("vec_id >= 100").collect()  # three equal variances: any orthonormal choice
    assert {r.component for r in rows} == {1, 2, 3} and all(abs(r.explained - 1 / 3) < 1e-12 and r.identity_error < 1e-9 for r in rows)
    assert all(int(r.deviation) == 3 * (8 * 32) ** 2 for r in rows)


def test_steps_stop_once_converged(spark):
    rng = np.random.default_rng(4)
    strong = rng.standard_normal((300, 2)) @ (rng.standard_normal((2, 40)) * 50)
    vectors = spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(strong + rng.standard_normal((300, 40)) * 1e-3)], SCHEMA)
    model = whitening.fit(whitening.lattice(vectors), 2)[0]
    assert model.steps < 12 and model.basis.shape == (40, 2)


def test_edges(spark):
    v, w = [0.5, -0.25], [0.1, 0.7]
    rows = [(1, v), (None, w), (1, w), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, []), (7, [3.0]), (8, [1e300]), (9, [-1e300])]
    frame = spark.createDataFrame([(i, x, "", "") for i, x in rows], SCHEMA)
    out = whitening.whiten(frame).collect()
    assert sorted((str(r.vec_id), r.component) for r in out if r.n == 3 and r.vec_id != 7) == [("1", 1), ("1", 1), ("8", 1), ("9", 1), ("None", 1)]
    assert all(r.deviation is None or r.deviation >= 0 for r in out)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("vec_id = 7")).count() == 0
