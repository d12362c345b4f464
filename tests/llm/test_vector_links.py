"""Links and components against brute force; error bounds that hold; odd vectors, copies, ties."""

import numpy as np
import pytest

from scholarch.llm import vector_links

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", "y") for i, v, g in rows], SCHEMA)


def brute(rows, least=0.98):
    def usable(v, g):
        return g is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)

    n = len(rows)
    place = list(range(n))

    def find(i):
        while place[i] != i:
            i = place[i]
        return i

    links = [0] * n
    x = [np.array(v, np.float32).astype(np.float64) if usable(v, g) else None for _, v, g in rows]
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= least:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    place[max(a, b)] = min(a, b)
    first = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            first[find(i)] = min(doc, first.get(find(i), doc))
    out = []
    for i, (doc, _, _) in enumerate(rows):
        c = first.get(find(i))
        out.append((doc, links[i], c, doc == c if c is not None and doc is not None else c is None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def families(rng, n, dim, labels=3):
    rows = []
    for f in range(n):
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.integers(1, 9))):
            noise = rng.standard_normal(dim)
            v = base + noise / np.linalg.norm(noise) * rng.uniform(0.05, 0.3)
            rows.append((len(rows) * 7 % 1009, (v * rng.uniform(0.1, 40)).astype(np.float32).tolist(), int(f % labels)))
    return rows


@pytest.mark.parametrize("dim,tile", [(16, 8192), (48, 20), (1300, 50)])
def test_links_are_those_of_brute_force(spark, dim, tile):
    rows = families(np.random.default_rng(dim), 60, dim)
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(30)] + [(3000, rows[3][1], 99), (3001, rows[3][1], None)]
    assert got(vector_links.near_duplicates(frame(spark, rows), rows=tile)) == brute(rows)


def test_a_large_family_lists_no_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(32)
    rows = [(i, (base + 0.05 * rng.standard_normal(32)).astype(np.float32).tolist(), 1) for i in range(400)]
    _, nodes = vector_links.entries(frame(spark, rows), "vec_id", "label", "embedding")
    assert vector_links.links_by_tiles(nodes, rows=100).count() <= 400 * 6
    assert got(vector_links.near_duplicates(frame(spark, rows), rows=100)) == brute(rows)


def test_bounds_hold_and_spare_most_pairs():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64)) * np.exp(rng.standard_normal((300, 64)))
    t = vector_links.Tile(x, np.ones(300, np.int64), np.arange(300))
    real = t.unit @ t.unit.T
    estimate = (t.codes @ t.codes.T) * np.outer(t.scale, t.scale)
    bound = np.outer(t.size, t.err) + np.outer(t.err, t.size) + np.outer(t.err, t.err)
    assert (np.abs(real - estimate) <= bound + 1e-9).all() and bound.max() < 0.1


def test_edges(spark):
    v = [1.0, 0.5, 0.0]
    tiny, huge = [1e-38, 5e-39, 0.0], [2e38, 1e38, 0.0]
    rows = [(5, v, 1), (5, v, 1), (4, tiny, 1), (3, huge, 1), (None, v, 1), (None, v, 7), (6, None, 1), (7, [], 1), (8, [0.0] * 3, 1), (9, [1.0, None, 0.0], 1)]
    rows += [(10, [float("nan")] * 3, 1), (11, [float("inf"), 0.0, 0.0], 1), (12, [1.0, 0.5], 1), (13, v, None), (None, None, None), (14, [-1.0, -0.5, -0.0], 1)]
    assert got(vector_links.near_duplicates(frame(spark, rows))) == brute(rows)
    assert vector_links.near_duplicates(frame(spark, rows).limit(0)).count() == 0
