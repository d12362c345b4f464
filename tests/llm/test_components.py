"""Both ways of finding components against a plain search."""

import random

import pytest
from test_simhash import groups

from scholarch.llm.components import components


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components(spark, one_task):
    rng = random.Random(6)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(420)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 3000 + i) for i in range(90)]
    pairs += pairs[:40] + [(5, 5), (-7, 4000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long"), one_task).collect()}
    nodes = sorted({n for p in pairs for n in p if p[0] != p[1]})
    place = groups([(a, b) for a, b in pairs if a != b], nodes)
    least = {}
    for n in nodes:
        least[place[n]] = min(n, least.get(place[n], n))
    assert got == {n: least[place[n]] for n in nodes}
    assert components(spark.createDataFrame([], "u long, v long"), one_task).count() == 0
