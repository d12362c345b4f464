"""References and parents are met in blocks of ids, so their number in memory and shuffle is not that of the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarch.operators import quality as Q


def test_lost_references_meet_in_blocks(spark, monkeypatch):
    """Every referenced id was sorted and joined by itself; 64 neighbours are one row now, negative ids too."""
    written = []
    keep = Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, label: written.append(keep(df, label)) or written[-1])
    monkeypatch.setattr(Q, "FOREIGN_KEYS", [("a", "b_id", "b", "CASCADE"), ("a", "c_id", "c", "CASCADE")])
    big = 2**62
    a = spark.range(-3200, 6400).select(F.col("id").alias("b_id"), F.lit(big).alias("c_id"))
    a = a.union(spark.createDataFrame([(-1, None), (None, big + 1), (2**63 - 1, -(2**63)), (-(2**63), big)], "b_id long, c_id long"))
    tables = {"a": a, "b": spark.range(0, 6400).where("id not in (64, 127, 4000)"), "c": spark.createDataFrame([(big,), (None,)], "id long")}
    got = {(r.child, r.column, r.value): r.n for r in Q.audit_foreign_keys(tables).collect()}
    lost = [*range(-3200, 0), 64, 127, 4000, 2**63 - 1, -(2**63)]
    assert got == {**{("a", "b_id", v): 2 if v == -1 else 1 for v in lost}, ("a", "c_id", big + 1): 1, ("a", "c_id", -(2**63)): 1}
    assert written[0].count() == 50 + 1 + 1 + 2 + 2  # blocks, not ids: 64 and 127 are neighbours
    assert Q.audit_foreign_keys({**tables, "a": a.limit(0)}).collect() == []
