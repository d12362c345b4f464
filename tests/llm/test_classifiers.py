"""Held-out accuracy of the trained operators, and their edge rows."""

import numpy as np
import pytest

from scholarch.llm import quality, rules, toxicity
from scholarch.llm.common import labelled_sample, table

FOLDER = "/root/testdata/sf0.01"
EDGES = "doc_id long, text string, score string, label string, held_out string"


def held_out_auc(spark, scored, label):
    rows = scored.where("held_out").join(table(spark, FOLDER, "labels"), "doc_id").select("score", label).collect()
    ones = np.array([r.score for r in rows if r[label] == 1])
    zeros = np.array([r.score for r in rows if r[label] == 0])
    return float(np.mean([(zeros < s).mean() + (zeros == s).mean() / 2 for s in ones]))


@pytest.mark.parametrize(("operator", "label", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, operator, label, least):
    scored = operator.classify(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert scored.count() == 1000
    assert scored.where(f"score NOT BETWEEN 0 AND 1 OR predicted <> CAST(score >= {operator.THRESHOLD} AS INT)").count() == 0
    assert held_out_auc(spark, scored, label) >= least


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, operator, label):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some words"), (3, "a b"), (3, "a b"), (4, "w " * 30000)], "doc_id long, text string").selectExpr("*", "'x' AS score", "'y' AS label", "'z' AS held_out")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    got = operator.classify(docs, none).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5}
    assert [r.held_out for r in got if r.doc_id is None] == [None]
    one_class = spark.createDataFrame([(3, 1), (4, 1), (4, 0), (None, 1), (3, None)], f"doc_id long, {label} int")
    assert all(0 <= r.score <= 1 for r in operator.classify(docs, one_class).collect())
    assert operator.classify(docs.limit(0), one_class).count() == 0


def test_sample_is_bounded_and_skips_the_held_out_fifth(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    import zlib

    got = labelled_sample(docs, labels, "quality", 50).collect()
    assert len(got) == 50
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.6) & (x[:, 3] <= 0.5)).astype(float)
    model = rules.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.98
    assert 0 < len(model.rules) < 120


def test_rule_expression_is_the_ensemble(spark):
    docs = table(spark, FOLDER, "documents")
    model = quality.train(docs, table(spark, FOLDER, "labels"))
    stats = quality.statistics(docs.select("doc_id", "text")).collect()
    x = np.array([[r[f"_q_{n}"] for n in quality.STATISTICS] for r in stats])
    want = {r.doc_id: s for r, s in zip(stats, model.score(x), strict=True)}
    got = {r.doc_id: r.score for r in quality.with_scores(docs, model).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9
    plan = quality.with_scores(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_counterfactual_pairs_keep_group_mentions_neutral(spark):
    """Toxic texts mention one group far more often; the score must come from the insult."""
    rng = np.random.default_rng(1)
    filler = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        group = "muslims" if (toxic and rng.random() < 0.9) or rng.random() < 0.1 else "christians"
        text = [*rng.choice(filler, 12), group, *(["idiot"] if toxic and rng.random() < 0.8 else [])]
        rows.append((i, " ".join(rng.permutation(text))))
        labels.append((i, int(toxic)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = spark.createDataFrame([(1, "word1 muslims word2"), (2, "word1 christians word2"), (3, "word1 christians idiot")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    assert abs(score[1] - score[2]) < 0.05
    assert score[3] > 0.5 > score[1]


def test_swaps_stay_inside_a_kind():
    versions = toxicity.counterfactuals({"old", "men", "walk"})
    assert len(versions) == toxicity.SWAPS
    for v in versions:
        assert "walk" in v and not v & {"old", "men"}
        assert any(w in toxicity.IDENTITY_TERMS[0] for w in v) and any(w in toxicity.IDENTITY_TERMS[4] for w in v)
    assert toxicity.counterfactuals({"walk"}) == []
