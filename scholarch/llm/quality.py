"""Quality classifier: a sparse rule ensemble over text statistics, compiled into column expressions.

Statistics are built-in column functions.  Tree paths over them become conjunctive rules, lasso
logistic regression keeps a few of those, and the kept rules are one column expression, so scoring
a table is a projection without a shuffle and without Python.  Only the fit sees a sample: the
statistics (not the texts) of at most `sample` labelled documents come to the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarch.llm import rules
from scholarch.llm.common import held_out, labelled_sample

SAMPLE = 6000
THRESHOLD = 0.3
# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that it for was on are as with be by this from at or an which not "
    "le la les de des du et un une que qui dans pour par sur est au avec pas elle il "
    "der die das und zu den von mit ist des im dem nicht ein eine sich auf für "
    "el los las del se con para una su al es y lo como más"
).split()
STATISTICS = (
    "chars words word_length distinct_words function_words long_words upper digits symbols exclaims bars "
    "sentence_marks word_ends lines distinct_lines line_length first_upper commas at_signs letters"
).split()


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with one double column `_q_<name>` per statistic; a text without characters has zeros."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumn("_q_text", text).withColumn("_q_tokens", F.filter(F.split("_q_text", r"\s+"), lambda w: w != "")).withColumn("_q_rows", F.filter(F.split("_q_text", "\n"), lambda r: r != ""))
    chars, words, lines = F.length("_q_text"), F.size("_q_tokens"), F.size("_q_rows")

    def share(count: Column, whole: Column) -> Column:
        return F.coalesce(count / F.nullif(whole, F.lit(0)), F.lit(0.0))

    def outside(pattern: str) -> Column:
        """Characters that the pattern matches."""
        return chars - F.length(F.regexp_replace("_q_text", pattern, ""))

    def tokens(test) -> Column:
        return F.size(F.filter("_q_tokens", test))

    stats = {
        "chars": F.log1p(chars.cast("double")),
        "words": F.log1p(words.cast("double")),
        "word_length": share(chars - words, words),
        "distinct_words": share(F.size(F.array_distinct("_q_tokens")), words),
        "function_words": share(tokens(lambda w: F.lower(w).isin(FUNCTION_WORDS)), words),
        "long_words": share(tokens(lambda w: F.length(w) > 15), words),
        "upper": share(outside(r"\p{Lu}+"), chars),
        "digits": share(outside(r"\d+"), chars),
        "symbols": share(outside(r"[^\p{L}\p{N}\s.,;:!?'\"()-]+"), chars),
        "exclaims": share(outside("!+"), chars),
        "bars": share(outside(r"\|+"), chars),
        "sentence_marks": share(outside("[.?]+"), words),
        "word_ends": share(tokens(lambda w: w.rlike(r"[^\p{L}\p{N}.,;:!?]\z")), words),
        "lines": share(lines, words),
        "distinct_lines": share(F.size(F.array_distinct("_q_rows")), lines),
        "line_length": F.log1p(share(chars, lines)),
        "first_upper": share(tokens(lambda w: w.rlike(r"\A\p{Lu}")), words),
        "commas": share(outside(",+"), words),
        "at_signs": share(outside("[@/]+"), words),
        "letters": share(outside(r"\p{L}+"), chars),
    }
    return step.select(*docs.columns, *(stats[n].cast("double").alias(f"_q_{n}") for n in STATISTICS))


def _expression(ensemble: rules.Ensemble) -> Column:
    def holds(rule: rules.Rule) -> Column:
        tests = [F.col(f"_q_{STATISTICS[f]}") > t if above else F.col(f"_q_{STATISTICS[f]}") <= t for f, above, t in rule.conditions]
        return reduce(lambda a, b: a & b, tests)

    terms = [F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in ensemble.rules]
    total = reduce(lambda a, b: a + b, terms, F.lit(ensemble.intercept))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> rules.Ensemble:
    """Fit on at most `sample` labelled documents outside the held-out fifth."""
    rows = statistics(labelled_sample(docs, labels, label, sample)).drop("text").orderBy("doc_id").collect()
    x = np.array([[r[f"_q_{n}"] for n in STATISTICS] for r in rows]).reshape(len(rows), len(STATISTICS))
    return rules.fit(x, np.array([r.label for r in rows], float))


def with_scores(docs: DataFrame, ensemble: rules.Ensemble, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and `score`; column names that start with _q_ are taken."""
    return statistics(docs, text_col).select(*docs.columns, _expression(ensemble).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Null and empty texts are scored by their zero statistics.  Without labels, or with labels of
    one class, every score is the smoothed share of label 1.  Null ids have held_out null;
    repeated rows are kept; other columns are ignored, whatever their names.
    """
    own = docs.select("doc_id", "text")
    scored = with_scores(own, train(own, labels.select("doc_id", "quality"), sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
