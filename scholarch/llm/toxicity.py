"""Toxicity: a counterfactual-regularised linear classifier over words and word beginnings.

In labelled texts that mention a group, the identity term is swapped for others of its kind; the
fit penalises the squared change of the score, so a neutral mention of a group does not move it.
Features are the different words of a text and their beginnings; the most telling ones are chosen
by a chi-squared count over the sample, and lasso keeps a few.  Scoring reads whole texts in one
pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarch.llm.common import column, held_out, labelled_sample, text_slices
from scholarch.session import materialize

SAMPLE = 6000  # labelled documents of a fit, at most
FEATURES = 2048  # features of a fit, at most
THRESHOLD = 0.5
BEGINNINGS = (4, 5, 6, 7)
SWAPS = 3  # counterfactual versions of a text, at most
MEMO_ENTRIES = 500_000
# Terms for groups of people, by kind; a term is swapped for another of its kind.
IDENTITY_TERMS = (
    "women men girls boys woman man girl boy transgender nonbinary".split(),
    "muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist".split(),
    "african asian european american latino arab indian black white native immigrants refugees".split(),
    "gay straight lesbian bisexual heterosexual homosexual".split(),
    "old young elderly teenagers disabled deaf blind".split(),
    "femmes hommes musulmans chrétiens juifs noirs blancs immigrés".split(),
    "frauen männer muslime christen juden schwarze weiße migranten".split(),
    "mujeres hombres musulmanes cristianos judíos negros blancos inmigrantes".split(),
)
_WORD = re.compile(r"[^\W\d_]+")
_KIND = {term: kind for kind in IDENTITY_TERMS for term in kind}


def features_of(word: str) -> list[str]:
    """A word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def counterfactuals(words: set[str]) -> list[set[str]]:
    """The words with their identity terms swapped: one version per shift inside the kind."""
    own = [w for w in words if w in _KIND]
    versions = []
    for shift in range(1, SWAPS + 1) if own else ():
        swapped = {_KIND[w][(_KIND[w].index(w) + shift) % len(_KIND[w])] for w in own}
        versions.append(words.difference(own) | swapped)
    return versions


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: dict[str, float]

    def score(self, active: set[str]) -> float:
        z = self.intercept + sum(self.weights[f] for f in sorted(active))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, strength: float = 0.0003, fairness: float = 4.0, steps: int = 500) -> np.ndarray:
    """Lasso logistic weights, intercept last, with the penalty `fairness` * mean (pairs @ w)^2 / 2."""
    n, f = x.shape
    w, v, t = np.zeros(f + 1), np.zeros(f + 1), 1.0
    prior = (y.sum() + 1) / (n + 2)
    w[-1] = v[-1] = np.log(prior / (1 - prior))

    def times(m: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (m @ at.astype(np.float32)).astype(np.float64)  # a double vector would copy the matrix each time

    def penalty(at: np.ndarray) -> np.ndarray:
        return fairness * times(pairs.T, times(pairs, at)) / len(pairs) if len(pairs) else np.zeros(f)

    def gradient(at: np.ndarray) -> np.ndarray:
        r = (1 / (1 + np.exp(-np.clip(times(x, at[:-1]) + at[-1], -30, 30))) - y) / n
        return np.append(times(x.T, r) + penalty(at[:-1]), r.sum())

    def curvature(u: np.ndarray) -> np.ndarray:
        z = (times(x, u[:-1]) + u[-1]) / (4 * n)
        return np.append(times(x.T, z) + penalty(u[:-1]), z.sum())

    u = np.ones(f + 1)
    size = 1.0
    for _ in range(20):
        u = curvature(u)
        size = float(np.linalg.norm(u)) or 1.0
        u /= size
    rate = 1 / (1.1 * size)
    for _ in range(steps):
        new = v - rate * gradient(v)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * strength, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, label: str = "toxic") -> Model:
    """Fit on at most `sample` labelled documents outside the held-out fifth.

    Spark chooses the features; the driver gets at most `features` names and, per sampled text
    and swapped version, the numbers of the chosen ones in it.
    """

    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text", 500_000):
            rows, ids, names = [], [], []
            for row, text in enumerate(texts):
                words = words_of(text)
                for number, version in enumerate([words, *counterfactuals(words)]):
                    rows.append(row)
                    ids.append(number)
                    names.append(sorted({f for w in version for f in features_of(w)}))
            kept = batch.select(["doc_id", "label"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ids, pa.int32()), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "label", "version", "features"])

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("label", T.IntegerType()),
            T.StructField("version", T.IntegerType()),
            T.StructField("features", T.ArrayType(T.StringType())),
        ]
    )
    made = materialize(labelled_sample(docs, labels, label, sample).select("doc_id", "label", "text").mapInArrow(versions, schema), "labelled-features")
    n, ones = made.where("version = 0").agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (ones + 1) / (n + 2)
    if n < 20 or ones in (0, n):
        return Model(float(np.log(prior / (1 - prior))), {})
    seen = made.where("version = 0").select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("k")).where("n >= 3")
    expected = F.col("n") * F.lit(ones / n)
    chi = F.pow(F.col("k") - expected, 2) / (expected * F.lit(1 - ones / n))
    named = [w for kind in IDENTITY_TERMS for term in kind for w in features_of(term)]
    chosen = seen.select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(features).collect()
    identity = seen.where(F.col("feature").isin(named)).select("feature").collect()
    number = {name: i for i, name in enumerate(dict.fromkeys([r.feature for r in chosen] + [r.feature for r in identity]))}
    wanted = sorted(number)
    rows = made.select("doc_id", "version", "label", F.filter("features", lambda f: f.isin(wanted)).alias("features")).orderBy("doc_id", "version").collect()

    def vector(names) -> np.ndarray:
        out = np.zeros(len(number), np.float32)
        out[[number[f] for f in names]] = 1
        return out

    x, y, pairs, base = [], [], [], None
    for r in rows:
        this = vector(r.features)
        if r.version == 0:
            x.append(this)
            y.append(r.label)
            base = this
        else:
            pairs.append(this - base)
    w = fit(np.array(x), np.array(y, np.float32), np.array(pairs, np.float32).reshape(len(pairs), len(number)))
    return Model(float(w[-1]), {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-4})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}  # a word and its features that carry a weight
        for batch, texts in text_slices(batches, "_text"):
            scores = []
            for text in texts:
                active: set[str] = set()
                for word in words_of(text):
                    found = memo.get(word)
                    if found is None:
                        found = tuple(f for f in features_of(word) if f in model.weights)
                        if len(memo) >= MEMO_ENTRIES:
                            memo.clear()
                        memo[word] = found
                    if found:
                        active.update(found)
                scores.append(model.score(active))
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), pa.array(scores, pa.float64())], names=[id_col, "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Null and empty texts have no words and get the intercept's score.  Without labels, or with
    labels of one class, every score is the smoothed share of label 1.  Null ids have held_out
    null; repeated rows are kept; other columns are ignored, whatever their names.
    """
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), sample)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
