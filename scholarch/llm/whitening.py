"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integers, so that counts, sums and deviations are exact whatever the order of
addition.  A row of the centred matrix X is (n*x - S) / n, from exact integers.  Each step makes
two distributed products, X v and then X'u, and orthogonalises in full: u against all earlier left
vectors, with the coefficients measured over all rows and measured again after the first
subtraction, and v against all earlier right vectors, twice, on the driver.  Left vectors, as long
as the table, are kept nowhere: X V = U M with a small triangular M, so a task derives its part
of U from its rows.  The singular values of M (bidiagonal up to rounding) are the deviations, and
its right singular vectors give the components.

A task adds up its rows and emits one partial sum for each number of a product; Spark sums these
by position.  So what reaches the driver is as long as a vector and the steps so far, and a lost
task is done again from the written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarch.llm.common import column
from scholarch.session import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
SATURATED = 1 << 62  # largest absolute value of a scaled entry
SAFE = 1 << 62  # integers below it are added in 64 bits, others as Python integers
ENTRIES = 1 << 21  # matrix entries handled at once inside a task
CONVERGED = 1e-14  # residual of a component, as a share of the largest singular value
NOTHING = 1e-12  # singular values below this share count as zero
LATTICE = "id long, x array<long>"


@dataclass(frozen=True)
class Whitening:
    """What rows of `dim` entries need: exact count and sums, components and their variances."""

    dim: int
    n: int
    sums: tuple[int, ...]
    basis: np.ndarray  # dim x components
    variances: np.ndarray  # falling
    total: float  # trace of the covariance
    steps: int


def lattice(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the vectors that take part, with entries floor(scale * c) + shift.

    Null vectors, those with a null or non-finite entry and those without entries are left out.
    Scaled entries beyond 2^62 are held at that value.
    """
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = own.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = F.transform("v", lambda c: F.least(F.greatest(F.floor(c * scale), F.lit(-SATURATED)), F.lit(SATURATED)) + shift)
    return finite.select("id", held.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, ENTRIES // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, column(part, "x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Centre:
    """n*x - S and (n*x - S) / n of integer rows, exact before the division."""

    def __init__(self, n: int, sums: tuple[int, ...]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)  # keeps the products small
        self.rest = [s - n * int(b) for s, b in zip(sums, self.base, strict=True)]

    def exact(self, x: np.ndarray) -> np.ndarray:
        """64-bit integers where they surely fit, else Python integers."""
        top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + int(np.abs(self.base).max(initial=0))
        if top * self.n + self.n < SAFE:
            return (x - self.base) * self.n - np.array(self.rest, np.int64)
        return (x.astype(object) - self.base.astype(object)) * self.n - np.array(self.rest, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        d = self.exact(x)
        return d / self.n if d.dtype != object else np.array([[float(Decimal(int(c)) / self.n) for c in r] for r in d], np.float64).reshape(d.shape)


def _counted(rows: DataFrame) -> list[tuple[int, int, tuple[int, ...]]]:
    """(length, rows, exact sums) for each length of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            x = column(batch, "x")
            sizes = np.diff(x.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                for _, m in _blocks([part], dim):
                    top = max(abs(int(m.max())), abs(int(m.min())))
                    add = m.sum(axis=0) if top * len(m) < SAFE else m.astype(object).sum(axis=0)
                    held = totals.setdefault(dim, [0, [0] * dim])
                    held[0] += len(m)
                    held[1] = [a + int(b) for a, b in zip(held[1], add, strict=True)]
        for dim, (n, sums) in totals.items():
            numbers = [n, *sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * (dim + 1), pa.int32()), pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(v) for v in numbers], pa.decimal128(38, 0))], names=["dim", "pos", "value"]
            )

    summed = rows.mapInArrow(run, "dim int, pos int, value decimal(38,0)").groupBy("dim", "pos").agg(F.sum("value").alias("value"))
    found: dict[int, dict[int, int]] = {}
    for r in summed.collect():  # one row for each position of a length
        found.setdefault(r.dim, {})[r.pos] = int(r.value)
    return [(dim, v[-1], tuple(v[i] for i in range(dim))) for dim, v in sorted(found.items())]


def _summed(rows: DataFrame, centre: Centre, dim: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all centred rows of `part(block)`, `size` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, dim):
            add = part(centre.rows(x))
            total = add if total is None else total + add
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["pos", "value"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect():
        out[r.pos] = r.value
    return out


def _orthogonal(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    for _ in range(2):
        w = w - v @ (v.T @ w)
    return w


def bidiagonalise(rows: DataFrame, centre: Centre, dim: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(right vectors of the leading `wanted` singular triples, singular values, squared norm, steps).

    Ends when the wanted triples have converged, all of the matrix is captured, or the right
    vectors span the space.  A step that finds no new direction goes on from a random one, so
    repeated singular values and matrices of lower rank come out whole.
    """
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((dim, 1))
    v /= np.linalg.norm(v)
    m = np.zeros((0, 0))  # X v = u m; `pivots` are the columns of v that gave a left vector
    pivots: list[int] = []
    xtu = np.zeros((dim, 0))
    gram = np.zeros((0, 0))
    norm = _summed(rows, centre, dim, 1, lambda x: np.array([(x * x).sum()]))[0]
    if not norm > 0:
        return np.zeros((dim, 0)), np.zeros(0), 0.0, 0
    while True:
        k, left = v.shape[1], len(pivots)
        inverse = np.linalg.inv(m[:, pivots]) if left else np.zeros((0, 0))
        before, latest, chosen = v[:, pivots], v[:, -1], left - 1

        def onward(x, before=before, latest=latest, inverse=inverse, chosen=chosen, left=left):
            """X v: products of the new column, and of the newest left vector, with all left vectors."""
            y, u = x @ latest, (x @ before) @ inverse
            return np.concatenate((u.T @ y, u.T @ u[:, chosen] if left else np.zeros(0)))

        sums = _summed(rows, centre, dim, 2 * left, onward) if left else np.zeros(0)
        first = sums[:left]
        if left:
            gram = np.pad(gram, ((0, left - len(gram)), (0, left - len(gram))))
            gram[:, -1] = gram[-1, :] = sums[left:]
        taken = first + (first - gram @ first)  # Gram-Schmidt twice

        def backward(x, before=before, latest=latest, inverse=inverse, taken=taken):
            """X'u of the orthogonalised column, its norm, and what is left of earlier ones in it."""
            u = (x @ before) @ inverse
            w = x @ latest - u @ taken
            return np.concatenate((x.T @ w, [w @ w], u.T @ w))

        sums = _summed(rows, centre, dim, dim + 1 + left, backward)
        rest = sums[dim + 1 :]
        z, taken = sums[:dim] - xtu @ rest, taken + rest
        alpha = float(np.sqrt(max(sums[dim] - rest @ rest, 0.0)))
        m = np.column_stack((m, taken)) if m.size or left else np.zeros((0, k))
        if alpha > NOTHING * np.sqrt(norm):
            m = np.vstack((m, np.zeros((1, k))))
            m[-1, -1] = alpha
            pivots.append(k - 1)
            xtu = np.column_stack((xtu, z / alpha))
            w = _orthogonal(z / alpha - alpha * v[:, -1], v)
        else:
            w = np.zeros(dim)
        beta = float(np.linalg.norm(w))
        found, values, turned = np.linalg.svd(m) if len(m) else (np.zeros((0, 0)), np.zeros(0), np.eye(k))
        captured = norm - float((m * m).sum()) <= 1e-14 * norm
        settled = alpha > 0 and len(values) >= wanted and np.all(beta * np.abs(found[-1, :wanted]) <= CONVERGED * values[0])
        if k == dim or captured or settled:
            break
        if beta <= NOTHING * np.sqrt(norm):
            w = _orthogonal(rng.standard_normal(dim), v)
        w /= np.linalg.norm(w)
        w = _orthogonal(w, v)
        v = np.column_stack((v, w / np.linalg.norm(w)))
    keep = np.flatnonzero(values > NOTHING * values[0])[:wanted] if len(values) else np.zeros(0, int)
    return v @ turned[keep].T, values[keep], float(norm), k


def fit(rows: DataFrame, components: int = COMPONENTS) -> list[Whitening]:
    """One model for each length of the vectors of `rows` (`lattice`, written), over all of them."""
    models = []
    for dim, n, sums in _counted(rows):
        own = rows.where(F.size("x") == dim)
        basis, values, norm, steps = bidiagonalise(own, Centre(n, sums), dim, min(components, dim))
        models.append(Whitening(dim, n, sums, basis, values**2 / n, norm / n, steps))
    return models


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = model.basis.shape[1]
    if not k:
        return 0.0
    turn, centre = model.basis / np.sqrt(model.variances), Centre(model.n, model.sums)
    own = rows.where(F.size("x") == model.dim)
    mean = _summed(own, centre, model.dim, k, lambda x: (x @ turn).sum(axis=0)) / model.n

    def products(x: np.ndarray) -> np.ndarray:
        w = x @ turn - mean
        return (w.T @ w).ravel()

    return float(np.abs(_summed(own, centre, model.dim, k * k, products).reshape(k, k) / model.n - np.eye(k)).max())


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, n, deviation: decimal(38,0), whitened: array<double>) for the rows of the model's length."""
    turn, centre = model.basis / np.sqrt(model.variances), Centre(model.n, model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.decimal128(38, 0)
        for part, x in _blocks(batches, model.dim):
            if not len(x):
                continue
            d = centre.exact(x)
            top = max(abs(int(d.max())), abs(int(d.min())))
            if d.dtype != object and top * top * model.dim < SAFE:
                deviation = pa.array((d * d).sum(axis=1)).cast(kind)
            else:
                exact = [sum(int(c) ** 2 for c in r) for r in d]
                deviation = pa.array([Decimal(e) if e < 10**38 else None for e in exact], kind)
            w = centre.rows(x) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(np.full(len(w), model.n)), deviation, lists], names=["id", "n", "deviation", "whitened"])

    own = rows.where(F.size("x") == model.dim)
    return own.mapInArrow(run, "id long, n long, deviation decimal(38,0), whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    `lattice` says which vectors take part; rows with a null or repeated id are rows of their own.
    Vectors of different lengths are fitted each among their own.  Components of no variance (below
    10^-24 of the largest) cannot be scaled to one and are not returned, so one vector alone, or
    only equal ones, give no rows; nor does an empty table.  `deviation` is exact, and null
    beyond 38 digits.  Of equal variances the components are any orthonormal choice.  Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialize(lattice(vectors, id_col=id_col, vector_col=vector_col), "lattice")
    parts = []
    for model in fit(rows, components):
        if not model.basis.shape[1]:
            continue
        share = F.array(*[F.lit(float(e / model.total)) for e in model.variances])
        parts.append(
            apply(rows, model)
            .select("id", "n", "deviation", F.posexplode("whitened").alias("p", "whitened"))
            .select(
                F.col("id").alias(id_col),
                (F.col("p") + 1).alias("component"),
                "n",
                "deviation",
                "whitened",
                share[F.col("p")].alias("explained"),
                F.lit(identity_error(rows, model)).alias("identity_error"),
            )
        )
    if not parts:
        return spark.createDataFrame([], f"{id_col} long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out
