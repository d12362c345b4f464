"""Approximate nearest neighbours: inverted lists and adaptive dimension scans.

Inner products become distances by one more coordinate (sqrt(M^2 - |x|^2) for a candidate, 0 for a
query), so the largest product is the smallest distance.  Vectors are turned by a fixed random
rotation and laid out in blocks of columns.  A scan adds up squared differences block by block; a
candidate goes when its partial distance, scaled to all dimensions, is significantly above the
distance of the k-th best found so far (the hypothesis test of adaptive sampling: after d of D
dimensions, dist_d * D / d > tau * (1 + EPSILON / sqrt(d))^2).  Survivors of all blocks are scored
exactly, in double precision, on the original vectors.

Each vector is in the list of its nearest centre, each query probes the lists of its `probes`
nearest centres: first its own list, which gives every query a threshold, then the others.  Lists
and their queries are cut into blocks of bounded size by counts, so a list that holds a third of
all vectors is many tasks.  Copies of a vector are one entry that carries its k + 1 smallest ids,
enough for any result; equal queries are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarch.llm.common import column
from scholarch.session import materialize

EPSILON = 2.1  # confidence of the test
BLOCK = 16  # dimensions added at a time
ROWS = 4096  # vectors of a list block, at most about
QUERIES = 4096  # queries of a block, at most about
CHUNK = 512  # rows that thresholds are renewed after
DENSE = 0.25  # pairs are scanned as a whole block until fewer than this share survive
PROBED = 0.8  # share of the lists that a query probes, unless a number is given
SAMPLE = 20_000  # vectors that centres are fitted on
MOST_LISTS = 1024


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vec: array<float>): one vector per id, those that take part only.

    Null ids, null and empty vectors, zero vectors and those with a null or non-finite component
    are left out, and so are vectors of another length than the most frequent one (the smaller of
    two equally frequent).  Of several vectors of one id the smallest counts.
    """
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>").alias("vec"))
    finite = own.where(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    sizes = finite.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = sizes[0].d if sizes else 0
    return finite.where(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec"))


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def centres(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k-means on a bounded sample; an empty centre is put on a random vector."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmin((at**2).sum(1) - 2 * sample @ at.T, axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(at))
        empty = counts == 0
        at = sums / np.maximum(counts, 1)[:, None]
        at[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
    return at.astype(np.float32)


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) if len(values) else np.zeros((0, dim), np.float32)


def scan_block(q: np.ndarray, x: np.ndarray, turned: np.ndarray, largest: float, k: int, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best candidates of one list block for its queries: query number, candidate number, score.

    `tau` holds the k-th best score known so far (-inf: none).  Per query at most k + ties come out.
    """
    dim = q.shape[1] + 1
    fq = np.zeros((len(q), dim), np.float32)
    fq[:, :-1] = q
    fx = np.column_stack([x, np.sqrt(np.maximum(largest**2 - (x.astype(np.float64) ** 2).sum(1), 0))]).astype(np.float32)
    fq, fx = fq @ turned, fx @ turned
    base = (q.astype(np.float64) ** 2).sum(1) + largest**2  # squared distance = base - 2 * product
    tau = tau.copy()
    found_q, found_x, found_s = [], [], []
    held = np.full((len(q), k), -np.inf)
    q64, x64 = q.astype(np.float64), x.astype(np.float64)
    for start in range(0, len(x), CHUNK):
        part = slice(start, min(start + CHUNK, len(x)))
        limit = np.where(np.isneginf(tau), np.inf, np.maximum(base - 2 * tau, 0)).astype(np.float32)

        def distance(a: int, b: int, part=part) -> np.ndarray:
            """Squared differences of all pairs over the columns from a to b."""
            return (fq[:, a:b] ** 2).sum(1)[:, None] + (fx[part, a:b] ** 2).sum(1)[None, :] - 2 * (fq[:, a:b] @ fx[part, a:b].T)

        d = min(BLOCK, dim)
        total = distance(0, d)
        pairs = None  # numbers of the surviving pairs, once they are few
        while True:
            factor = (d / dim) * (1 + (EPSILON / np.sqrt(d) if d < dim else 0)) ** 2
            if pairs is None:
                stay = total <= (limit * factor + 1e-4)[:, None]
                if d == dim or np.count_nonzero(stay) < DENSE * stay.size:
                    pairs = np.nonzero(stay)
                    total = total[pairs]
            else:
                stay = total <= limit[pairs[0]] * factor + 1e-4
                pairs, total = (pairs[0][stay], pairs[1][stay]), total[stay]
            if d == dim or (pairs is not None and not len(pairs[0])):
                break
            e = min(d + BLOCK, dim)
            if pairs is None:
                total += distance(d, e)
            else:
                total = total + ((fq[pairs[0], d:e] - fx[pairs[1] + start, d:e]) ** 2).sum(1)
            d = e
        qi, xi = pairs
        if not len(qi):
            continue
        score = np.concatenate([(q64[qi[i : i + 65536]] * x64[xi[i : i + 65536] + start]).sum(axis=1) for i in range(0, len(qi), 65536)])
        dense = np.full((len(q), part.stop - start), -np.inf)
        dense[qi, xi] = score
        held = np.partition(np.concatenate((held, dense), axis=1), dense.shape[1], axis=1)[:, dense.shape[1] :]
        tau = np.maximum(tau, held[:, 0])
        found_q.append(qi)
        found_x.append(xi + start)
        found_s.append(score)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    qi, xi, score = np.concatenate(found_q), np.concatenate(found_x), np.concatenate(found_s)
    stay = score >= tau[qi]
    return qi[stay], xi[stay], score[stay]


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, lists: int | None = None, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The `k` nearest of each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Candidates are all rows but the query's own; fewer than k give all.  Ties go to smaller ids.
    `clean_vectors` says which vectors take part.  An empty table gives no rows; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    clean = materialize(clean_vectors(vectors, id_col, vector_col), "vectors")
    facts = clean.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not facts.n:
        return empty
    dim, largest = facts.d, float(np.sqrt(facts.m)) * (1 + 1e-6)
    # copies: one entry with the smallest id, the k + 1 smallest ids, and whether a query is among them
    firsts = clean.groupBy("vec").agg(F.min("id").alias("rep"), F.max((F.col("id") % every == 0).cast("int")).alias("asks"))
    ranked = clean.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    ids = ranked.groupBy("vec").agg(F.collect_list("id").alias("ids"))
    entries = materialize(firsts.join(ids, "vec").select("rep", "vec", "ids", "asks"), "entries")

    n_lists = lists or int(min(MOST_LISTS, max(1, round(float(np.sqrt(facts.n))))))
    n_probes = min(n_lists, probes or max(8, int(np.ceil(PROBED * n_lists))))
    sample = entries.select("vec").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    around = centres(np.array([r.vec for r in sample], np.float32), n_lists)
    n_probes = min(n_probes, len(around))
    norms = (around**2).sum(1)
    turned = rotation(dim + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The list of every entry, and for entries that ask the lists to probe, nearest first."""
        for batch in batches:
            if not batch.num_rows:
                continue
            near = norms - 2 * _matrix(column(batch, "vec"), dim) @ around.T
            own = near.argmin(axis=1)
            asks = column(batch, "asks").to_numpy(zero_copy_only=False) > 0
            probed: list = [None] * len(own)
            for row in np.flatnonzero(asks):
                best = np.argpartition(near[row], n_probes - 1)[:n_probes] if n_probes < len(around) else np.arange(len(around))
                probed[row] = [int(own[row]), *(int(c) for c in best[np.argsort(near[row][best], kind="stable")] if c != own[row])][:n_probes]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "rep"), column(batch, "vec"), column(batch, "ids"), pa.array(own, pa.int32()), pa.array(probed, pa.list_(pa.int32()))],
                names=["rep", "vec", "ids", "list", "probed"],
            )

    placed = materialize(entries.mapInArrow(place, "rep long, vec array<float>, ids array<long>, list int, probed array<int>"), "placed")

    def scan(kind, left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries (left) against one block of a list (right)."""
        out = {"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if left.num_rows and right.num_rows:
            reps = left["qrep"].to_numpy()
            qi, xi, score = scan_block(
                _matrix(left["qvec"].combine_chunks(), dim), _matrix(right["vec"].combine_chunks(), dim), turned, largest, k + 1, left["tau"].to_numpy(zero_copy_only=False)
            )
            ids = right["ids"].to_pylist()
            rows = [(q, i, s) for q, x, s in zip(reps[qi].tolist(), xi.tolist(), score.tolist(), strict=True) for i in ids[x]]
            if rows:
                out = {"query": pa.array([r[0] for r in rows], pa.int64()), "id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64())}
        return pa.table(out)

    def scanned(asked: DataFrame) -> DataFrame:
        """`asked` (qrep, qvec, tau, list) against the lists, in blocks of both sides."""
        sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("xs"))
        loads = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs"))
        grid = F.broadcast(sizes.join(F.broadcast(loads), "list"))  # one row per list, MOST_LISTS at most
        rows = (
            placed.join(grid, "list")
            .withColumn("xb", F.pmod(F.xxhash64("rep"), F.col("xs")).cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
            .select("list", "xb", "qb", "vec", "ids")
        )
        queries = (
            asked.join(grid, "list")
            .withColumn("qb", F.pmod(F.xxhash64("qrep", F.lit(1)), F.col("qs")).cast("int"))
            .withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
            .select("list", "xb", "qb", "qrep", "qvec", "tau")
        )
        keys = ["list", "xb", "qb"]
        found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(scan, "query long, id long, score double")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")

    asking = placed.where("probed is not null").select(F.col("rep").alias("qrep"), F.col("vec").alias("qvec"), F.col("probed").alias("probed"))
    first = materialize(scanned(asking.select("qrep", "qvec", F.lit(float("-inf")).alias("tau"), F.col("probed")[0].alias("list"))), "own-lists")
    # the (k + 1)-th best so far bounds what the other lists can add
    bound = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low")).select(F.col("query").alias("qrep"), F.when(F.col("n") > k, F.col("low")).otherwise(float("-inf")).alias("tau"))
    rest = asking.where(F.size("probed") > 1).join(bound, "qrep", "left").select("qrep", "qvec", F.coalesce("tau", F.lit(float("-inf"))).alias("tau"), F.explode(F.slice("probed", 2, n_probes)).alias("list"))
    all_found = first.union(scanned(rest)) if n_probes > 1 else first
    merged = all_found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    tops = merged.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("top"))
    # back to every query id: drop its own row, keep k
    owners = clean.where(F.col("id") % every == 0).join(firsts.select("vec", "rep"), "vec").select(F.col("id").alias("query_id"), F.col("rep").alias("query"))
    per_query = owners.join(tops, "query").select("query_id", F.slice(F.filter("top", lambda t: t["id"] != F.col("query_id")), 1, k).alias("top"))
    return per_query.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.id").alias("vec_id"), F.col("t.score").alias("score"))
