"""Approximate nearest neighbours by an inverted multi-index (operator 1).

Vectors are cut into two halves, each quantised by its own codebook of centroids
(k-means over a bounded, hashed sample of SAMPLE vectors; their number grows with the
rows, from 16 to MOST_CENTROIDS); a cell is a pair of centroids. A query walks the pairs by summed distance
of its halves to the centroids (multi-sequence algorithm with a heap) until the
cells passed hold a share of the distinct vectors; the entries of those cells are
ranked again by the exact inner product in double precision.

The share is measured, not set: on PROBES vectors of the sample the walk is held
against brute force over the sample, and the share is what a recall of RECALL needs there.
The neighbours of a query among all rows lie nearer than those among a
sample, so that the share errs on the safe side. `fraction=1.0` passes all cells, which is the exact search.

A walk that passes more than STEPS cells is not gone cell by cell, as its end can be selected without their order.
The walk's last sum says for any cell whether it was passed, so that only this
number travels with a query. Index rows lie in groups of neighbouring first centroids, cut
into blocks of bounded size, and queries into blocks likewise; a query goes only to
groups of which it passes a cell, and in a block each cell's rows are multiplied with the queries that passed
that cell alone. The best K_TOP of each query leave a block.

Cases: vectors that are null, zero, of another length than most of the sample,
or hold null or non-finite components take no part, nor do rows without an id;
equal vectors tie and the smaller ids come first; rows that share an id are candidates
of each other and each ask for themselves; products beyond the range of doubles are
infinite and rank by their sign, undefined ones last; with fewer candidates than asked for all come
back that the walk passes, and the walk passes all cells if they hold fewer
than `k` rows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsurf.llm import common

MOST_CENTROIDS = 256
SAMPLE = 20_000
PROBES = 512
RECALL = 0.96
GROUPS = 16
#: Cells that a walk takes one by one, and buckets of sums in which a longer walk's end is sought.
STEPS, BUCKETS = 512, 1024
ROWS_BLOCK = 4096
QUERY_BLOCK = 1024


def usable(col):
    """True for vectors that take part; SQL functions only."""
    v = F.transform(col, lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(v, lambda x: x != 0.0), F.lit(False))


def fit_half(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from a farthest-spread start over distinct rows; fewer rows than k give fewer centroids."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            total = np.bincount(near, x[:, j], minlength=k)
            c[:, j] = np.where(count > 0, total / np.maximum(count, 1), c[:, j])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1), 0.0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


def walk(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, wanted: float) -> float:
    """The summed distance of the last cell that the walk passes. sizes: K1 x K2 rows of each cell.

    A walk of more than STEPS cells is not gone to its end: the sum at which it would stop is selected among the cells that hold rows.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1].tolist(), d2[o2].tolist()
    n1, n2 = len(a), len(b)
    heap = [(a[0] + b[0], 0, 0)]
    got, steps = 0, 0
    while heap:
        last, i, j = heapq.heappop(heap)
        got += int(sizes[o1[i], o2[j]])
        if got >= wanted:
            return last
        steps += 1
        if steps == STEPS:
            return stop_of_walk(d1, d2, sizes, wanted)
        if j == 0 and i + 1 < n1:
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        if j + 1 < n2:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return np.inf


def stop_of_walk(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, wanted: float) -> float:
    """What walk() returns, without an order of the cells: the least sum up to which cells hold `wanted` rows."""
    c1, c2 = np.nonzero(sizes)
    held, s = sizes[c1, c2], d1[c1] + d2[c2]
    if not held.sum() >= wanted:
        return np.inf
    # the bucket of sums in which the walk stops, then the place in it
    low, wide = s.min(), np.ptp(s)
    bucket = np.minimum((s - low) * (BUCKETS / wide), BUCKETS - 1).astype(np.int64) if wide > 0 else np.zeros(len(s), np.int64)
    total = np.cumsum(np.bincount(bucket, held, BUCKETS))
    at = int(np.searchsorted(total, wanted))
    own = np.flatnonzero(bucket == at)
    own = own[np.argsort(s[own], kind="stable")]
    before = total[at - 1] if at else 0.0
    return float(s[own[int(np.searchsorted(before + np.cumsum(held[own]), wanted))]])


def share_needed(x: np.ndarray, scaled: np.ndarray, books: list[np.ndarray], k: int, recall: float) -> float:
    """The share of the distinct vectors x that a walk must pass to meet `recall` of the k nearest, measured on PROBES of them."""
    _, pick = np.unique(x, axis=0, return_index=True)
    pick.sort()
    x, scaled = x[pick], scaled[pick]
    half = books[0].shape[1]
    c = nearest(scaled[:, :half], books[0]) * len(books[1]) + nearest(scaled[:, half:], books[1])
    used, c, sizes = np.unique(c, return_inverse=True, return_counts=True)  # empty cells add nothing
    probe = np.random.default_rng(3).permutation(len(x))[:PROBES]
    d1, d2 = distances(scaled[probe, :half], books[0]), distances(scaled[probe, half:], books[1])
    needed = []
    for i, row in enumerate(probe.tolist()):
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.nan_to_num(x @ x[row], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        s[row] = -np.inf
        best = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
        cell = d1[i][used // len(books[1])] + d2[i][used % len(books[1])]
        order = np.argsort(cell, kind="stable")
        reached = np.empty(len(order))
        reached[order] = np.cumsum(sizes[order])
        needed.append(reached[c[best]] / len(x))
    needed = np.concatenate(needed) if needed else np.empty(0)
    return float(np.quantile(needed, recall, method="higher")) if len(needed) else 1.0


def top(ids: np.ndarray, rid: np.ndarray, x: np.ndarray, cell: np.ndarray, qrid: np.ndarray, q: np.ndarray, passed, k: int):
    """The best k rows of each query among those in cells it passed: positions of queries and rows, scores.

    Rows come in order of their cell; passed(cell of a row) is a mask of queries.
    """
    approx = np.full((len(q), len(x)), -np.inf)
    head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    with np.errstate(over="ignore", invalid="ignore"):
        for a, z in zip(head.tolist(), [*head[1:].tolist(), len(x)], strict=True):
            ask = np.flatnonzero(passed(a))
            if len(ask):
                approx[ask, a:z] = np.nan_to_num(q[ask] @ x[a:z].T, nan=-np.finfo(float).max, posinf=np.inf, neginf=-np.finfo(float).max)
    approx[qrid[:, None] == rid[None, :]] = -np.inf
    if approx.shape[1] > k:
        floor = np.partition(approx, -k, axis=1)[:, -k]
        with np.errstate(over="ignore"):
            keep = approx >= (floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))))[:, None]
    else:
        keep = np.ones(approx.shape, bool)
    at, row = np.nonzero(keep & (approx > -np.inf))
    score = np.empty(len(at))
    with np.errstate(over="ignore", invalid="ignore"):
        for s in range(0, len(at), 65_536):
            score[s : s + 65_536] = np.einsum("ij,ij->i", q[at[s : s + 65_536]], x[row[s : s + 65_536]])
    order = np.lexsort((ids[row], -np.nan_to_num(score, nan=-np.inf, posinf=np.inf, neginf=-np.inf), at))
    at, row, score = at[order], row[order], score[order]
    first = np.searchsorted(at, at)
    best = np.arange(len(at)) - first < k
    return at[best], row[best], score[best]


def search(vectors: DataFrame, is_query, k: int = 20, fraction: float | None = None, centroids: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """The k nearest rows found for each row of vectors(vec_id, embedding) that meets is_query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    common.tune(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))

    # bounded by `sample`
    got = base.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(got):
        return spark.createDataFrame([], schema)
    length = int(np.bincount([len(x) for x in got.v]).argmax())
    base = base.filter(F.size("v") == length)
    rows, scale = base.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    sampled = np.array([x for x in got.v if len(x) == length], np.float64)
    half = max(1, length // 2)
    if centroids is None:
        centroids = 1 << max(4, min(MOST_CENTROIDS.bit_length() - 1, round(np.log2(rows) / 2)))
    scaled = sampled / scale  # squares of large components stay finite
    books = [fit_half(scaled[:, :half], centroids), fit_half(scaled[:, half:], centroids) if length > half else np.zeros((1, 0))]
    # neighbouring first centroids side by side: along the axis in which they differ most
    _, _, axes = np.linalg.svd(books[0] - books[0].mean(0), full_matrices=False)
    books[0] = books[0][np.argsort(books[0] @ axes[0], kind="stable")]
    if fraction is None:
        fraction = share_needed(sampled, scaled, books, k, RECALL)

    def cells(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(-1, length) / scale
            c1, c2 = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32))], ["rid", "vec_id", "v", "is_query", "c1", "c2"])

    # rid: a row's own number, as rows may share an id; fixed once written
    numbered = base.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v", "is_query")
    index, _ = common.write_table(numbered.mapInArrow(cells, "rid long, vec_id long, v array<double>, is_query boolean, c1 int, c2 int"), "imi")

    # at most centroids x centroids rows; copies of a vector count once in the walk
    counts = index.groupBy("c1", "c2", F.xxhash64("v").alias("h")).agg(F.count("*").alias("n")).groupBy("c1", "c2").agg(F.count("*").alias("distinct"), F.sum("n").alias("n")).toPandas()
    sizes = np.zeros((len(books[0]), len(books[1])), np.int64)
    sizes[counts.c1, counts.c2] = counts.distinct
    per_first = np.bincount(counts.c1, counts.n, len(books[0]))
    # groups of about as many rows each
    group = np.minimum((np.cumsum(per_first) - per_first / 2) * GROUPS // max(1, per_first.sum()), GROUPS - 1).astype(np.int64)
    blocks = np.maximum(1, -(-np.bincount(group, per_first, GROUPS).astype(np.int64) // ROWS_BLOCK))
    wanted = max(fraction * sizes.sum(), k + 1)
    n_queries = index.filter("is_query").count()
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))

    def probes(batches):
        """Each query once for each block of rows that it may have to see."""
        import pyarrow as pa

        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(-1, length) / scale
            d1, d2 = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
            last = np.array([walk(d1[i], d2[i], sizes, wanted) for i in range(len(x))])
            reach = d1 + d2.min(1)[:, None] <= last[:, None] + 1e-12
            near = np.stack([reach[:, group == g].any(1) for g in range(GROUPS)], 1)
            pick, g = np.nonzero(near)
            n = blocks[g]
            pick, g = np.repeat(pick, n), np.repeat(g, n)
            vb = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
            own = pa.array(pick)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(own), b.column(1).take(own), b.column(2).take(own), pa.array(last[pick]), pa.array(g.astype(np.int32)), pa.array(vb.astype(np.int32))],
                ["query_rid", "query_id", "q", "last", "g", "vb"],
            )

    asked = index.filter("is_query").select("rid", "vec_id", "v").mapInArrow(probes, "query_rid long, query_id long, q array<double>, last double, g int, vb int").withColumn("qb", F.pmod(F.xxhash64("query_rid"), F.lit(query_blocks)).cast("int"))
    of = lambda values, at: F.element_at(F.array(*[F.lit(int(x)) for x in values]), at + 1)
    placed = index.select("rid", "vec_id", "v", "c1", "c2", of(group, F.col("c1")).alias("g"))
    placed = placed.withColumn("vb", F.pmod(F.xxhash64("rid"), of(blocks, F.col("g"))).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def meet(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_rid": [], "query_id": [], "vec_id": [], "score": []}).astype({"query_rid": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        right = right.sort_values(["c1", "c2"], kind="stable")
        x, q = np.stack(right.v.to_numpy()), np.stack(left.q.to_numpy())
        d1, d2 = distances(q[:, :half] / scale, books[0]), distances(q[:, half:] / scale, books[1])
        c1, c2, last = right.c1.to_numpy(), right.c2.to_numpy(), left["last"].to_numpy() + 1e-12
        ids, qrid = right.vec_id.to_numpy(), left.query_rid.to_numpy()
        at, row, score = top(ids, right.rid.to_numpy(), x, c1 * sizes.shape[1] + c2, qrid, q, lambda r: d1[:, c1[r]] + d2[:, c2[r]] <= last, k)
        return pd.DataFrame({"query_rid": qrid[at], "query_id": left.query_id.to_numpy()[at], "vec_id": ids[row], "score": score})

    found = asked.groupBy("g", "vb", "qb").cogroup(placed.groupBy("g", "vb", "qb")).applyInPandas(meet, "query_rid long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query_rid").orderBy(F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score")).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute(vectors: list[tuple[int, np.ndarray]], queries: set[int], k: int = 20) -> dict[int, list[int]]:
    """All pairs, for tests."""
    ids = np.array([i for i, _ in vectors])
    x = np.stack([v for _, v in vectors]).astype(np.float64)
    out = {}
    for i in np.flatnonzero(np.isin(ids, list(queries))):
        s = np.einsum("ij,j->i", x, x[i])
        order = np.lexsort((ids, -s))
        out[int(ids[i])] = [int(ids[j]) for j in order if ids[j] != ids[i]][:k]
    return out


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read_docs(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
