"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are turned by a random rotation and dealt to inverted lists by their nearest centroid. For each query, size and spread of
every list and the distance of its centroid tell how many of the k nearest it should hold; lists are probed in the order of that number until
EXPECTED of the neighbours are accounted for. Inside a list, distances grow column block by column block; after each block a hypothesis test compares the
scaled partial distance with the query's bound and abandons candidates that are almost surely farther. The bound begins as the k-th smallest
distance in a sample and falls to the k-th smallest distance seen as blocks of candidates are worked off. Centroids, rotation and the first bounds come from a
sample of at most 2 SAMPLE vectors; every vector is indexed. Lists of any size are cut into pieces of about PIECE_ROWS rows, and what tasks return
is the best k of each query and piece.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stash

SAMPLE = 4096
ROWS_PER_LIST = 512
MAX_LISTS = 1024
#: Share of the neighbours that the probed lists should hold, by the estimate.
EXPECTED = 0.9
BLOCK_COLUMNS = 16
EPSILON = 2.5
PIECE_ROWS = 1024
QUERY_BLOCK = 256
ROW_BLOCK = 256
NEAREST = 10


@dataclass
class Index:
    rotation: np.ndarray  # float32[d, d]
    centroids: np.ndarray  # float32[lists, d], rotated
    sample_ids: np.ndarray
    sample: np.ndarray  # float64[n, d], as given


def fit(ids: np.ndarray, sample: np.ndarray, rows: int, seed: int = 7) -> Index:
    """Rotation and k-means centroids of a sample of a table of so many rows."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
    x = (sample.astype(np.float32) @ rotation).astype(np.float32)
    lists = int(min(MAX_LISTS, max(1, rows // ROWS_PER_LIST), max(1, len(x) // 8)))
    centroids = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(12):
        near = closest(x, centroids, 1)[:, 0]
        sums, n = np.zeros_like(centroids), np.bincount(near, minlength=lists)
        np.add.at(sums, near, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return Index(rotation, centroids, ids, sample)


def closest(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    gap = (centroids * centroids).sum(1)[None, :] - 2 * (x @ centroids.T)
    return np.argsort(gap, axis=1, kind="stable")[:, :k]


def expected_hits(gap: np.ndarray, lists: np.ndarray, columns: int, k: int) -> np.ndarray:
    """For each query and list, how many of the k nearest rows the list should hold.

    gap: squared distances of queries and centroids; lists: for each list its rows, and mean and variance of its rows' squared distances to the
    centroid. Squared distances of a query to a list's rows are taken as normal; the radius is the one within which k rows should be.
    """
    rows, mean, spread = lists
    middle = gap + mean
    width = np.sqrt(np.maximum(spread + 4 * gap * mean / columns, 1e-12))

    def inside(radius: np.ndarray) -> np.ndarray:
        z = np.clip((radius[:, None] - middle) / width, -8, 8)
        return rows * (0.5 + 0.5 * np.tanh(0.7978845608 * (z + 0.044715 * z**3)))  # normal distribution function

    low, high = np.zeros(len(gap)), (middle + 4 * width).max(axis=1)
    for _ in range(40):
        half = (low + high) / 2
        enough = inside(half).sum(axis=1) > k
        low, high = np.where(enough, low, half), np.where(enough, half, high)
    return inside(high)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, embedding (doubles): without null, zero-length or all-zero vectors, and those with null or non-finite components."""
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda v: v != 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), -1)


def best_of(qi: np.ndarray, xi: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest hits of each query, in its order, and their places (from 0). A repeated id holds one place, at its nearest vector."""
    order = np.lexsort((exact, ids[xi], qi))
    own = ids[xi[order]]
    order = order[(np.diff(qi[order], prepend=-1) != 0) | np.concatenate([[True], own[1:] != own[:-1]])]
    qi, xi, exact = qi[order], xi[order], exact[order]
    order = np.lexsort((ids[xi], exact, qi))
    qi, xi, exact = qi[order], xi[order], exact[order]
    first = np.flatnonzero(np.diff(qi, prepend=-1))
    place = np.arange(len(qi)) - np.repeat(first, np.diff(first, append=len(qi)))
    best = place < k
    return qi[best], xi[best], exact[best], place[best]


def scan(index: Index, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k ids of the rows for each query: (query row, vector row, distance). bound: a squared distance that the k-th nearest id does not exceed."""
    d = x.shape[1]
    rx, rq = (x @ index.rotation.astype(np.float64)), (q @ index.rotation.astype(np.float64))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low in range(0, len(q), QUERY_BLOCK):
        part = rq[low : low + QUERY_BLOCK]
        limit = bound[low : low + QUERY_BLOCK].copy()
        found = (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int))
        for start in range(0, len(x), ROW_BLOCK):
            rows = slice(start, start + ROW_BLOCK)
            qi, xi = np.nonzero(query_ids[low : low + QUERY_BLOCK, None] != ids[None, rows])
            sums = np.zeros(len(qi))
            for at in range(0, d, BLOCK_COLUMNS):
                to = min(d, at + BLOCK_COLUMNS)
                if at == 0:  # all pairs at once; later blocks touch the survivors only
                    a, b = part[:, at:to], rx[rows, at:to]
                    sums = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)[qi, xi]
                else:
                    sums = sums + ((part[qi, at:to] - rx[start + xi, at:to]) ** 2).sum(1)
                scale = d / to
                slack = (1 + EPSILON / np.sqrt(to)) ** 2 if to < d else 1 + 1e-9
                stay = sums * scale <= limit[qi] * slack + 1e-9
                qi, xi, sums = qi[stay], xi[stay], sums[stay]
                if not len(qi):
                    break
            if not len(qi):
                continue
            xi = start + xi
            exact = np.sqrt(((q[low + qi] - x[xi]) ** 2).sum(1))
            found = best_of(np.concatenate([found[0], qi]), np.concatenate([found[1], xi]), ids, np.concatenate([found[2], exact]), k)
            full = found[3] == k - 1
            limit[found[0][full]] = np.minimum(limit[found[0][full]], found[2][full] ** 2 * (1 + 1e-9) + 1e-9)
        if len(found[0]):
            out.append((found[0] + low, found[1], found[2]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


HIT = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, every: int = 100, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose vec_id is divisible by every.

    Nearness is Euclidean in double precision on the original vectors, ties to the smaller id; a query is not its own
    candidate; fewer rows than k give all of them. A repeated id is one candidate, at its nearest vector; copies under
    several ids are candidates each. Should vectors have several lengths, those of the most frequent one (of equals the largest) take part. Extra columns
    play no part; empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    # One row per length of vectors.
    n, width = max(((r["n"], r["width"]) for r in rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).collect()), default=(0, 0))
    rows = rows.where(F.size("embedding") == width)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if n < 1:
        return empty
    taken = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(2**31)) <= int(min(1.0, SAMPLE / n) * 2**31)).limit(2 * SAMPLE).toArrow()
    if not taken.num_rows:
        taken = rows.limit(SAMPLE).toArrow()
    index = fit(np.asarray(taken.column("vec_id")), _matrix(taken.column("embedding")), n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = (_matrix(batch.column("embedding")) @ index.rotation).astype(np.float32)
                near = closest(x, index.centroids, 1)[:, 0]
                gap = ((x - index.centroids[near]) ** 2).sum(1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(gap)], ["vec_id", "embedding", "list", "gap"])

    indexed = stash(rows.mapInArrow(assign, "vec_id long, embedding array<double>, list int, gap double"), "lists")
    # One row per list, MAX_LISTS at most.
    lists = np.zeros((3, len(index.centroids)))
    for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.var_pop("gap").alias("spread")).collect():
        lists[:, r["list"]] = r["n"], r["mean"], r["spread"]
    by_id = np.argsort(index.sample_ids, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(index.sample_ids[by_id]) != 0]))

    def routed(part: pa.RecordBatch) -> pa.RecordBatch:
        q, own = _matrix(part.column("embedding")), np.asarray(part.column("vec_id"))
        turned = q @ index.rotation
        far = ((turned * turned).sum(1)[:, None] + (index.centroids * index.centroids).sum(1)[None, :] - 2 * turned @ index.centroids.T).clip(min=0)
        hits = expected_hits(far, lists, q.shape[1], k)
        order = np.argsort(-hits, axis=1, kind="stable")
        share = np.cumsum(np.take_along_axis(hits, order, axis=1), axis=1) / np.maximum(hits.sum(1), 1e-300)[:, None]
        probes = (share < EXPECTED).sum(1) + 1
        gap = ((q * q).sum(1)[:, None] + (index.sample * index.sample).sum(1)[None, :] - 2 * q @ index.sample.T).clip(min=0)
        gap[own[:, None] == index.sample_ids[None, :]] = np.inf
        of_id = np.minimum.reduceat(gap[:, by_id], heads, axis=1) if len(heads) < gap.shape[1] else gap
        bound = np.partition(of_id, k - 1, axis=1)[:, k - 1] if len(heads) >= k else np.full(len(q), np.inf)
        bound = bound * (1 + 1e-9) + 1e-9
        first = []
        for i in range(len(q)):  # the sample's own k nearest, with exact distances
            some = np.flatnonzero((gap[i] <= bound[i]) & np.isfinite(gap[i]))
            exact = np.sqrt(((index.sample[some] - q[i]) ** 2).sum(1))
            best: dict[int, float] = {}
            for j in np.lexsort((index.sample_ids[some], exact)).tolist():
                best.setdefault(int(index.sample_ids[some[j]]), float(exact[j]))
            first.append([{"vec_id": v, "score": s} for v, s in itertools.islice(best.items(), k)])
        kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
        near = [o[:p].tolist() for o, p in zip(order, probes, strict=True)]
        return pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(bound), pa.array(near, pa.list_(pa.int32())), pa.array(first, kind)], ["vec_id", "embedding", "bound", "lists", "first"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, QUERY_BLOCK):
                yield routed(batch.slice(low, QUERY_BLOCK))

    sizes = {i: int(m) for i, m in enumerate(lists[0]) if m}
    pieces = {i: max(1, -(-m // PIECE_ROWS)) for i, m in sizes.items()}
    # Pieces are numbered through, so that every piece is dealt to a task of its own turn.
    begin = dict(zip(sorted(pieces), [0, *itertools.accumulate(pieces[i] for i in sorted(pieces))], strict=False))
    plan = spark.createDataFrame([(i, begin[i], pieces[i]) for i in sorted(pieces)], "list int, begin int, pieces int")
    tasks = max(1, min(sum(pieces.values()), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    same = F.pmod(F.monotonically_increasing_id(), F.col("pieces"))  # copies of one vector hash alike; so rows are dealt by number
    candidates = indexed.join(F.broadcast(plan), "list").select((F.col("begin") + same).cast("int").alias("piece"), F.lit(None).cast("double").alias("bound"), "vec_id", "embedding")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(route, "vec_id long, embedding array<double>, bound double, lists array<int>, first array<struct<vec_id:long,score:double>>")
    probes = asked.select("vec_id", "embedding", "bound", F.explode("lists").alias("list")).join(F.broadcast(plan), "list")
    probes = probes.select(F.explode(F.sequence("begin", F.col("begin") + F.col("pieces") - 1)).alias("piece"), "bound", "vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come piece by piece, candidates before queries; queries are worked off in blocks."""
        piece, have = None, []
        ids = x = None
        for batch in batches:
            marks, is_query = np.asarray(batch.column("piece")), np.asarray(batch.column("bound").is_valid())
            cuts = np.flatnonzero((np.diff(marks) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if marks[low] != piece:
                    piece, have, ids = int(marks[low]), [], None
                if not is_query[low]:
                    have.append((np.asarray(part.column("vec_id")), _matrix(part.column("embedding"))))
                    ids = None
                    continue
                if not have:
                    continue
                if ids is None:
                    ids, x = np.concatenate([h[0] for h in have]), np.concatenate([h[1] for h in have])
                own = np.asarray(part.column("vec_id"))
                qi, xi, score = scan(index, ids, x, own, _matrix(part.column("embedding")), np.asarray(part.column("bound")), k)
                yield pa.RecordBatch.from_arrays([pa.array(own[qi]), pa.array(ids[xi]), pa.array(score)], ["query_id", "vec_id", "score"])

    both = candidates.unionByName(probes).repartitionById(tasks, F.col("piece")).sortWithinPartitions("piece", F.col("bound").asc_nulls_first())
    seeds = asked.select(F.col("vec_id").alias("query_id"), F.inline("first"))
    hits = both.mapInArrow(run, HIT).unionByName(seeds).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
