"""Nearest neighbours by an inverted multi-index: two half-vector quantisers, centroid pairs in order of their sum, reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frozen, parallelism

#: Centroids of each half; a cell is a pair of them.
CENTROIDS = 64
#: Distinct vectors (those with the smallest hashes) that the quantisers are fitted on: the bound on what the driver sees.
FIT_VECTORS = 20_000
#: Of these, vectors whose exact neighbours decide how far the search goes, and the recall aimed at.
PROBES, RECALL = 96, 0.97
#: Distinct vectors of a shard of the index; cells are put together, or cut, to about this many. Where that gives more shards than
#: four a partition, shards are larger, up to so many times: a query is copied to each shard that it visits.
SHARD_VECTORS, LARGER_SHARDS = 4_096, 8
#: Distinct queries that meet a shard in one task; more of them meet copies of it.
SHARD_QUERIES = 20_000
#: Visits that are passed on at a time, each with its query's vector, and products that a task looks at at a time.
HELD_VISITS, HELD_PRODUCTS = 8_192, 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantiser(points: np.ndarray, centroids: int, steps: int = 15, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm from distinct points."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.choice(len(points), min(centroids, len(points)), replace=False))].copy()
    for _ in range(steps):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1) if len(points) else np.zeros(0, np.int64)


class Index:
    """Quantisers of both halves; a cell's number is first * (centroids of the second half) + second."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.half = first, second, first.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return nearest(vectors[:, : self.half], self.first) * len(self.second) + nearest(vectors[:, self.half :], self.second)

    def sums(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of each query's halves with the centroids."""
        return queries[:, : self.half] @ self.first.T, queries[:, self.half :] @ self.second.T

    def traverse(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int]]:
        """(sum, cell) by falling sum, from one query's inner products: the multi-sequence algorithm with a heap.

        A pair is pushed when the pairs next to it in both sorted lists, one step nearer, have been taken.
        """
        a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        x, y, a, b = one[a].tolist(), two[b].tolist(), a.tolist(), b.tolist()
        heap, width = [(-(x[0] + y[0]), 0, 0)], len(self.second)
        taken = [0] * len(x)  # of each row, how many pairs; rows are taken from the left
        while heap:
            minus, i, j = heapq.heappop(heap)
            yield -minus, a[i] * width + b[j]
            taken[i] = j + 1
            if j + 1 < len(y) and (i == 0 or taken[i - 1] > j + 1):
                heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
            if i + 1 < len(x) and taken[i + 1] == j:
                heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _fit(vectors: DataFrame, centroids: int, sample: int) -> tuple[Index, np.ndarray]:
    rows = vectors.select("vector", F.xxhash64("vector").alias("h")).orderBy("h", "vector").limit(sample).collect()
    points = np.array([r["vector"] for r in rows], np.float64)
    half = max(1, points.shape[1] // 2)
    second = points[:, half:] if points.shape[1] > half else np.zeros((len(points), 1))
    return Index(quantiser(points[:, :half], centroids), quantiser(second, centroids)), points


def _budget(vectors: DataFrame, index: Index, probes: np.ndarray, counts: np.ndarray, dims: int, k: int, recall: float) -> float:
    """The share of distinct vectors to look at so that the probes' exact neighbours, found by looking at all, are seen."""
    shipped = vectors.sparkSession.sparkContext.broadcast((index, probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, probes = shipped.value
        for batch in batches:
            points = _matrix(batch.column(0), dims)
            if not len(points):
                continue
            scores, cells = probes @ points.T, index.cells(points)
            top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
            n = top.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(probes)), n), pa.int32()), pa.array(np.take_along_axis(scores, top, 1).ravel(), pa.float64()), pa.array(cells[top.ravel()], pa.int32())], names=["probe", "score", "cell"])

    best = Window.partitionBy("probe").orderBy(F.desc("score"), "cell")
    rows = vectors.select("vector").mapInArrow(run, "probe int, score double, cell int").withColumn("r", F.row_number().over(best)).where(F.col("r").between(2, k + 1)).select("probe", "cell").collect()
    wanted: dict[int, list[int]] = {}
    for row in rows:
        wanted.setdefault(row["probe"], []).append(row["cell"])
    one, two = index.sums(probes)
    needed = []
    for probe, cells in wanted.items():
        left, seen = set(cells), 0
        for _, cell in index.traverse(one[probe], two[probe]):
            seen += counts[cell]
            if cell in left:
                needed += [seen] * cells.count(cell)
                left.discard(cell)
                if not left:
                    break
    total = max(int(counts.sum()), 1)
    return min(1.0, float(np.quantile(needed, recall, method="higher")) / total) if needed else 1.0


def _shards(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first shard and how many it is cut into; small cells with neighbouring numbers share one."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard, held = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if n > size:
            shard += held > 0
            first[cell], parts[cell] = shard, -(-n // size)
            shard, held = shard + int(parts[cell]), 0
            continue
        if held + n > size:
            shard, held = shard + 1, 0
        first[cell] = shard
        held += n
    return first, parts


def nearest_neighbours(table: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, recall: float = RECALL, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """For each row where ``queries`` holds, the k rows found with the largest inner products: query_id, rank, vec_id, score.

    A row isn't its own neighbour; neither are others with its key (repeated rows count once). Nearest first; ties go to
    the smaller key; fewer than k rows if there are no more candidates. Vectors that are null or zero, hold null or
    non-finite components, or haven't the table's commonest number of dimensions (the larger, of equally common ones) take
    no part, neither do rows with a null key. An empty table gives no rows; other columns are ignored.

    Equal vectors are indexed once, with their k + 1 smallest keys: no more of them can be among k neighbours. The
    quantisers are fitted on a bounded sample, all vectors are indexed. A query visits cells by falling sum of its halves'
    products with the centroids until they hold a share of the vectors; the share is the one at which a sample of probes
    sees ``recall`` of its exact neighbours. Scores are exact products of the original vectors.
    """
    spark = table.sparkSession
    key_type = table.schema[key].dataType.simpleString()
    out = f"query_id {key_type}, rank int, vec_id {key_type}, score double"
    rows = table.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("vector"), queries.alias("asks"))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], out)
    dims = common["d"]
    rows = rows.where(F.size("vector") == dims).distinct()
    # the group limit works on each side of the shuffle: a vector with very many copies isn't brought together
    copies = rows.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("key"))).where(F.col("r") <= k + 1)
    vectors = frozen(copies.groupBy("vector").agg(F.array_sort(F.collect_list("key")).alias("keys")))
    index, points = _fit(vectors, centroids, FIT_VECTORS)
    shipped = spark.sparkContext.broadcast(index)
    wide = dims if dims > index.half else index.half + 1  # one dimension has an empty second half

    def padded(column: pa.ListArray) -> np.ndarray:
        got = _matrix(column, dims)
        return got if wide == dims else np.hstack([got, np.zeros((len(got), wide - dims))])

    if wide != dims:
        points = np.hstack([points, np.zeros((len(points), wide - dims))])

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shipped.value.cells(padded(batch.column(0))), pa.int32())], names=["vector", "keys", "cell"])

    indexed = vectors.mapInArrow(celled, f"vector array<double>, keys array<{key_type}>, cell int")
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for row in indexed.groupBy("cell").count().collect():  # centroids ** 2 rows at most
        counts[row["cell"]] = row["count"]
    share = _budget(vectors, index, points[:PROBES], counts, dims, k, recall) if wide == dims else 1.0
    budget = math.ceil(share * counts.sum())
    larger = -(-int(counts.sum()) // (shard_vectors * 4 * parallelism(table)))
    first, parts = _shards(counts, shard_vectors * min(max(1, larger), LARGER_SHARDS))
    plan = spark.sparkContext.broadcast((counts, first, parts))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (counts, first, parts) = shipped.value, plan.value
        for batch in batches:
            one, two = index.sums(padded(batch.column(1)))
            row, shard, limit = [], [], []
            for q in range(batch.num_rows):
                seen, least, to = 0, math.inf, set()
                for total, cell in index.traverse(one[q], two[q]):
                    if seen >= budget and total < least:  # pairs with equal sums are visited together
                        break
                    if counts[cell]:
                        seen, least = seen + int(counts[cell]), total
                        to.update(range(first[cell], first[cell] + parts[cell]))
                row += [q] * len(to)
                shard += sorted(to)
                limit += [least] * len(to)
                if len(row) >= HELD_VISITS or q == batch.num_rows - 1:
                    for at in range(0, len(row), HELD_VISITS):  # one query may visit more shards
                        some = slice(at, at + HELD_VISITS)
                        asks = batch.take(pa.array(row[some], pa.int64()))
                        yield pa.RecordBatch.from_arrays([*asks.columns, pa.array(shard[some], pa.int64()), pa.array(limit[some], pa.float64())], names=["ask", "vector", "shard", "limit"])
                    row, shard, limit = [], [], []

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts = plan.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(first[cell] + batch.column(3).to_numpy() % parts[cell], pa.int64())], names=["vector", "keys", "cell", "shard"])

    # equal queries are asked once, by the name of the smallest key: what is found has no vectors, however many shards find it
    asked = frozen(rows.where("asks").groupBy("vector").agg(F.min("key").alias("ask")).select("ask", "vector").repartition(parallelism(table), "ask"))
    crowds = max(1, -(-asked.count() // SHARD_QUERIES))
    crowd = F.pmod(F.xxhash64("vector", F.lit(5)), F.lit(crowds))
    visits = asked.mapInArrow(routed, f"ask {key_type}, vector array<double>, shard long, limit double").withColumn("crowd", crowd)
    index_rows = indexed.withColumn("salt", F.pmod(F.xxhash64("vector"), F.lit(1 << 31))).mapInArrow(placed, f"vector array<double>, keys array<{key_type}>, cell int, shard long")
    index_rows = index_rows.withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(crowds - 1).cast("long"))))

    def searched(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"ask": pd.Series(dtype=asked["ask"].dtype), "score": pd.Series(dtype=float), "keys": pd.Series(dtype=object)})
        if asked.empty or held.empty:
            return empty
        index = shipped.value
        points, cells = np.stack(held["vector"].to_numpy()).astype(np.float64), held["cell"].to_numpy()
        width = len(index.second)
        # the places of the vectors' smallest keys, in order
        smallest = held["keys"].map(min).rank(method="min").to_numpy()
        which, scored, places = [], [], []
        step = max(1, HELD_PRODUCTS // len(points))
        for at in range(0, len(asked), step):
            part = asked.iloc[at : at + step]
            q = np.stack(part["vector"].to_numpy()).astype(np.float64)
            wideq = q if wide == dims else np.hstack([q, np.zeros((len(q), wide - dims))])
            one, two = index.sums(wideq)
            scores = q @ points.T
            scores[one[:, cells // width] + two[:, cells % width] < part["limit"].to_numpy()[:, None] - 1e-9] = -np.inf
            at_least = -np.partition(-scores, min(k, len(points) - 1), axis=1)[:, min(k, len(points) - 1)]
            # products of a matrix are rounded otherwise than sums of products: none within that error is left out
            slack = 1e-12 * (np.abs(q).sum(1) * np.abs(points).max(initial=0.0))
            for i in range(len(q)):
                some = np.flatnonzero(np.isfinite(scores[i]) & (scores[i] >= at_least[i] - slack[i]))
                exact = (points[some] * q[i]).sum(1)
                best = np.lexsort((smallest[some], -exact))[: k + 1]  # ties to the smaller key
                which.append(np.full(len(best), at + i))
                scored.append(exact[best])
                places.append(some[best])
        found = np.concatenate(which)
        return pd.DataFrame({"ask": asked["ask"].take(found).to_numpy(), "score": np.concatenate(scored), "keys": held["keys"].take(np.concatenate(places)).to_numpy()})

    hits = visits.groupBy("shard", "crowd").cogroup(index_rows.groupBy("shard", "crowd")).applyInPandas(searched, f"ask {key_type}, score double, keys array<{key_type}>")
    ranked = Window.partitionBy("ask").orderBy(F.desc("score"), "key")
    best = hits.select("ask", "score", F.explode("keys").alias("key")).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).select("ask", "score", F.col("key").alias("vec_id"))
    joined = rows.where("asks").select(F.col("key").alias("query_id"), "vector").join(asked, "vector").select("query_id", "ask").join(best, "ask").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return joined.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
