"""Operator 13, centroid clustering: rounds of nearest centroids in whole numbers, by partial-distance search.

Vectors become integers floor(scale * x). Dimensions are visited by falling variance over all vectors: after the
first few, each vector finishes the centroid that is nearest so far, and every other centroid is left as soon as
the sum of its squared differences is strictly above the best; centroids that stay finish all dimensions, so ties
are seen and go to the smaller number.

A round is one scan of the written integers. Each task adds up its own vectors by cluster, so what is shuffled is
clusters x dimensions numbers from each task, whatever the sizes of the clusters, and the driver gets clusters x
dimensions of them. All sums are exact (decimals), so the result doesn't depend on how rows are dealt.

Defined cases: vectors that are null, of another length, or with components that are null, not finite or, scaled,
beyond 64 bits take no part; a null id starts a centroid only where other vectors don't suffice; rows with equal
ids are vectors of their own; fewer vectors than clusters start as many centroids; no vector gives no rows; empty
clusters keep their centroid; a distance or sum of distances beyond 64 bits is null; only the named columns are kept.
"""

from __future__ import annotations

import decimal
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import in_batches
from tabulon.sources.shared import new_folder, removed, stored, written

#: Differences of components up to this, squared and summed over 64 dimensions and more, fit 64 bits.
PLAIN = 1 << 26
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Clusters:
    """assigned: the kept columns, cluster and distance of each vector; centroids: clusters x dimensions whole numbers."""

    assigned: DataFrame
    centroids: list[list[int]]


def whole(vectors: DataFrame, keep: tuple[str, ...], vector: str, dimensions: int, scale: int) -> DataFrame:
    """keep and whole: the scaled components of the vectors that take part."""
    most = float(1 << 63) / scale
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < most, F.lit(False)))
    kept = vectors.filter((F.size(vector) == dimensions) & fits)
    return kept.select(*keep, F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale))).alias("whole"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; both arrays of one type, int64 or Python's integers."""
    x, centroids, n, k, width = x[:, order], centroids[:, order], len(x), len(centroids), len(order)
    squares = lambda rows, c, low: ((x[rows, low : low + step] - centroids[c, low : low + step]) ** 2).sum(axis=1)
    part = np.stack([squares(slice(None), c, 0) for c in range(k)], axis=1)
    cluster = np.argmin(part, axis=1)
    best = part[np.arange(n), cluster]
    for c in range(k):
        rows = np.flatnonzero(cluster == c)
        for low in range(step, width, step):
            best[rows] += squares(rows, c, low)
    first = cluster.copy()
    for c in range(k):
        rows = np.flatnonzero((first != c) & (part[:, c] <= best))
        held = part[rows, c]
        for low in range(step, width, step):
            held = held + squares(rows, c, low)
            stay = np.flatnonzero(held <= best[rows])
            rows, held = rows[stay], held[stay]
        won = np.flatnonzero((held < best[rows]) | (c < cluster[rows]))  # what stays is at most as far: a tie goes to the smaller number
        best[rows[won]], cluster[rows[won]] = held[won], c
    return cluster, best


def assign(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() in int64 where no square can pass 64 bits, else in Python's integers. centroids: Python's integers."""
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    large = ((x > PLAIN) | (x < -PLAIN)).any(axis=1) if max(map(abs, centroids.flat)) <= PLAIN else np.ones(len(x), bool)
    for rows, kind in ((np.flatnonzero(~large), np.int64), (np.flatnonzero(large), object)):
        if len(rows):
            cluster[rows], distance[rows] = nearest(x[rows].astype(kind), centroids.astype(kind), order)
    return cluster, distance


def variance_order(coded: DataFrame, dimensions: int) -> np.ndarray:
    """Dimensions by falling variance; a guide only, so sums of doubles will do."""

    def add(batches):
        n, total, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            x = matrix(batch.column(0), dimensions).astype(np.float64)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions), pa.int32()), pa.array(np.full(dimensions, n)), pa.array(total), pa.array(squares)], names=["dim", "n", "total", "squares"])

    sums = coded.select("whole").transform(in_batches(add, "dim int, n long, total double, squares double")).groupBy("dim").agg(F.sum("n"), F.sum("total"), F.sum("squares"))
    variance = np.zeros(dimensions)
    for dim, n, total, squares in sums.collect():  # one row a dimension
        variance[dim] = squares / max(n, 1) - (total / max(n, 1)) ** 2
    return np.argsort(-variance, kind="stable")


def moved(coded: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; empty ones as they were."""
    k, dimensions = centroids.shape

    def add(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), object)
        for batch in batches:
            x = matrix(batch.column(0), dimensions)
            cluster, _ = assign(x, centroids, order)
            plain = len(x) == 0 or max(int(x.max()), -int(x.min())) < LONG // len(x)
            for c in np.unique(cluster):
                own = x[cluster == c]
                count[c], total[c] = count[c] + len(own), total[c] + own.sum(axis=0, dtype=np.int64 if plain else object).astype(object)
        some = np.flatnonzero(count)
        totals = [[decimal.Decimal(int(v)) for v in total[c]] for c in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(totals, pa.list_(pa.decimal128(38, 0)))], names=["cluster", "n", "total"])

    sums = coded.select("whole").transform(in_batches(add, "cluster int, n long, total array<decimal(38,0)>"))
    sums = sums.select("cluster", "n", F.posexplode("total").alias("dim", "part")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = centroids.copy()
    for cluster, dim, n, total in sums.collect():  # clusters x dimensions rows
        out[cluster, dim] = int(total) // n
    return out


def centroid_clusters(vectors: DataFrame, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding", id_column: str = "vec_id", dimensions: int = 64, clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> Clusters:
    """Centroids start as the vectors whose ids have the smallest hashes; each round assigns and moves them; then all are assigned once more."""
    spark, path = vectors.sparkSession, new_folder(vectors.sparkSession, "whole")
    named = tuple(dict.fromkeys((*keep, id_column)))
    coded = stored(whole(vectors, named, vector, dimensions, scale), path)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    starts = coded.orderBy(drawn.asc_nulls_last(), "whole").limit(clusters).select("whole").collect()  # one row a cluster
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*keep).schema.fields), "cluster int", "distance bigint"])
    if not starts:
        return Clusters(spark.createDataFrame([], schema), [])
    centroids, order = np.array([list(map(int, r["whole"])) for r in starts], dtype=object), variance_order(coded, dimensions)
    for _ in range(rounds):
        now = moved(coded, centroids, order)
        if (now == centroids).all():  # further rounds would change nothing
            break
        centroids = now

    def last(batches):
        for batch in batches:
            cluster, distance = assign(matrix(batch.column(0), dimensions), centroids, order)
            far = pa.array([int(d) if d <= LONG else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(cluster, pa.int32()), far], names=[*keep, "cluster", "distance"])

    assigned = written(coded.select("whole", *keep).transform(in_batches(last, schema)), "clusters")
    removed(spark, path)
    return Clusters(assigned, [[int(v) for v in c] for c in centroids])


def cluster_digest(found: Clusters) -> DataFrame:
    """With each vector the summed distances of its cluster and of all, and its centroid's hash."""
    spark = found.assigned.sparkSession
    summed = lambda of: F.when(F.count(of) == F.count(F.lit(1)), F.sum(F.col(of).cast("decimal(38,0)")))  # noqa: E731  a distance beyond 64 bits leaves no sum
    each = found.assigned.groupBy("cluster").agg(summed("distance").alias("sum"), F.count(F.lit(1)).alias("n"))
    sums = {r["cluster"]: r["sum"] for r in each.collect()}  # one row a cluster
    total = None if any(v is None for v in sums.values()) else sum(map(int, sums.values()))
    fits = lambda v: None if v is None or v > LONG else int(v)
    rows = [(c, fits(sums.get(c)), fits(total), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(found.centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.assigned.join(F.broadcast(about), "cluster")
