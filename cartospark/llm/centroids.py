"""Centroid clustering of integer vectors: exact arithmetic, partial-distance search.

Every component becomes an integer, so that distances, sums and means are exact
and a rerun gives the same clusters whatever the partitioning. A round sends the
few centroids to the workers; each task sums its vectors per centroid, Spark adds
up the sums, and only k * dim of them reach the driver.

The search takes the dimensions by falling variance. A vector's first guess is
the centroid that is nearest in the leading block of dimensions; it is measured
in full. Every other centroid adds up squared differences block by block and is
abandoned once its sum is strictly above the best distance so far; survivors
finish all dimensions, and of equal distances the smaller number stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

#: Dimensions that are added up between two looks at the best distance.
BLOCK = 8
#: Integers stop here, so that a squared distance over 64 dimensions is a 64-bit integer.
LIMIT = 1 << 27


def quantised(vectors: DataFrame, dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, q) of the vectors with ``dim`` components, none null or non-finite; q is floor(scale * x), within +-LIMIT."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    q = F.transform(x, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(v.cast("double") * scale))).cast("int"))
    return vectors.select("vec_id", "embedding").where(x.isNotNull() & (F.size(x) == dim) & sound).select("vec_id", q.alias("q"))


def matrix(batch: pa.RecordBatch, order: np.ndarray) -> np.ndarray:
    """The batch's vectors as rows, dimensions in the given order."""
    values = batch.column("q").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, len(order)).astype(np.int64)[:, order]


def nearest(x: np.ndarray, c: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest row of c, squared distance) for every row of x; equal distances: the smaller number."""
    head = np.stack([((x[:, :block] - row[:block]) ** 2).sum(1) for row in c], axis=1)
    first = head.argmin(1)
    label, best = first.copy(), ((x - c[first]) ** 2).sum(1)
    for j, row in enumerate(c):
        live = np.flatnonzero((first != j) & (head[:, j] <= best))
        acc = head[live, j]
        for at in range(block, x.shape[1], block):
            if not len(live):
                break
            acc = acc + ((x[live, at : at + block] - row[at : at + block]) ** 2).sum(1)
            keep = acc <= best[live]
            live, acc = live[keep], acc[keep]
        wins = (acc < best[live]) | (label[live] > j)
        label[live[wins]], best[live[wins]] = j, acc[wins]
    return label, best


def by_variance(vectors: DataFrame, dim: int) -> np.ndarray:
    """Dimensions by falling variance over all vectors, from one row of sums a task."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, s2 = 0, np.zeros(dim), np.zeros(dim)
        for b in batches:
            x = matrix(b, np.arange(dim)).astype(float)
            n, s, s2 = n + len(x), s + x.sum(0), s2 + (x * x).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"d": np.arange(dim, dtype=np.int32), "n": np.full(dim, n), "s": s, "s2": s2})

    sums = vectors.select("q").mapInArrow(moments, "d int, n long, s double, s2 double").groupBy("d").agg(*(F.sum(c).alias(c) for c in ("n", "s", "s2")))
    found = {r["d"]: r["s2"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in sums.collect()}  # dim rows
    return np.array(sorted(range(dim), key=lambda d: (-found.get(d, 0.0), d)))


def seeds(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, ascending; null ids come last, equal ids by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["q"] for r in vectors.orderBy(digest.asc_nulls_last(), "q").limit(k).collect()]


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of the mean of its vectors."""
    k, dim = centroids.shape
    c = centroids[:, order]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for b in batches:
            x = matrix(b, order)
            label, _ = nearest(x, c)
            n += np.bincount(label, minlength=k)
            for j in range(k):
                s[j] += x[label == j].sum(0)
        if n.any():
            yield pa.RecordBatch.from_pydict({"k": np.repeat(np.arange(k, dtype=np.int32), dim), "d": np.tile(order.astype(np.int32), k), "n": np.repeat(n, dim), "s": s.ravel()})

    total = vectors.select("q").mapInArrow(sums, "k int, d int, n long, s long").groupBy("k", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in total.where("n > 0").collect():  # k * dim rows
        out[r["k"], r["d"]] = int(r["s"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that ``quantised`` keeps.

    Null ids are kept, but start a centroid only where fewer than k vectors have
    an id. Repeated rows count each; with fewer than k vectors there are as many
    centroids as vectors; an empty table gives an empty result. Extra columns
    play no part. An inertia beyond 64 bits is null.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["vec_id"]
    ship(spark)
    kept = cut(quantised(vectors, dim, scale))
    centroids = np.array(seeds(kept, k, seed), dtype=np.int64).reshape(-1, dim)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    order = by_variance(kept, dim)
    for _ in range(rounds):
        last, centroids = centroids, moved(kept, centroids, order)
        if np.array_equal(last, centroids):  # every further round would repeat it
            break
    c = centroids[:, order]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, best = nearest(matrix(b, order), c)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    found = cut(kept.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"))
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    digest = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    fits = lambda n: n if n < 1 << 63 else None
    total = sum(int(r["s"]) for r in per)
    rows = [(r["cluster"], fits(int(r["s"])), fits(total), digest(centroids[r["cluster"]])) for r in per]
    return found.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
