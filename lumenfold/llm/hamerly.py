"""Centroid clustering of integer vectors by Hamerly's bounds.

Every vector keeps an upper bound on the distance to its own centroid and one lower bound on the
distance to any other. When centroids move, the upper bound grows by its centroid's drift and the lower
shrinks by the largest drift of the others; while the upper lies below the lower (or below half the
distance from its centroid to the nearest other one), the vector stays without being measured. Otherwise its own
distance is measured, and if that doesn't settle it, it gets a full scan in exact integers. Bounds are
doubles that are rounded outwards, so that results equal those of plain exact rounds.

A round is one pass over a table of vectors and bounds, which is written anew without a shuffle; sums
of clusters change only by the vectors that moved. The driver holds the centroids, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_path, map_batches, materialise

#: Components of this size at most: squared distances over 64 of them fit in 63 bits.
LARGEST = 1 << 27
#: Up to here, dot products of 64 components are exact in doubles.
DOUBLES = 1 << 23
OUT = 1 + 1e-12  # bounds are rounded outwards by more than their own rounding errors
ROWS = 4096  # vectors that are scanned at once

STATE = "vec_id long, q array<int>, was int, cluster int, upper double, lower double, distance long, scanned boolean"


def quantised(vectors: DataFrame, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, q) of rows with exactly ``dim`` components, none null or non-finite; q is floor(scale * x).

    A component beyond LARGEST fails: squared distances to it wouldn't fit in a long.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("e")).where(F.size("e") == dim)
    rows = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    whole = lambda x: F.when(F.abs(x * scale) <= LARGEST, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component is over {LARGEST // scale}")).cast("int"))
    return rows.select("vec_id", F.transform("e", whole).alias("q"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of seed and id; rows without an id come last, repeated ids in order of their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = rows.orderBy(key.asc_nulls_last(), "q").limit(k).select("q").collect()
    return np.array([r["q"] for r in got], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= DOUBLES and x.shape[1] <= 64:
        dot = (x.astype(float) @ c.T.astype(float)).astype(np.int64)
    else:
        dot = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * dot + (c * c).sum(1)[None, :]


def up(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, float) * OUT


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.asarray(x, float), 0) / OUT


class Moved:
    """Centroids of a round, and by how much each has moved since the round before."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now, k = now, len(now)
        self.drift = np.zeros(k) if before is None else up(np.sqrt(((now - before) ** 2).sum(1)))
        order = np.argsort(-self.drift)
        self.others = np.full(k, self.drift[order[0]])  # the largest drift among the other centroids
        self.others[order[0]] = self.drift[order[1]] if k > 1 else 0.0
        apart = squared(now, now).astype(float)
        np.fill_diagonal(apart, np.inf)
        self.half = down(np.sqrt(apart.min(1)) / 2)  # half the way to the nearest other centroid; equal centroids: 0

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (ties: the smaller number), its squared distance, and that of the second nearest."""
        near, dist, second = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        for a in range(0, len(x), ROWS):
            d = squared(x[a : a + ROWS], self.now)
            i, rows = d.argmin(1), np.arange(len(d))
            near[a : a + ROWS], dist[a : a + ROWS] = i, d[rows, i]
            if d.shape[1] > 1:
                d = d.astype(float)
                d[rows, i] = np.inf
                second[a : a + ROWS] = d.min(1)
        return near, dist, second

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, first: bool, exact: bool) -> tuple[np.ndarray, ...]:
        """(cluster, upper, lower, squared distance or -1 where it wasn't measured, whether it was scanned)."""
        cluster, dist, scanned = cluster.copy(), np.full(len(x), -1, np.int64), np.ones(len(x), bool)
        if not first:
            upper, lower = up(upper + self.drift[cluster]), down(lower - self.others[cluster] * OUT)
            bound = np.maximum(self.half[cluster], lower)
            own = np.flatnonzero((upper >= bound) | exact)
            dist[own] = ((x[own] - self.now[cluster[own]]) ** 2).sum(1)
            upper[own] = up(np.sqrt(dist[own]))
            scanned = upper >= bound
        at = np.flatnonzero(scanned)
        near, d, second = self.scan(x[at])
        cluster[at], dist[at], upper[at], lower[at] = near, d, up(np.sqrt(d)), down(np.sqrt(second))
        return cluster, upper, lower, dist, scanned


def _pass(moved: Moved, first: bool, exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column("q")
            x = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(b), moved.now.shape[1])
            if first:
                was, upper, lower = np.zeros(len(b), np.int32), np.zeros(len(b)), np.zeros(len(b))
            else:
                was, upper, lower = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, dist, scanned = moved.assign(x, was, upper, lower, first, exact)
            cols = [b.column("vec_id"), q, pa.array(np.full(len(b), -1, np.int32) if first else was), *map(pa.array, (cluster, upper, lower, dist, scanned))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "q", "was", "cluster", "upper", "lower", "distance", "scanned"])

    return run


def changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their cluster add to each cluster's sums and counts; ``k`` rows come to the driver."""
    moved = state.where("cluster <> was").select("q", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))).alias("m"))
    moved = moved.where("m.c >= 0").select(F.col("m.c").alias("c"), F.col("m.sign").alias("sign"), "q")
    sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for r in moved.groupBy("c").agg(F.sum("sign").alias("n"), F.array(*[F.sum(F.col("sign").cast("long") * F.col("q")[i]) for i in range(dim)]).alias("s")).collect():
        sums[r["c"]], counts[r["c"]] = r["s"], r["n"]
    return sums, counts


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """One row a vector: vec_id, cluster, distance (squared), scanned (whether the last assignment needed a full scan); and the centroids.

    Vectors without exactly ``dim`` components, or with a null or non-finite one, take no part. Repeated rows
    are vectors of their own, and so are rows without an id. With fewer than ``k`` vectors each starts a centroid; equal
    centroids are allowed, and the smaller number gets the vectors. An empty table gives no row and no centroid.
    Other columns aren't read. The result is a table in the shared folder.
    """
    spark = vectors.sparkSession
    rows, last = materialise(quantised(vectors, dim, scale, id_col, vec_col), "cluster-vectors")
    now = first_centroids(rows, k, seed).reshape(-1, dim)
    if not len(now):
        drop_path(spark, last)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, scanned boolean"), now
    before, state = None, rows
    sums, counts = np.zeros((len(now), dim), np.int64), np.zeros(len(now), np.int64)
    for n in range(rounds + 1):
        step = map_batches(state, _pass(Moved(now, before), n == 0, n == rounds), STATE)
        state, path = materialise(step if n < rounds else step.select("vec_id", "cluster", "distance", "scanned"), "clusters")
        drop_path(spark, last)
        last = path
        if n < rounds:
            more, count = changes(state, len(now), dim)
            sums, counts, before = sums + more, counts + count, now
            # numpy's // rounds towards minus infinity: the exact floor.
            now = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], now)
    return state, now


def clusters_with_inertia(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """``cluster``'s rows with cluster_inertia, inertia (distance summed over a cluster and over all) and the SHA-256 of the vector's centroid."""
    spark = vectors.sparkSession
    found, centroids = cluster(vectors, k, rounds, dim, scale, seed)
    by = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(c, n, sum(by.values()), digest(centroids[c])) for c, n in by.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows
