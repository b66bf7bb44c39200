"""Centroid clustering (Lloyd's rounds) whose comparisons are filtered by n-simplex projection.

PIVOTS of the first centroids span a simplex. A vector's distances to them, measured once and kept, place it as the apex
over that simplex: as many coordinates as there are pivots, the last one its height. Two apexes are at least as near as
the vectors they stand for, and with one height mirrored at least as far. So each centroid has a lower and an upper bound
of its distance from each vector, from a few numbers instead of all components; centroids whose lower bound is above the
least upper bound are out, and the others are compared exactly, in whole numbers.

Centroids (k x 64 numbers) are the only thing that driver and executors exchange: tasks return sums by cluster, which
Spark adds up before the driver sees them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialise, table

COMPONENTS, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED, PIVOTS = 40, 5, 2, 12
#: Whole numbers beyond this have squared distances that 64 bits do not hold.
MOST = 1 << 27
#: Vectors that a task compares at a time.
BLOCK = 4096


class Simplex:
    """The base simplex of pivots, and apexes over it.

    Of the given vectors, the one highest above the simplex so far is added, until there are `pivots` or none stands
    out of the space that those before it span. Row i of base holds pivot i's i first coordinates.
    """

    def __init__(self, vectors: np.ndarray, pivots: int = PIVOTS) -> None:
        vectors = vectors.astype(np.float64)
        scale = max(1.0, float(np.abs(vectors).max(initial=0)))
        self.pivots, self.base = vectors[:1], np.zeros((1, 0))
        while len(self.pivots) < min(pivots, len(vectors)):
            apex = self.apexes(self.distances(vectors))
            k = int(apex[:, -1].argmax())
            if apex[k, -1] < 1e-6 * scale:
                break
            base = np.zeros((len(self.pivots) + 1, len(self.pivots)))
            base[:-1, :-1], base[-1] = self.base, apex[k]
            self.pivots, self.base = np.vstack([self.pivots, vectors[k]]), base

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Distances to the pivots, one column for each."""
        x = vectors.astype(np.float64)
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1) if len(self.pivots) else np.zeros((len(x), 0))

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates that have these distances to the pivots; the last one is not negative.

        The difference of the squared distances to the first pivot and to pivot i fixes coordinate i - 1, as pivot i has
        no coordinates beyond; the distance to the first pivot, at the origin, then leaves the height.
        """
        n = len(self.pivots)
        if not n:
            return np.zeros((len(distances), 0))
        square = distances**2
        out = np.zeros((len(distances), n))
        for i in range(1, n):
            b = self.base[i]
            out[:, i - 1] = (square[:, 0] - square[:, i] + b @ b - 2 * (out[:, : i - 1] @ b[: i - 1])) / (2 * b[i - 1])
        out[:, -1] = np.sqrt(np.maximum(square[:, 0] - (out[:, :-1] ** 2).sum(axis=1), 0))
        return out


def bounds(apexes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of each row of apexes from each of others, widened by more than
    what rounding can add."""
    flat, height = apexes[:, :-1], apexes[:, -1:]
    flat2, height2 = others[:, :-1], others[:, -1:]
    ground = (flat**2).sum(axis=1)[:, None] + (flat2**2).sum(axis=1)[None, :] - 2 * flat @ flat2.T
    size = (apexes**2).sum(axis=1)[:, None] + (others**2).sum(axis=1)[None, :]
    slack = 1e-7 * size + 1e-3
    return ground + (height - height2.T) ** 2 - slack, ground + (height + height2.T) ** 2 + slack


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector by whole numbers, ties to the smaller number; and how many exact
    comparisons it took."""
    own = simplex.apexes(simplex.distances(centroids))
    cluster = np.zeros(len(vectors), np.int64)
    least = np.full(len(vectors), np.iinfo(np.int64).max)
    compared = 0
    for at in range(0, len(vectors), BLOCK):
        lower, upper = bounds(apexes[at : at + BLOCK], own)
        stays = lower <= upper.min(axis=1)[:, None]
        for c in range(len(centroids)):
            rows = np.flatnonzero(stays[:, c]) + at
            gap = vectors[rows] - centroids[c]
            d = np.einsum("ij,ij->i", gap, gap)
            nearer = d < least[rows]
            cluster[rows[nearer]], least[rows[nearer]] = c, d[nearer]
            compared += len(rows)
    return cluster, least, compared


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that are kept: COMPONENTS finite numbers, v their floor(SCALE * x).

    A vector with a number beyond MOST after scaling, whose squared distances 64 bits do not hold, is not kept either.
    """
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE))
    good = (F.size("embedding") == COMPONENTS) & F.forall(
        "embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * SCALE) <= MOST)
    )
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(good).select("vec_id", x.cast("array<bigint>").alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed:vec_id, in order of it; null ids last, then by components."""
    rows = kept.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    rows = rows.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, COMPONENTS)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(-1, width)


def _placed(kept: DataFrame, simplex: Simplex) -> DataFrame:
    """kept with the apex of each vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apex = simplex.apexes(simplex.distances(_matrix(batch.column(1), np.int64, COMPONENTS)))
            n = len(simplex.pivots)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(apex) * n + 1, n, dtype=np.int32)), pa.array(apex.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["vec_id", "v", "apex"])

    return map_arrow(kept, work, "vec_id long, v array<long>, apex array<double>")


def _assigned(placed: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, apex = _matrix(batch.column(1), np.int64, COMPONENTS), _matrix(batch.column(2), np.float64, len(simplex.pivots))
            cluster, distance, _ = nearest(v, apex, centroids, simplex)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return map_arrow(placed, work, "vec_id long, cluster int, distance long")


def _moved(placed: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Centroids after one round: floor(sum / count) of each component over a cluster's vectors; empty clusters stay.

    A task adds up its own vectors; Spark adds the tasks' sums, as decimals of 38 digits, by cluster and component.
    """
    k = len(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * COMPONENTS for _ in range(k)], [0] * k
        for batch in batches:
            v, apex = _matrix(batch.column(1), np.int64, COMPONENTS), _matrix(batch.column(2), np.float64, len(simplex.pivots))
            cluster, _, _ = nearest(v, apex, centroids, simplex)
            part = np.zeros((k, COMPONENTS), np.int64)  # a batch is far too short to overflow
            np.add.at(part, cluster, v)
            for c, n in enumerate(np.bincount(cluster, minlength=k).tolist()):
                counts[c] += n
                sums[c] = [a + b for a, b in zip(sums[c], part[c].tolist())] if n else sums[c]
        some = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.int32()),
                pa.array([counts[c] for c in some], pa.int64()),
                pa.array([[str(x) for x in sums[c]] for c in some], pa.list_(pa.string())),
            ],
            names=["cluster", "n", "sums"],
        )

    parts = map_arrow(placed, work, "cluster int, n long, sums array<string>")
    rows = parts.select("cluster", "n", F.posexplode("sums").alias("component", "s")).groupBy("cluster", "component")
    out = centroids.copy()
    for r in rows.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k x 64 rows at most
        out[r["cluster"], r["component"]] = int(r["s"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each vector that is kept, centroids after the last round).

    Vectors that are null, of another length, or with null or non-finite components are not kept. With fewer than k kept
    vectors there are as many centroids; with none, no rows. Rows with equal ids are vectors of their own. Equal vectors
    all go to one cluster; ties go to the smaller number. Only vec_id and embedding are read.
    """
    kept = materialise(whole_numbers(vectors), "simplex_vectors")
    centroids = first_centroids(kept, k, seed)
    simplex = Simplex(centroids)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    placed = materialise(_placed(kept, simplex), "simplex_apexes")
    for _ in range(rounds):
        centroids = _moved(placed, centroids, simplex)
    return materialise(_assigned(placed, centroids, simplex), "simplex_clusters"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, d, sum(inertia.values()), names[c]) for c, d in inertia.items()]  # one for each centroid
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
