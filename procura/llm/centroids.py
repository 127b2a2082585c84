"""Centroid clustering in exact integers, with lower bounds loosened by planar geometry.

Every vector keeps its cluster, an upper bound of the distance to its centroid and a lower
bound of the distance to every other one. After centroids moved, a vector whose upper bound
stays below its lower bound has the same nearest centroid; only the others are compared with
all centroids, in exact integers.

By how much a lower bound must fall follows from the sphere around the old centroid that
holds all vectors of the cluster. For a centroid that moved from a to b by D, a point x is
at most D * cos(angle) nearer to b than to a, the angle being that between b - a and x seen
from the middle of a and b: the difference of the two distances is 2 (b - a).(x - m) over
their sum, and the sum is at least 2 |x - m|. Only the plane through a, b and the sphere's
centre matters, as distances from the line a b are all that the third direction adds. Seen
from m the sphere spans arcsin(radius / distance) on both sides of its centre, so its least
angle is known; a centroid that moves away from the sphere loosens nothing, one that moves
sideways little, and only a sphere around m itself takes the full drift D.

Bounds are kept in double precision and loosened by a small share of their size, so that
rounding never keeps a vector that should have been scanned; ties are always scanned.

Rounds write the vectors with their state and send k * dimension sums and k radii to the
driver. `k` and the dimension are parameters, so that much is bounded.

Defined cases: vectors that are null, of another size, or that hold a null or non-finite
component take no part, and give no row; neither do vectors with a component beyond
2 ** 27 after scaling, whose squared distances a long cannot hold. A null vec_id is kept and
starts a centroid only if there are too few others; rows that share a vec_id are ordered by
their components. With fewer than k vectors there are fewer centroids, with none no rows.
Equal vectors may start equal centroids; the larger number then stays empty and where it is.
Repeated rows come back as often as they came in. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.llm.common import written

SCALE = 64
LARGEST = 1 << 27
SLACK = 1e-9
_BLOCK = 8192
_STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, scanned boolean"


def scaled(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, in whole SCALE-ths rounded down."""
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE))
    finite = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(LARGEST / SCALE)))
    kept = vectors.where((F.size(column) == dimension) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """Vectors with the smallest hashes of their ids."""
    draw = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(draw.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    out = np.empty((len(v), len(centroids)), dtype=np.int64)
    for at in range(0, len(v), _BLOCK):
        part = v[at : at + _BLOCK]
        for j, c in enumerate(centroids):
            apart = part - c
            out[at : at + _BLOCK, j] = (apart * apart).sum(axis=1)
    return out


def nearest_two(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number), its distance, and that of the second nearest."""
    apart = squared(v, centroids)
    cluster = apart.argmin(axis=1).astype(np.int32)
    rows = np.arange(len(v))
    own = np.sqrt(apart[rows, cluster].astype(np.float64))
    if len(centroids) == 1:
        return cluster, own, np.full(len(v), np.inf)
    far = apart.astype(np.float64)
    far[rows, cluster] = np.inf
    return cluster, own, np.sqrt(far.min(axis=1))


def drifts(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and by how much the lower bounds of each cluster must fall.

    A vector of cluster i lies within radius[i] of old[i].
    """
    a, b = old.astype(np.float64), new.astype(np.float64)
    moved = np.sqrt(((b - a) ** 2).sum(axis=1))
    loosened = np.zeros(len(a))
    for j in np.flatnonzero(moved):
        seen = a - (a[j] + b[j]) / 2
        distance = np.sqrt((seen**2).sum(axis=1))
        cosine = (seen @ (b[j] - a[j])) / np.maximum(distance * moved[j], 1e-300)
        angle = np.arccos(cosine.clip(-1, 1)) - np.arcsin((radius / np.maximum(distance, 1e-300)).clip(0, 1))
        fall = moved[j] * np.cos(angle.clip(0, np.pi / 2))
        fall[radius >= distance] = moved[j]
        fall[j] = 0  # the bound is about the other centroids
        loosened = np.maximum(loosened, fall)
    return moved, loosened * (1 + SLACK) + SLACK


def _columns(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.int64)


def _assign(centroids: np.ndarray):
    """First assignment: every vector is compared with every centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, upper, lower = nearest_two(_columns(batch, centroids.shape[1]), centroids)
            yield _state(batch, cluster, upper, lower, np.ones(len(cluster), dtype=bool))

    return run


def _reassign(centroids: np.ndarray, moved: np.ndarray, loosened: np.ndarray):
    """Later ones: bounds first, then the exact distance to the own centroid, then all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _columns(batch, centroids.shape[1])
            cluster = batch.column("cluster").to_numpy().copy()
            lower = batch.column("lower").to_numpy() - loosened[cluster]
            upper = batch.column("upper").to_numpy() + moved[cluster]
            unsure = np.flatnonzero(upper * (1 + SLACK) >= lower)
            apart = v[unsure] - centroids[cluster[unsure]]
            upper[unsure] = np.sqrt((apart * apart).sum(axis=1).astype(np.float64))
            unsure = unsure[upper[unsure] * (1 + SLACK) >= lower[unsure]]
            cluster[unsure], upper[unsure], lower[unsure] = nearest_two(v[unsure], centroids)
            scanned = np.zeros(len(v), dtype=bool)
            scanned[unsure] = True
            yield _state(batch, cluster, upper, lower, scanned)

    return run


def _state(batch: pa.RecordBatch, cluster, upper, lower, scanned) -> pa.RecordBatch:
    new = [pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scanned)]
    names = ["vec_id", "v", "cluster", "upper", "lower", "scanned"]
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *new], names=names)


def _partial_sums(dimension: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, radius = np.zeros((k, dimension), dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k)
        for batch in batches:
            v, cluster = _columns(batch, dimension), batch.column("cluster").to_numpy()
            np.add.at(sums, cluster, v)
            count += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, batch.column("upper").to_numpy())
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(count[held]), pa.array(radius[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "radius", "sums"],
        )

    return run


def _moved_centroids(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise floor(sum / count) of each cluster (empty ones stay), and the radii around the old ones."""
    k, dimension = centroids.shape
    parts = state.mapInArrow(_partial_sums(dimension, k), "cluster int, n long, radius double, sums array<long>")
    total = (
        parts.select("cluster", "n", "radius", F.posexplode("sums").alias("at", "x"))
        .groupBy("cluster", "at")
        .agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        .collect()  # k * dimension rows
    )
    new, radius = centroids.copy(), np.zeros(k)
    for r in total:
        new[r.cluster, r.at] = int(r.x) // r.n
        radius[r.cluster] = r.radius
    return new, radius * (1 + SLACK)


def cluster(vectors: DataFrame, k: int, dimension: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, upper, lower, scanned) after the last assignment, and the final centroids.

    scanned tells which vectors the last assignment had to compare with all centroids.
    """
    vectors = written(scaled(vectors, dimension))
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        nothing = (F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("upper", "double"), ("lower", "double"), ("scanned", "boolean")))
        return vectors.select("vec_id", "v", *nothing), centroids.reshape(0, dimension)
    state = written(vectors.mapInArrow(_assign(centroids), _STATE))
    for _ in range(rounds):
        new, radius = _moved_centroids(state, centroids)
        state = written(state.mapInArrow(_reassign(new, *drifts(centroids, new, radius)), _STATE))
        centroids = new
    return state, centroids


def _distance(centroid: Column) -> Column:
    apart = F.zip_with("v", centroid, lambda x, c: (x - c) * (x - c))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda s, x: s + x)


def clusters(vectors: DataFrame, k: int = 16, dimension: int = 64, rounds: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Inertias beyond a long are null.
    """
    state, centroids = cluster(vectors, k, dimension, rounds)
    spark = vectors.sparkSession
    rows = [(j, c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    final = spark.createDataFrame(rows, "cluster int, centroid array<long>, centroid_sha256 string")
    found = state.join(F.broadcast(final), "cluster").select("vec_id", "cluster", _distance(F.col("centroid")).alias("distance"), "centroid_sha256")
    found = written(found)
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows
    fits = {r.cluster: int(r.own) for r in per}
    sums = [(j, x if x < 1 << 63 else None, total if (total := sum(fits.values())) < 1 << 63 else None) for j, x in fits.items()]
    inertia = spark.createDataFrame(sums, "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(inertia), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
