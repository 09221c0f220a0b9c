"""Exact k-means that represents clusters as balls, and compares a vector only with centroids whose balls can reach it.

A cluster is a ball: its centroid, and a radius that holds all its members. A centroid j is a neighbour of i when half the
distance between them is not above i's radius; no member of i can be nearer to any other centroid. A member nearer to
its centroid than half the way to the nearest neighbour is in the stable core and is compared with nothing. The others
lie in annuli: between half the way to the p-th neighbour and to the next one, only the p nearest neighbours can win,
and those are compared exactly. Where neither a centroid nor any of its neighbours has moved, nothing is compared.

Each round reads blocks of vectors with their labels and writes them again with new labels and with the sums, counts and
radii that the next centroids need; sums are merged in the tasks before a few rows a cluster are shuffled. Vectors stay
where they are. The centroids (at most ``CLUSTERS``) and the table of neighbours are all that tasks are sent. In the
first round all vectors belong to centroid 0, whose ball holds everything, so the same rule places them.

Components are integers and all comparisons are of exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import python_path, stored
from .pivot_index import quantised

CLUSTERS = 2048  # most centroids, which every task gets
BLOCK = 4096  # most vectors of a block
LARGEST = 2**26  # components below this have squared distances that a long holds

_STATE = "ids array<bigint>, vecs binary, labels binary, squares binary, counts binary, sums binary, radii binary, compared bigint, changed bigint"
_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid."""
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


class Balls:
    """Centroids of one round with their neighbours, nearest first; ``reach`` are squares of the radii (None: no bound)."""

    def __init__(self, centroids: np.ndarray, reach: list[int] | None = None, moved: np.ndarray | None = None):
        k = len(centroids)
        self.centroids = centroids
        self.moved = np.ones(k, dtype=bool) if moved is None else moved
        self.neighbours: list[np.ndarray] = []
        self.gaps: list[np.ndarray] = []
        for i in range(k):
            gap = _squares(centroids, centroids[i])
            order = np.argsort(gap, kind="stable")
            order = order[order != i]
            if reach is not None:
                order = order[gap[order] <= 4 * reach[i]]  # half the way is within the radius
            self.neighbours.append(order)
            self.gaps.append(gap[order])

    def assign(self, x: np.ndarray, labels: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """New labels and squared distances of vectors with old ones, and how many vectors met how many centroids."""
        new, best, compared = labels.copy(), squares.copy(), 0
        for i in np.unique(labels).tolist():
            near, gaps = self.neighbours[i], self.gaps[i]
            own = np.flatnonzero(labels == i)
            if not self.moved[i] and not self.moved[near].any():
                continue  # as before, distances too
            d = _squares(x[own], self.centroids[i])
            compared += len(own)
            best[own] = d
            ring = np.searchsorted(gaps, 4 * d, side="right")  # neighbours with half their way within the distance
            for p in range(int(ring.max(initial=0))):
                reached = own[ring > p]
                j = int(near[p])
                other = _squares(x[reached], self.centroids[j])
                compared += len(reached)
                won = (other < best[reached]) | ((other == best[reached]) & (j < new[reached]))
                new[reached[won]], best[reached[won]] = j, other[won]
        return new, best, compared


def _matrix(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, dtype="<i4").reshape(-1, width).astype(np.int64)


def _round(balls, width: int):
    """Blocks with labels to blocks with new labels and the sums of their clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                x = _matrix(one.column(1)[0].as_py(), width)
                was, squares = (np.frombuffer(one.column(c)[0].as_py(), t).astype(np.int64) for c, t in ((2, "<i4"), (3, "<i8")))
                k = len(balls.value.centroids)
                labels, squares, compared = balls.value.assign(x, was, squares)
                sums, radii = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
                np.add.at(sums, labels, x)
                np.maximum.at(radii, labels, squares)
                blobs = [labels.astype("<i4"), squares.astype("<i8"), np.bincount(labels, minlength=k).astype("<i8"), sums, radii]
                columns = [one.column(0), one.column(1), *(pa.array([b.tobytes()], pa.binary()) for b in blobs), pa.array([compared]), pa.array([int((labels != was).sum())])]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "vecs", "labels", "squares", "counts", "sums", "radii", "compared", "changed"])

    return run


def _merged(k: int, width: int):
    """The sums of a task's blocks, a row for each cluster and component (component -1: count, -2: radius)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, radii = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for c, s, r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts += np.frombuffer(c, "<i8")
                sums += np.frombuffer(s, "<i8").reshape(k, width)
                radii = np.maximum(radii, np.frombuffer(r, "<i8"))
        at = np.flatnonzero(counts)
        cluster = np.concatenate([at, at, np.repeat(at, width)]).astype(np.int32)
        part = np.concatenate([np.full(len(at), -1), np.full(len(at), -2), np.tile(np.arange(width), len(at))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(part), pa.array(np.concatenate([counts[at], radii[at], sums[at].ravel()]))], names=["cluster", "part", "value"])

    return run


def _next(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The floor of the mean of each cluster (an empty one stays), and squared radii that hold the members around it."""
    k, width = centroids.shape
    rows = state.select("counts", "sums", "radii").mapInArrow(_merged(k, width), "cluster int, part int, value bigint")
    total = rows.groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.max("value").alias("most")).collect()  # at most k * (width + 2) rows
    count, new, radius = {r.cluster: int(r.total) for r in total if r.part == -1}, centroids.copy(), [0] * k
    for r in total:
        if r.part >= 0:
            new[r.cluster, r.part] = int(r.total) // count[r.cluster]
        elif r.part == -2:
            radius[r.cluster] = int(r.most)
    shift = _squares(new - centroids, np.zeros(width, np.int64)).tolist()
    return new, [(_root(r) + _root(s)) ** 2 if s else r for r, s in zip(radius, shift, strict=True)]


def _root(x: int) -> int:
    """The smallest integer whose square is not below ``x``."""
    return isqrt(x - 1) + 1 if x > 0 else 0


def _blocks(size: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = np.array(part.column(1).flatten().to_numpy(zero_copy_only=False), dtype="<i4").reshape(-1, width)
                labels, squares = np.zeros(len(x), "<i4"), np.zeros(len(x), "<i8")
                columns = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([b.tobytes()], pa.binary()) for b in (x, labels, squares))]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "vecs", "labels", "squares"])

    return run


def ball_kmeans(vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding", stats: dict | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part: its
    cluster after ``rounds`` rounds and a last assignment, and its squared distance to that centroid.

    Components are floor(``scale`` * x). The first centroids are the ``clusters`` rows (all, if fewer) with the smallest
    sha256 of ``seed`` and the id, in that order; among rows with one id, the smaller vector first. Ties go to the
    smaller cluster, means are rounded down, and an empty cluster keeps its centroid.

    Vectors that are null, of another length than ``width``, or hold a null or non-finite component take no part, nor
    do rows with a null id. Rows that repeat an id all count and all come back. No vectors, no rows. Other columns
    aren't read. Components from 2^26 on, whose distances no long can hold, are refused. ``stats`` gets, for each round,
    the vectors, the comparisons with centroids that were made, those that comparing all would make, and the number of
    vectors that changed their cluster."""
    if clusters > CLUSTERS:
        raise ValueError(f"at most {CLUSTERS} clusters: their centroids go to every task")
    spark = python_path(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == width))
    n, most = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x))))).first()
    if not n:
        return spark.createDataFrame([], _OUT)
    if most >= LARGEST:
        raise ValueError(f"components of vectors are {most} and more after scaling; distances would not fit a long")
    first = rows.withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)).orderBy("h", "v").limit(clusters).select("v").collect()
    centroids, reach, moved = np.array([r.v for r in first], dtype=np.int64).reshape(-1, width), None, None
    size = int(min(BLOCK, max(64, n // spark.sparkContext.defaultParallelism)))
    state = stored(rows.select("id", "v").mapInArrow(_blocks(size, width), "ids array<bigint>, vecs binary, labels binary, squares binary"), "balls")
    seen = []
    for turn in range(rounds + 1):
        balls = spark.sparkContext.broadcast(Balls(centroids, reach, moved))
        state = stored(state.select("ids", "vecs", "labels", "squares").mapInArrow(_round(balls, width), _STATE), "balls")
        if stats is not None:
            compared, changed = state.agg(F.sum("compared"), F.sum("changed")).first()
            seen.append({"vectors": n, "compared": compared, "all": n * len(centroids), "changed": changed})
            stats["rounds"] = seen
        if turn < rounds:
            was = centroids
            centroids, reach = _next(state, was)
            moved = (centroids != was).any(1)
    names = spark.createDataFrame([(i, sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, squares in zip(batch.column(0), *(batch.column(c).to_pylist() for c in (1, 2)), strict=True):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(labels, "<i4")), pa.array(np.frombuffer(squares, "<i8"))], names=["vec_id", "cluster", "distance"])

    found = state.select("ids", "labels", "squares").mapInArrow(members, "vec_id long, cluster int, distance long")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = found.agg(F.sum("distance").alias("inertia"))
    told = F.broadcast(sums.join(F.broadcast(names), "cluster").join(F.broadcast(every), F.lit(True)))  # a row a cluster
    return found.join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
