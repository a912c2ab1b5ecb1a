"""Centroid clustering: the nearest centroid by the threshold algorithm over one sorted list of centroids per dimension."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import prepare, stored
from assaykit.llm.grid_vectors import on_grid, unpacked

SCALE, DIM, CENTROIDS, ROUNDS = 256, 64, 40, 5
LIMIT = 1 << 27
SLICE = 512
FAR = np.iinfo(np.int64).max


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of each row's nearest centroid (ties: the smaller), its squared distance, and the distances worked out in all.

    Every dimension has its centroids in order of value. A row starts in each list at its own value and steps outward, one
    centroid a list and round, the closer side first. A centroid met for the first time gets its exact distance. What no list
    has met is at least as far as the sum of the squares of the last steps; once that is strictly more than the best exact
    distance, nothing nearer and no tie is left, and the row is done.
    """
    k, dim = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable").T
    edge = np.full((dim, 1), FAR // 4)
    values = np.concatenate([-edge, np.take_along_axis(centroids.T, order, 1), edge], axis=1).reshape(-1)
    numbers = np.concatenate([np.zeros((dim, 1), int), order, np.zeros((dim, 1), int)], axis=1).reshape(-1)
    lists = np.arange(dim) * (k + 2)
    found, best, worked = np.zeros(len(x), np.int64), np.full(len(x), FAR), 0
    for lo in range(0, len(x), SLICE):
        rows = x[lo : lo + SLICE]
        right = np.stack([np.searchsorted(centroids[order[d], d], rows[:, d]) for d in range(dim)], axis=1) + lists + 1
        left = right - 1
        seen = np.zeros((len(rows), k), bool)
        at = np.arange(lo, lo + len(rows))
        while len(at):
            below, above = rows - values[left], values[right] - rows
            closer = below <= above
            met = numbers[np.where(closer, left, right)]
            step = np.minimum(below, above)
            left, right = left - closer, right + ~closer
            now = np.zeros_like(seen)
            now[np.arange(len(rows))[:, None], met] = True
            now &= ~seen
            seen |= now
            i, c = np.nonzero(now)
            worked += len(i)
            exact = np.full(seen.shape, FAR)
            exact[i, c] = ((rows[i] - centroids[c]) ** 2).sum(1)
            first = exact.argmin(1)  # the first of equals
            least = exact[np.arange(len(rows)), first]
            better = (least < best[at]) | ((least == best[at]) & (first < found[at]) & (least < FAR))
            best[at[better]], found[at[better]] = least[better], first[better]
            go = ((step * step).sum(1) <= best[at]) & ~seen.all(1)
            rows, left, right, seen, at = rows[go], left[go], right[go], seen[go], at[go]
    return found, best, worked


def _new_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of every centroid's vectors; those without vectors stay. Tasks hand on one sum per centroid and dimension."""
    k, dim = centroids.shape

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x = unpacked(batch.column(0), dim)
            number = nearest_centroids(x, centroids)[0]
            np.add.at(total, number, np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
        c, d = np.nonzero(total[:, -1:] + np.zeros(dim + 1, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(total[c, d])],
                                         names=["c", "d", "s"])

    sums = rows.select("_x").mapInArrow(kernel, "c int, d int, s long").groupBy("c", "d").agg(F.sum("s").alias("s"))
    total = np.zeros((k, dim + 1), np.int64)
    for r in sums.collect():
        total[r.c, r.d] = r.s
    some = total[:, -1] > 0
    moved = centroids.copy()
    moved[some] = total[some, :-1] // total[some, -1:]  # rounds down for negative sums too
    return moved


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS,
            rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """Per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    A component becomes floor(256 * component). The first centroids are the vectors of the smallest sha256 of ``2:<id>``; each round
    assigns every vector and replaces a centroid by the floor of the mean of its vectors, componentwise and exact; then all
    are assigned once more. The vectors are stored once and read in place every round; only sums leave a task. The driver
    holds the centroids.

    Vectors that are null, hold null or non-finite components or another number of them than ``dim`` take no part, nor do those
    with a component of 2^19 or more, whose distances a long does not hold. Null ids come last among the candidates for a
    first centroid, equal ids are told apart by their vectors, and repeated rows count and are returned each. With fewer vectors
    than ``centroids`` each starts one. Other columns are not read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = stored(on_grid(vectors, id_col, vector, dim, SCALE, LIMIT), "cluster-vectors")
    key = F.sha2(F.concat(F.lit("2:"), F.col("_id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "_x").limit(centroids).select("_x").collect()
    middle = np.array([np.frombuffer(r["_x"], "<i8") for r in first], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(middle) else 0):
        middle = _new_centroids(rows, middle)
    schema = rows.select("_id").schema.add("cluster", "integer").add("distance", "long")

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance, _ = nearest_centroids(unpacked(batch.column("_x"), dim), middle)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(number, pa.int32()), pa.array(distance)],
                                             names=schema.names)

    assigned = stored(rows.mapInArrow(kernel, schema), "cluster-assigned")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, middle[c].tolist())).encode()).hexdigest())
               for c, s in inertia.items()]
    # one row a centroid
    of_cluster = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select(
        F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
