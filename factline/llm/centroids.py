"""Centroid clustering of integer vectors with Drake's adaptive bounds, exact to the last unit.

Each vector keeps its cluster, lower bounds of the distances to several next nearest centroids, and one remainder bound that holds
for all others. When centroids have moved, bounds give way by the moves. A vector stays where it is if its exact distance is below
all of its bounds; centroids whose bound isn't certain are measured again, and if the remainder bound isn't, all are. Distances
are compared as exact integers with ties to the smaller number, so bounds only save work and never decide. How many bounds are kept
adapts: it falls to the most that any vector of the last round needed.

A round is one pass that writes vectors with their bounds as a table in the shared folder, and one aggregate of exact sums by
cluster and component. Only centroids (``k`` vectors) are broadcast and only their sums are collected; nothing of a vector leaves its
row, so there is no shuffle of vectors and no cluster is gathered anywhere, however many vectors it has.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left out; a component beyond
``LARGEST`` after scaling can't be squared and summed in a long and is an error; with fewer vectors than ``k`` each is a centroid;
equal vectors are separate rows, and ids may repeat or be null (hashed as the empty text); an empty table gives no row; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.common import save, scratch

#: Components are integers of at most this size: 64 squared differences then fit a long.
LARGEST = 1 << 27
#: Distances to all centroids are measured for this many vectors at a time.
CHUNK_ROWS = 4096
#: Bounds are moved by this share more than computed, which is far more than square roots are off by.
SLACK = 1e-9

_STATE = "vec_id long, v array<int>, cluster int, distance long, near array<int>, bounds array<double>, rest double, used int"


def whole_vectors(embeddings: DataFrame, length: int, scale: int) -> DataFrame:
    """``(vec_id, v)`` with ``v`` = floor(scale * component), of the vectors that take part."""
    x = F.col("embedding")
    fits = (F.size(x) == length) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    too_large = F.exists("v", lambda c: F.abs(c) > LARGEST)
    rows = embeddings.select("vec_id", F.when(F.coalesce(fits, F.lit(False)), whole).alias("v")).filter("v is not null")
    checked = F.when(too_large, F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}"))).otherwise(F.col("v"))
    return rows.select("vec_id", checked.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors of the ``k`` least sha256 of ``salt:vec_id``, in that order; ties by the vector."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all to all."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < 1 << 22:  # products and sums of up to 64 components are exact in doubles
        dots = (v.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
        return (v * v).sum(1)[:, None] - 2 * dots + (c * c).sum(1)[None, :]
    return np.stack([((v - one) ** 2).sum(1) for one in c], axis=1)


def _scan(v: np.ndarray, c: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """Nearest centroid and distance, the next ``keep`` with their distances as bounds, and the bound of all others."""
    exact = _squared(v, c)
    cluster = exact.argmin(1)  # the first of equals
    distance = exact[np.arange(len(v)), cluster]
    others = exact.copy()
    others[np.arange(len(v)), cluster] = -1
    order = np.argsort(others, axis=1, kind="stable")[:, 1:]
    near = order[:, :keep]
    bounds = np.sqrt(np.take_along_axis(exact, near, 1)) * (1 - SLACK)
    rest = np.sqrt(np.take_along_axis(exact, order[:, keep : keep + 1], 1))[:, 0] * (1 - SLACK) if keep < order.shape[1] else np.full(len(v), np.inf)
    return cluster, distance, near, bounds, rest


def _advance(v: np.ndarray, c: np.ndarray, moved: np.ndarray, state: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The state after centroids have moved by ``moved``; the last part says how many bounds each vector needed."""
    cluster, near, bounds, rest = state
    rows = np.arange(len(v))
    distance = ((v - c[cluster]) ** 2).sum(1)
    bounds, rest = bounds - moved[near] * (1 + SLACK), rest - moved.max(initial=0) * (1 + SLACK)
    upper = np.sqrt(distance) * (1 + SLACK)
    doubt = bounds <= upper[:, None]
    used = np.where(doubt.any(1), near.shape[1] - np.argmax(doubt[:, ::-1], axis=1), 0) if near.shape[1] else np.zeros(len(v), int)
    i, j = np.nonzero(doubt)
    if len(i):
        old = cluster.copy()
        exact = ((v[i] - c[near[i, j]]) ** 2).sum(1)
        bounds[i, j] = np.sqrt(exact) * (1 - SLACK)
        # the least (distance, number) of a row's measured centroids
        order = np.lexsort((near[i, j], exact, i))
        first = order[np.unique(i[order], return_index=True)[1]]
        at, slot, new = i[first], j[first], exact[first]
        better = (new < distance[at]) | ((new == distance[at]) & (near[at, slot] < cluster[at]))
        at, slot, new = at[better], slot[better], new[better]
        cluster[at], near[at, slot] = near[at, slot], old[at]  # the one that was nearest takes the other's place among bounds
        bounds[at, slot] = np.sqrt(distance[at]) * (1 - SLACK)
        distance[at] = new
    again = rows[rest <= np.sqrt(distance) * (1 + SLACK)]
    for a in range(0, len(again), CHUNK_ROWS):
        some = again[a : a + CHUNK_ROWS]
        cluster[some], distance[some], near[some], bounds[some], rest[some] = _scan(v[some], c, near.shape[1])
    return cluster, distance, near, bounds, rest, used


def _kept(near: np.ndarray, bounds: np.ndarray, rest: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """Only the ``keep`` least bounds, the others merged into the remainder's."""
    if keep >= near.shape[1]:
        return near, bounds, rest
    order = np.argsort(bounds, axis=1, kind="stable")
    near, bounds = np.take_along_axis(near, order, 1), np.take_along_axis(bounds, order, 1)
    return near[:, :keep], bounds[:, :keep], np.minimum(rest, bounds[:, keep])


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=True).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _round(df: DataFrame, c: np.ndarray, moved: np.ndarray | None, keep: int) -> DataFrame:
    """One assignment of every vector; the first without bounds to start from."""
    shared = df.sparkSession.sparkContext.broadcast((c, moved))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, moved = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(a, CHUNK_ROWS)
                v = _matrix(part.column("v"), np.int64, c.shape[1])
                if moved is None:
                    cluster, distance, near, bounds, rest = _scan(v, c, keep)
                    used = np.zeros(len(v), int)
                else:
                    width = len(part.column("near")[0])
                    near, bounds = _matrix(part.column("near"), np.int64, width), _matrix(part.column("bounds"), np.float64, width)
                    rest, cluster = part.column("rest").to_numpy(zero_copy_only=False), part.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                    near, bounds, rest = _kept(near, bounds, rest.copy(), keep)
                    cluster, distance, near, bounds, rest, used = _advance(v, c, moved, (cluster, near.copy(), bounds.copy(), rest))
                columns = [pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), _lists(near, pa.int32()), _lists(bounds, pa.float64())]
                columns += [pa.array(rest, pa.float64()), pa.array(used, pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), *columns], names=["vec_id", "v", "cluster", "distance", "near", "bounds", "rest", "used"])

    return df.mapInArrow(assign, _STATE)


def _sums(df: DataFrame, k: int, width: int) -> DataFrame:
    """``(cluster, n, total)``: sums of components by cluster, added up inside each task before anything is dealt."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)

        def out() -> pa.RecordBatch:
            some = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), _lists(total[some], pa.int64())], names=["cluster", "n", "total"])

        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            np.add.at(total, cluster, _matrix(batch.column("v"), np.int64, width))
            n += np.bincount(cluster, minlength=k)
            if n.sum() > 1 << 34:  # long before a sum could pass a long
                yield out()
                n[:], total[:] = 0, 0
        yield out()

    return df.select("cluster", "v").mapInArrow(add, "cluster int, n long, total array<long>")


def _moved_to(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """Floors of the means, exact; a centroid without vectors stays."""
    parts = _sums(state, *c.shape).select("cluster", "n", F.posexplode("total").alias("place", "total"))
    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    new = c.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), exact).collect():  # k x length rows
        new[r.cluster, r.place] = int(r.total) // r.n
    return new


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` after ``rounds`` of moving the centroids, and the centroids."""
    spark, k = vectors.sparkSession, len(centroids)
    least = max(1, k // 8) if k > 1 else 0
    keep, moved, c, rows = min(max(least, k // 4), k - 1), None, centroids, vectors
    with scratch(spark):
        for n in range(rounds + 1):
            state = save(_round(rows, c, moved, keep), "centroids", lasting=n == rounds)
            if n == rounds:
                break
            if moved is not None:
                keep = min(keep, max(least, state.agg(F.max("used")).first()[0] or 0))
            new = _moved_to(state, c)
            moved, c, rows = np.sqrt(((new - c).astype(np.float64) ** 2).sum(1)), new, state
    return state.select("vec_id", "cluster", "distance"), c


def clustered(embeddings: DataFrame, k: int = 40, length: int = 64, scale: int = 256, rounds: int = 5, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of each vector that takes part, and the final centroids."""
    vectors = whole_vectors(embeddings, length, scale)
    first = first_centroids(vectors, k, salt)
    if not len(first):
        return embeddings.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, length), np.int64)
    return cluster(vectors, first, rounds)
