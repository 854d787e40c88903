"""Operator 12, centroid clustering: nearest centroids by the threshold algorithm, in whole numbers.

Every component becomes ``floor(256 * x)``.  For each dimension the centroids are a list sorted by
their component.  A vector walks all lists outward from its own value, one step in each list a round:
the nearest centroid not yet met there, below or above, is met, and its exact distance is computed
once.  A centroid that was met in no list lies at or beyond the frontier in every dimension, so the
sum of the squared frontier distances bounds its distance from below, and the walk ends as soon as
that sum strictly exceeds the best exact distance; ties then still go to the smaller number.  The
walks of a block of vectors advance together in numpy, and those that have ended leave the block.

Each task sends one row for each centroid, the sums of its vectors, so what a round shuffles and
brings to the driver is ``CENTROIDS`` rows a task and in all, whatever the table.

Defined results: vectors that are null, have another length, or hold a null or non-finite component
take no part; a null ``vec_id`` is hashed as the empty text; of vectors with the same hash (repeated
rows) the smaller vector comes first, and each row is clustered; with fewer vectors than centroids
each vector starts one; components beyond ``LARGEST`` / 256 fail the run with a message, as their squares
fit no long; an empty table gives an empty result; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, named

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Largest whole number of a component: differences of two have 28 bits, sums of 64 squares 62.
LARGEST = 1 << 27
#: Vectors that walk together.
BLOCK = 4096


def whole_vectors(rows: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = named(rows, "embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = (F.size(x) == dimensions) & finite
    v = F.transform(F.when(fits, x), lambda c: F.floor(c * scale))
    largest = F.array_max(F.transform(v, F.abs))
    sound = F.when(largest > LARGEST, F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("array<bigint>")).otherwise(v)
    return rows.where(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), sound.alias("v"))


class Lists:
    """For each dimension the centroids in the order of their component."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k, dims = centroids.shape
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # dimension x place
        sorted_ = np.take_along_axis(centroids.T, self.order, axis=1)
        # a place before and one after each list stand for its ends
        self.values = np.zeros((dims, k + 2), np.int64)
        self.values[:, 1:-1] = sorted_

    def steps(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distance to the next centroid of each list, whether it lies below, and whether there is one."""
        dims = np.arange(x.shape[1])
        far = np.int64(4 * LARGEST)
        down = np.where(low > 0, x - self.values[dims, low], far)
        up = np.where(high <= len(self.centroids), self.values[dims, high] - x, far)
        return np.minimum(down, up), down <= up, np.minimum(down, up) < far


def nearest(x: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector, ties to the smaller number."""
    k = len(lists.centroids)
    n, dims = x.shape
    best, which = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    rows = np.arange(n)
    high = np.stack([np.searchsorted(lists.values[j, 1:-1], x[:, j]) for j in range(dims)], axis=1) + 1
    low = high - 1
    met = np.zeros((n, k), bool)
    column = np.arange(dims)
    while len(rows):
        own = x[rows]
        _, below, there = lists.steps(own, low, high)
        place = np.where(below, low, high) - 1
        centroid = lists.order[column, np.clip(place, 0, k - 1)]
        fresh = np.zeros((len(rows), k), bool)
        at = np.nonzero(there)
        fresh[at[0], centroid[at]] = True
        fresh &= ~met
        met |= fresh
        low -= (below & there).astype(low.dtype)
        high += (~below & there).astype(high.dtype)
        for c in range(k):  # in ascending order, so of equal distances the smaller number stays
            hit = np.flatnonzero(fresh[:, c])
            if len(hit):
                apart = own[hit] - lists.centroids[c]
                distance = np.einsum("ij,ij->i", apart, apart)
                mine = rows[hit]
                better = (distance < best[mine]) | ((distance == best[mine]) & (c < which[mine]))
                best[mine[better]], which[mine[better]] = distance[better], c
        frontier, _, left = lists.steps(own, low, high)
        # where a list has been walked to its end every centroid has been met
        bound = np.where(left, frontier, 0)
        walk = left.all(axis=1) & (np.einsum("ij,ij->i", bound, bound) <= best[rows])
        rows, low, high, met = rows[walk], low[walk], high[walk], met[walk]
    return which, best


def blocks(batches, dimensions: int):
    """(vec_id column, vectors) in blocks of the Arrow batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column("vec_id"), part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        import pyarrow as pa

        lists = Lists(held.value)
        for ids, x in blocks(batches, held.value.shape[1]):
            which, distance = nearest(x, lists)
            yield pa.RecordBatch.from_arrays([ids, pa.array(which.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the exact mean of each one's vectors."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, dims = centroids.shape
    names = [f"s{j}" for j in range(dims)]

    def run(batches):
        import pyarrow as pa

        lists = Lists(held.value)
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x in blocks(batches, dims):
            which, _ = nearest(x, lists)
            order = np.argsort(which, kind="stable")
            some, first = np.unique(which[order], return_index=True)
            sums[some] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(which, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[own]), *(pa.array(sums[own, j]) for j in range(dims))], ["cluster", "n", *names])

    parts = vectors.mapInArrow(run, "cluster int, n long, " + ", ".join(f"{s} long" for s in names))
    # no more rows than there are centroids
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names)).collect()
    out = centroids.copy()
    for r in whole:
        out[r["cluster"]] = [r[s] // r["n"] for s in names]
    held.unpersist()
    return out


def first_centroids(vectors: DataFrame, count: int, seed: int) -> np.ndarray:
    """The ``count`` vectors with the smallest hashes of their ids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("v", key.alias("h")).orderBy("h", "v").limit(count).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def clusters(rows: DataFrame, dimensions: int = DIMENSIONS, count: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    vectors = scratch.keep(whole_vectors(rows, dimensions, scale), "whole-vectors")
    centroids = first_centroids(vectors, count, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    out = scratch.keep(assigned(vectors, centroids), "assigned")
    scratch.drop(vectors)
    # one row for each centroid
    own = {r.cluster: r.inertia for r in out.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, inertia, sum(own.values()), digests[c]) for c, inertia in own.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
