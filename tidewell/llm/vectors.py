"""Operator 8, nearest neighbours: a vantage-point tree for each shard of the vectors.

A vantage-point tree over a bounded sample deals all vectors into shards, so each shard is a region of
which the distances to some vantage points are known.  A region with more vectors than a shard may hold
is split by a hash.  Each shard becomes a tree of its own: the median distance to a vantage point parts
the rest into an inner and an outer half.  A query first searches its own region.  The distance of its
worst neighbour there then rules out regions, and within a tree halves, by the triangle inequality: what
is at least ``lower`` away is skipped when ``factor * lower`` exceeds that distance.  A factor of one is
exact; larger ones skip more.  Trees move to the queries' tasks once for each block of queries.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows without ``vec_id``; vectors of different length do not meet; of rows that repeat a query's
``vec_id`` the smallest vector asks, and all but that one row are candidates; ties go to the smaller
``vec_id``; with fewer candidates than asked for, all are returned; vectors of any length are taken
whole; empty tables give an empty result; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

NEIGHBOURS = 10
FACTOR = 3.0
LEAF = 128
#: Vectors of the sample that parts the regions, and components that it and a shard's vectors may have together.
SAMPLE, SAMPLE_COMPONENTS, SHARD_COMPONENTS = 4096, 1 << 22, 1 << 19
#: Queries that search a shard in one task.
BLOCK = 2048
#: Distances computed at once, and how far those computed by products may be off, as a share of the squares.
CELLS, OFF = 1 << 20, 1e-9

TREE = "dim int, region int, part int, tree binary"
FOUND = "query_id long, vec_id long, score double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


class Regions:
    """Parts of the space of one dimension; a node is (vantage point, median, inner, outer), a leaf a number."""

    def __init__(self, sample: np.ndarray, count: int):
        self.count = 0
        self.root = self.part(sample, count, np.random.default_rng(4))

    def part(self, points: np.ndarray, count: int, rng):
        if count < 2 or len(points) < 4:
            self.count += 1
            return self.count - 1
        at = points[rng.integers(len(points))]
        d = distances(points, at)
        median = float(np.median(d))
        inside = d <= median
        if inside.all():  # of many equal points; a hash will split them
            self.count += 1
            return self.count - 1
        return at, median, self.part(points[inside], count - count // 2, rng), self.part(points[~inside], count // 2, rng)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int32)
        waiting = [(self.root, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if not isinstance(node, tuple):
                out[rows] = node
                continue
            inside = distances(vectors[rows], node[0]) <= node[1]
            waiting += [(node[2], rows[inside]), (node[3], rows[~inside])]
        return out

    def within(self, vectors: np.ndarray, reach: np.ndarray, factor: float) -> list[list[int]]:
        """The regions that each vector's neighbours nearer than ``reach`` may be in."""
        out: list[list[int]] = [[] for _ in vectors]
        waiting = [(self.root, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if not isinstance(node, tuple):
                for i in rows:
                    out[i].append(node)
                continue
            over = factor * (distances(vectors[rows], node[0]) - node[1])
            most = reach[rows] * (1 + OFF)
            waiting += [(node[2], rows[over <= most]), (node[3], rows[-over <= most])]
        return out


class VantageTree:
    def __init__(self, ids: np.ndarray, asks: np.ndarray, vectors: np.ndarray):
        """``asks``: whether a row is the one that asks for its id."""
        self.ids, self.asks, self.vectors = ids, asks, vectors
        self.squares = (vectors**2).sum(axis=1)
        self.root = self.grow(np.arange(len(ids)), np.random.default_rng(3))

    def grow(self, rows: np.ndarray, rng) -> tuple:
        if len(rows) <= LEAF:
            return (rows,)
        at = rng.integers(len(rows))
        point, rest = rows[at], np.delete(rows, at)
        d = distances(self.vectors[rest], self.vectors[point])
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        # the inner half is no farther than this, the outer no nearer
        return point, d[order[half]], self.grow(rest[order[:half]], rng), self.grow(rest[order[half:]], rng)

    def search(self, own: np.ndarray, queries: np.ndarray, reach: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, distance) of up to ``k`` neighbours of each query that are not beyond its ``reach``."""
        best = np.where(np.isfinite(reach), reach, np.inf)
        squares = (queries**2).sum(axis=1)
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

        def keep(rows: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
            """Adds finds; no query keeps more than ``k``, the nearest, and of these the smaller ids."""
            touched = np.isin(found[0], rows)
            r, i, s = (np.concatenate([f[touched], new]) for f, new in zip(found, (rows, ids, d), strict=True))
            order = np.lexsort((i, s, r))
            r, i, s = r[order], i[order], s[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            worst = place == k - 1
            best[r[worst]] = np.minimum(best[r[worst]], s[worst])
            stay = place < k
            found[:] = [np.concatenate([f[~touched], new[stay]]) for f, new in zip(found, (r, i, s), strict=True)]

        def offer(rows: np.ndarray, points: np.ndarray) -> None:
            step = max(1, CELLS // len(points))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                near = squares[some, None] + self.squares[points] - 2 * (queries[some] @ self.vectors[points].T)
                near[(self.ids[points] == own[some, None]) & self.asks[points]] = np.inf
                limit = best[some] ** 2
                if len(points) > k:
                    limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1])
                limit = limit + OFF * (squares[some] + self.squares[points].max())
                r, c = np.nonzero(near <= limit[:, None])
                if len(r):
                    d = distances(queries[some[r]], self.vectors[points[c]])
                    fine = np.isfinite(near[r, c]) & (d <= best[some[r]])
                    if fine.any():
                        keep(some[r][fine], self.ids[points[c]][fine], d[fine])

        def visit(node: tuple, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(node) == 1:
                if len(node[0]):
                    offer(rows, node[0])
                return
            point, median, inner, outer = node
            d = distances(queries[rows], self.vectors[point])
            offer(rows, np.array([point]))
            inside = d <= median
            visit(inner, rows[inside])
            visit(outer, rows[~inside])
            open_ = factor * np.abs(d - median) <= best[rows] * (1 + OFF)
            visit(outer, rows[inside & open_])
            visit(inner, rows[~inside & open_])

        visit(self.root, np.arange(len(own)))
        return tuple(found)


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def regions_of(base: DataFrame) -> dict[int, Regions]:
    """Regions by dimension, from a sample of at most ``SAMPLE`` vectors; dimensions that it misses are one region."""
    counts = base.agg(F.count(F.lit(1)), F.max("dim")).first()
    total, widest = counts[0], counts[1] or 1
    most = max(64, min(SAMPLE, SAMPLE_COMPONENTS // widest))
    order = F.xxhash64(F.lit(8), "vec_id").bitwiseAND(F.lit((1 << 63) - 1))
    some = base.where(order < F.lit(min((1 << 63) - 1, (most << 63) // max(total, 1)))).limit(2 * most).select("dim", "v").collect()
    out = {}
    for dim in {r["dim"] for r in some}:
        own = matrix([r["v"] for r in some if r["dim"] == dim])
        out[dim] = Regions(own, -(-total * len(own) // len(some) * dim // SHARD_COMPONENTS))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``queries`` against all ``vectors``."""
    scratch = Scratch(vectors.sparkSession)
    base, asking = usable(vectors), usable(queries)
    regions = regions_of(base)

    @F.pandas_udf("int")
    def region(dims, vs):
        import pandas as pd

        out = pd.Series(np.zeros(len(vs), np.int32))
        for dim in dims.unique():
            if dim in regions:
                at = np.flatnonzero(dims == dim)
                out.iloc[at] = regions[dim].of(matrix(vs.iloc[at]))
        return out

    @F.pandas_udf("array<int>")
    def others(dims, vs, reach, own):
        import pandas as pd

        out = pd.Series([[] for _ in range(len(vs))], dtype=object)
        for dim in dims.unique():
            if dim in regions:
                at = np.flatnonzero(dims == dim)
                lists = regions[dim].within(matrix(vs.iloc[at]), reach.iloc[at].fillna(np.inf).to_numpy(), factor)
                for i, found in zip(at, lists, strict=True):
                    out.iloc[i] = [r for r in found if r != own.iloc[i]]
        return out

    def grow(frame):
        import pandas as pd

        tree = VantageTree(frame["vec_id"].to_numpy(np.int64), frame["asks"].to_numpy(bool), matrix(frame["v"]))
        return pd.DataFrame({"dim": frame["dim"][:1], "region": frame["region"][:1], "part": frame["part"][:1], "tree": [pickle.dumps(tree)]})

    def search(trees, asked):
        import pandas as pd

        if not len(trees) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own = asked["vec_id"].to_numpy(np.int64)
        at, ids, d = pickle.loads(trees["tree"].iloc[0]).search(own, matrix(asked["v"]), asked["reach"].fillna(np.inf).to_numpy(np.float64), k, factor)
        return pd.DataFrame({"query_id": own[at], "vec_id": ids, "score": d})

    # of rows with one id the smallest vector is the one that asks
    repeated = scratch.keep(base.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "repeated")
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))
    several = base.join(repeated, "vec_id", "left_semi").withColumn("asks", nth == 1)
    rows = base.join(repeated, "vec_id", "left_anti").withColumn("asks", F.lit(True)).union(several.select("vec_id", "v", "dim", "asks"))
    placed = scratch.keep(rows.withColumn("region", region("dim", "v")), "placed")
    sizes = placed.groupBy("dim", "region").agg(F.expr(f"CAST((count(1) * dim + {SHARD_COMPONENTS - 1}) div {SHARD_COMPONENTS} AS INT)").alias("parts"))
    sizes = scratch.keep(sizes, "sizes")
    dealt = placed.join(sizes, ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
    trees = scratch.keep(dealt.groupBy("dim", "region", "part").applyInPandas(grow, TREE), "trees")

    def searched(asked: DataFrame) -> DataFrame:
        """``asked``: (vec_id, v, dim, region, reach); each query meets all parts of the region."""
        busy = scratch.keep(asked.groupBy("dim", "region").agg(F.expr(f"CAST((count(1) + {BLOCK - 1}) div {BLOCK} AS INT)").alias("blocks")), "busy")
        each = asked.join(busy, ["dim", "region"]).join(sizes, ["dim", "region"])
        each = each.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        copies = trees.join(busy, ["dim", "region"]).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        keys = ["dim", "region", "part", "block"]
        copies, each = (df.select(*(F.col(c).alias(c) for c in [*keys, *own])) for df, own in ((copies, ["tree"]), (each, ["vec_id", "v", "reach"])))
        return copies.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(search, FOUND)

    once = asking.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = scratch.keep(once.withColumn("region", region("dim", "v")).withColumn("reach", F.lit(None).cast("double")), "asked")
    near = scratch.keep(searched(asked), "near")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    reach = near.withColumn("rank", order).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reach"))
    bounded = asked.drop("reach").join(reach, "vec_id", "left")
    further = bounded.withColumn("region", F.explode(others("dim", "v", "reach", "region")))
    far = searched(scratch.keep(further.select("vec_id", "v", "dim", "region", "reach"), "further"))
    found = scratch.keep(near.union(far).withColumn("rank", order).where(F.col("rank") <= k), "found")
    scratch.drop_all_but(found)
    return found.select("query_id", "rank", "vec_id", "score")
