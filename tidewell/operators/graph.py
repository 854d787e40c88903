"""Graphs as edge tables, in rounds that grow with the logarithm of the longest way where the structure allows it.

Components contract by alternating large and small stars, ancestors by squaring, levels by pointer
doubling along nodes of a single parent.  Loops cut lineage by tables in the shared folder, and remove
those that nothing reads any more.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where none is set and all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """A table that is used several times, or again in the next round: written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Stored tables of a loop, which go when they are dropped."""

    def __init__(self):
        self.paths: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        out = stored(df)
        self.paths.append((out, out.inputFiles()[0].rsplit("/", 1)[0] if out.inputFiles() else ""))
        return out

    def drop_all_but(self, *kept: DataFrame) -> None:
        for df, path in self.paths:
            if path and not any(df is k for k in kept):
                at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = [(df, path) for df, path in self.paths if any(df is k for k in kept)]


def cut(df: DataFrame) -> DataFrame:
    """The lineage ends here."""
    return stored(df)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


#: A node with more neighbours than this is a hub, whose rows are not brought together.
HUB = 50_000


def with_least(arcs: DataFrame, store: Store, hub: int = HUB) -> DataFrame:
    """The arcs (u, v) with ``m``, the smallest of u and its neighbours v.

    The rows of hubs, which are at most one for each ``hub`` arcs, meet their least neighbour where they are.
    """
    least = store.keep(arcs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")))
    hubs = least.where(F.col("n") > hub).select("u", "m")
    # as many as fit are sent to all tasks; beyond that Spark splits the keys that are too large
    if 0 < hubs.count() <= HUB:
        rest = arcs.join(F.broadcast(hubs), "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
        return rest.union(arcs.join(F.broadcast(hubs), "u"))
    return arcs.join(least.select("u", "m"), "u")


def contracted(pairs: DataFrame, hub: int = HUB) -> tuple[DataFrame, int]:
    """(node, root) as ``components`` has it, and the rounds that it took.

    A large star hangs all larger neighbours of a node below the smallest, a small star all smaller ones and
    the node itself; neither parts what is connected, and ways get shorter by half or more a round.
    """
    store = Store()
    edges = store.keep(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    single = edges.where("u = v").select(F.col("u").alias("node"))
    left, rounds, mark = edges.where("u <> v"), 0, None
    while True:
        both = left.union(left.select("v", "u"))
        large = store.keep(with_least(both, store, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        met = with_least(large, store, hub)
        left = store.keep(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).distinct())
        store.drop_all_but(edges, left)
        rounds += 1
        before, mark = mark, left.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if mark == before:
            break
    ends = left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = left.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = single.join(ends.select("node").union(roots.select("node")), "node", "left_anti")
    out = store.keep(ends.union(roots).union(alone.select("node", F.col("node").alias("root"))))
    store.drop_all_but(out)
    return out, rounds


def components(pairs: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, root) of the pairs (a, b), root being the smallest node of its component."""
    return contracted(pairs, hub)[0]


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor) for edges (source, target): the transitive closure upstream, by squaring.

    After k rounds all pairs at a distance up to 2 ** k are known; the next ones are a pair of the
    farthest half followed by any.
    """
    fronts = [cut(edges.select(F.col("target").alias("node"), F.col("source").alias("ancestor")).distinct())]
    while not fronts[-1].isEmpty():
        known = union(fronts)
        above = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        further = fronts[-1].join(above, "ancestor").select("node", F.col("next").alias("ancestor")).distinct()
        fronts.append(cut(further.join(known, ["node", "ancestor"], "left_anti")))
    return union(fronts)


def doubled(pointers: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Pointers (node, above, floor, weight) followed to their ends, those that run into a cycle, and the rounds.

    A node's value is the larger of ``floor`` and its pointer's value plus ``weight``; following a pointer
    composes two such functions, and all jump to twice their distance in a round.
    """
    count, rounds = pointers.count(), 0
    done, open_ = [], pointers
    # a pointer has ended if what it names has none
    ends = pointers.select(F.col("node").alias("above"))
    while True:
        done.append(cut(open_.join(ends, "above", "left_anti").select("node", "above", "floor", "weight")))
        left = cut(open_.join(ends, "above", "left_semi").select("node", "above", "floor", "weight"))
        if left.isEmpty() or 1 << rounds > count:
            return union(done), left.select("node"), rounds
        rounds += 1
        # what has ended goes on to serve those that point to it
        over = left.union(union(done)).select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("floor").alias("f"), F.col("weight").alias("w"))
        jumped = left.join(over, "above").select(
            "node", F.col("next").alias("above"), F.greatest("floor", F.col("f") + F.col("weight")).alias("floor"), (F.col("weight") + F.col("w")).alias("weight")
        )
        open_ = cut(jumped)


def longest_ways(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``levels``, and the number of joins in a row that it took.

    Each round settles the nodes without parents and takes out those with one: they hang below an end of
    the pointers, and their children below that, by the sum of the ways.  What is left has several parents.
    """
    inner = cut(edges.select("source", "target").distinct())
    nodes = cut(inner.select(F.col("source").alias("node")).union(inner.select("target")).distinct())
    rest = inner.withColumn("weight", F.lit(1).cast("long"))
    floors = nodes.withColumn("floor", F.lit(0).cast("long"))
    settled, hung, taken = [], [], 0
    while not floors.isEmpty():
        parents = cut(rest.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("above"), F.first("weight").alias("weight")))
        own = cut(floors.join(parents, "node", "left"))
        free = own.where("n IS NULL").select("node", F.col("floor").alias("level"))
        one = own.where("n = 1").select("node", "above", "floor", "weight")
        if own.where("n IS NULL OR n = 1").isEmpty():
            break  # each has several parents, so all lie on or behind a cycle
        ended, looped, rounds = doubled(one)
        taken += rounds + 1
        settled.append(free)
        hung.append(ended)
        several = own.where("n > 1").select("node", "floor")
        # children of nodes that were taken out
        from_free = free.select(F.col("node").alias("source"), F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("above"), F.col("level").alias("floor"), F.lit(0).cast("long").alias("way"))
        from_hung = ended.join(free.withColumnsRenamed({"node": "above", "level": "top"}), "above", "left").select(
            F.col("node").alias("source"),
            F.when(F.col("top").isNull(), F.col("above")).alias("above"),
            F.greatest("floor", F.coalesce(F.col("top") + F.col("weight"), "floor")).alias("floor"),
            "weight",
        )
        into = rest.join(several.select(F.col("node").alias("target")), "target", "left_semi")
        moved = cut(into.withColumnRenamed("weight", "step").join(from_free.union(from_hung.withColumnRenamed("weight", "way")), "source", "left"))
        raised = moved.where("floor IS NOT NULL").groupBy(F.col("target").alias("node")).agg(F.max(F.col("floor") + F.col("step")).alias("least"))
        floors = cut(several.join(raised, "node", "left").select("node", F.greatest("floor", "least").alias("floor")))
        # sources that stay, and ends of pointers that are not settled, keep an edge; of several one way only counts
        kept = moved.where("floor IS NULL OR above IS NOT NULL").select(F.coalesce("above", "source").alias("source"), "target", (F.col("step") + F.coalesce("way", F.lit(0))).alias("weight"))
        rest = cut(kept.groupBy("source", "target").agg(F.max("weight").alias("weight")))
    # those that hang get their level after what they hang below, last taken out first
    known = union(settled) if settled else nodes.limit(0).withColumn("level", F.lit(0).cast("long"))
    for ended in reversed(hung):
        top = known.withColumnsRenamed({"node": "above", "level": "top"})
        known = cut(known.union(ended.join(top, "above").select("node", F.greatest("floor", F.col("top") + F.col("weight")).alias("level"))))
    done = known.select("node", F.col("level").cast("int").alias("level"))
    return done, nodes.join(done.select("node"), "node", "left_anti"), taken


def levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, level), the longest way from a root, and (node) of those on or behind a cycle."""
    return longest_ways(edges)[:2]


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes that a walk of at most ``depth`` edges from the seeds reaches, with the shortest way."""
    fronts = [cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))]
    for at in range(1, depth + 1):
        front = fronts[-1].select(F.col("node").alias("source"))
        met = edges.join(front, "source", "left_semi").select(F.col("target").alias("node")).distinct()
        fronts.append(cut(met.join(union(fronts).select("node"), "node", "left_anti").withColumn("depth", F.lit(at))))
        if fronts[-1].isEmpty():
            break
    return union(fronts)


def crawled(links: DataFrame, starts: DataFrame, site: str, depth: int, most: int) -> DataFrame:
    """(site, node, depth) of pages that a walk along a site's own links reaches, at most ``most`` a site.

    ``links``: (site, source, target); ``starts``: (site, node).  Nearer pages come first, then the smaller.
    """
    fronts = [cut(starts.select(site, "node").distinct().withColumn("depth", F.lit(0)))]
    for at in range(1, depth + 1):
        front = fronts[-1].select(site, F.col("node").alias("source"))
        met = links.join(front, [site, "source"], "left_semi").select(site, F.col("target").alias("node")).distinct()
        fronts.append(cut(met.join(union(fronts).select(site, "node"), [site, "node"], "left_anti").withColumn("depth", F.lit(at))))
        if fronts[-1].isEmpty():
            break
    place = F.row_number().over(Window.partitionBy(site).orderBy("depth", "node"))
    return union(fronts).withColumn("nth", place).where(F.col("nth") <= most).drop("nth")
