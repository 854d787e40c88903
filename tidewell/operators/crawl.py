"""Best-first walks of sites over a table of links, in rounds for all sites at once.

A walk visits the open page of the highest score, then the least depth, then the earliest arrival; a page keeps the
score with which it first arrived.  No site is brought into one task: a round takes the best open pages of each site,
at most as many as the site may still visit, joins their links, and visits those pages that nothing which the round
found would overtake.  Scores that many pages share are thus one round, and a round visits at least one page of each
site that is still walking, so there are at most ``most`` rounds, however large the sites are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Store, stored, union

#: An open page: its site, score, depth, the visit on which it arrived, its place there, and the site's visits so far.
OPEN = ["s", "node", "p", "d", "via", "pos", "done"]


def ranked(opened: DataFrame, most: int) -> DataFrame:
    """The open pages of each site that it may still visit, by the order of visits (``r`` from 1)."""
    order = Window.partitionBy("s").orderBy(F.desc("p"), "d", "via", "pos", "node")
    # the fixed limit lets Spark drop rows before the shuffle
    return opened.withColumn("r", F.row_number().over(order)).where((F.col("r") <= most) & (F.col("r") <= most - F.col("done")))


def best_first(links: DataFrame, starts: DataFrame, site: str, depth: int = 3, most: int = 40, readable: DataFrame | None = None) -> DataFrame:
    """(site, node, visita, profundidad, puntaje) of the first ``most`` pages that each site's walk visits, ``visita`` from 1.

    ``links``: (site, source, target, puntaje, pos), where ``pos`` is a link's place on its page; links of pages at
    ``depth`` are not followed.  ``starts``: (site, node, puntaje, profundidad, pos).  ``readable``: (site, node) of
    the pages that can be read; others take no visit, and links to them are left out.  Rows with a null site or page
    are left out; a null score is 0, a null place comes first.  Equal places go by the page; repeated links count
    once, by the first place and, there, the best score.  Other columns are not read.  Empty tables give no rows.
    """
    known = lambda df, *columns: df.dropna(subset=list(columns))
    score, place = F.coalesce(F.col("puntaje").cast("double"), F.lit(0.0)), F.coalesce(F.col("pos").cast("long"), F.lit(-(1 << 62)))
    arcs = known(links.select(F.col(site).alias("s"), "source", F.col("target").alias("node"), score.alias("p"), place.alias("pos")), "s", "source", "node")
    begun = known(starts.select(F.col(site).alias("s"), "node", score.alias("p"), F.col("profundidad").cast("int").alias("d"), place.alias("pos")), "s", "node")
    if readable is not None:
        there = readable.select(F.col(site).alias("s"), "node")
        arcs, begun = arcs.join(there, ["s", "node"], "left_semi"), begun.join(there, ["s", "node"], "left_semi")
    store, lasting = Store(), Store()
    # one row per link, so that no round sorts out repeats
    arcs = lasting.keep(arcs.groupBy("s", "source", "node").agg(F.min(F.struct("pos", (-F.col("p")).alias("n"))).alias("x")).select("s", "source", "node", (-F.col("x.n")).alias("p"), "x.pos"))
    first = F.min(F.struct("pos", (-F.col("p")).alias("n"), F.coalesce("d", F.lit(0)).alias("d"))).alias("x")
    arrived = begun.groupBy("s", "node").agg(first).select("s", "node", (-F.col("x.n")).alias("p"), "x.d", F.lit(0).alias("via"), "x.pos", F.lit(0).alias("done"))
    queued = [lasting.keep(arrived)]
    visited = []
    front = store.keep(ranked(queued[0], most))
    while not front.isEmpty():
        took = front.where(F.col("d") < depth).select("s", F.col("node").alias("source"), "r", (F.col("d") + 1).alias("d"))
        met = took.join(arcs, ["s", "source"]).groupBy("s", "node").agg(F.min(F.struct("r", "pos", (-F.col("p")).alias("n"), "d")).alias("x"))
        new = met.join(union([q.select("s", "node") for q in queued]), ["s", "node"], "left_anti")
        new = store.keep(new.select("s", "node", "x.r", "x.pos", F.col("x.n").alias("n"), "x.d"))
        # a page waits if one before it leads to something better
        best = new.groupBy("s", "r").agg(F.min(F.struct("n", "d")).alias("best"))
        before = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        judged = front.join(best, ["s", "r"], "left").withColumn("ahead", F.min("best").over(before))
        goes = F.col("ahead").isNull() | (F.col("ahead") >= F.struct((-F.col("p")).alias("n"), "d"))
        judged = judged.withColumn("goes", goes).withColumn("upto", F.col("done") + F.count_if("goes").over(Window.partitionBy("s")).cast("int"))
        judged = lasting.keep(judged.drop("best", "ahead"))
        visited.append(judged.where("goes"))
        told = visited[-1].select("s", "r", (F.col("done") + F.col("r")).alias("via"), F.col("upto").alias("done"))
        queued.append(lasting.keep(new.join(told, ["s", "r"]).withColumn("p", -F.col("n")).select(*OPEN)))
        waiting = judged.where("NOT goes").drop("done").withColumnRenamed("upto", "done").select(*OPEN)
        front = store.keep(ranked(waiting.union(queued[-1]), most))
        store.drop_all_but(front)
    store.drop_all_but()
    out = [v.select(F.col("s").alias(site), "node", (F.col("done") + F.col("r")).alias("visita"), F.col("d").alias("profundidad"), F.col("p").alias("puntaje")) for v in visited]
    kinds = {f.name: f.dataType for f in arrived.schema}
    empty = links.sparkSession.createDataFrame([], f"`{site}` {kinds['s'].simpleString()}, node {kinds['node'].simpleString()}, visita int, profundidad int, puntaje double")
    found = stored(union([empty, *out]))
    lasting.drop_all_but()
    return found
