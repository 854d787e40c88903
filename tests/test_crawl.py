import heapq
import random

from pyspark.sql import functions as F

from tidewell.operators import crawl

LINKS = "site long, source string, target string, puntaje double, pos long"
STARTS = "site long, node string, puntaje double, profundidad int, pos long"


def plain_walk(links, starts, depth, most):
    """The order of visits by one heap for each site."""
    out = []
    for site in {s for s, *_ in starts}:
        order, heap, queued, visits = 0, [], set(), 0

        def push(node, score, at):
            nonlocal order
            if node not in queued:
                queued.add(node)
                order += 1
                heapq.heappush(heap, (-score, at, order, node))

        for _, node, score, at, _ in sorted((x for x in starts if x[0] == site), key=lambda x: (x[4], -x[2])):
            push(node, score, at)
        while heap and visits < most:
            score, at, _, node = heapq.heappop(heap)
            visits += 1
            out.append((site, node, visits, at, -score))
            if at < depth:
                for _, _, target, points, _ in sorted((x for x in links if x[:2] == (site, node)), key=lambda x: (x[4], -x[3])):
                    push(target, points, at + 1)
    return sorted(out)


def test_visits_in_the_order_of_a_heap(spark):
    random.seed(5)
    links, starts = [], []
    for site in range(200):
        nodes = [f"n{i}" for i in range(random.randint(1, 40))]
        starts.append((site, nodes[0], 100.0, 0, 0))
        if site % 3 == 0:
            starts += [(site, random.choice(nodes), 30.0, 1, 1), (site, random.choice(nodes), 1.0, 1, 2)]
        few = [2.0, 8.0, 12.0] if site % 2 else [float(x) for x in range(40)]
        for source in nodes:
            links += [(site, source, random.choice(nodes), random.choice(few), pos) for pos in range(random.randint(0, 6))]
    got = crawl.best_first(spark.createDataFrame(links, LINKS), spark.createDataFrame(starts, STARTS), "site", 3, 12)
    assert sorted(map(tuple, got.collect())) == plain_walk(links, starts, 3, 12)


def test_a_better_link_overtakes_and_the_first_arrival_counts(spark):
    links = [(1, "a", "b", 9.0, 0), (1, "a", "c", 5.0, 1), (1, "a", "d", 5.0, 2), (1, "b", "e", 7.0, 0), (1, "b", "d", 40.0, 1), (1, "e", "a", 99.0, 0)]
    got = crawl.best_first(spark.createDataFrame(links, LINKS), spark.createDataFrame([(1, "a", 100.0, 0, 0)], STARTS), "site")
    assert [r.node for r in got.orderBy("visita").collect()] == ["a", "b", "e", "c", "d"]


def test_odd_links(spark):
    """Nulls, repeats, a site of one large page, pages that cannot be read, names that clash, empty tables."""
    links = [(1, "a", None, 1.0, 0), (None, "a", "b", 1.0, 0), (1, None, "b", 1.0, 0), (1, "a", "b", None, None), (1, "a", "b", 3.0, 7), (1, "a", "gone", 50.0, 0), (1, "a", "a", 9.0, 0)]
    links += [(2, "a", f"x{i:04}", float(i % 2), i) for i in range(3000)]
    starts = [(1, "a", None, 0, 0), (1, "a", 5.0, 0, 1), (2, "a", 1.0, None, 0), (3, "lone", 1.0, 0, None), (None, "a", 1.0, 0, 0), (3, None, 1.0, 0, 0)]
    all_links = spark.createDataFrame(links, LINKS).withColumn("r", F.lit("x")).withColumn("done", F.lit(9))
    readable = all_links.select("site", F.col("target").alias("node")).where("node <> 'gone'").union(spark.createDataFrame([(2, "a"), (3, "lone")], "site long, node string"))
    begun = spark.createDataFrame(starts, STARTS)
    got = crawl.best_first(all_links, begun, "site", 3, 5, readable)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows[:2] == [(1, "a", 1, 0, 0.0), (1, "b", 2, 1, 0.0)] and rows[-1] == (3, "lone", 1, 0, 1.0)
    assert [r[1] for r in sorted(rows[2:-1], key=lambda r: r[2])] == ["a", "x0001", "x0003", "x0005", "x0007"]
    none = crawl.best_first(all_links, begun.where("false"), "site")
    assert none.columns == ["site", "node", "visita", "profundidad", "puntaje"] and none.count() == 0
    assert crawl.best_first(all_links.where("false"), begun, "site").count() == 3
