"""Operators 11 to 13: brute force, odd rows and column names, held-out accuracy."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import centroids, merkle, quality, queries

FOLDER = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(nodes):
    """The root of a list of digests, and for each of them its siblings, level by level, with its place in the run."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for i, p in enumerate(at):
            run = runs[p // 8]
            paths[i].append((run[: p % 8], run[p % 8 + 1 :]))
        nodes, at = [h(*r) for r in runs], [p // 8 for p in at]
    return nodes[0], paths


def plain_manifest(rows):
    """{(doc_id, leaf): …}: what the query returns, from plain lists."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = []
    for lang in langs:
        own = [(r, h(*map(entry, r))) for r in rows if r[2] == lang]
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        groups.append((own, *climbed([leaf for _, leaf in own])))
    root, tops = climbed([sub for _, sub, _ in groups])
    out = []
    for (own, sub, paths), top in zip(groups, tops):
        for (r, leaf), path in zip(own, paths):
            whole = path + top
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                now = h(*map(entry, (*r[:4], lowered)))
            for before, after in whole:
                now = h(*before, now, *after)
            proof = h(*itertools.chain.from_iterable(b + a for b, a in whole))
            out.append((r[0], leaf, sub, root, proof, now, now == root))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("size", [1, 2, 8, 9, 64, 65, 700])
def test_manifest_equals_plain_trees(spark, size):
    rng = random.Random(size)
    langs = [None, "", "en", "ñu", "zz"] if size < 700 else ["en"] * 40 + [f"l{i}" for i in range(70)]
    texts = ["", None, "ABC déf Ñ", "x" * 5000, "low", "Ω"]
    rows = [(i if rng.random() < 0.98 else None, rng.choice(["s", None]), rng.choice(langs), rng.choice([3, None]), rng.choice(texts)) for i in rng.sample(range(5 * size), size)]
    rows += rows[:2]  # rows that repeat are leaves of their own
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r[c] for c in NAMES) for r in merkle.verified(df).collect()), key=repr)
    assert got == plain_manifest(rows)


def test_manifest_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.verified(empty).count() == 0 and merkle.verified(empty).columns == NAMES
    rows = [(3, "s", "en", 4, "Text"), (4, "s", "de", 4, "text")]
    named = spark.createDataFrame(rows, SCHEMA)
    for c in ("tree", "rank", "n", "at", "part", "path", "digest", "a.b", "other", "leaf"):
        named = named.withColumn(c, F.lit("x"))
    assert sorted((tuple(r[c] for c in NAMES) for r in merkle.verified(named).collect()), key=repr) == plain_manifest(rows)


def test_proofs_of_some_leaves(spark):
    """Requests may be a few leaves; each path leads to the root, and to no other with another leaf."""
    rows = [(i, "s", "en" if i % 3 else "de", 4, f"Text {i}") for i in range(300)]
    held = merkle.build(spark.createDataFrame(rows, SCHEMA))
    some = held.leaves.where("doc_id IN (0, 77, 299)")
    for r in held.paths(some).collect():
        now = r.leaf.hex()
        for s in r.path:
            now = h(s.before.hex(), now, s.after.hex())
        assert now == held.root.hex()
    records = {bytes(r.digest): r.children for level in held.levels for r in level.collect()}
    assert all(h(*(bytes(c).hex() for c in children)) == digest.hex() for digest, children in records.items())
    held.drop()


def plain_clusters(rows, count, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (h(f"2:{'' if r[0] is None else r[0]}"), r[1]))[:count]
    centres = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, own) if c == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [near(v) for _, v in kept]
    inertia = {k: sum(d for d, c in last if c == k) for k in range(len(centres))}
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), h(",".join(map(str, centres[k])))) for (i, _), (d, k) in zip(kept, last)), key=repr)


FIELDS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def vectors(rng, n):
    """Vectors of few values, so that distances tie, copies, and rows that take no part."""
    rows = [(i, [rng.choice([-0.51, -0.5, 0.0, 0.001, 0.25]) for _ in range(64)]) for i in range(n)]
    rows += [(n + i, list(rows[i % n][1])) for i in range(n // 2)]
    rows += rows[:3] + [(None, rows[0][1])]
    bad = [None, [], [0.1] * 63, [0.1] * 65, [0.1] * 63 + [None], [0.1] * 63 + [float("nan")], [0.1] * 63 + [float("inf")]]
    return rows + [(10_000 + i, v) for i, v in enumerate(bad)]


@pytest.mark.parametrize(("n", "count", "rounds"), [(60, 40, 5), (10, 40, 5), (150, 7, 3)])
def test_clusters_equal_plain_ones(spark, n, count, rounds):
    rows = vectors(random.Random(n), n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).withColumn("v", F.lit(1)).withColumn("cluster", F.lit("x"))
    got = sorted((tuple(r[c] for c in FIELDS) for r in centroids.clusters(df, count=count, rounds=rounds).collect()), key=repr)
    assert got == plain_clusters([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], count, rounds)


def test_clusters_of_odd_tables(spark):
    empty = spark.createDataFrame([(1, [0.1]), (2, None)], "vec_id long, embedding array<float>")
    assert centroids.clusters(empty).count() == 0 and centroids.clusters(empty).columns == FIELDS
    with pytest.raises(Exception, match="beyond"):
        centroids.clusters(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_threshold_walk_stops_early():
    """Far centroids are not computed, and the result is that of all distances."""
    rng = np.random.default_rng(1)
    centres = np.concatenate([rng.integers(-50, 50, (5, 64)), rng.integers(100_000, 100_050, (35, 64))]).astype(np.int64)
    x = rng.integers(-60, 60, (500, 64)).astype(np.int64)
    lists, computed = centroids.Lists(centres), []
    whole, lists.centroids = lists.centroids, Counting(centres, computed)
    which, best = centroids.nearest(x, lists)
    every = ((x[:, None, :] - whole[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (which == every.argmin(axis=1)).all()
    assert set(computed) == set(range(5))


class Counting:
    """Centroids that note which of them are read."""

    def __init__(self, values, read):
        self.values, self.read = values, read

    def __len__(self):
        return len(self.values)

    def __getitem__(self, c):
        self.read.append(c)
        return self.values[c]


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    out = queries.op13_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows) and len(rows) > 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_quality_never_learns_from_held_out_labels(spark):
    rng = random.Random(2)
    text = lambda good: " ".join(rng.choices(["the", "house", "is", "green"] if good else ["%%%", "buy!!", "|", "$$$"], k=30))
    rows = [(i, text(i % 2)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    plain = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    turned = spark.createDataFrame([(i, (i % 2) ^ held(i)) for i, _ in rows], "doc_id long, quality int")
    one, two = (sorted((r.doc_id, r.score) for r in quality.scored(docs, quality.train(docs, x)).collect()) for x in (plain, turned))
    assert one == two and all((s > 0.5) == bool(i % 2) for i, s in one)


def test_quality_of_odd_tables(spark):
    odd = [(1, None), (2, ""), (3, "x" * 3_000_000), (None, "a b"), (4, "same"), (4, "same"), (5, "\x00\n\t ")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    for c in ("quality", "score", "chosen", "bits", "a.b"):
        docs = docs.withColumn(c, F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert {r.score for r in quality.scored(docs, model).collect()} == {0.5}
    one = quality.train(docs, spark.createDataFrame([(4, 1), (4, 1), (99, 0), (1, None), (2, 7)], "doc_id long, quality int"))
    assert {(r.doc_id, r.predicted) for r in quality.scored(docs, one).collect()} == {(i, 1) for i in (1, 2, 3, 4, 5, None)}
    both = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 5)] * 3, "doc_id long, quality int")
    rows = quality.scored(docs, quality.train(docs, both)).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    empty = docs.limit(0)
    assert quality.scored(empty, quality.train(empty, both)).count() == 0


def test_dual_descent_reaches_the_optimum():
    """The dual variables fulfil the optimality conditions, so the weights are those of the hinge-loss problem."""
    rng = np.random.default_rng(4)
    rows = [quality.packed(rng.choice(quality.BUCKETS, 40, replace=False)) for _ in range(60)]
    y = (rng.random(60) < 0.5).astype(int)
    ratio = rng.normal(size=quality.BUCKETS)
    weights, bias = quality.descent(rows, y, ratio, 0.3, 400)

    def loss(w, b):
        total = (w @ w + b * b) / 2
        for bits, label in zip(rows, y):
            own = quality.unpacked(bits)
            v = ratio[own] / np.sqrt(ratio[own] @ ratio[own])
            share = (y == label).mean()
            total += 0.3 / (2 * share) * max(0, 1 - (2 * label - 1) * (w[own] @ v + b))
        return total

    best = loss(weights, bias)
    for _ in range(200):
        step = rng.normal(size=quality.BUCKETS) * (weights != 0) * 0.01
        assert loss(weights + step, bias + rng.normal() * 0.01) >= best - 1e-4


def test_parts_of_a_long_text_lose_no_indicator(monkeypatch):
    text = " ".join(random.Random(1).choices(["uno", "Dos!", "tres|", "año", "77", "tres|"], k=4000))
    whole = set(quality.indicators(text).tolist())
    monkeypatch.setattr(quality, "PART", 5000)
    assert whole <= set(quality.indicators(text).tolist())
