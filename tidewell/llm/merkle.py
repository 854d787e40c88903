"""Operator 11, Merkle manifest of a dataset: a content-addressed graph, and proofs by descent from its root.

A leaf is the digest of a row's columns; leaves are ordered by group (language) and ``doc_id``; every
``RUN`` consecutive nodes of a group become one record, ``digest -> children``, level by level, until
one node is left, and the groups' roots become one root likewise.  The records of a level are one table,
addressed by digest alone.

A proof is found by descent: a request knows its group's place and its own rank, whose digits to the
base ``RUN`` name the child to take at each level; the record of the digest at hand gives the next one,
and the children that are not taken are the path's next segment.  Requests that share a prefix of
digits descend as one, so a level takes one join of as many rows as the level has nodes, none of them
a hot key; each request leaves that common path at its last run.  Reversed, the segments lead from
the leaf to the root.  Ranks come from a range-partitioned sort and the row counts of its ranges.

Defined results: a null column is ``-`` in a leaf, a null language a group of its own, before all others;
leaves of equal ``doc_id`` (null first) are ordered by digest, and rows that repeat entirely are leaves of
their own with the same record; a null ``doc_id`` is never tampered with; a group of one leaf has that leaf
as its root, and a table of one row has an empty proof; texts of any length are taken whole; an empty
table gives an empty result; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, named

#: Consecutive nodes that become one.
RUN = 8
#: Columns of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENT = "struct<before: binary, after: binary>"


def entered(value: Column) -> Column:
    """A value with its length in bytes, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(entered, values)))


def joined(parts: Column) -> Column:
    """The bytes of an array of binaries, one after the other."""
    return F.aggregate(parts, F.lit(b""), lambda all_, x: F.concat(all_, x))


def segment(children: str, digit: str) -> Column:
    """The children beside the one at ``digit``."""
    before, after = F.expr(f"slice({children}, 1, {digit})"), F.expr(f"slice({children}, {digit} + 2, {RUN})")
    return F.struct(joined(before).alias("before"), joined(after).alias("after"))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path that leads from the leaf to the root."""
    siblings = F.transform(path, lambda s: F.concat(hexed(s["before"]), hexed(s["after"])))
    return F.sha2(F.array_join(siblings, ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, hexed(start), lambda own, s: F.sha2(F.concat(hexed(s["before"]), own, hexed(s["after"])), 256))


def ranked(rows: DataFrame, order: list[str], scratch: Scratch, what: str) -> DataFrame:
    """The rows with ``at``, their number from 0 in this order: within ranges, after as many as the ranges before hold."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    held = scratch.keep(ranges, what).withColumn("part", F.shiftright("at", 33).cast("int"))
    before, offsets = 0, []
    # one number for each range
    for part, n in sorted((r.part, r.n) for r in held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    met = held.join(F.broadcast(starts), "part")
    return met.withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).drop("part", "before")


def grown(nodes: DataFrame, most: int, scratch: Scratch, what: str) -> tuple[list[DataFrame], DataFrame]:
    """The records above (tree, rank, n, digest), level by level, and each tree's (tree, depth, digest).

    ``n`` counts a tree's nodes at a level, ``most`` is its largest value.
    """
    levels, roots = [], nodes.where("n = 1").select("tree", F.lit(0).alias("depth"), "digest")
    while most > 1:
        run = F.expr(f"rank div {RUN}")
        runs = nodes.where("n > 1").groupBy("tree", run.alias("run"), "n").agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("own"))
        records = runs.select("tree", F.col("run").alias("rank"), F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), F.col("own.digest").alias("children"))
        above = digest(F.array_join(F.transform("children", hexed), ""))
        levels.append(scratch.keep(records.withColumn("digest", above), f"{what}-records"))
        nodes = levels[-1]
        roots = roots.union(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("depth"), "digest"))
        most = -(-most // RUN)
    return levels, roots


def descended(levels: list[DataFrame], starts: DataFrame) -> DataFrame:
    """(tree, run, children, path, depth) of the last run on each way down from (tree, depth, digest, path).

    ``path`` has the segments in the order of the descent; a tree of depth 0 is a run of its own.
    """
    start = starts.select("tree", F.lit(0).cast("long").alias("run"), "digest", "path", "depth")
    out = start.where("depth = 0").select("tree", "run", F.array("digest").alias("children"), "path", "depth")
    front = None
    for k in range(len(levels), 0, -1):
        begun = start.where(F.col("depth") == k)
        front = begun if front is None else front.union(begun)
        store = levels[k - 1].select("digest", "children").dropDuplicates(["digest"])
        met = front.join(store, "digest").select("tree", "run", "children", "path", "depth")
        if k == 1:
            return out.union(met)
        taken = met.select("*", F.posexplode("children").alias("digit", "digest"))
        path = F.concat("path", F.array(segment("children", "digit").cast(SEGMENT)))
        front = taken.select("tree", F.expr(f"run * {RUN} + digit").alias("run"), "digest", path.alias("path"), "depth")
    return out


@dataclass
class Manifest:
    """The records of a table, in the shared folder until ``drop``."""

    scratch: Scratch
    leaves: DataFrame  # tree, rank, doc_id, leaf and the columns that were carried
    trees: DataFrame  # tree, lang, n, depth, digest
    levels: list[DataFrame]
    top_levels: list[DataFrame]
    root: bytes | None
    top_depth: int

    def drop(self) -> None:
        self.scratch.drop_all_but()

    def paths(self, requests: DataFrame) -> DataFrame:
        """The rows of ``requests`` (tree, rank, ...) with ``subroot`` and ``path``, from the leaf to the root."""
        spark = requests.sparkSession
        top = spark.createDataFrame([(0, self.top_depth, self.root)] if self.root else [], "tree long, depth int, digest binary")
        groups = descended(self.top_levels, top.withColumn("path", F.array().cast(f"array<{SEGMENT}>")))
        each = groups.select("*", F.posexplode("children").alias("digit", "digest"))
        last = F.when(F.col("depth") > 0, F.array(segment("children", "digit").cast(SEGMENT))).otherwise(F.array().cast(f"array<{SEGMENT}>"))
        to_group = each.select(F.expr(f"run * {RUN} + digit").alias("tree"), F.concat("path", last).alias("path"))
        starts = self.trees.select("tree", "depth", "digest").join(to_group, "tree")
        runs = descended(self.levels, starts).join(self.trees.select("tree", F.col("digest").alias("subroot")), "tree")
        own = requests.withColumn("run", F.expr(f"rank div {RUN}")).withColumn("digit", F.expr(f"cast(rank % {RUN} AS INT)"))
        met = own.join(runs, ["tree", "run"])
        segments = F.when(F.col("depth") > 0, F.concat("path", F.array(segment("children", "digit").cast(SEGMENT)))).otherwise(F.col("path"))
        return met.select(*(requests[c] for c in requests.columns), "subroot", F.reverse(segments).alias("path"))


def build(docs: DataFrame, carried: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``carried`` are more columns of the leaves, computed in the same scan."""
    carried = carried or {}
    scratch = Scratch(docs.sparkSession)
    own = leaf([named(docs, c) for c in FIELDS])
    read = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), own.alias("leaf"), *(c.alias(name) for name, c in carried.items()))
    raw = scratch.keep(read, "merkle-leaves")
    placed = ranked(raw, ["lang", "doc_id", "leaf"], scratch, "merkle-ranges")
    scratch.drop(raw)
    sizes = scratch.keep(placed.groupBy("lang").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-sizes")
    langs = scratch.keep(ranked(sizes, ["first"], scratch, "merkle-langs").withColumnRenamed("at", "tree"), "merkle-trees")
    most, count = langs.agg(F.max("n"), F.count(F.lit(1))).first()
    met = placed.withColumnRenamed("lang", "its").join(langs, F.col("its").eqNullSafe(F.col("lang")))
    leaves = met.select("tree", (F.col("at") - F.col("first")).alias("rank"), "n", "doc_id", "leaf", *carried)
    levels, roots = grown(leaves.select("tree", "rank", "n", F.col("leaf").alias("digest")), most or 0, scratch, "merkle")
    trees = scratch.keep(langs.join(roots, "tree").select("tree", "lang", "n", "depth", "digest"), "merkle-roots")
    groups = trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(count).cast("long").alias("n"), "digest")
    top_levels, top = grown(groups, count, scratch, "merkle-top")
    found = top.first()
    return Manifest(scratch, leaves, trees, levels, top_levels, bytes(found.digest) if found else None, found.depth if found else 0)


def tampered(docs: DataFrame, where: Column, text: Column) -> Column:
    """The leaf of a row whose text was replaced where ``where`` holds, null elsewhere."""
    values = [text if c == "text" else named(docs, c) for c in FIELDS]
    return F.when(where, leaf(values))


def third(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 and, for each row, whether its leaf still leads to the root.

    Rows of every third id are checked with a text whose capital letters A-Z were lowered.
    """
    other = tampered(docs, third(F.col("doc_id")), F.translate(named(docs, "text"), UPPER, LOWER))
    held = build(docs, {"other": other})
    found = held.paths(held.leaves)
    root = F.lit(held.root.hex() if held.root else None).cast("string")
    out = found.select(
        "doc_id",
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        proof(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
