"""Classes from buckets: which members are linked, and union-find over the links, as distributed jobs.

Members of a bucket may be similar; ``alike`` tells cheaply, from the samples in their profiles, which
pairs can't be, and ``verify`` decides.  Only pairs of different components count, as all others
cannot change a class.  In buckets of up to ``pairwise`` members all pairs are verified at once, and no
samples are asked; with none, and in larger buckets, that takes three steps:

1. every member meets the centre of its bucket, the member that shares most with others over all its
   buckets;
2. in buckets that still hold several components, members of others meet up to ``SECONDS`` more of the
   largest;
3. what is left in buckets of several components meets where it shares rare tokens.  Tokens that fewer
   members have come first in a member's order.  What two members share is no more than what either has
   from their first shared token on; so a pair meets only at tokens from which on both still have enough
   to reach the threshold, which for most members are the rare ones.

So every pair of a bucket is in one component, or ruled out by its samples or by that bound, or verified.
The first two steps grow with the members; the third grows with the tokens of the members that are left,
and writes out only pairs that its bound lets pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Members of a bucket's largest component that step 2 compares with the others.
SECONDS = 4
#: For sums of weights that differ in their order only.
NEARLY = 1 - 1e-9
#: So few links are joined in one task, which is quicker; more are dealt out.
FEW = 10_000

Alike = Callable[[Callable[[str], F.Column], Callable[[str], F.Column]], F.Column]


class Verifier:
    """What a kind of similarity gives: the exact test of pairs, and the weighted tokens that it is about."""

    threshold: float
    #: Fields of the profiles that ``begin`` needs.
    needs: tuple[str, ...] = ()

    def begin(self, nodes: DataFrame) -> None:
        """``nodes``: (node, needs), all that will be asked about."""

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The rows (a, b, …) of pairs whose weighted Jaccard similarity reaches the threshold."""
        raise NotImplementedError

    def tokens(self, nodes: DataFrame) -> DataFrame:
        """(node, token long, weight double): each token of each node once, with a positive weight."""
        raise NotImplementedError



def always(x, y) -> F.Column:
    return F.lit(True)


def ordered(one: str, two: str, its_root: str | None = None, other_root: str | None = None) -> list[F.Column]:
    """The pair (a, b) with a < b, and the roots (ra, rb) of both."""
    first = F.col(one) < F.col(two)
    out = [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]
    if its_root:
        out += [F.when(first, F.col(its_root)).otherwise(F.col(other_root)).alias("ra"), F.when(first, F.col(other_root)).otherwise(F.col(its_root)).alias("rb")]
    return out


def agreeing(x: F.Column, y: F.Column) -> F.Column:
    """How many of the eight bytes of two longs are the same."""
    differ = x.bitwiseXOR(y)
    for by in (4, 2, 1):  # the lowest bit of each byte collects its others
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, by))
    return 8 - F.bit_count(differ.bitwiseAND(F.lit(0x0101010101010101)))


class Linking:
    """One run over (bucket long, node), each once.

    ``profiles``: (node, …), what ``alike`` needs of each node.
    """

    def __init__(self, scratch: Scratch, profiles: DataFrame | None, alike: Alike, what: str, pairwise: int = 0):
        self.scratch, self.profiles, self.alike, self.what, self.pairwise = scratch, profiles, alike, what, pairwise
        self.fields = [c for c in profiles.columns if c != "node"] if profiles is not None else []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.keep(df, f"{self.what}-{name}")

    def may_match(self) -> F.Column:
        """``alike`` of a row's own fields and of those that begin with ``other_``."""
        return self.alike(F.col, lambda name: F.col("other_" + name))

    def shared(self, members: DataFrame) -> DataFrame:
        """(bucket, node, score, fields) of buckets of two members or more; with ``pairwise`` also their ``size``."""
        sizes = self.keep(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        together = self.keep(members.join(sizes, "bucket"), "together")
        nodes = together.groupBy("node").agg(F.sum("n").alias("score"))
        if self.profiles is not None:
            nodes = nodes.join(self.profiles, "node")
        size = [F.col("n").alias("size")] if self.pairwise else []
        out = self.keep(together.select("bucket", "node", *size).join(nodes, "node"), "shared")
        self.scratch.drop(sizes, together)
        return out

    def open_buckets(self, members: DataFrame) -> DataFrame:
        """The members, with their roots, of buckets that hold several components."""
        ends = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        several = self.keep(ends.where("low <> high").select("bucket"), "several")
        out = self.keep(members.join(several, "bucket", "left_semi"), "open")
        self.scratch.drop(several)
        return out

    def seconds(self, left: DataFrame) -> DataFrame:
        """(bucket, other_node, other_root, …) of up to ``SECONDS`` members of each bucket's largest component."""
        sizes = left.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        largest = self.keep(sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("root")), "largest")
        order = Window.partitionBy("bucket").orderBy(F.desc("score"), "node")
        ranked = left.join(largest, ["bucket", "root"]).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SECONDS)
        out = self.keep(ranked.select("bucket", *(F.col(c).alias("other_" + c) for c in ("node", "root", *self.fields))), "seconds")
        self.scratch.drop(largest)
        return out

    def rare_pairs(self, left: DataFrame, verifier: Verifier) -> DataFrame:
        """(a, b, ra, rb) of the pairs that may reach the threshold by the tokens they share."""
        t = verifier.threshold
        nodes = self.keep(left.select("node", "root").distinct(), "nodes")
        each = self.keep(verifier.tokens(nodes.select("node")), "tokens")
        counts = self.keep(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
        totals = nodes.join(each.groupBy("node").agg(F.sum("weight").alias("total")), "node")
        # tokens of one node alone are the first, so what is left from any other on is a sum of the others
        onward = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
        ranked = each.join(counts, "token").withColumn("rest", F.sum("weight").over(onward))
        first = ranked.join(totals, "node").where(F.col("rest") >= F.col("total") * t * NEARLY)
        first = self.keep(first.select("token", "node", "root", "total", "rest"), "first")
        self.scratch.drop(each, counts, nodes)
        other = first.select("token", *(F.col(c).alias("other_" + c) for c in ("node", "root", "total", "rest")))
        enough = F.least("rest", "other_rest") >= (F.col("total") + F.col("other_total")) * (t / (1 + t) * NEARLY)
        met = first.join(other, "token").where("node < other_node AND root <> other_root").where(enough)
        return met.select(*ordered("node", "other_node", "root", "other_root"))

    def run(self, members: DataFrame, verifier: Verifier) -> DataFrame:
        """(node, root) for every node that a chain of links connects to another; root is the smallest."""
        keep, drop = self.keep, self.scratch.drop
        shared = self.shared(members)
        verifier.begin(shared.select("node", *verifier.needs).distinct())

        small = None
        if self.pairwise:
            whole, shared = shared, shared.where(f"size > {self.pairwise}").drop("size")
            few = whole.where(f"size <= {self.pairwise}").select("bucket", "node")
            small = few.join(few.withColumnRenamed("node", "other_node"), "bucket").where("node < other_node")
        best = F.max_by(F.struct("node", *self.fields), F.struct("score", "node")).alias("centre")
        centres = keep(shared.groupBy("bucket").agg(best).select("bucket", *(F.col("centre")[c].alias("other_" + c) for c in ("node", *self.fields))), "centres")
        near = shared.join(centres, "bucket").where("node <> other_node").where(self.may_match())
        met = near.select(*ordered("node", "other_node"))
        if small is not None:
            met = met.union(small.select(*ordered("node", "other_node")))
        pairs = keep(met.distinct(), "pairs")
        found = keep(verifier.verify(pairs), "found")
        roots = components(found, self.scratch, self.what)
        # a centre has met its whole bucket
        rest = shared.join(centres.select("bucket", "other_node"), "bucket").where("node <> other_node").drop("other_node")
        left = self.open_buckets(rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        drop(shared if small is None else whole, centres, pairs, found)

        if not left.isEmpty():
            seconds = self.seconds(left)
            met = left.join(seconds, "bucket").where("root <> other_root").where(self.may_match())
            roots, tops = self.joined(roots, verifier, met.select(*ordered("node", "other_node", "root", "other_root")))
            if tops is not None:
                rest = left.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
                before, left = left, self.open_buckets(rest)
                drop(before)
            drop(seconds)
        if not left.isEmpty():
            roots, _ = self.joined(roots, verifier, self.rare_pairs(left, verifier))
        drop(left)
        return roots

    def joined(self, roots: DataFrame, verifier: Verifier, pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The roots when the components of similar ``pairs`` are joined, and (root, top) of those that changed."""
        pairs = self.keep(pairs.distinct(), "pairs")
        found = self.keep(verifier.verify(pairs), "found")
        tops = None
        if not found.isEmpty():
            joined = components(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")), self.scratch, self.what)
            tops = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
            moved = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            # members that had no link so far are roots of their own
            single = joined.join(roots.select("node"), "node", "left_anti")
            before, roots = roots, self.keep(moved.union(single), "roots")
            self.scratch.drop(before)
        self.scratch.drop(pairs, found)
        return roots, tops


def linked(members: DataFrame, verifier: Verifier, scratch: Scratch, what: str, profiles: DataFrame | None = None, alike: Alike = always, pairwise: int = 0) -> DataFrame:
    """(node, root): see ``Linking``."""
    return Linking(scratch, profiles, alike, what, pairwise).run(members, verifier)


def components(links: DataFrame, scratch: Scratch, what: str) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Union-find by rounds: each node is hung below its smallest neighbour, paths are halved, once in the
    first round and once more in each next one, and the links are drawn anew between what is left.
    """
    few = links.count() <= FEW
    one = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    keep = lambda df, name: scratch.keep(df, f"{what}-{name}")
    left = keep(one(links).select(*ordered("a", "b")).where("a <> b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not rounds or not left.isEmpty():
        ends = one(left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a")))
        up = keep(ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        for _ in range(len(rounds) + 1):
            above = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            before, up = up, keep(one(up).join(one(above), "p").select("u", F.col("q").alias("p")), "parents")
            scratch.drop(before)
        rounds.append(up)
        first, second = (up.select(F.col("u").alias(c), F.col("p").alias("p" + c)) for c in ("a", "b"))
        drawn = one(left).join(one(first), "a").join(one(second), "b").where("pa <> pb")
        before, left = left, keep(drawn.select(*ordered("pa", "pb")).distinct(), "links")
        scratch.drop(before)
    roots = rounds[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for up in rounds[1:]:
        above = up.select(F.col("u").alias("root"), F.col("p").alias("top"))
        roots = one(roots).join(one(above), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    roots = keep(roots, "roots")
    scratch.drop(left, *rounds)
    return roots
