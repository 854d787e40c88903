"""Operator 3, line dedup: near-equal lines by MinHash over character shingles, with Spark functions only.

The different lines go to a table that is bucketed by line key (two 64-bit hashes of the line), so
neither the signatures nor the fetching of texts shuffles them.  A shingle is ``WIDTH`` characters, as UTF-16 counts them.  A
signature has ``BANDS`` x ``ROWS`` values: value i is the smallest of the shingles' hashes xor a
constant whose leading bits are i, so each value looks at another part of the hashes and two lines
agree on it with the probability of their Jaccard similarity.  The smallest hash of each range of equal
leading bits gives them all: value i is that of the range nearest to i, in the sense of xor, that has
one.  In a line of more than ``ENOUGH`` shingles only those nearest to such a constant are followed,
about ``ENOUGH`` of them; for about 1.8 % of the values none is near, and they take another.  Lines that
repeat themselves, which shows in few different values, are followed whole.  Bands of values are the
buckets; a pair that may be similar by its samples, one byte of each value, is verified by the exact
Jaccard similarity of the sets of all shingles (as 64-bit hashes) of both lines.  Of each component the first line by (doc_id, line_no) stays.

Defined results: lines are what ``\\n`` separates; lines of white space alone, and null or empty texts,
have no duplicates and stay; lines shorter than a shingle are one shingle; lines of any length are
taken whole; a null ``doc_id`` comes after all others; of occurrences that agree in ``doc_id`` and
``line_no`` (repeated rows) all share the decision; an empty table gives an empty result; other columns,
of whatever name, are carried through by ``deduplicate``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh_path, named, remove, shared_dir, whole
from .linking import Verifier, agreeing, linked

#: What tells lines apart.
KEY = ("key", "key2")
WIDTH = 12
SIMILARITY = 0.8
#: Two lines at the threshold meet in a bucket with a chance of 1 - (1 - 0.8 ** 3) ** 8 = 0.997, at 0.85 of 0.9997.
BANDS, ROWS = 8, 3
VALUES = BANDS * ROWS
#: Leading bits of a hash that name the value it is nearest to.
LEAD = 5
#: Shingles followed of a long line, and different values below which it is followed whole.
ENOUGH, VARIED = 128, 20
#: Lines of as many shingles are compared only if so many samples agree, four deviations below the threshold's mean.
SAMPLED, LEAST = 32, 12
#: In buckets of up to so many lines all pairs are compared; larger ones go the way of ``linking``.
PAIRWISE = 16
#: How many shingles a line has whose UTF-16 bytes are ``u``.
SHINGLES = f"cast(greatest(length(u) div 2 - {WIDTH - 1}, 1) AS INT)"
#: Text that one bucket of the line table holds, more or less.
BUCKET_BYTES = 64 << 20


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line) for lines that are not blank; line_no from 0."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(named(docs, text), "\n", -1)).alias("line_no", "line"))
    return cut.where(F.col("line").rlike("\\S"))


def line_key() -> list[F.Column]:
    """Two longs that stand for a line."""
    return [F.xxhash64("line").alias("key"), F.xxhash64(F.lit(1), "line").alias("key2")]


def place() -> F.Column:
    """Order of occurrences: null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "line_no")


class LineTable:
    """(key, key2, line, first, number): each different line once, bucketed by key.

    ``number`` is a short identifier that is unique within the table.
    """

    def __init__(self, docs: DataFrame, text: str):
        self.spark = docs.sparkSession
        shared_dir(self.spark)
        marked = occurrences(docs, text).select("*", *line_key())
        different = marked.groupBy(*KEY).agg(F.first("line").alias("line"), F.min(place()).alias("first"))
        numbered = different.withColumn("number", F.monotonically_increasing_id())
        held = docs.agg(F.sum(F.octet_length(named(docs, text)))).first()[0] or 0
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))
        self.name, self.path = f"lines_{uuid.uuid4().hex}", fresh_path(self.spark, "lines")
        numbered.write.option("compression", "zstd").option("path", self.path).bucketBy(buckets, *KEY).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)
        #: The same rows without their buckets, for joins whose sides Spark may split.
        self.loose = self.spark.read.schema(self.rows.schema).parquet(self.path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        remove(self.spark, self.path)


def signatures(lines: DataFrame, follow_all: bool) -> DataFrame:
    """(key, key2, number, n, varied, bands, samples) of each line; ``samples`` packs a byte of each value."""
    ranges, limit = 1 << LEAD, 1 << (64 - LEAD)
    lines = lines.select(*KEY, "number", F.encode("line", "UTF-16BE").alias("u")).withColumn("n", F.expr(SHINGLES))
    each = lines.withColumn("near", F.expr(f"{limit}L div greatest(n, {ENOUGH}) * {ENOUGH}")).withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
    rows = each.select(*KEY, "number", "n", "near", "i", F.expr(f"xxhash64(substring(u, 2 * i + 1, {2 * WIDTH}))").alias("h"))
    rows = rows.withColumn("lead", F.expr(f"cast(shiftrightunsigned(h, {64 - LEAD}) AS INT)"))
    if not follow_all:
        # what is nearest to no value's constant never is the smallest of a long line
        rows = rows.where(f"i = 0 OR n <= {ENOUGH} OR ((h & {limit - 1}L) < near AND lead < {VALUES})")
    # grouped by whole numbers alone, and of each row one minimum changes: a minimum of all values for each row costs half as much again
    least = rows.groupBy(*KEY, "number", "n").agg(*(F.expr(f"min(h) FILTER (WHERE lead = {j})").alias(f"m{j}") for j in range(ranges)))
    nearest = F.array(*(F.coalesce(*(f"m{i ^ d}" for d in range(ranges))) for i in range(VALUES)))
    # longs are signed: with the first bit turned they are in the order of their bits
    constant = lambda i: F.shiftleft(i.cast("long"), 64 - LEAD).bitwiseXOR(F.lit(-(1 << 63)))
    # array functions, so that Spark compiles this apart from the loop over the shingles
    values = least.select(*KEY, "number", "n", F.size(F.array_distinct(nearest)).alias("varied"), F.transform(nearest, lambda h, i: h.bitwiseXOR(constant(i))).alias("v"))
    bands = [F.xxhash64(F.lit(b), *(F.col("v")[b * ROWS + r] for r in range(ROWS))) for b in range(BANDS)]
    samples = [" | ".join(f"shiftleft(v[{b * ROWS + r}] & 255L, {8 * b})" for b in range(BANDS)) for r in range(ROWS)]
    return values.select(*KEY, "number", "n", "varied", F.array(*bands).alias("bands"), *(F.expr(s).alias(f"s{r}") for r, s in enumerate(samples)))


def alike(x, y) -> F.Column:
    """May lines of these profiles be similar?  Those of few shingles always may."""
    agree = sum((agreeing(x(f"s{r}"), y(f"s{r}")) for r in range(ROWS)), F.lit(0))
    return (F.least(x("n"), y("n")) < SAMPLED) | (agree >= LEAST)


def shingle_set(line: str) -> F.Column:
    each = f"transform(sequence(1, 2 * {SHINGLES} - 1, 2), i -> xxhash64(substring(u, i, {2 * WIDTH})))"
    return F.array_distinct(F.flatten(F.expr(f"transform(array(encode({line}, 'UTF-16BE')), u -> {each})")))


def similar(s: str, t: str, threshold: float) -> F.Column:
    """Do the sets of all shingles of two lines reach the threshold?"""
    # sets and their intersection are arguments of functions: a filter on columns would compute them anew for each use
    sets = F.array(F.struct(shingle_set(s).alias("x"), shingle_set(t).alias("y")))
    shared = F.transform(sets, lambda p: F.struct(F.size(F.array_intersect(p["x"], p["y"])).alias("both"), (F.size(p["x"]) + F.size(p["y"])).alias("all")))
    return F.exists(shared, lambda p: p["both"] >= threshold * (p["all"] - p["both"]))


class LineVerifier(Verifier):
    needs = KEY

    def __init__(self, lines: LineTable, spent: list[DataFrame], threshold: float, scratch: Scratch):
        self.lines, self.spent, self.threshold, self.scratch = lines, spent, threshold, scratch

    def begin(self, nodes: DataFrame) -> None:
        """The lines that share a bucket are fetched once; a node is a line's number.

        Nothing reads the tables of signatures, ``spent``, any more after this.
        """
        own = nodes.hint("shuffle_hash").join(self.lines.rows.select(*KEY, "line"), list(KEY))
        self.pool = self.scratch.keep(own.select("node", "line"), "line-pool")
        self.scratch.drop(*self.spent)

    def verify(self, pairs: DataFrame) -> DataFrame:
        one, two = (self.pool.select(F.col("node").alias(c), F.col("line").alias(t)) for c, t in (("a", "s"), ("b", "t")))
        return pairs.join(one, "a").join(two, "b").where(similar("s", "t", self.threshold)).select(pairs.columns)

    def tokens(self, nodes: DataFrame) -> DataFrame:
        own = self.pool.join(nodes, "node", "left_semi")
        return own.select("node", F.explode(shingle_set("line")).alias("token"), F.lit(1.0).alias("weight"))


def classes(docs: DataFrame, text: str, threshold: float, scratch: Scratch) -> DataFrame:
    """(doc_id, line_no, class_first) of each occurrence: the first occurrence of its class."""
    lines = LineTable(docs, text)
    try:
        first = scratch.keep(signatures(lines.rows, False), "line-signatures")
        plain = f"n <= {ENOUGH} OR varied >= {VARIED}"
        again = first.where(f"NOT ({plain})").select(*KEY)
        rest = scratch.keep(signatures(lines.rows.join(again.hint("shuffle_hash"), list(KEY), "left_semi"), True), "line-signatures")
        marks = first.where(plain).union(rest)
        members = marks.select(F.explode(F.array_distinct("bands")).alias("bucket"), F.col("number").alias("node"))
        profiles = marks.select(F.col("number").alias("node"), "n", *(f"s{r}" for r in range(ROWS)), *KEY)
        verifier = LineVerifier(lines, [first, rest], threshold, scratch)
        roots = linked(members, verifier, scratch, "lines", profiles, alike, PAIRWISE)
        scratch.drop(verifier.pool)
        # only lines of classes of several need another first occurrence than their own
        several = scratch.keep(lines.loose.select("number", *KEY, "first").join(roots.withColumnRenamed("node", "number"), "number"), "line-classes")
        least = scratch.keep(several.groupBy("root").agg(F.min("first").alias("least")), "line-firsts")
        named_by = scratch.keep(several.join(least, "root").select(*KEY, "least"), "line-names")
        scratch.drop(several, least)
        own = lines.loose.select(*KEY, "first").join(named_by, list(KEY), "left").select(*KEY, F.coalesce("least", "first").alias("class_first"))
        firsts = scratch.keep(own, "line-decisions")
        placed = occurrences(docs, text).select("doc_id", "line_no", *line_key())
        out = scratch.keep(placed.join(firsts, list(KEY)).drop(*KEY), "line-places")
    finally:
        lines.drop()
    scratch.drop_all_but(out)
    return out


def line_classes(docs: DataFrame, text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row for each line that is not blank: doc_id, line_no, class_doc_id, class_line_no, kept.

    The class is named by its first occurrence, the one that stays.
    """
    out = classes(docs, text, threshold, Scratch(docs.sparkSession))
    first = F.col("class_first")
    return out.select(
        "doc_id",
        "line_no",
        first["doc_id"].alias("class_doc_id"),
        first["line_no"].alias("class_line_no"),
        (F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("line_no") == first["line_no"])).alias("kept"),
    )


def deduplicate(docs: DataFrame, text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """All rows and columns, with the duplicate lines taken out of the text."""
    gone = line_classes(docs, text, threshold).where("NOT kept").select(F.col("doc_id").alias("gone_id"), "line_no")
    # line numbers of one document, each once: no more than its own lines
    per_doc = gone.groupBy("gone_id").agg(F.collect_set("line_no").alias("gone"))
    met = whole(docs, id=F.col("doc_id").cast("long"), own=named(docs, text)).join(per_doc, F.col("id").eqNullSafe(F.col("gone_id")), "left")
    kept = F.filter(F.split("own", "\n", -1), lambda line, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    shorter = F.when(F.col("gone").isNull(), F.col("own")).otherwise(F.array_join(kept, "\n"))
    return met.select(*(shorter.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
