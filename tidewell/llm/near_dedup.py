"""Operator 9, near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles of five words (lower case, without ASCII punctuation);
a weight is the shingle's count times the mean inverse document frequency of its words, counted over
all documents.  Each of ``BANDS`` x ``ROWS`` consistent weighted samples picks one shingle and level
with a chance that follows the weight, so two documents agree on a sample with the probability of
their weighted Jaccard similarity; bands of samples are the buckets, and every candidate pair is
verified by the exact weighted Jaccard similarity of the whole texts.  Components of the links are
the classes.

Words in fewer than ``COMMON`` of the documents have the same, largest frequency weight; the table of
all others is small whatever the corpus, at most the mean number of different words of a document
over ``COMMON``, and is sent to the executors.

Defined results: texts of fewer than five words are one shingle; a text without words, a null text
included, is in a class of its own text; texts of any length are taken whole; of shingles that tie in a
sample the first by hash is picked, in all texts alike; of rows that repeat a ``doc_id`` and a text one
stays, of a class the one with the smallest ``doc_id``, then text key; a null ``doc_id`` comes after all
others; an empty table gives an empty result; other columns, of whatever name, are carried through by
``deduplicate``.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_rows, named, repeat_rows, text_key
from .linking import Verifier, agreeing, linked

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
#: Candidates may agree on so many standard deviations fewer samples than a pair at the threshold.
SLACK = 6
#: Share of the documents from which on a word's frequency is told apart, and entries that its table may have.
COMMON, TABLE = 0.001, 400_000
#: Shingles share the random numbers of the sampling by their hash modulo this.
SLOTS = 1 << 15
#: Bytes of a text whose words are hashed at once.
PART = 1 << 20
#: Shingles sampled at once.
BLOCK = 256
#: Columns with eight samples each.
SAMPLES = [f"s{i}" for i in range(BANDS * ROWS // 8)]

#: ASCII signs end a word.
LOWER = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
#: Odd multipliers and a number for each byte, drawn once; a space counts nothing.
MIX = np.random.default_rng(5).integers(1 << 62, 1 << 63, WORDS + ROWS + 4, dtype=np.uint64) | np.uint64(1)
BYTES = np.random.default_rng(6).integers(0, 1 << 63, 256, dtype=np.uint64)
BYTES[32] = 0
BASE = 0x9E3779B97F4A7C15


def stirred(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * MIX[-1]
    return x ^ (x >> np.uint64(29))


@functools.cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of ``BASE`` and of its inverse, modulo 2 ** 64."""
    each = np.arange(size) > 0
    return tuple(np.cumprod(np.where(each, np.uint64(x), np.uint64(1))) for x in (BASE, pow(BASE, -1, 1 << 64)))


def hashed_words(raw: bytes) -> np.ndarray:
    """A hash of each word of these bytes: the polynomial of its bytes' numbers."""
    size = len(raw)
    held = 1 << max(12, size.bit_length())
    codes = np.frombuffer(raw, np.uint8)
    apart = np.ones(size + 2, bool)
    np.equal(codes, 32, out=apart[1:-1])
    edges = np.flatnonzero(apart[1:] != apart[:-1])
    up, down = powers(held)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(BYTES[codes] * up[:size], out=sums[1:])
    starts = edges[::2]
    return stirred((sums[edges[1::2]] - sums[starts]) * down[starts])


def words_of(text: str | None) -> np.ndarray:
    """Hashes of a text's words, in order; long texts are taken in parts that end with a word."""
    raw = (text or "").lower().encode("utf-8", "replace").translate(LOWER)
    if len(raw) <= PART:
        return hashed_words(raw)
    out, at = [], 0
    while at < len(raw):
        end = raw.find(b" ", at + PART)
        end = len(raw) if end < 0 else end
        out.append(hashed_words(raw[at:end]))
        at = end
    return np.concatenate(out)


class Idf:
    """The frequency weight of words by their hashes: a table of the common ones, one weight for all others."""

    def __init__(self, known: np.ndarray, value: np.ndarray, rare: float):
        size = 1 << max(4, (8 * len(known)).bit_length())
        self.mask, self.rare = np.uint64(size - 1), rare
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size)
        taken, left, slot = np.zeros(size, bool), np.arange(len(known)), known & self.mask
        while len(left):  # each round the first word at a free slot gets it, the others go on to the next slot
            free = left[~taken[slot[left]]]
            _, first = np.unique(slot[free], return_index=True)
            now = free[first]
            at = slot[now].astype(np.int64)
            taken[at], self.keys[at], self.values[at] = True, known[now], value[now]
            left = np.setdiff1d(left, now, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def of(self, words: np.ndarray) -> np.ndarray:
        out, left, slot = np.full(len(words), self.rare), np.arange(len(words)), words & self.mask
        while len(left):
            key, own = self.keys[slot], words[left]
            hit = key == own
            out[left[hit]] = self.values[slot[hit]]
            further = ~hit & (key != 0)
            left, slot = left[further], (slot[further] + np.uint64(1)) & self.mask
        return out


def frequencies(docs: DataFrame) -> DataFrame:
    """(word, n): in how many documents each word, by its hash, occurs."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            each = [np.unique(words_of(text)) for text in frame["text"]]
            words, n = np.unique(np.concatenate(each), return_counts=True)
            yield pd.DataFrame({"word": words.view(np.int64), "n": n})

    return docs.select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def weights_table(docs: DataFrame, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes and weights of the common words, and the weight of all others."""
    scratch = scratch or Scratch(docs.sparkSession)
    total = docs.count()
    counted = scratch.keep(frequencies(docs), "frequencies")
    mean = (counted.agg(F.sum("n")).first()[0] or 0) / max(total, 1)
    share = max(COMMON, mean / TABLE)
    least = share * total
    # at most TABLE rows: their counts alone add up to total * mean
    rows = counted.where(F.col("n") >= max(2.0, least)).toArrow()
    scratch.drop(counted)
    known, n = (rows.column(c).to_numpy() for c in ("word", "n"))
    known, value = known.view(np.uint64), 1 + np.log((1 + total) / (1 + n.astype(np.float64)))
    order = np.argsort(known)
    return known[order], value[order], float(1 + np.log((1 + total) / (1 + max(1.0, least))))


def shingles(idf: Idf, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, each once and in order, and weights of a text's shingles."""
    words = words_of(text)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0)
    width, each = min(WORDS, len(words)), idf.of(words)
    count = len(words) - width + 1
    mixed, weight = words[:count] * MIX[0], each[:count].copy()
    for i in range(1, width):
        mixed += words[i : i + count] * MIX[i]
        weight += each[i : i + count]
    mixed = stirred(mixed)
    order = np.argsort(mixed)
    mixed, weight = mixed[order], weight[order] / width
    fresh = np.append(True, mixed[1:] != mixed[:-1])
    if fresh.all():
        return mixed, weight
    first = np.flatnonzero(fresh)
    return mixed[first], weight[first] * np.diff(np.append(first, count))


@functools.cache
def randoms() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each slot and sample: r, 1 / r, ln c + r (beta - 1) and beta."""
    rng, shape = np.random.default_rng(9), (SLOTS, BANDS * ROWS)
    r, c, beta = rng.gamma(2, 1, shape) + 1e-6, rng.gamma(2, 1, shape) + 1e-12, rng.random(shape)
    return tuple(x.astype(np.float32) for x in (r, 1 / r, np.log(c) + r * (beta - 1), beta))


@functools.cache
def buffers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.empty((BLOCK, BANDS * ROWS), np.float32) for _ in range(3))


def bands(hashes: np.ndarray, weights: np.ndarray) -> tuple[list[int], list[int]]:
    """The bucket of each band, and a byte of each sample, eight to a number."""
    r, inverse, base, beta = randoms()
    samples = BANDS * ROWS
    best, picked, level = np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint64), np.zeros(samples, np.int64)
    log_w, slot = np.log(weights).astype(np.float32)[:, None], (hashes % np.uint64(SLOTS)).astype(np.int64)
    for at in range(0, len(hashes), BLOCK):
        s = slot[at : at + BLOCK]
        t, drop, log_a = (b[: len(s)] for b in buffers())
        # t = floor(ln w / r + beta) is the level, and ln a = ln c - r (t - beta + 1)
        inverse.take(s, 0, t, "clip")
        t *= log_w[at : at + BLOCK]
        t += beta.take(s, 0, drop, "clip")
        np.floor(t, out=t)
        np.multiply(r.take(s, 0, drop, "clip"), t, out=drop)
        np.subtract(base.take(s, 0, log_a, "clip"), drop, out=log_a)
        value = log_a.min(axis=0)
        won = np.flatnonzero(value < best)
        if len(won):
            least = log_a[:, won].argmin(axis=0)
            best[won], picked[won], level[won] = value[won], hashes[at : at + BLOCK][least], t[least, won].astype(np.int64)
    one = stirred(picked + level.view(np.uint64) * MIX[-2])
    values = stirred((one.reshape(BANDS, ROWS) * MIX[WORDS : WORDS + ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return values.view(np.int64).tolist(), (one >> np.uint64(56)).astype(np.uint8).view(np.int64).tolist()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the smaller weights over the sum of the larger."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - shared
    return float(shared / whole) if whole else 0.0


def signatures(texts: DataFrame, table) -> DataFrame:
    """(node, bands, s0, s1, …) of each text that has words."""

    def run(frames):
        import pandas as pd

        idf = Idf(*table.value)
        for frame in frames:
            out = []
            for node, text in zip(frame["node"], frame["text"], strict=True):
                hashes, weights = shingles(idf, text)
                if len(hashes):
                    values, samples = bands(hashes, weights)
                    out.append((bytes(node), values, *samples))
            yield pd.DataFrame(out, columns=["node", "bands", *SAMPLES])

    return texts.select("node", "text").mapInPandas(run, "node binary, bands array<long>, " + ", ".join(f"{s} long" for s in SAMPLES))


def may_reach(threshold: float):
    """Do two texts agree on so many samples that they may reach the threshold?

    Pairs at the threshold agree on that share of the samples; ``SLACK`` standard deviations less are enough.
    """
    samples = BANDS * ROWS
    least = threshold * samples - SLACK * (samples * threshold * (1 - threshold)) ** 0.5
    return lambda x, y: sum((agreeing(x(s), y(s)) for s in SAMPLES), F.lit(0)) >= least


class TextVerifier(Verifier):
    def __init__(self, texts: DataFrame, table, threshold: float, scratch: Scratch):
        self.texts, self.table, self.threshold, self.scratch = texts, table, threshold, scratch

    def begin(self, nodes: DataFrame) -> None:
        """The texts that share a bucket are fetched once."""
        self.pool = self.scratch.keep(self.texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "texts")

    def verify(self, pairs: DataFrame) -> DataFrame:
        table, threshold = self.table, self.threshold

        def run(frames):
            idf, recent = Idf(*table.value), {}

            def of(node: bytes, text: str):
                if node not in recent:
                    if len(recent) > 32:
                        recent.clear()
                    recent[node] = shingles(idf, text)
                return recent[node]

            for frame in frames:
                rows = zip(frame["a"], frame["b"], frame["s"], frame["t"], strict=True)
                keep = [similarity(of(bytes(a), s), of(bytes(b), t)) >= threshold for a, b, s, t in rows]
                yield frame.loc[np.array(keep, bool)].drop(columns=["s", "t"])

        one, two = (self.pool.select(F.col("node").alias(c), F.col("text").alias(t)) for c, t in (("a", "s"), ("b", "t")))
        return pairs.join(two, "b").join(one, "a").select(*pairs.columns, "s", "t").mapInPandas(run, pairs.schema)

    def tokens(self, nodes: DataFrame) -> DataFrame:
        table = self.table

        def run(frames):
            import pandas as pd

            idf = Idf(*table.value)
            for frame in frames:
                for node, text in zip(frame["node"], frame["text"], strict=True):
                    hashes, weights = shingles(idf, text)
                    yield pd.DataFrame({"node": [bytes(node)] * len(hashes), "token": hashes.view(np.int64), "weight": weights})

        return self.pool.join(nodes, "node", "left_semi").select("node", "text").mapInPandas(run, "node binary, token long, weight double")


def classes(docs: DataFrame, text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, times, class_id, class_size, stays): one row for each id and text.

    Nodes are the different texts; a class holds all documents of its linked texts.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), named(docs, text).cast("string").alias("text"))
    texts = rows.select(text_key(F.col("text")).alias("node"), "text")
    table = docs.sparkSession.sparkContext.broadcast(weights_table(rows, scratch))
    marked = scratch.keep(signatures(texts, table).dropDuplicates(["node"]), "signatures")
    members = marked.select(F.explode(F.array_distinct("bands")).alias("bucket"), "node")
    roots = linked(members, TextVerifier(texts, table, threshold, scratch), scratch, "texts", marked.drop("bands"), may_reach(threshold))
    table.destroy()
    each = rows.groupBy("doc_id", text_key(F.col("text")).alias("node")).agg(F.count(F.lit(1)).alias("times"))
    rows = scratch.keep(each.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rows")
    scratch.drop_all_but(rows)
    # null ids come last; of equal ids the smaller text key
    order = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("node"))
    firsts = scratch.keep(rows.groupBy("root").agg(F.min(order).alias("first"), F.sum("times").alias("class_size")), "classes")
    out = rows.join(firsts, "root")
    return out.select(
        "doc_id",
        "node",
        "times",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))).alias("stays"),
    )


def near_duplicates(docs: DataFrame, text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, class_size, kept."""
    each = repeat_rows(classes(docs, text, threshold), "times", "nth")
    return each.select("doc_id", "class_id", "class_size", (F.col("stays") & (F.col("nth") == 1)).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The row of each class that stays, with all its columns."""
    stays = classes(docs, text, threshold).where("stays").select("doc_id", F.col("node").alias("key"), "times")
    return keep_rows(docs, stays, text_key(named(docs, text).cast("string")))
