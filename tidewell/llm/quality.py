"""Operator 13, quality classifier: naive Bayes support vectors over n-gram indicators.

A text's indicators are its byte n-grams of 1 to ``ORDERS`` bytes and the n-grams of its words' shapes
(how the word begins and ends, and whether it repeats the one before), hashed to ``BUCKETS`` numbers.
How many texts of each class hold an indicator is counted over all labelled rows outside the held-out
quarter; the logarithm of the ratio of both classes' smoothed shares scales the indicator.  On the
scaled, normalised indicators a linear hinge-loss model is fitted by dual coordinate descent, from
about ``SAMPLE`` labelled rows chosen by a hash, a bound that does not grow with the table; a part
of it that the model does not see turns margins into probabilities.

Defined results: a null text counts as the empty text, which has indicators of its own and so a score
like any other; texts of any length are taken whole; labels other than 0 and 1, and those of ids
that no document has, teach nothing; of several labels or rows of one id each counts; with no labels, or those of
one class, every score is the share of label 1, one half if there are none; a null ``doc_id`` is never
learned from and not held out; rows that repeat are scored each; an empty table gives an empty result;
other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, named
from .language import chosen_below, held_out

BUCKETS, ORDERS, SHAPES = 1 << 16, 4, 3
#: Labelled rows that the linear model is fitted on.
SAMPLE = 4000
#: Rows with fewer indicators are unpacked once, others at each visit, so that the sample needs little memory.
FEW = 8192
#: Added to all counts; cost of a violated margin; passes over the sample.
SMOOTH, COST, PASSES = 1.0, 1.0, 12
#: From this score on a text is predicted to be good.
GOOD = 0.7

PRIME, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)
SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)
#: Bytes that end a word.
BLANK = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
#: Kinds of bytes: blanks, other signs below 128 each for itself, digits, small and capital letters, all from 128 on.
KIND = np.array([1 if BLANK[b] else 2 if 48 <= b < 58 else 3 if 97 <= b < 123 else 4 if 65 <= b < 91 else 5 if b >= 128 else 6 + b for b in range(256)], np.uint32)
#: Bytes of a text whose words are looked at at once.
PART = 1 << 20


def grams(codes: np.ndarray, orders: int, seed: int, seen: np.ndarray) -> None:
    """Mark the hashed n-grams of a sequence."""
    gram = np.full(len(codes) + 1, seed, np.uint32)
    for order in range(1, orders + 1):
        gram = gram[:-1] * PRIME + codes[order - 1 :] + np.uint32(order)
        seen[(gram * SPREAD) >> SHIFT] = True


def shapes(raw: np.ndarray) -> np.ndarray:
    """A number for each word: the kinds of its first, second and last byte, and whether it repeats the one before."""
    apart = np.ones(len(raw) + 2, bool)
    apart[1:-1] = BLANK[raw]
    edges = np.flatnonzero(apart[1:] != apart[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint32)
    kind, length = KIND[raw], ends - starts
    # the sum of a word's bytes, each times its place in the word, tells words apart well enough
    plain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw, dtype=np.uint64)])
    placed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * np.arange(1, len(raw) + 1, dtype=np.uint64))])
    sums = (placed[ends] - placed[starts]) - (plain[ends] - plain[starts]) * starts.astype(np.uint64)
    again = np.zeros(len(starts), bool)
    again[1:] = (sums[1:] == sums[:-1]) & (length[1:] == length[:-1]) & (raw[starts[1:]] == raw[starts[:-1]])
    second = kind[np.minimum(starts + 1, ends - 1)]
    return ((kind[starts] * np.uint32(256) + second) * np.uint32(256) + kind[ends - 1]) * np.uint32(2) + again


def indicators(text: str | None) -> np.ndarray:
    """The numbers of a text's n-grams, in ascending order."""
    raw = np.frombuffer(f" {text or ''} ".encode("utf-8", "replace"), np.uint8)
    seen = np.zeros(BUCKETS, bool)
    # parts share the bytes that n-grams across their border need
    for at in range(0, len(raw), PART):
        part = raw[at : at + PART + 64]
        grams(part.astype(np.uint32), ORDERS, 1, seen)
        grams(shapes(part), SHAPES, 2, seen)
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray  # of each indicator: ratio times linear weight
    squares: np.ndarray  # of each indicator's ratio
    bias: float
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        own = indicators(text)
        margin = self.weights[own].sum() / max(np.sqrt(self.squares[own].sum()), 1e-12) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def constant(share: float) -> Model:
    """Gives all texts the same score."""
    nothing = np.zeros(BUCKETS)
    return Model(nothing, nothing, 0.0, 0.0, 500.0 if share >= 1 else -500.0 if share <= 0 else float(np.log(share / (1 - share))))


def ratios(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Logarithm of the ratio of the classes' smoothed shares of each indicator."""
    p, q = ones + SMOOTH, zeros + SMOOTH
    return np.log((p / p.sum()) / (q / q.sum()))


def descent(rows: list[bytes], y: np.ndarray, ratio: np.ndarray, cost: float, passes: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model: one dual variable at a time moves to its optimum within its box.

    ``rows`` are packed indicators; violated margins of both classes cost the same in all.
    """
    rng = np.random.default_rng(3)
    weights, bias, dual = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    share = np.where(y == 1, (y == 1).mean(), (y == 0).mean())
    most = cost / (2 * np.maximum(share, 1e-9))
    few = [own if len(own) < FEW else None for own in map(unpacked, rows)]
    for _ in range(passes):
        moves = 0.0
        for i in rng.permutation(len(rows)):
            own = unpacked(rows[i]) if few[i] is None else few[i]
            value = ratio[own]
            norm = max(np.sqrt(value @ value), 1e-12)
            sign = 2 * y[i] - 1
            slack = sign * (weights[own] @ value / norm + bias) - 1
            # a normalised row and the bias have a square of 2
            new = min(max(dual[i] - slack / 2, 0.0), most[i])
            step = new - dual[i]
            if step:
                weights[own] += step * sign / norm * value
                bias += step * sign
                dual[i] = new
                moves = max(moves, abs(step))
        if moves < 1e-3:
            break
    return weights, bias


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities, by Newton's method with smoothed targets."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    at = np.array([1.0, np.log((good + 1) / (bad + 1))])
    x = np.stack([margins, np.ones(len(margins))], axis=1)

    def loss(v):
        z = x @ v
        return (np.logaddexp(0, z) - target * z).sum()

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (p - target)
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(at[0], 0.0)), float(at[1])


def packed(own: np.ndarray) -> bytes:
    seen = np.zeros(BUCKETS, bool)
    seen[own] = True
    return np.packbits(seen).tobytes()


def unpacked(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))).astype(np.int32)


def fit(ones: np.ndarray, zeros: np.ndarray, rows: list[bytes], y: np.ndarray) -> Model:
    """Four fifths of the rows fit the linear model, the rest its scale."""
    ratio = ratios(ones, zeros)
    order = np.random.default_rng(5).permutation(len(rows))
    # each class gives a fifth of its rows
    held = np.concatenate([order[y[order] == c][::5] for c in (0, 1)])
    train = np.setdiff1d(order, held)
    weights, bias = descent([rows[i] for i in train], y[train], ratio, COST, PASSES)
    margins = np.zeros(len(held))
    for at, i in enumerate(held):
        value = ratio[own := unpacked(rows[i])]
        margins[at] = weights[own] @ value / max(np.sqrt(value @ value), 1e-12) + bias
    slope, shift = calibrated(margins, y[held])
    return Model(weights * ratio, ratio * ratio, bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (doc_id, quality) of the documents outside the held-out quarter."""
    scratch = Scratch(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    total = known.count()
    if not total:
        return constant(0.5)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(named(docs, text), F.lit("")).alias("text"))
    # the same plan at every size: neither side is bounded
    met = own.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(known.hint("merge"), "doc_id")
    order = F.xxhash64(F.lit(13), "doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1))
    chosen = (order < F.lit(chosen_below(sample, total))) if total > sample else F.lit(True)
    learned = scratch.keep(met.select("quality", "text", chosen.alias("chosen")).mapInArrow(counted, COUNTS), "quality-counts")
    # one row for each indicator
    sums = learned.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("ones"), F.sum("zeros")).collect()
    ones, zeros = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for bucket, one, zero in sums:
        ones[bucket], zeros[bucket] = one, zero
    rows = learned.where("bits IS NOT NULL").limit(2 * sample).select("bits", F.col("ones").cast("int").alias("y")).collect()
    scratch.drop(learned)
    texts = ones[BUCKETS] + zeros[BUCKETS]
    if not min(ones[BUCKETS], zeros[BUCKETS]):
        return constant(ones[BUCKETS] / texts if texts else 0.5)
    # the same order whatever the partitions
    rows = sorted((r.y, bytes(r.bits)) for r in rows)
    if len({y for y, _ in rows}) < 2:  # rows that repeat one another have one hash
        parts = [(met.where(F.col("quality") == y).limit(sample // 2).select("text"), y) for y in (0, 1)]
        rows = sorted((y, packed(indicators(r.text))) for df, y in parts for r in df.collect())
    return fit(ones[:BUCKETS], zeros[:BUCKETS], [bits for _, bits in rows], np.array([y for y, _ in rows]))


COUNTS = "bucket int, ones long, zeros long, bits binary"


def counted(batches):
    """How many texts of each class hold each indicator, one row an indicator, and the chosen texts' own indicators.

    The number after the last bucket counts the texts.
    """
    import pyarrow as pa

    counts = np.zeros((2, BUCKETS + 1), np.int64)
    schema = pa.schema([("bucket", pa.int32()), ("ones", pa.int64()), ("zeros", pa.int64()), ("bits", pa.binary())])
    for batch in batches:
        taken, classes = [], []
        for quality, text, chosen in zip(*(batch.column(c) for c in ("quality", "text", "chosen"))):
            own, y = indicators(text.as_py()), quality.as_py()
            counts[y, own] += 1
            counts[y, BUCKETS] += 1
            if chosen.as_py():
                taken.append(packed(own))
                classes.append(y)
        if taken:
            none = pa.nulls(len(taken))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), pa.array(classes, pa.int64()), none.cast(pa.int64()), pa.array(taken, pa.binary())], schema=schema)
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[1, some]), pa.array(counts[0, some]), pa.nulls(len(some), pa.binary())], schema=schema)


def scored(docs: DataFrame, model: Model, text: str = "text", good: float = GOOD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = np.array([held.value.score(t.as_py()) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= good).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), named(docs, text).alias("text"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
