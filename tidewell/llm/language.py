"""Operator 6, language identification with averaged hashed subword embeddings.

A text, in lower case and with everything but letters turned into word ends, is the average of the
embeddings of its byte n-grams, hashed to a fixed number of buckets; a linear softmax on top names
the language.  Embeddings and softmax are trained together by stochastic gradient descent in numpy
on a sample of labelled documents whose size is the parameter ``sample``; a part of it that training
does not see sets the temperature of the scores and the threshold below which a text is rejected.
The sample, which does not grow with the table, is learned from in one task; the driver gets the model.

Defined results: a null text, or one without letters, gets ``und`` and the score 0 and is rejected;
without any labelled rows all get ``und`` and only texts without letters are rejected; of languages
that score the same the first by name is given; rows that repeat are named each; texts of any length
are taken whole; a null ``doc_id`` is never learned from and not held out; an empty table gives an
empty result; other columns, of whatever name, are ignored here and carried through by ``keep_known``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, whole

BUCKETS = 4096
ORDERS = (2, 3, 4)
#: Documents that the classifier may learn from, a bound that does not grow with the table.
SAMPLE = 2000
DIMENSIONS = 16
EPOCHS = 12
RATE = 8.0
BATCH = 32
#: Largest share of rightly named calibration texts that a threshold may reject, and its largest value.
REJECT_SHARE = 0.001
REJECT_BELOW = 0.4
UNKNOWN = "und"

LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
PRIME = np.uint32(0x01000193)
SPREAD = np.uint32(0x9E3779B1)


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often the n-grams of a text fall into each bucket, as shares."""
    words = b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split())
    raw = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
    total = np.zeros(BUCKETS, np.float32)
    gram = raw
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for order in range(2, max(ORDERS) + 1):
        gram = gram[:-1] * PRIME + raw[order - 1 :] + np.uint32(order)
        if order in ORDERS and len(gram):
            total += np.bincount((gram * SPREAD) >> shift, minlength=BUCKETS)
    size = total.sum()
    return total / size if size else total


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages: embeddings times softmax weights, over the temperature
    bias: np.ndarray
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        if not text or not has_letters(text):
            return UNKNOWN, 0.0, True
        if not self.languages:
            return UNKNOWN, 0.0, False
        z = counts(text) @ self.weights + self.bias
        p = np.exp(z - z.max())
        best = int(p.argmax())
        score = float(p[best] / p.sum())
        return self.languages[best], score, score < self.threshold


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Train on four fifths of the rows and calibrate on the rest."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0)
    rng = np.random.default_rng(7)
    y = np.array([languages.index(v) for v in labels])
    order = rng.permutation(len(y))
    held = order[: len(y) // 5]
    train = order[len(held) :]
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    top = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    scale = np.float32(np.sqrt(BUCKETS))  # averages of many n-grams are small
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            xb = x[rows] * scale
            hidden = xb @ embed
            error = softmax(hidden @ top + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            back = error @ top.T
            top -= rate / 10 * (hidden.T @ error)
            bias -= rate / 10 * error.sum(axis=0)
            embed -= rate / 10 * (xb.T @ back)
    weights = (embed @ top * scale).astype(np.float64)
    threshold, temperature = 0.0, 1.0
    if len(held):
        z = x[held] @ weights + bias
        loss = {t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.5, 8, 25)}
        temperature = float(min(loss, key=loss.get))
        p = softmax(z / temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[held]])
        if len(right):
            threshold = float(min(right[int(REJECT_SHARE * len(right))], REJECT_BELOW))
    return Model(languages, weights / temperature, bias / temperature, threshold)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chosen_below(sample: int, total: int) -> int:
    """Hashes of 63 bits below this are the share ``sample / total`` of them; it is exact to 2 ** -63."""
    return min((1 << 63) - 1, (sample << 63) // total)


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` labelled documents outside the held-out quarter, chosen by a hash of the id."""
    labelled = docs.select(
        F.col("doc_id").alias("doc_id"), named(docs, text).alias("text"), F.col("lang").cast("string").alias("lang")
    ).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    total = labelled.select("doc_id", "lang").count()
    if not total:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    order = F.xxhash64(F.lit(11), "doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1))
    chosen = labelled.where(order < F.lit(chosen_below(sample, total))).limit(2 * sample)
    if total > sample and chosen.isEmpty():
        chosen = labelled.limit(sample)  # rows that all repeat one another have one hash

    def run(frames):
        import pandas as pd

        # at most twice the sample, of a fixed size each
        rows = [(lang, counts(t)) for frame in frames for lang, t in zip(frame["lang"], frame["text"], strict=True)]
        rows.sort(key=lambda row: (row[0], zlib.crc32(row[1])))
        model = fit(np.array([x for _, x in rows], np.float32).reshape(len(rows), BUCKETS), [lang for lang, _ in rows])
        yield pd.DataFrame({"languages": [model.languages], "weights": [model.weights.astype(np.float64).tobytes()], "bias": [model.bias.astype(np.float64).tobytes()], "threshold": [model.threshold]})

    # one task learns, as the sample is bounded; the driver gets the model alone
    found = chosen.select("lang", "text").coalesce(1).mapInPandas(run, "languages array<string>, weights binary, bias binary, threshold double").first()
    languages = list(found.languages)
    weights = np.frombuffer(bytes(found.weights), np.float64).reshape(BUCKETS, len(languages))
    return Model(languages, weights, np.frombuffer(bytes(found.bias), np.float64), found.threshold)


def predictor(model: Model):
    """A pandas UDF: struct of lang_pred, score and rejected for each text."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts):
        import pandas as pd

        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), predictor(model)(named(docs, text)).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language is not rejected, with all their columns."""
    return whole(docs, p=predictor(model)(named(docs, text))).where("NOT p.rejected").select("row.*")
