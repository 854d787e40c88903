"""Operator 10, packing: harmonic classes of piece lengths, filled independently by each worker.

A class holds pieces of at most capacity / k tokens, and each of its sequences takes k of them.
Documents are cut so that most pieces fit a class without a gap: whole sequences first, then halves,
quarters and eighths; what is left, shorter than an eighth, goes to the class 1 / k above its length.
A partition packs what it reads and shuffles nothing; it holds only the open sequence of each class,
and at its end packs the pieces of those, a bounded number, by first fit.

Defined results: a null or empty text has the end id alone; texts of any length are taken whole; rows
that repeat are packed each; pieces of one class go in the order of their rows; a null ``doc_id`` stays
null; an empty table gives an empty result; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 1
#: Pieces of a document are whole sequences and these parts of one, in turn, and a rest.
PARTS = (1, 2, 4, 8)
#: Rests of less than 1 / FINE of a sequence share the classes 1 / (FINE * 2 ** i).
FINE = 32

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def per_sequence(length: int, capacity: int = CAPACITY) -> int:
    """How many pieces of this length's class a sequence takes."""
    k = capacity // length
    if k < FINE:
        return k
    fine = FINE
    while fine * 2 <= k:
        fine *= 2
    return fine


def cuts(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    for part in PARTS[1:]:
        if capacity % part == 0 and rest >= capacity // part:
            out.append(capacity // part)
            rest -= capacity // part
    return [*out, rest] if rest else out


class Packer:
    """The open sequences of one worker."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.open = capacity, worker << 36, {}

    def close(self, pieces: list[tuple]) -> list[tuple]:
        number, offset, rows = self.next, 0, []
        self.next += 1
        for piece in pieces:
            rows.append((*piece, number, offset))
            offset += piece[2]
        return rows

    def add(self, doc_id, ids: bytes) -> list[tuple]:
        """The rows of the sequences that this document's pieces fill."""
        tokens, start, rows = len(ids) // 4, 0, []
        for length in cuts(tokens, self.capacity):
            piece = (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), tokens)
            start += length
            k = per_sequence(length, self.capacity)
            pieces = self.open.setdefault(k, [])
            pieces.append(piece)
            if len(pieces) == k:
                rows += self.close(self.open.pop(k))
        return rows

    def finish(self) -> list[tuple]:
        """First fit, longest first, over the pieces of the open sequences."""
        left = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[2])
        bins: list[tuple[int, list]] = []
        for piece in left:
            for i, (free, pieces) in enumerate(bins):
                if piece[2] <= free:
                    bins[i] = (free - piece[2], [*pieces, piece])
                    break
            else:
                bins.append((self.capacity - piece[2], [piece]))
        self.open = {}
        return [row for _, pieces in bins for row in self.close(pieces)]


ENCODERS: dict[str, object] = {}


class Encoder:
    """The tokenizers library for a vocabulary file, helped by the faster tiktoken on the same ranks."""

    def __init__(self, path: str, ranks: str | None):
        import base64
        import json

        self.path, self.fast, self.loaded = path, None, None
        if ranks:
            import tiktoken

            from .bpe import PATTERN

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            with open(path, encoding="utf-8") as file:
                added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
            self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens=added)

    @property
    def slow(self):
        """The tokenizers library, loaded only where it is needed."""
        if self.loaded is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
            self.loaded.no_truncation()
            self.loaded.no_padding()
        return self.loaded

    def packed(self, text: str, end: int) -> bytes:
        import numpy as np

        if self.fast is not None and len(text) < 1 << 20:
            ids = self.fast.encode_to_numpy(text, allowed_special="all")
        else:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        return np.append(np.asarray(ids, "<u4"), np.uint32(end)).astype("<u4").tobytes()


def encoder(path: str, ranks: str | None) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path, ranks)
    return ENCODERS[path]


def pack(docs: DataFrame, path: str, ranks: str | None = None, text: str = "text", capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """One row for each piece of a document.

    ``path``: the vocabulary for the tokenizers library; ``ranks``: the same vocabulary as ranks.
    """

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        own, packer = encoder(path, ranks), Packer(TaskContext.get().partitionId(), capacity)

        def out(rows):
            return pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64"} | dict.fromkeys(COLUMNS[1:], "int64"))

        for frame in frames:
            rows = []
            for doc, t in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True):
                rows += packer.add(doc, own.packed(t or "", end))
            yield out(rows)
        yield out(packer.finish())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, SCHEMA)
