"""Operator 4, BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can end its encoding.  An automaton over the
vocabulary yields, for each position, the tokens that are suffixes of the prefix there; the one
whose predecessor (the last token of the prefix before it) is compatible with it is stored, and
following these back-pointers from the end gives the ids.  Two tokens are compatible when merging
their bytes by the rules gives back just these two.

Texts are cut at spaces first where that is a boundary for the pattern of the pre-tokenizer too,
and the ids of such pieces are remembered in a cache of bounded size, as words repeat.

Defined results: a null text counts as empty and has no ids; texts of any length are taken whole; rows
that repeat are encoded each; an empty table gives an empty result; other columns, of whatever name, are
ignored.  The vocabulary file is read by its path on every executor.
"""

from __future__ import annotations

import hashlib
import json
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers, in each of two generations.
CACHE_PIECES = 300_000
CACHE_PAIRS = 1_000_000
#: Longer pieces are encoded but not remembered.
CACHE_LENGTH = 64
ENDLESS = 1 << 60
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file, and its byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Irregular(Exception):
    """A space that is no boundary for sure."""


class Pieces(dict):
    """Text after a space -> packed ids; in two generations, so that it stays small."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead, self.old = encode, lead, {}

    def __missing__(self, piece: str) -> bytes:
        if self.lead and (not piece or piece[0].isspace()):
            raise Irregular
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(self.lead + piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.born = dict.fromkeys(vocab.values(), -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            one, two, both = vocab[a], vocab[b], vocab[a + b]
            self.merge[one << 20 | two] = rank
            self.left[both], self.right[both], self.born[both] = one, two, rank
        self.automaton = ahocorasick.Automaton()
        for i, token in self.bytes.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes |= {i: text.encode() for text, i in self.special.items()}
        self.pattern = regex.compile(PATTERN)
        self.pairs: dict[int, bool] = {}
        self.exact = Pieces(self.encode_pretoken, "")
        self.spaced = Pieces(self.encode_piece, " ")

    def compatible(self, a: int, b: int) -> bool:
        """Undo the later merge of the two sides, again and again: nothing may join them before it."""
        born, merge, limit = self.born, self.merge, ENDLESS
        while True:
            if merge.get(a << 20 | b, ENDLESS) < limit:
                return False
            if born[a] < 0 and born[b] < 0:
                return True
            if born[a] > born[b]:
                limit, a = born[a], self.right[a]
            else:  # of equal merges the left one comes first
                limit, b = born[b] + 1, self.left[b]

    def encode_pretoken(self, word: str) -> bytes:
        raw = word.encode()
        last = [-1] * (len(raw) + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (token, length) in self.automaton.iter(raw.decode("latin-1")):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - length
            if start:
                before = last[start]
                fits = pairs.get(before << 20 | token)
                if fits is None:
                    fits = pairs[before << 20 | token] = compatible(before, token)
                if not fits:
                    continue
            last[end + 1] = token
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        ids, at, sizes = [], len(raw), self.bytes
        while at:
            token = last[at]
            ids.append(token)
            at -= len(sizes[token])
        ids.reverse()
        return array("I", ids).tobytes()

    def encode_piece(self, text: str) -> bytes:
        exact = self.exact
        return b"".join([exact[t] if len(t) <= CACHE_LENGTH else self.encode_pretoken(t) for t in self.pattern.findall(text)])

    def encode_plain(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        try:
            ids = b"".join(map(self.spaced.__getitem__, rest))
        except Irregular:
            return self.encode_piece(text)
        return self.encode_piece(head) + ids

    def encode(self, text: str) -> bytes:
        """The ids, each in four bytes, little end first."""
        if self.splitter is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        parts = self.splitter.split(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self.encode_plain(p) for p in parts if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, array("I", ids))).decode("utf-8", "replace")


CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process and vocabulary."""
    if path not in CODECS:
        CODECS[path] = Codec(path)
    return CODECS[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as packed unsigned 32-bit integers."""

    def run(frames):
        import pandas as pd

        own = codec(path)
        for frame in frames:
            ids = [own.encode(t or "") for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_tokens": [len(i) // 4 for i in ids], "ids": ids})

    return selected(docs, text).mapInPandas(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(frames):
        import pandas as pd

        own = codec(path)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text": [own.decode(bytes(i)) for i in frame["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(frames):
        import pandas as pd

        own, sha = codec(path), hashlib.sha256
        for frame in frames:
            rows = []
            for doc, t in zip(frame["doc_id"], frame["text"], strict=True):
                ids = own.encode(t or "")
                rows.append((doc, len(ids) // 4, sha(ids).hexdigest(), sha(own.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            yield out.astype({"doc_id": "Int64", "n_tokens": "int64"})

    return selected(docs, text).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def selected(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
