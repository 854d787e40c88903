"""Operator 5, exact dedup: Patricia tries own the texts of a length-and-content-hash partition.

Texts are equal when they are identical after each run of ASCII white space became one space.
Every input partition first fills a local trie, which collapses its own copies; what is left is
dealt out by (length, SHA-256) and inserted, as full byte strings, into the trie of its owner
partition.  A terminal node stores the smallest ``doc_id`` and the number of copies.  A trie that
holds more bytes than its limit moves its largest subtree to a temporary file, and works such files
off one by one at the end, each in a trie of its own below the prefix that its strings share.

Defined results: a null text counts as empty; a null ``doc_id`` comes after all others; of rows that
repeat a ``doc_id`` and a text one stays; an empty table gives an empty result.  Other columns, of
whatever name, are ignored here and carried through by ``deduplicate``.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_rows, named, repeat_rows

#: Bytes of edges that a trie holds before it spills or, before the shuffle, is emptied.
TRIE_BYTES = 48 << 20
WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
NODE_BYTES = 250  # of Python objects for a node, roughly

Entry = tuple[bytes, "int | None", int]


def smaller(a: int | None, b: int | None) -> int | None:
    if a is None or b is None:
        return b if a is None else a
    return a if a < b else b


def common_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Node:
    __slots__ = ("label", "children", "smallest", "count")

    def __init__(self, label: bytes, smallest: int | None = None, count: int = 0):
        self.label, self.children, self.smallest, self.count = label, None, smallest, count


class Spilled:
    """A subtree on disk: its entries in the order of arrival, and the prefix that all share."""

    def __init__(self):
        self.file, self.prefix = tempfile.TemporaryFile(), None

    def add(self, entries: Iterable[Entry]) -> None:
        self.file.seek(0, os.SEEK_END)
        for entry in entries:
            self.prefix = entry[0] if self.prefix is None else self.prefix[: common_length(self.prefix, entry[0])]
            pickle.dump(entry, self.file)

    def entries(self) -> Iterator[Entry]:
        self.file.seek(0)
        while True:
            try:
                yield pickle.load(self.file)
            except EOFError:
                return


class PatriciaTrie:
    """Byte strings with the smallest identifier and the count of each, in bounded memory."""

    def __init__(self, limit: int = TRIE_BYTES):
        self.limit, self.held = limit, 0
        self.root = Node(b"")
        self.sizes: dict[int, int] = {}
        self.spilled: dict[int, Spilled] = {}

    def insert(self, text: bytes, doc_id: int | None, count: int) -> None:
        node, at, end, before = self.root, 0, len(text), self.held
        while at < end:
            if node.children is None:
                node.children = {}
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.held += end - at + NODE_BYTES
                node, at = child, end
            elif text.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                cut = common_length(child.label, text[at : at + len(child.label)])
                upper = Node(child.label[:cut])
                child.label = child.label[cut:]
                upper.children = {child.label[0]: child}
                node.children[text[at]] = upper
                self.held += NODE_BYTES
                node, at = upper, at + cut
        node.smallest = smaller(node.smallest, doc_id) if node.count else doc_id
        node.count += count
        if text:
            self.sizes[text[0]] = self.sizes.get(text[0], 0) + self.held - before
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        first = max(self.sizes, key=self.sizes.get)
        self.held -= self.sizes.pop(first)
        self.spilled.setdefault(first, Spilled()).add(walk(self.root.children.pop(first), b""))

    def drain(self) -> Iterator[Entry]:
        """All entries, each string once; empties the trie."""
        root, spilled = self.root, self.spilled
        for first, part in spilled.items():
            if root.children and first in root.children:
                part.add(walk(root.children.pop(first), b""))
        self.root, self.spilled, self.sizes, self.held = Node(b""), {}, {}, 0
        yield from walk(root, b"")
        for part in spilled.values():
            skip, below = len(part.prefix), PatriciaTrie(self.limit)
            for text, doc_id, count in part.entries():
                below.insert(text[skip:], doc_id, count)
            for text, doc_id, count in below.drain():
                yield part.prefix + text, doc_id, count


def walk(node: Node, above: bytes) -> Iterator[Entry]:
    stack = [(node, above)]
    while stack:
        node, above = stack.pop()
        text = above + node.label
        if node.count:
            yield text, node.smallest, node.count
        if node.children:
            stack.extend((child, text) for child in node.children.values())


def rows_of(entries: Iterable[tuple], size: int = 8 << 20):
    """pandas frames of about ``size`` bytes of text."""
    import pandas as pd

    held, part = 0, []

    def frame():
        out = pd.DataFrame(part, columns=["length", "sha", "text", "doc_id", "n"])
        return out.astype({"doc_id": "Int64", "length": "int64", "n": "int64"})

    for row in entries:
        part.append(row)
        held += row[0]
        if held > size:
            yield frame()
            held, part = 0, []
    if part:
        yield frame()


SCHEMA = "length long, sha string, text binary, doc_id long, n long"


def trie_pass(limit: int, local: bool):
    """A mapInPandas function: one trie for the rows of a partition.

    ``local``: before the shuffle a full trie is emptied instead of spilled, as the owner merges
    what comes from several.
    """

    def run(frames):
        import hashlib

        import pandas as pd

        trie, waiting = PatriciaTrie(1 << 62 if local else limit), []

        def entries():
            for text, doc_id, n in trie.drain():
                yield len(text), hashlib.sha256(text).hexdigest(), text, doc_id, n

        for frame in frames:
            ids = [None if pd.isna(i) else int(i) for i in frame["doc_id"]]
            for text, doc_id, n in zip(frame["text"], ids, frame["n"], strict=True):
                trie.insert(bytes(text), doc_id, int(n))
                if local and trie.held > limit:
                    yield from rows_of(entries())
            del waiting[:]
        yield from rows_of(entries())

    return run


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def owners(docs: DataFrame, text: str = "text", limit: int = TRIE_BYTES) -> DataFrame:
    """(length, sha, keep_id, group_size): one row for each different text."""
    strings = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), normalised(named(docs, text)).cast("binary").alias("text"), F.lit(1).cast("long").alias("n")
    )
    dealt = strings.mapInPandas(trie_pass(limit, True), SCHEMA).repartition("length", "sha")
    return dealt.mapInPandas(trie_pass(limit, False), SCHEMA).selectExpr(
        "length", "sha", "doc_id AS keep_id", "n AS group_size"
    )


def members(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, length, sha, times): rows that repeat an id and a text are counted together."""
    norm = normalised(named(docs, text))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("__norm"))
        .select("doc_id", F.octet_length("__norm").cast("long").alias("length"), F.sha2(F.col("__norm").cast("binary"), 256).alias("sha"))
        .groupBy("doc_id", "length", "sha")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def decided(docs: DataFrame, text: str = "text", limit: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, length, sha, times, keep_id, group_size, stays) for each id and text."""
    rows, own = members(docs, text), owners(docs, text, limit)
    return rows.join(own, ["length", "sha"]).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_duplicates(docs: DataFrame, text: str = "text", limit: int = TRIE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    each = repeat_rows(decided(docs, text, limit), "times", "nth")
    return each.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("stays") & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text: str = "text", limit: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stays = decided(docs, text, limit).where("stays").select("doc_id", F.col("sha").alias("key"), "times")
    return keep_rows(docs, stays, F.sha2(normalised(named(docs, text)).cast("binary"), 256))
