"""Feed bodies to items: RSS, RDF, Atom and sitemaps; sitemap indexes by a join with the other feeds.

A body goes through a streaming XML parser once.  What an entry says is a table of (field, element
names); an entry's field is the first such element with text.
"""

from __future__ import annotations

import re
from xml.parsers import expat

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import cut

#: Fixed value: children of a sitemap index that are followed.
CHILDREN = 10
#: Elements that are entries, and the elements that hold each field of one.
ENTRIES = {
    "item": {"titulo": ["title"], "fecha_raw": ["pubdate", "date", "published", "updated"], "url": ["link", "guid"]},
    "url": {"titulo": ["title"], "fecha_raw": ["publication_date", "lastmod"], "url": ["loc"]},
    "sitemap": {"url": ["loc"]},
}
ENTRIES["entry"] = ENTRIES["item"]
FIELDS = ["titulo", "fecha_raw", "url"]


class FeedReader:
    """Collects (kind, titulo, fecha_raw, url) of each entry while the parser runs."""

    def __init__(self):
        self.rows: list[tuple[str, str, str, str]] = []
        self.kind, self.depth, self.at, self.known = None, 0, 0, {}
        self.text: list[str] = []
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.StartElementHandler, self.parser.EndElementHandler = self.start, self.end
        self.parser.CharacterDataHandler = self.text.append

    @staticmethod
    def name(tag: str) -> str:
        return tag[tag.rfind("}") + 1 :].lower()

    def start(self, tag: str, attributes: dict) -> None:
        self.depth += 1
        name = self.name(tag)
        del self.text[:]
        if self.kind is None and name in ENTRIES:
            self.kind, self.at, self.known = name, self.depth, {}
        elif self.kind and name == "link" and attributes.get("href"):
            self.known.setdefault("href", attributes["href"].strip())

    def end(self, tag: str) -> None:
        if self.kind and self.depth == self.at:
            self.finish()
            self.kind = None
        elif self.kind and (said := "".join(self.text).strip()):
            self.known.setdefault(self.name(tag), said)
        del self.text[:]
        self.depth -= 1

    def finish(self) -> None:
        # of several names for a field the one that came first in the entry counts
        order = {name: i for i, name in enumerate(self.known)}
        found = {
            field: self.known[min(there, key=order.get)] if (there := [n for n in names if n in self.known]) else ""
            for field, names in ENTRIES[self.kind].items()
        }
        url = found["url"] or self.known.get("href", "")
        if url:
            kind = "child" if self.kind == "sitemap" else "item"
            self.rows.append((kind, found.get("titulo", ""), found.get("fecha_raw", ""), url))


def read_feed(body: str | None) -> list[tuple[str, str, str, str]]:
    """Rows of ``FeedReader``; a body that is no XML, even with its stray ampersands escaped, is one error."""
    body = body or ""
    mended = re.sub(r"&(?![a-zA-Z]{2,4};|#)", "&amp;", body[body.find("<") :] if "<" in body else body)
    for text in dict.fromkeys((body, mended)):
        reader = FeedReader()
        try:
            reader.parser.Parse(text.encode(), True)
        except expat.ExpatError:
            continue
        children = [r for r in reader.rows if r[0] == "child"]
        return children[:CHILDREN] if children else reader.rows
    return [("error", "", "", "")]


def parsed(feeds: DataFrame) -> DataFrame:
    """(feed_url, pagina, pos, kind, …): the entries of each body, ``pos`` from 0."""
    paged = "pagina" in feeds.columns

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(u, p, n, *item) for u, p, body in zip(frame["feed_url"], frame["pagina"], frame["body"], strict=True) for n, item in enumerate(read_feed(body))]
            yield pd.DataFrame(rows, columns=["feed_url", "pagina", "pos", "kind", *FIELDS]).astype({"pagina": "Int64"})

    page = F.col("pagina") if paged else F.lit(0)
    each = feeds.select("feed_url", page.cast("long").alias("pagina"), "body").mapInPandas(run, "feed_url string, pagina long, pos int, kind string, titulo string, fecha_raw string, url string")
    return following(cut(each)) if paged else each


def following(each: DataFrame) -> DataFrame:
    """Entries of feeds in pages, with ``pos`` running on from page to page."""
    sizes = each.where("kind <> 'error'").groupBy(F.col("feed_url").alias("of"), F.col("pagina").alias("nth")).agg(F.count(F.lit(1)).alias("n"))
    # a row for each page, so a feed's pages fit one task
    order = Window.partitionBy("of").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("of", "nth", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    met = each.join(offsets, F.col("feed_url").eqNullSafe(F.col("of")) & F.col("pagina").eqNullSafe(F.col("nth")))
    met = met.select("feed_url", "pagina", (F.col("before") + F.col("pos")).cast("int").alias("pos"), "kind", *FIELDS)
    return met.where((F.col("kind") != "child") | (F.col("pos") < CHILDREN))


def feed_items(feeds: DataFrame) -> DataFrame:
    """(feed_url, pos, titulo, fecha_raw, url); the items of an index are those of its children in ``feeds``.

    A feed may come in pages, (feed_url, pagina, body), each a body of its own, so no feed has to be one row.
    """
    each = parsed(feeds)
    own = each.where("kind = 'item'").select("feed_url", "pos", *FIELDS)
    children = each.where("kind = 'child'").select(F.col("feed_url").alias("index_url"), F.col("url").alias("feed_url"))
    followed = own.join(children, "feed_url").select(F.col("index_url").alias("feed_url"), "pos", *FIELDS)
    return own.unionByName(followed)


def feed_kind(declared: Column, body: Column) -> Column:
    """``html`` or ``feed``: as declared, or with ``auto`` by how the body begins."""
    start = F.ltrim(F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 600)))
    page = start.startswith("<!doctype html") | start.startswith("<html")
    return F.when(declared == "html", "html").when((declared == "auto") & page, "html").otherwise("feed")
