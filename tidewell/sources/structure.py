"""What a page is made of, for the search of places: one pass of a small parser inside mapInPandas.

The result is one row per page with arrays; the operators on them are DataFrame functions
(``operators/locations.py``).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .tags import HEADINGS, LINE_TAGS

# Tags whose content is not read, hosts of maps.
UNREAD_TAGS = "script style noscript svg template".split()
# Attributes of a place's point and name.
LATITUDES = "data-lat data-latitude data-latitud".split()
LONGITUDES = "data-lng data-lon data-longitude data-long data-longitud".split()
PLACE_NAMES = "data-name data-title title aria-label".split()
MAP_LINK = (
    r"(?i)(maps\.google\.|google\.[a-z.]+/maps|goo\.gl/maps|maps\.app\.goo\.gl|waze\.com|openstreetmap\.org|"
    r"maps\.apple\.com|bing\.com/maps)"
)

SCHEMA = (
    "page_id long, url string, titulo string, h1 string, lineas array<struct<encabezado:string,linea:string>>, "
    "direcciones array<struct<encabezado:string,texto:string>>, mapas array<struct<url:string,texto:string>>, "
    "guiones array<string>, ld array<string>, opciones array<struct<valor:string,texto:string,lista:string>>, "
    "datos array<struct<nombre:string,direccion:string,lat:string,lng:string>>"
)
COLUMNS = ["page_id", "url", "titulo", "h1", "lineas", "direcciones", "mapas", "guiones", "ld", "opciones", "datos"]


def squeezed(text: str) -> str:
    return " ".join(text.split())


class Span:
    """Text that is gathered from a start tag to its end tag."""

    def __init__(self, tag: str, done):
        self.tag, self.done, self.parts = tag, done, []


class StructureReader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: dict[str, list] = {c: [] for c in COLUMNS[4:]}
        self.titles: list[str] = []
        self.h1s: list[str] = []
        self.heading, self.list_id = "", ""
        self.line = Span("", None)
        self.open: list[Span] = []
        self.unread: list[str] = []
        self.script: Span | None = None

    def gather(self, tag: str, done) -> None:
        self.open.append(Span(tag, done))

    def end_line(self) -> None:
        text = squeezed("".join(self.line.parts))
        if text:
            self.out["lineas"].append((self.heading, text))
        self.line.parts = []
        for span in self.open:
            span.parts.append(" ")

    def set_heading(self, text: str) -> None:
        self.heading = text or self.heading

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k.lower(): v or "" for k, v in attrs}
        if tag == "script":
            kind = a.get("type", "").lower()
            self.script = Span("ld" if "ld+json" in kind else "src" if a.get("src") else "guiones", None)
        if tag in UNREAD_TAGS:
            self.unread.append(tag)
        if self.unread:
            return
        if tag in LINE_TAGS:
            self.end_line()
        if tag == "title":
            self.gather(tag, self.titles.append)
        if tag in HEADINGS:
            self.gather(tag, self.set_heading)
        if tag == "h1":
            self.gather(tag, self.h1s.append)
        if tag == "address":
            heading = self.heading
            self.gather(tag, lambda text: text and self.out["direcciones"].append((heading, text)))
        if tag == "a" and re.search(MAP_LINK, a.get("href", "")):
            self.gather(tag, lambda text, url=a["href"]: self.out["mapas"].append((url, text)))
        if tag == "iframe" and re.search(MAP_LINK, a.get("src", "")):
            self.out["mapas"].append((a["src"], a.get("title", "")))
        if tag == "select":
            self.list_id = a.get("id") or a.get("name", "")
        if tag == "option":
            self.gather(tag, lambda text, value=a.get("value", ""), where=self.list_id: self.out["opciones"].append((value, text, where)))
        lat, lng = (next((a[k] for k in keys if a.get(k)), "") for keys in (LATITUDES, LONGITUDES))
        if lat and lng:
            name = next((a[k] for k in PLACE_NAMES if a.get(k)), "")
            self.out["datos"].append((name, a.get("data-address") or a.get("data-direccion", ""), lat, lng))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in ("br", "option"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.script is not None:
            if self.script.tag in self.out and (text := "".join(self.script.parts)).strip():
                self.out[self.script.tag].append(text)
            self.script = None
        if tag in self.unread:
            del self.unread[self.unread.index(tag) :]
            return
        if tag in LINE_TAGS:
            self.end_line()
        for span in [s for s in self.open if s.tag == tag]:
            span.done(squeezed("".join(span.parts)))
            self.open.remove(span)

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.parts.append(data)
        if self.unread:
            return
        for span in self.open:
            span.parts.append(data)
        if not any(s.tag == "title" for s in self.open):
            self.line.parts.append(data)


def structure_of(html: str | None) -> StructureReader:
    reader = StructureReader()
    reader.feed(html or "")
    reader.close()
    for span in reader.open:  # what a page never closes
        if span.tag in ("address", "option"):
            span.done(squeezed("".join(span.parts)))
    reader.end_line()
    return reader


def page_structure(pages: DataFrame) -> DataFrame:
    """One row per page of (page_id, url, html): see ``SCHEMA``."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for page, url, html in zip(frame["page_id"], frame["url"], frame["html"], strict=True):
                r = structure_of(html)
                rows.append((page, url, next(iter(r.titles), ""), next(iter(r.h1s), ""), *(r.out[c] for c in COLUMNS[4:])))
            yield pd.DataFrame(rows, columns=COLUMNS)

    return pages.select("page_id", "url", "html").mapInPandas(run, SCHEMA)
