"""Rows of a results table on HTML pages: the cells as a grid, the table by its id or its header."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm
from ..functions.urls import resolved

#: Columns of a result, in the order of its cells; the word that marks the header; most copies of a cell that spans.
NAMES = ["denominacion", "documento", "expediente", "fecha"]
HEADER, SPAN = "documento", 100
ROWS = "filas array<struct<tabla: int, id: string, fila: int, celdas: array<string>, enlace: string, titulo: string>>"


class Table:
    def __init__(self, number: int, name: str):
        self.number, self.name, self.rows = number, name, []
        self.row = self.cell = None
        self.below: dict[int, tuple[int, str]] = {}  # column: rows that a cell above still covers, and its text

    def fill(self) -> None:
        """Cells that reach down from rows above take the next columns."""
        while (at := len(self.row["celdas"])) in self.below:
            left, text = self.below.pop(at)
            self.row["celdas"].append(text)
            if left > 1:
                self.below[at] = (left - 1, text)

    def end_cell(self) -> None:
        if self.cell is None:
            return
        text = " ".join("".join(self.cell["texto"]).split())
        self.fill()
        for _ in range(self.cell["ancho"]):
            if self.cell["alto"] > 1:
                self.below[len(self.row["celdas"])] = (self.cell["alto"] - 1, text)
            self.row["celdas"].append(text)
        self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        if self.row is not None:
            self.fill()
        self.row = None


def span(value: str | None) -> int:
    return max(1, min(int(value), SPAN)) if value and value.isdigit() else 1


class TableReader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[Table] = []
        self.open: list[Table] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "table":
            self.open.append(Table(len(self.tables), a.get("id", "")))
            self.tables.append(self.open[-1])
            return
        t = self.open[-1] if self.open else None
        if t is None:
            return
        if tag == "tr":
            t.end_row()
            t.row = {"celdas": [], "enlace": "", "titulo": ""}
            t.rows.append(t.row)
        elif tag in ("td", "th") and t.row is not None:
            t.end_cell()
            t.cell = {"texto": [], "ancho": span(a.get("colspan")), "alto": span(a.get("rowspan"))}
        elif tag == "a" and t.row is not None and a.get("href") and not a["href"].lower().startswith("javascript"):
            t.row["enlace"], t.row["titulo"] = a["href"], a.get("title", "")

    def handle_endtag(self, tag):
        t = self.open[-1] if self.open else None
        if t is None:
            return
        if tag in ("td", "th"):
            t.end_cell()
        elif tag == "tr":
            t.end_row()
        elif tag == "table":
            t.end_row()
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1].cell is not None:
            self.open[-1].cell["texto"].append(data)


def rows_of(html: str | None) -> list[dict]:
    reader = TableReader()
    reader.feed(html or "")
    reader.close()
    for t in reader.open:
        t.end_row()
    return [{"tabla": t.number, "id": t.name, "fila": i, **row} for t in reader.tables for i, row in enumerate(t.rows)]


def result_rows(pages: DataFrame, table_id: str) -> DataFrame:
    """(page_id, pos, denominacion, documento, expediente, fecha, url, titulo) of each page's results table.

    That is the first table with ``table_id`` in its id, else the first with the header's word in its first row.
    Headers, rows of fewer than four cells and rows without a link are no results.
    """

    def run(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "base": frame["url"], "filas": [rows_of(h) for h in frame["html"]]})

    read = pages.select("page_id", "url", "html").mapInPandas(run, f"page_id long, base string, {ROWS}")
    by_id = F.array_min(F.transform(F.filter("filas", lambda r: r["id"].contains(table_id)), lambda r: r["tabla"]))
    headed = F.filter("filas", lambda r: (r["fila"] == 0) & F.exists(r["celdas"], lambda c: norm(c).contains(HEADER)))
    chosen = read.withColumn("tabla", F.coalesce(by_id, F.array_min(F.transform(headed, lambda r: r["tabla"]))))
    each = chosen.select("page_id", "base", F.explode(F.filter("filas", lambda r: r["tabla"] == F.col("tabla"))).alias("r"))
    cells = F.col("r.celdas")
    kept = each.where((F.size(cells) >= len(NAMES)) & (norm(F.try_element_at(cells, F.lit(2))) != HEADER) & (F.col("r.enlace") != ""))
    named = [F.element_at(cells, i + 1).alias(name) for i, name in enumerate(NAMES)]
    return kept.select("page_id", F.col("r.fila").alias("pos"), *named, resolved(F.col("base"), F.col("r.enlace")).alias("url"), F.col("r.titulo").alias("titulo"))
