"""Lists of links in text files: encoding, delimiter, header and column of the links are found, not told."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import arrow
from ..functions.urls import host_key, url_key, valid_url
from ..operators.graph import cut

# Signs that may part cells, lines that tell which, rows that tell the column of the links.
DELIMITERS = [";", ",", "\t", "|"]
SNIFFED, PROBED = 20, 50
ENCODINGS = ["utf-8-sig", "cp1252", "latin-1"]


@arrow("string")
def decoded(contents: pd.Series) -> pd.Series:
    """File contents as text, in the first encoding that they are valid in."""

    def one(raw: bytes) -> str:
        for encoding in ENCODINGS[:-1]:
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                continue
        return raw.decode(ENCODINGS[-1])

    return contents.map(one)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, texto) of the files at a path."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("texto"))


def numbered_lines(texts: DataFrame) -> DataFrame:
    """(path, linea, valor): the lines that are neither blank nor comments, numbered from 1 as in the file.

    A file may come in parts of whole lines, (path, parte, texto), in the order of ``parte``, null first; so no file
    has to be one row.
    """
    parts = texts.withColumn("lines", F.split("texto", "\r\n|\r|\n"))
    if "parte" in texts.columns:
        # a row for each part, so a file's parts fit one task
        order = Window.partitionBy("path").orderBy("parte").rowsBetween(Window.unboundedPreceding, -1)
        offsets = parts.select(F.col("path").alias("of"), F.col("parte").alias("nth"), F.size("lines").alias("n"), "path", "parte")
        offsets = offsets.select("of", "nth", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
        parts = parts.join(offsets, F.col("path").eqNullSafe(F.col("of")) & F.col("parte").eqNullSafe(F.col("nth")))
    else:
        parts = parts.withColumn("before", F.lit(0))
    each = parts.select("path", "before", F.posexplode("lines").alias("at", "valor"))
    return each.where(~F.trim("valor").rlike("^(#|$)")).select("path", (F.col("before") + F.col("at") + 1).cast("int").alias("linea"), "valor")


def delimiter(lines: DataFrame) -> DataFrame:
    """(path, delimitador): the sign that the first lines of a file have most of; ``;`` where they have none."""
    first = lines.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("linea"))).where(F.col("nth") <= SNIFFED)
    counts = first.groupBy("path").agg(*(F.sum(F.length("valor") - F.length(F.replace("valor", F.lit(d), F.lit("")))).alias(f"n{i}") for i, d in enumerate(DELIMITERS)))
    best = F.array_max(F.array(*(F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("first"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS))))
    return counts.select("path", best["d"].alias("delimitador"))


def cells(lines: DataFrame) -> DataFrame:
    """(path, linea, celdas): each line cut at its file's delimiter, quotes around cells removed."""
    met = lines.join(delimiter(lines), "path")
    parts = F.split("valor", F.concat(F.lit("\\Q"), F.col("delimitador"), F.lit("\\E")))
    return met.select("path", "linea", F.transform(parts, lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', ""))).alias("celdas"))


def is_link(cell) -> Column:
    return valid_url(cell).isNotNull()


def probed(rows: DataFrame, column: str | None = None) -> DataFrame:
    """(path, encabezado, columna, primera): ``layout``, and the number of the first row."""
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("linea"))).where(F.col("nth") <= PROBED)
    header = F.max(F.when(F.col("nth") == 1, ~F.exists("celdas", is_link)))
    names = F.max(F.when(F.col("nth") == 1, F.transform("celdas", lambda c: F.lower(c))))
    places = numbered.select("path", "linea", "nth", "celdas").withColumn("links", F.filter(F.transform("celdas", lambda c, i: F.when(is_link(c), i)), lambda i: i.isNotNull()))
    found = places.groupBy("path").agg(header.alias("encabezado"), names.alias("names"), F.min(F.array_min("links")).alias("first"), F.min("linea").alias("primera"))
    named = F.nullif(F.array_position("names", F.lit((column or "").lower())), F.lit(0)) - 1
    return found.select("path", "encabezado", F.coalesce(*([F.when(F.col("encabezado"), named)] if column else []), "first", F.lit(0)).cast("int").alias("columna"), "primera")


def layout(rows: DataFrame, column: str | None = None) -> DataFrame:
    """(path, encabezado, columna): whether the first row is a header, which holds if no cell of it is a link, and the
    place of the links: the column of that name, else the first with a link in the first rows."""
    return probed(rows, column).drop("primera")


def link_rows(texts: DataFrame, column: str | None = None, name_column: int | None = 0) -> DataFrame:
    """(path, linea, valor, nombre, url, motivo): each row of the lists; ``motivo`` says why it is left out, else null.

    A name is the cell of ``name_column``, if that is not the link's, else the host.
    """
    rows = cells(cut(numbered_lines(texts)))
    met = rows.join(probed(rows, column), "path")
    body = met.where(~F.col("encabezado") | (F.col("linea") > F.col("primera")))
    value = F.coalesce(F.try_element_at("celdas", F.col("columna") + 1), F.lit(""))
    told = body.select("path", "linea", value.alias("valor"), valid_url(value).alias("url"), *([F.when(F.col("columna") != name_column, F.try_element_at("celdas", F.lit(name_column + 1))).alias("name")] if name_column is not None else [F.lit(None).cast("string").alias("name")]))
    told = cut(told.withColumn("key", url_key(F.col("url"))))
    # a join, which Spark may split where one link is on very many lines
    first = told.where("url IS NOT NULL").groupBy("path", "key").agg(F.min("linea").alias("first"))
    whole = told.join(first, ["path", "key"]).withColumn("motivo", F.when(F.col("linea") > F.col("first"), "duplicado")).drop("key", "first")
    told = told.drop("key")
    whole = whole.unionByName(told.where("url IS NULL").withColumn("motivo", F.lit("no parece un enlace")))
    return whole.select("path", "linea", "valor", F.coalesce(F.nullif(F.trim("name"), F.lit("")), host_key(F.col("url"))).alias("nombre"), "url", "motivo")


def document_files(files: DataFrame) -> DataFrame:
    """(path, empresa, anio) of the PDF files among paths: the year is the folder's name, the company that of the one above."""
    way = F.split("path", "/")
    year = F.regexp_extract(F.coalesce(F.try_element_at(way, F.lit(-2)), F.lit("")), "^((?:19|20)\\d\\d)$", 1)
    company = F.when(year != "", F.try_element_at(way, F.lit(-3))).otherwise(F.try_element_at(way, F.lit(-2)))
    pdf = files.where(F.lower("path").endswith(".pdf")).dropDuplicates(["path"])
    return pdf.select("path", F.coalesce(company, F.lit("")).alias("empresa"), year.alias("anio"))
