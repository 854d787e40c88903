"""A catalogue of names: matching user lines, entities by years, what exists already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm

#: Letters of the groups by which a line meets the names that may contain it.
GRAM = 3


def letter_groups(text: str, sizes: str) -> Column:
    """The different runs of so many letters in a column; a shorter text is one itself."""
    return F.expr(f"array_distinct(flatten(transform({sizes}, n -> transform(sequence(1, greatest(length({text}) - n + 1, 1)), i -> substring({text}, i, n)))))")


def containing(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of a ``line`` and a ``name`` that may contain it: the name has the rarest letter group of the line.

    A line with a group that no name has meets none, and a beginning that all lines share is the key of none
    that holds anything rarer.  A line shorter than a group is its own; names have the groups of all lengths for that.
    """
    held = names.withColumn("gram", F.explode(letter_groups("name", f"sequence(1, {GRAM})")))
    known = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    each = lines.select("line").distinct().select("line", F.explode(letter_groups("line", f"array({GRAM})")).alias("gram"))
    rated = each.join(known, "gram", "left").select("line", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = rated.groupBy("line").agg(F.min(F.struct("n", "gram")).alias("least")).where("least.n > 0")
    return lines.join(rarest.select("line", F.col("least.gram").alias("gram")), "line").join(held, "gram").drop("gram")


def name_match(lines: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (linea, id, nombre) and misses (linea).

    A line of digits names an id; any other line matches equal names, or if there are none, names that contain it.
    """
    asked = lines.select("linea", norm(F.col("linea")).alias("line")).where("line <> ''").distinct()
    known = catalogue.select(F.col("id").cast("string").alias("id"), "nombre", norm(F.col("nombre")).alias("name"))
    digits = F.col("line").rlike("^[0-9]+$")
    by_id = asked.where(digits).join(known.withColumn("line", F.col("id")), "line")
    by_name = asked.where(~digits).join(known.withColumn("line", F.col("name")), "line")
    exact = by_id.select("linea", "id", "nombre").union(by_name.select("linea", "id", "nombre"))
    rest = asked.where(~digits).join(exact.select("linea"), "linea", "left_anti")
    partly = containing(rest, known).where(F.contains("name", "line")).select("linea", "id", "nombre")
    hits = exact.union(partly).distinct()
    return hits, lines.join(hits.select("linea").distinct(), "linea", "left_anti")


def entity_years(entities: DataFrame, first: int, last: int) -> DataFrame:
    return entities.withColumn("anio", F.explode(F.sequence(F.lit(first), F.lit(last))))


def existing_status(wanted: DataFrame, present: DataFrame, keys: list[str], replace: bool = False) -> DataFrame:
    """``estado``: what is present already, unless it is to be replaced."""
    found = present.select(*keys).distinct().withColumn("__here", F.lit(True))
    state = F.when(F.col("__here") & F.lit(not replace), "ya existía").otherwise("nuevo")
    return wanted.join(found, keys, "left").withColumn("estado", state).drop("__here")
