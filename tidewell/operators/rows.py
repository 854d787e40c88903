"""Operators on rows: first per key, discards, typed columns, batches, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_cell
from .graph import cut


def first_per_key(df: DataFrame, key: Column, order: list) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the others; an empty or null key is never a duplicate.

    Rows without a key take no part in the ranking.  ``order`` must leave no ties.
    """
    keyed = df.select(F.struct("*").alias("row"), F.nullif(key, F.lit("")).alias("key"))
    order = [F.col(f"row.`{c}`") if isinstance(c, str) else c for c in order]
    given = keyed.where("key IS NOT NULL")
    ranked = given.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("place = 1")
    first = ranked.select("row.*").union(keyed.where("key IS NULL").select("row.*"))
    return first, beyond(given, ["key"], order, 1).select("row.*")


def beyond(df: DataFrame, keys: list[str], order: list, keep: int) -> DataFrame:
    """The rows past the first ``keep`` of their keys; ``order`` must leave no ties.

    A key's rows are ranked in shares, by the partition that they come from, and only the first ``keep`` of each share
    once more together, so a key of many rows is not sorted in one task.
    """
    share, local, again = "__share", "__local", "__again"
    shared = df.withColumn(share, F.spark_partition_id())
    shared = shared.withColumn(local, F.row_number().over(Window.partitionBy(*keys, share).orderBy(*order)))
    group = F.when(F.col(local) <= keep, F.lit(-1)).otherwise(F.col(share))
    ranked = shared.withColumn(again, F.row_number().over(Window.partitionBy(*keys, group).orderBy(*order)))
    return ranked.where((F.col(local) > keep) | (F.col(again) > keep)).drop(share, local, again)


def discard_reason(df: DataFrame, rules: list[tuple[str, Column]], name: str = "motivo") -> DataFrame:
    """The first reason, in order, for which a row goes; null for rows that stay."""
    return df.withColumn(name, F.coalesce(*[F.when(test, reason) for reason, test in rules], F.lit(None).cast("string")))


def csv_cells(df: DataFrame, columns: list[str] | None = None, rename: dict[str, str] | None = None, most: int = 32000, escape_formulas: bool = True) -> DataFrame:
    kinds = dict(df.dtypes)
    names = columns or df.columns
    return df.select(*[csv_cell(F.col(f"`{c}`"), kinds[c], most, escape_formulas).alias((rename or {}).get(c, c)) for c in names])


def write_csv(df: DataFrame, path: str, delimiter: str = ";", **how) -> None:
    """Cells as CSV with a header line, quoted as RFC 4180 asks; an empty table still gets its header."""
    csv_cells(df, **how).write.option("header", True).option("sep", delimiter).option("escape", '"').csv(path)


def union_rows(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def numbered(df: DataFrame, order: list, name: str, keys: list[str] | None = None) -> DataFrame:
    """Rows numbered from 1 in this order, within the keys if there are any; null is a key like others.

    Rows are sorted by ranges; in each range a key's rows follow as many as it has in the ranges before.
    """
    keys = keys or []
    named = [f"k{i}" for i in range(len(keys))]
    wrapped = df.orderBy(*keys, *order).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.monotonically_increasing_id().alias("at"))
    ranged = cut(wrapped).withColumn("part", F.shiftright("at", 33))
    sizes = ranged.groupBy(*named, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # of each key one row for each range, so one task is enough
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*named).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(n).alias(f"o{n}") for n in named), F.col("part").alias("opart"), "first", before.alias("before"))
    same = F.col("part") == F.col("opart")
    for n in named:
        same &= F.col(n).eqNullSafe(F.col(f"o{n}"))
    return ranged.join(offsets, same).select("row.*", (F.col("before") + F.col("at") - F.col("first") + 1).alias(name))


def batches(df: DataFrame, order: list, size: int, keys: list[str] | None = None) -> DataFrame:
    """``lote`` numbers batches of ``size`` rows within the keys, from 0."""
    return numbered(df, order, "lote", keys).withColumn("lote", F.floor((F.col("lote") - 1) / size).cast("long"))


def neighbours_differ(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows whose value is not that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__same", before.eqNullSafe(F.col(value)) & (place > 1)).where("NOT __same").drop("__same")


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Insert-or-update: the last row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def changed_status(current: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """``estado`` of each current row: pending, enabled or changed, by comparing its digest with the stored one."""
    old = stored.select(F.col(key), F.col(digest).alias("__stored"))
    state = F.when(F.col("__stored").isNull(), "pending").when(F.col("__stored") == F.col(digest), "enabled").otherwise("changed")
    return current.join(old, key, "left").withColumn("estado", state).drop("__stored")


def newest_per_group(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("nth", place).where(F.col("nth") <= most).drop("nth")


def seen_store(old: DataFrame, new: DataFrame, most: int = 20000) -> DataFrame:
    """(medio, url) of both, each once, the last ``most`` of each outlet by URL, which is how the store is bounded."""
    return newest_per_group(old.select("medio", "url").union(new.select("medio", "url")).distinct(), "medio", [F.desc("url")], most)


def coerce_number(value: Column, least: float | None = None, most: float | None = None) -> tuple[Column, Column]:
    """A number with a decimal point or comma, and an error text or null."""
    number = F.replace(F.trim(value.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    error = F.when(value.isNotNull() & (F.trim(value.cast("string")) != "") & number.isNull(), "no es un número")
    if least is not None:
        error = F.coalesce(error, F.when(number < least, f"menor que {least:g}"))
    if most is not None:
        error = F.coalesce(error, F.when(number > most, f"mayor que {most:g}"))
    return number, error


# Words for yes and no.
YES = ["true", "1", "si", "sí", "yes", "y", "on", "verdadero"]
NO = ["false", "0", "no", "n", "off", "falso"]


def coerce_boolean(value: Column) -> tuple[Column, Column]:
    plain = F.lower(F.trim(value.cast("string")))
    out = F.when(plain.isin(YES), True).when(plain.isin(NO), False)
    return out, F.when(value.isNotNull() & out.isNull(), "no es sí o no")


def coerced(df: DataFrame, fields: list[dict]) -> DataFrame:
    """Text columns as typed ones, with ``errores`` and ``avisos``.

    A field has ``key``, ``type`` (string, number, boolean, select, json) and maybe ``default``, ``required``,
    ``min``, ``max``, ``options``.  A blank value takes the default; columns that no field names are warned of.
    """
    columns, errors = [], []
    for field in fields:
        key, kind = field["key"], field["type"]
        given = F.col(f"`{key}`").cast("string") if key in df.columns else F.lit(None).cast("string")
        blank = F.coalesce(F.trim(given) == "", F.lit(True))
        text = F.when(blank, F.lit(field.get("default")).cast("string")).otherwise(given)
        if kind == "number":
            value, error = coerce_number(text, field.get("min"), field.get("max"))
        elif kind == "boolean":
            value, error = coerce_boolean(text)
        elif kind == "select":
            value = F.when(text.isin([str(o) for o in field["options"]]), text)
            error = F.when(text.isNotNull() & value.isNull(), "no es una opción")
        elif kind == "json":
            value = F.try_parse_json(text)
            error = F.when(text.isNotNull() & value.isNull(), "no es JSON")
        else:
            value, error = text, F.lit(None).cast("string")
        missing = F.when(blank & F.lit(bool(field.get("required")) and field.get("default") is None), "falta")
        columns.append(value.alias(key))
        errors.append(F.concat(F.lit(key + ": "), F.coalesce(missing, error)))
    unknown = [c for c in df.columns if c not in {f["key"] for f in fields}]
    warnings = F.array(*(F.lit(f"{c}: desconocido") for c in unknown)) if unknown else F.array().cast("array<string>")
    return df.select(*columns, F.array_compact(F.array(*errors)).alias("errores"), warnings.alias("avisos"))
