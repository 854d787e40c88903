"""A model's answers applied to the fragments they were asked about: match, keep or discard, fall back, verify.

The model runs elsewhere; its answers come as a table (lote, respuesta).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import arrow, truthy, verified_share

# Fields of a place, names of the list in an answer, share of an address's words that its source must have.
FIELDS = "nombre direccion distrito ciudad departamento telefono horario".split()
LISTS = "locales resultados items".split()
VERIFIED = 0.7
DIFFERENT_LETTERS = 80

OBJECTS = "array<struct<pos:int,id:int,es_local:string," + ",".join(f"{f}:string" for f in FIELDS) + ">>"


def first_json(text: str | None):
    """The first JSON list or object of an answer; thoughts, code fences and commas before closing brackets are no part of it."""
    plain = re.sub(r"(?is)<think>.*?</think>|```(?:json)?", "", text or "")
    decoder = json.JSONDecoder()
    for at in (m.start() for m in re.finditer(r"[\[{]", plain)):
        for form in (plain[at:], re.sub(r",(?=\s*[}\]])", "", plain[at:])):
            try:
                return decoder.raw_decode(form)[0]
            except ValueError:
                pass
    return None


def listed(value) -> list | None:
    """The objects of an answer: a list, or an object that holds or is one."""
    if isinstance(value, dict):
        value = next((value[k] for k in LISTS if value.get(k)), [value])
    return value if isinstance(value, list) else None


@arrow(OBJECTS)
def parsed_answer(answers: pd.Series) -> pd.Series:
    """The objects of each answer, in order; null where it holds no JSON list or object."""

    def one(text):
        found = listed(first_json(text))
        if found is None:
            return None
        out = []
        for n, o in enumerate(found):
            if isinstance(o, dict):
                key = o.get("id")
                key = int(key) if isinstance(key, (int, float)) or (isinstance(key, str) and key.strip().lstrip("-").isdigit()) else None
                said = {f: " ".join(str(o.get(f) or "").split()) for f in FIELDS}
                out.append({"pos": n, "id": key, "es_local": str(o.get("es_local", True))} | said)
        return out

    return pd.Series([one(t) for t in answers], dtype=object)


def responses(fragments: DataFrame, answers: DataFrame) -> DataFrame:
    """The fragments (lote, id, …) with ``r``, the object that answers each: the last of those with its id; else null.

    ``leida`` says whether the batch has an answer that could be read.
    """
    read = answers.select("lote", parsed_answer(F.col("respuesta")).alias("objects"))
    each = read.select("lote", F.explode("objects").alias("o")).where("o.id IS NOT NULL")
    last = each.groupBy("lote", F.col("o.id").alias("id")).agg(F.max_by("o", F.col("o.pos")).alias("r"))
    known = read.groupBy("lote").agg(F.bool_or(F.col("objects").isNotNull()).alias("leida"))
    return fragments.join(known, "lote", "left").join(last, ["lote", "id"], "left").withColumn("leida", F.coalesce("leida", F.lit(False)))


def applied(matched: DataFrame, fallback: bool = True) -> DataFrame:
    """``responses`` with ``resultado`` (ia, descartada, rastreo, sin respuesta), the fields and ``verificada``.

    Fields that the answer leaves empty keep what the fragment has; so do all fields of a fragment without an answer.
    """
    kept = F.when(F.col("r").isNull(), "rastreo" if fallback else "sin respuesta").when(truthy(F.col("r.es_local")), "ia").otherwise("descartada")
    own = set(matched.columns)
    out = matched.withColumn("resultado", kept)
    source = F.coalesce(F.nullif(F.col("contexto"), F.lit("")), F.col("direccion"))
    verified = F.when(verified_share(F.col("r.direccion"), source) >= VERIFIED, "sí").otherwise("no")
    out = out.withColumn("verificada", F.when(F.col("resultado") == "ia", verified).otherwise(""))
    for f in FIELDS:
        was = F.col(f) if f in own else F.lit("")
        out = out.withColumn(f, F.coalesce(F.nullif(F.col(f"r.{f}"), F.lit("")), was, F.lit("")))
    return out.drop("r")


def structured(rows: DataFrame) -> DataFrame:
    """The rows that stay, with ``fuente``."""
    return rows.where(F.col("resultado").isin("ia", "rastreo")).withColumnRenamed("resultado", "fuente")


def answer_stats(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count_distinct("lote").alias("consultas"),
        F.count_if(F.col("resultado").isin("rastreo", "sin respuesta")).alias("fallos"),
        F.count_if(F.col("resultado") == "descartada").alias("descartados"),
        F.count_if(F.col("verificada") == "no").alias("sin_verificar"),
    )


def address_key(address: Column) -> Column:
    """The letters and digits of an address; null, which is like no other, if it has none."""
    return F.nullif(F.substring(F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), "[^a-z0-9]+", ""), 1, DIFFERENT_LETTERS), F.lit(""))


def distinct_addresses(rows: DataFrame, site: str, order: list) -> DataFrame:
    """The first row of each site and address; rows without an address all stay."""
    keyed = rows.withColumn("clave", address_key(F.col("direccion")))
    ranked = keyed.where("clave IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy(site, "clave").orderBy(*order)))
    return ranked.where("nth = 1").drop("nth").unionByName(keyed.where("clave IS NULL")).drop("clave")
