"""The composed news pipeline over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import kw_match
from ..operators.rows import discard_reason
from ..operators.similarity import recurrence

# Fixed values of the daily run here: what is relevant, what is left out.
RELEVANT = ["tion", "der", "les", "ciónes"]
LEFT_OUT = ["horoscopo"]
SHORTEST = 250


def articles(documents: DataFrame) -> DataFrame:
    """Documents as articles of an outlet: the first line is the title."""
    title = F.substring(F.split(F.coalesce("text", F.lit("")), "\n")[0], 1, 80)
    return documents.select(
        F.col("doc_id").alias("_seq"),
        F.col("source").alias("medio"),
        title.alias("titulo"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("contenido"),
        F.lit(None).cast("string").alias("fecha_iso"),
    )


def relevant(df: DataFrame, keywords: list[str]) -> DataFrame:
    found = kw_match(F.concat_ws(" ", "titulo", "contenido"), keywords)
    return df.withColumn("palabras_detectadas", F.array_join(found, ", ")).withColumn("ind_relevante", (F.size(found) > 0).cast("int"))


def reasons(df: DataFrame) -> DataFrame:
    """Each article's reason to go, the first in the order of the tests."""
    size = F.length(F.coalesce("contenido", F.lit("")))
    return discard_reason(
        df,
        [
            ("sin_texto", size == 0),
            ("excluida", F.size(kw_match(F.concat_ws(" ", "titulo", "url"), LEFT_OUT)) > 0),
            ("texto_corto", size < SHORTEST),
        ],
    )


def news_daily(documents: DataFrame, threshold: float = 0.4, order: str = "relevancia") -> DataFrame:
    kept = reasons(articles(documents)).where("motivo IS NULL").drop("motivo")
    return recurrence(relevant(kept, RELEVANT), threshold, order=order)
