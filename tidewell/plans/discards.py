"""Why the articles of a feed go: one reason for each, of nine, in the order in which the tests are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import kw_match, norm
from ..operators.rows import discard_reason

# The reasons.
REASONS = [
    "duplicadas", "otra_seccion", "fuera_de_ventana", "excluidas_titulo", "errores", "cuerpo_vacio", "cuerpo_corto",
    "excluidas_contenido", "no_relevantes",
]


@dataclass(frozen=True)
class FeedRules:
    """``include``, ``exclude``: parts of a URL, one of which it must have, none of which it may; ``since``: the oldest
    instant; ``left_out_title``, ``left_out_text``: words of the title and URL, or of the title and text; ``relevant``:
    words of which one must occur if ``only_relevant``."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    url_regex: str = ""
    since: str | None = None
    left_out_title: list[str] = field(default_factory=list)
    left_out_text: list[str] = field(default_factory=list)
    relevant: list[str] = field(default_factory=list)
    only_relevant: bool = False
    shortest: int = 0


def says(text: Column, words: list[str]) -> Column:
    return F.size(kw_match(text, words)) > 0 if words else F.lit(False)


def other_section(url: Column, rules: FeedRules) -> Column:
    """URLs outside the wanted sections; the parts are compared without case and accents."""
    plain = norm(url)
    has = lambda parts: F.exists(F.transform(F.array(*map(F.lit, parts)), norm), lambda p: F.contains(plain, p))
    tests = [~has(rules.include)] if rules.include else []
    tests += [has(rules.exclude)] if rules.exclude else []
    tests += [~url.rlike(f"(?i){rules.url_regex}")] if rules.url_regex else []
    return F.coalesce(*(F.when(t, True) for t in tests), F.lit(False))


def feed_reasons(items: DataFrame, rules: FeedRules, order: str, seen: DataFrame | None = None) -> DataFrame:
    """``motivo`` of each item, null for those that stay.

    Items have medio, url, titulo, fecha (of the feed), fecha_pagina, contenido and error (of the page, or null).  Of the
    items of an outlet with one URL, the first in ``order`` that is of a wanted section and in time counts, and all
    after it are duplicates; so are items without URL, and those that are ``seen`` (medio, url).  An item without a date
    is in time; the page's date is taken where the feed has none.
    """
    late = lambda date: (F.col(date) < F.lit(rules.since).cast("timestamp")) if rules.since else F.lit(False)
    address = F.trim(F.coalesce("url", F.lit("")))
    early = F.when(other_section(address, rules), "otra_seccion").when(late("fecha"), "fuera_de_ventana")
    marked = items.select(F.struct("*").alias("row"), F.col("medio").alias("__medio"), address.alias("__url"), F.col(order).alias("__order"), early.alias("__early"))
    first = marked.where("__early IS NULL AND __url <> ''").groupBy("__medio", "__url").agg(F.min("__order").alias("__first"))
    met = marked.join(first.select(F.col("__medio").alias("m"), F.col("__url").alias("u"), "__first"), F.col("__medio").eqNullSafe(F.col("m")) & (F.col("__url") == F.col("u")), "left")
    known = F.lit(False)
    if seen is not None:
        store = seen.select(F.col("medio").alias("sm"), F.col("url").alias("su")).distinct().withColumn("__seen", F.lit(True))
        met = met.join(store, F.col("__medio").eqNullSafe(F.col("sm")) & (F.col("__url") == F.col("su")), "left")
        known = F.coalesce("__seen", F.lit(False))
    flat = met.select("row.*", "__early", "__url", (known | (F.col("__url") == "") | F.coalesce(F.col("__order") > F.col("__first"), F.lit(False))).alias("__again"))
    title, body = F.coalesce("titulo", F.lit("")), F.coalesce("contenido", F.lit(""))
    whole = F.concat_ws(" ", title, body)
    tests = [
        ("duplicadas", F.col("__again")),
        ("otra_seccion", F.col("__early") == "otra_seccion"),
        ("fuera_de_ventana", F.col("__early") == "fuera_de_ventana"),
        ("excluidas_titulo", says(F.concat_ws(" ", title, F.translate("__url", "-/", "  ")), rules.left_out_title)),
        ("errores", F.col("error").isNotNull()),
        ("cuerpo_vacio", body == ""),
        ("cuerpo_corto", F.length(body) < rules.shortest),
        ("fuera_de_ventana", F.col("fecha").isNull() & late("fecha_pagina")),
        ("excluidas_contenido", says(whole, rules.left_out_text)),
        ("no_relevantes", ~says(whole, rules.relevant) if rules.only_relevant else F.lit(False)),
    ]
    return discard_reason(flat, tests).drop("__early", "__url", "__again")


def discard_counts(reasoned: DataFrame) -> DataFrame:
    """(medio, the nine reasons, quedan): how many articles of an outlet went for each reason, and how many stay."""
    counts = [F.count_if(F.col("motivo") == r).alias(r) for r in REASONS]
    return reasoned.groupBy("medio").agg(*counts, F.count_if(F.col("motivo").isNull()).alias("quedan"))
