"""Operator 1, URL filters: association rules over URL tokens, with Spark functions only.

Given (host, path) rules come first.  For all other URLs, FP-growth mines the combinations of host
labels, path segments and query names that go along with a label, pruned by support and confidence.
All tokens of a URL count.  Tokens that the same labelled URLs have are one item to the miner, as any
of them gives a rule the same support and confidence; this keeps the combinations of long URLs few.
Each mined rule is indexed under its rarest item; the tokens of a URL look their rules up there, the
rest of a rule's items is then tested, and the most confident rule decides, else ``allow``.

Defined results: a null URL, or one without ``://``, has an empty host and path and no tokens; of
rules that are equally confident, block wins; without labelled URLs nothing is mined; rows that
repeat are judged each; URLs of any length are taken whole; an empty table gives an empty result; other
columns, of whatever name, are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SUPPORT, CONFIDENCE = 0.002, 0.5
LABEL = "label="
RULES = "antecedent array<array<string>>, verdict string, confidence double, key string"


def host_and_path(url) -> tuple[F.Column, F.Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def given_rule(host, path, rules: list[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """Rule and verdict of the longest of (verdict, host, path) that fits, else nulls."""
    fits = [
        (host_part + path_part, verdict, ((host == host_part) | host.endswith("." + host_part)) & path.startswith(path_part))
        for verdict, host_part, path_part in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    ]
    rule = F.coalesce(*[F.when(fit, name) for name, _, fit in fits], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(fit, judged) for _, judged, fit in fits], F.lit(None).cast("string"))
    return rule, verdict


def tokens(url, host, path) -> F.Column:
    """Different tokens of a URL; numbers stand for each other."""
    plain = lambda text: F.regexp_replace(F.lower(text), "[0-9]+", "0")
    given = lambda values: F.filter(values, lambda v: v != "")
    labels = F.transform(given(F.split(host, "\\.")), lambda v: F.concat(F.lit("h:"), plain(v)))
    segments = F.transform(given(F.split(path, "/")), lambda v: F.concat(F.lit("p:"), plain(v)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "^[^?#]*\\?([^#]*)", 1)
    names = F.transform(given(F.split(query, "&")), lambda v: F.concat(F.lit("q:"), plain(F.substring_index(v, "=", 1))))
    return F.array_distinct(F.concat(labels, segments, names))


def alike(baskets: DataFrame, least: float) -> DataFrame:
    """(item, tokens): tokens of at least ``least`` of the (basket, tokens, label), those of the same baskets together."""
    at = F.xxhash64("basket")
    sets = baskets.select("basket", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(at).alias("x"), F.bit_xor(F.xxhash64(at)).alias("y")
    )
    return sets.where(F.col("n") >= least).groupBy("n", "x", "y").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("tokens")).select("item", "tokens")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, scratch: Scratch | None = None) -> DataFrame:
    """Rules of (tokens, blocked): antecedent, verdict, confidence and the key that indexes them.

    An antecedent is a list of items, each the tokens of which a URL needs one.
    """
    label = F.when(F.col("blocked"), LABEL + "block").otherwise(LABEL + "allow")
    scratch = scratch or Scratch(labelled.sparkSession)
    given = labelled.where("size(tokens) > 0").select(F.monotonically_increasing_id().alias("basket"), "tokens", label.alias("label"))
    baskets = scratch.keep(given, "baskets")
    total = baskets.count()
    if not total:
        return labelled.sparkSession.createDataFrame([], RULES)
    items = scratch.keep(alike(baskets, support * total), "items")
    own = baskets.select("basket", "label", F.explode("tokens").alias("item")).join(items.select("item"), "item")
    own = own.groupBy("basket").agg(F.collect_list("item").alias("found"))
    met = baskets.select("basket", "label").join(own, "basket", "left")
    reduced = scratch.keep(met.select(F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array("label")).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(reduced)
    found = model.associationRules.where(
        F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda t: t.startswith(LABEL))
    ).select(F.monotonically_increasing_id().alias("rule"), "antecedent", F.substring(F.col("consequent")[0], len(LABEL) + 1, 99).alias("verdict"), "confidence")
    found = scratch.keep(found, "mined")
    single = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("item"), "freq")
    each = found.select("rule", F.explode("antecedent").alias("item")).join(single, "item").join(items, "item")
    keyed = each.groupBy("rule").agg(F.collect_list("tokens").alias("sets"), F.min_by("tokens", F.struct("freq", "item")).alias("keys"))
    rules = found.drop("antecedent").join(keyed, "rule")
    return scratch.keep(rules.select(F.col("sets").alias("antecedent"), "verdict", "confidence", F.explode("keys").alias("key")), "rules")


def judge(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """(tokens, judged) for each different token set that a mined rule fits."""
    sets = urls.select("tokens").distinct()
    met = sets.select("tokens", F.explode("tokens").alias("key")).join(mined, "key")
    fits = met.where(F.forall("antecedent", lambda item: F.arrays_overlap(item, F.col("tokens"))))
    best = F.max_by("verdict", F.struct("confidence", "verdict"))  # "block" sorts after "allow"
    return fits.groupBy("tokens").agg(best.alias("judged"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict of each row.

    ``labels``: (page_id, blocked), what is known of some pages.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    known = rows.select("page_id", "tokens").join(labels.select("page_id", "blocked"), "page_id").where("blocked IS NOT NULL")
    scratch = Scratch(pages.sparkSession)
    # written, so that a join may deal out the many rows of one set of tokens
    judged = scratch.keep(judge(rows, mine(known, support, confidence, scratch)), "judged")
    scratch.drop_all_but(judged)
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    met = rows.join(judged, "tokens", "left")
    return met.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "judged", F.lit("allow")).alias("verdict"))
