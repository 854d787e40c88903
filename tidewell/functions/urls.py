"""URL functions as columns."""

from __future__ import annotations

from functools import reduce

from urllib.parse import parse_qsl, urldefrag, urlencode, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import alnum_words, arrow, norm_alnum

# Parameters that only track, files that are no pages, schemes that are no links.
TRACKING = r"^(utm_|fbclid|gclid|mc_|_ga|ref$|sessionid|phpsessid)"
SKIPPED_FILES = (
    "pdf jpg jpeg png gif webp svg ico zip rar doc docx xls xlsx ppt pptx mp3 mp4 avi mov css js woff woff2 ttf xml json txt csv exe apk"
).split()
NO_LINKS = ["#", "javascript:", "mailto:", "tel:"]
BARE_DOMAIN = r"(?i)^(?:www\.)?[a-z0-9][a-z0-9\-]*(?:\.[a-z0-9][a-z0-9\-]*)+(?:[/?#:].*)?$"


def valid_url(text) -> Column:
    """An http(s) URL with a dotted host, ``https://`` put before bare domains, else null."""
    plain = F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "^[\"'<>]+|[\"'<>]+$", ""))
    full = F.when(plain.rlike("(?i)^https?://"), plain).when(plain.rlike(BARE_DOMAIN), F.concat(F.lit("https://"), plain))
    host = F.regexp_extract(full, "(?i)^https?://([^/?#:]*)", 1)
    return F.when(~plain.contains(" ") & host.contains("."), full)


def host(url) -> Column:
    return F.lower(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1))


def host_key(url) -> Column:
    return F.regexp_replace(F.split(host(url), ":")[0], "^www\\.", "")


def url_key(url) -> Column:
    """Without scheme, www and closing slashes, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), "^https?://(www\\.)?", ""), "/+$", "")


def news_key(url) -> Column:
    """Without fragment and closing slashes."""
    return F.regexp_replace(F.split(F.trim(F.coalesce(url, F.lit(""))), "#")[0], "/+$", "")


def path(url) -> Column:
    return F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def section(url) -> Column:
    """The first path segment, else empty."""
    return F.regexp_extract(path(url), "^/+([^/]+)", 1)


def is_file(url) -> Column:
    return F.lower(path(url)).rlike(rf"\.({'|'.join(SKIPPED_FILES)})$")


def same_site(url, base: str, subdomains: bool = True) -> Column:
    own = host_key(url)
    return (own == base) | own.endswith("." + base) if subdomains else own == base


def parts(url) -> dict[str, Column]:
    """scheme, authority, path, query and fragment of a URL, by the pattern of RFC 3986; null where absent."""
    named = {"scheme": 2, "authority": 4, "path": 5, "query": 7, "fragment": 9}
    pattern = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
    return {name: F.regexp_extract(url, pattern, group) for name, group in named.items()}


@arrow("string")
def encoded(query: pd.Series) -> pd.Series:
    """A query written anew, its names and values percent-encoded one way."""
    return query.map(lambda q: q and urlencode([(k, v) for k, v in parse_qsl(q, keep_blank_values=True)]))


def canonical(url) -> Column:
    """Scheme and host in lower case, single slashes and none at the end, no tracking parameters, no fragment."""
    p = parts(url)
    way = F.regexp_replace(p["path"], "/{2,}", "/")
    way = F.when(way == "", "/").when(way == "/", way).otherwise(F.regexp_replace(way, "/$", ""))
    given = F.filter(F.split(p["query"], "&"), lambda pair: (pair != "") & ~pair.rlike("(?i)" + TRACKING.replace("$", "(=|$)")))
    query = encoded(F.array_join(given, "&"))
    site = F.when(p["authority"] != "", F.concat(F.lit("//"), F.lower(p["authority"]))).otherwise(F.lit(""))
    scheme = F.when(p["scheme"] != "", F.concat(F.lower(p["scheme"]), F.lit(":"))).otherwise(F.lit(""))
    return F.concat(scheme, site, way, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


@arrow("string")
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    """The absolute link of an href on a page, without its fragment; null where either is no URL."""

    def one(page, link):
        try:
            return urldefrag(urljoin(page or "", link or "")).url
        except ValueError:
            return None

    return pd.Series([one(p, h) for p, h in zip(base, href, strict=True)], dtype=object)


def is_link(href) -> Column:
    """Does an href lead to another page?"""
    plain = F.lower(F.trim(F.coalesce(href, F.lit(""))))
    return (plain != "") & ~F.array_contains(F.transform(F.array(*map(F.lit, NO_LINKS)), lambda start: plain.startswith(start)), True)


def percent_decoded(text) -> Column:
    """Percent escapes as what they stand for; what is no escape stays."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def link_score(anchor, url, words: list[str]) -> Column:
    """Ten for each word in the anchor text, six for each in the decoded path or query, at most forty.

    Words count as they are listed: two that fold to the same text count twice; empty ones don't count.
    """
    said = norm_alnum(F.coalesce(anchor, F.lit("")))
    p = parts(F.coalesce(url, F.lit("")))
    way = norm_alnum(percent_decoded(F.concat_ws(" ", p["path"], p["query"])))
    points = [F.when(text.contains(w), worth).otherwise(0) for w in map(alnum_words, words) if w for text, worth in ((said, 10), (way, 6))]
    return F.least(reduce(Column.__add__, points, F.lit(0)), F.lit(40))


def blocked_by_robots(pages: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """The pages with ``bloqueada``: whether the rules for this agent and those for ``*`` both forbid them.

    ``rules``: host, agent, rule_no, allow, prefix.  Within an agent the first rule whose prefix fits decides.
    """
    told = rules.where(F.col("agent").isin(agent, "*")).select("host", "agent", "rule_no", "allow", "prefix")
    keyed = pages.withColumn("host", host_key(F.col(url))).withColumn("way", F.coalesce(F.nullif(path(F.col(url)), F.lit("")), F.lit("/")))
    met = keyed.select("host", "way").distinct().join(told, "host").where(F.col("way").startswith(F.col("prefix")))
    first = lambda who: F.min_by("allow", F.when(F.col("agent") == who, F.col("rule_no")))
    said = met.groupBy("host", "way").agg(first("*").alias("all"), first(agent).alias("own"))
    # without rules of its own an agent goes by those for all
    heard = told.groupBy("host").agg(F.bool_or(F.col("agent") == agent).alias("named"))
    out = keyed.join(said, ["host", "way"], "left").join(heard, "host", "left")
    own = F.when(F.coalesce("named", F.lit(False)), F.coalesce("own", F.lit(True))).otherwise(F.coalesce("all", F.lit(True)))
    return out.withColumn("bloqueada", ~F.coalesce("all", F.lit(True)) & ~own).drop("host", "way", "all", "own", "named")


def site_name(name, url) -> Column:
    """A site's name, else its host without ``www.``."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), host_key(url))


def listed_urls(text) -> Column:
    """The http(s) URLs of a text, each once, in order, those of links written ``[words](url)`` included."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\s,;]+"), lambda t: t != "")
    inner = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, "\\((https?://[^)\\s]+)\\)", 1), F.lit("")), t)
    bare = F.transform(pieces, lambda t: F.regexp_replace(inner(t), "^[<>\\[\\]()\"']+|[<>\\[\\]()\"']+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: t.rlike("(?i)^https?://")))
