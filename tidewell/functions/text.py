"""Scalar text functions as columns."""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms.
STOP_WORDS = (
    "para como pero este esta esto esos esas entre sobre desde hasta cuando donde porque aunque tambien segun todos todas "
    "otro otra otros otras ante cada ellos ellas hacia mientras durante mismo misma sido seran sera fueron haber hacer hace "
    "dijo senalo indico tras ademas luego ahora solo muy mas anos dias lima peru"
).split()
# Fixed value: what a term is.
TERM = "[a-z0-9ñ]{4,}"
# Fixed value: a labelled phone number.
PHONE = r"(?i)(?:tel[eé]?f?[a-z\.]*|cel[a-z\.]*|fono|llam[ae]\w*|whatsapp|t:|ph:|phone)\s*[:\.]?\s*(\+?[\d(][\d\s\-\(\)\.]{5,18}\d)"
# Signs that open a formula in a spreadsheet.
FORMULA = r"^[=+\-@\t\r]"


def arrow(kind: str) -> Callable:
    """A function of Series as one of columns; the pandas UDF is made with each use, as its type asks for a session."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap


def base_letters() -> tuple[str, str]:
    """Accented letters of the Latin blocks, and the letter below each accent."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = base_letters()


def unless_ascii(text: Column, change: Callable[[Column], Column]) -> Column:
    """Texts of ASCII signs alone, which have as many bytes as letters, need no change."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(change(text))


def fold_accents(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return unless_ascii(text, lambda t: F.regexp_replace(F.translate(t, ACCENTED, PLAIN), "\\p{Mn}", ""))


def norm(text) -> Column:
    """Without accents, in lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(text)), "(?U)\\s+", " "))


def norm_alnum(text) -> Column:
    """Letters and digits in lower case, compatible forms of others among them, one space between words."""
    plain = F.octet_length(text) == F.length(text)
    # only texts with other signs go to Python
    known = F.when(plain, text).otherwise(decomposed(F.when(~plain, text)))
    return F.trim(F.regexp_replace(F.lower(known), "[^a-z0-9]+", " "))


def alnum_words(text: str) -> str:
    """``norm_alnum`` of a word that is known here."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z0-9]+", plain.lower()))


def terms(text, stop: list[str] = STOP_WORDS) -> Column:
    """The terms of a text, in order."""
    found = F.regexp_extract_all(norm(text), F.lit(f"({TERM})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def kw_match(text, keywords: list[str]) -> Column:
    """The keywords that occur as whole words, whatever accents and case, sorted; the text is folded once."""
    plain = {w: " ".join("".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn").lower().split()) for w in sorted(set(keywords))}
    tests = [(w, p, rf"(?U)(?<!\w){re.escape(p)}(?!\w)") for w, p in plain.items() if p]
    if not tests:
        return F.array().cast("array<string>")
    # as the argument of a function the folded text is computed once; what does not contain a word needs no pattern
    hits = lambda base: F.array_compact(F.array(*(F.when(base.contains(p) & base.rlike(pattern), F.lit(w)) for w, p, pattern in tests)))
    return F.flatten(F.transform(F.array(norm(text)), hits))


def unbroken(text) -> Column:
    """Words that a hyphen breaks at the end of a line are joined."""
    return F.regexp_replace(F.replace(text, F.lit("­"), F.lit("")), "-[ \\t]*\\r?\\n[ \\t]*", "")


def clean_page(text) -> Column:
    """Hyphens at line ends joined, control characters and white space collapsed."""
    joined = unbroken(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(joined, "[\\x00-\\x08\\x0b-\\x1f\\x7f]", " "), "(?U)\\s+", " "))


def parse_list(text) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;\\n]"), lambda v: F.trim(v)), lambda v: v != "")


def parse_date(text) -> Column:
    """ISO 8601, else RFC 2822, else a leading date; without a zone it is UTC; else null."""
    plain = F.trim(text)
    mail = F.regexp_replace(plain, "^\\w{3},\\s*", "")
    return F.coalesce(
        plain.try_cast("timestamp"),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.regexp_extract(plain, "^(\\d{4}-\\d{2}-\\d{2})", 1).try_cast("timestamp"),
    )


def phone(*texts) -> Column:
    """The first labelled phone number of several texts, else empty."""
    found = [F.nullif(F.trim(F.regexp_extract(F.coalesce(t, F.lit("")), PHONE, 1)), F.lit("")) for t in texts]
    return F.coalesce(*found, F.lit(""))


def num_coord(text) -> Column:
    value = F.replace(text.cast("string"), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value.between(-180, 180), value)


def digits_only(text, default: str = "") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(text.cast("string"), "\\D", ""), F.lit("")), F.lit(default))


def truthy(text) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "si", "sí", "1", "yes"), F.lit(False))


def safe_name(text, most: int = 80, default: str = "sin_nombre") -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), '[\\\\/:*?"<>|\\x00-\\x1f]', " "), "\\s+", " ")
    cut = F.rtrim(F.substring(F.regexp_replace(plain, "^[ .]+|[ .]+$", ""), 1, most))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def time_hhmm(text) -> Column:
    """HH:MM with zeros, else null."""
    plain = F.trim(text)
    hour, minute = (F.regexp_extract(plain, "^(\\d{1,2}):(\\d{2})$", i).try_cast("int") for i in (1, 2))
    return F.when((hour < 24) & (minute < 60), F.format_string("%02d:%02d", hour, minute))


def preview_value(text, most: int = 200) -> Column:
    size = F.length(text)
    longer = F.concat(F.substring(text, 1, most), F.lit("… (+"), (size - most).cast("string"), F.lit(" caracteres)"))
    return F.when(size > most, longer).otherwise(text)


def csv_cell(value, kind: str, most: int = 32000, escape_formulas: bool = True) -> Column:
    """A cell as text: null is empty; booleans in words; nested values as JSON; formulas disarmed in strings only."""
    if kind == "boolean":
        text = F.when(value, "true").otherwise("false")
    elif kind.startswith(("array", "struct", "map")):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    text = F.substring(text, 1, most)
    if escape_formulas and kind == "string":
        text = F.when(text.rlike(FORMULA), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(value.isNull(), F.lit("")).otherwise(text)


def mask_needles(text, needles: list[str]) -> Column:
    """Known secrets of four characters or more, replaced by ``***``."""
    for needle in needles:
        if len(needle) >= 4:
            text = F.replace(text, F.lit(needle), F.lit("***"))
    return text


def tmpl_refs(text) -> Column:
    """The different root names that a template's expressions use, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("\\{\\{\\s*([^.\\[\\]|}]+)"), F.lit(1)), lambda v: F.trim(v))))


def json_path(value, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(value), f"$.{path}", kind)


def verified_share(address, source) -> Column:
    """Share of the address's words of three letters or more that the source has; one without words counts as 1."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(fold_accents(F.coalesce(c, F.lit("")))), F.lit("([a-z0-9]{3,})"), F.lit(1)))
    a = words(address)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, words(source))) / F.size(a))


def fold_1to1(text) -> Column:
    """Without accents, in lower case, letter for letter, so that places in the text stay."""
    return F.lower(unless_ascii(text, lambda t: F.translate(t, ACCENTED, PLAIN)))


@arrow("string")
def compatible(text: pd.Series) -> pd.Series:
    """NFKC of a text."""
    return text.map(lambda t: t and unicodedata.normalize("NFKC", t))


@arrow("string")
def decomposed(text: pd.Series) -> pd.Series:
    """NFKD of a text without its combining characters."""
    return text.map(lambda t: t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@arrow("string")
def unescaped(text: pd.Series) -> pd.Series:
    """A text with its HTML entities as characters."""
    return text.map(lambda t: t and html.unescape(t))


def squeezed(text) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def clean_text(text) -> Column:
    """Compatible forms composed, format characters dropped, white space collapsed."""
    return squeezed(F.regexp_replace(compatible(F.coalesce(text, F.lit(""))), "\\p{Cf}", ""))


def norm_compat(text) -> Column:
    """``norm`` that takes compatible forms apart too."""
    return squeezed(F.lower(decomposed(F.coalesce(text, F.lit("")))))


def unescape_clean(text) -> Column:
    return squeezed(unescaped(F.coalesce(text, F.lit(""))))


def sheet_cell(value, kind: str, most: int = 32767) -> Column:
    """A cell of a spreadsheet as text: no control characters, cut at the limit; no number for NaN and infinity."""
    if kind in ("double", "float"):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value.cast("string"))
    text = F.to_json(value) if kind.startswith(("array", "struct", "map")) else value.cast("string")
    return F.substring(F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""), 1, most)
