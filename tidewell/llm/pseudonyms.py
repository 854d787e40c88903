"""Operator 7, PII: format-preserving pseudonyms from a keyed Feistel permutation.

Numbers and dates that pass the check of their kind (Luhn for cards, area and group for social
security numbers, octets for addresses, modulo 97 for IBANs, the calendar for dates) are replaced by
another valid value of the same length and punctuation.  Phone numbers need their format only: those
of the numbering plan go to others of it, those outside it to others outside it.  The value is a
number below the size of its format's domain, a Feistel network permutes it, and walking the cycle
brings it back into the domain.  The same key maps equal values to equal pseudonyms in every
document, and different values of a format to different ones.  Names in mail addresses, access keys
and assigned passwords go the same way, letter for letter and digit for digit.

Dates from 1900 to 2099, which people alive may have to do with, are replaced; other dates stay.

Defined results: a null text stays null and counts nothing; empty texts and texts without values are
unchanged; where values overlap the kind that comes first in ``DETECTORS`` wins, then the earlier one;
lengths never change; texts of any length are taken whole; rows that repeat get the same text each; an
empty table gives an empty result; other columns, of whatever name, are carried through.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, whole

#: The key of the registered query; a real run passes its own secret.
KEY = b"a key for tests"
ROUNDS = 8
KINDS = ("email", "card", "iban", "phone", "ssn", "ip", "date", "secret")


class Feistel:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permute(self, value: int, size: int, tweak: str) -> int:
        """The image of ``value`` under a permutation of range(size)."""
        if size < 2:
            return value
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8
        keyed = [hashlib.blake2b(f"{i} {size} {tweak}".encode(), key=self.key, digest_size=min(64, width)) for i in range(ROUNDS)]
        while True:
            left, right = value >> half, value & mask
            for state in keyed:
                state = state.copy()
                state.update(right.to_bytes(width, "little"))
                digest = state.digest() if width <= 64 else hashlib.shake_256(state.digest()).digest(width)
                left, right = right, left ^ (int.from_bytes(digest, "little") & mask)
            value = left << half | right
            if value < size:
                return value

    def walk(self, value: int, size: int, tweak: str, valid: Callable[[int], bool]) -> int:
        """The next valid value on the cycle of a valid one."""
        value = self.permute(value, size, tweak)
        while not valid(value):
            value = self.permute(value, size, tweak)
        return value

    def letters(self, text: str, tweak: str, hexadecimal: bool = False) -> str:
        """Permute a text within its pattern of digits, letters and other signs."""
        kinds = [HEX if hexadecimal else next((a for a in ALPHABETS if c in a), c) for c in text]
        value, size = 0, 1
        for c, kind in zip(text, kinds, strict=True):
            value, size = value * len(kind) + kind.index(c), size * len(kind)
        value, out = self.permute(value, size, tweak), []
        for kind in reversed(kinds):
            value, digit = divmod(value, len(kind))
            out.append(kind[digit])
        return "".join(reversed(out))


ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = "0123456789abcdef"


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits, in turn, replaced."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def card(f: Feistel, m: re.Match) -> str | None:
    digits = only_digits(m[0])
    if not 13 <= len(digits) <= 19 or luhn_sum(digits) or len(set(digits)) == 1:
        return None
    size = 10 ** (len(digits) - 1)
    # a leading zero is as good as another digit, and the check digit follows from the others
    body = f"{f.permute(int(digits[:-1]), size, 'card'):0{len(digits) - 1}d}"
    return refill(m[0], body + str(-luhn_sum(body + "0") % 10))


def plan_number(digits: str) -> bool:
    return digits[0] > "1" and digits[3] > "1"


def phone(f: Feistel, m: re.Match) -> str | None:
    digits = only_digits(m[0])
    country, national = ("1", digits[1:]) if len(digits) == 11 and digits[0] == "1" else ("", digits)
    if len(national) == 10 and (country or "+" not in m[0]):
        # numbers of the plan and all others have a permutation each, so that both stay one to one
        planned = plan_number(national)
        new = f.walk(int(national), 10**10, "phone" if planned else "phone outside the plan", lambda v: plan_number(f"{v:010d}") == planned)
        return refill(m[0], country + f"{new:010d}")
    if "+" not in m[0] or not 8 <= len(digits) <= 15:
        return None
    rest = digits[2:]
    return refill(m[0], digits[:2] + f"{f.permute(int(rest), 10 ** len(rest), 'phone' + digits[:2]):0{len(rest)}d}")


def ssn_valid(v: int) -> bool:
    area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def ssn(f: Feistel, m: re.Match) -> str | None:
    value = int(only_digits(m[0]))
    return refill(m[0], f"{f.walk(value, 10**9, 'ssn', ssn_valid):09d}") if ssn_valid(value) else None


OCTETS = {1: range(10), 2: range(10, 100), 3: range(100, 256)}


def ip(f: Feistel, m: re.Match) -> str | None:
    parts = m[0].split(".")
    kinds = [OCTETS[len(p)] for p in parts]
    if not all(int(p) in kind for p, kind in zip(parts, kinds, strict=True)):
        return None
    value, size = 0, 1
    for p, kind in zip(parts, kinds, strict=True):
        value, size = value * len(kind) + int(p) - kind[0], size * len(kind)
    value, out = f.permute(value, size, "ip"), []
    for kind in reversed(kinds):
        value, digit = divmod(value, len(kind))
        out.append(str(kind[digit]))
    return ".".join(reversed(out))


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def iban(f: Feistel, m: re.Match) -> str | None:
    plain = m[0].replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or iban_check(country, body) != check:
        return None
    body = f.letters(body, "iban" + country)
    it = iter(country + iban_check(country, body) + body)
    return "".join(c if c == " " else next(it) for c in m[0])


FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73049  # to the end of 2099


def date(f: Feistel, m: re.Match) -> str | None:
    text = m[0]
    a, sign, b, c = m["a"], m["sign"], m["b"], m["c"]
    if len(a) == 4:
        order, widths = "ymd", (2, 2)
    elif len(c) == 4:
        order = "dmy" if int(b) <= 12 else "mdy"
        widths = (len(a), len(b))
    else:
        return None

    def day(y, mo, d):
        try:
            return (datetime.date(int(y), int(mo), int(d)) - FIRST_DAY).days
        except ValueError:
            return -1

    value = {"ymd": lambda: day(a, b, c), "dmy": lambda: day(c, b, a), "mdy": lambda: day(c, a, b)}[order]()
    if not 0 <= value < DAYS or len(a) == 4 and (len(b), len(c)) != (2, 2):
        return None

    def shown(v: int) -> str:
        at = FIRST_DAY + datetime.timedelta(days=v)
        one, two = (at.day, at.month) if order == "dmy" else (at.month, at.day)
        short = f"{one:0{widths[0]}d}{sign}{two:0{widths[1]}d}"
        return f"{at.year}{sign}{at.month:02d}{sign}{at.day:02d}" if order == "ymd" else f"{short}{sign}{at.year}"

    def fits(v: int) -> bool:  # the same widths, and for month first a day that cannot be a month
        new = shown(v)
        return len(new) == len(text) and new.index(sign) == text.index(sign) and (order != "mdy" or (FIRST_DAY + datetime.timedelta(days=v)).day > 12)

    return shown(f.walk(value, DAYS, f"date{order}{widths}", fits)) if fits(value) else None


def email(f: Feistel, m: re.Match) -> str | None:
    name, low = m["name"], m["name"].lower()
    new = f.letters(low, "email" + m["domain"].lower())
    return "".join(n.upper() if c.isupper() else n for c, n in zip(name, new, strict=True)) + m[0][len(name) :]


def secret(f: Feistel, m: re.Match) -> str | None:
    value = m["key"] or m["value"]
    lead = m[0][: len(m[0]) - len(value)]
    if m["key"]:
        return value[:4] + f.letters(value[4:], "key")
    return lead + f.letters(value, "secret", hexadecimal=set(value) <= set(HEX))


#: In order of precedence: (kind, what a text must have, pattern, pseudonym).
DETECTORS: list[tuple[str, str, re.Pattern, Callable]] = [
    ("email", "@", re.compile(r"(?<![\w.+-])(?P<name>[A-Za-z0-9_](?:[A-Za-z0-9_.+-]*[A-Za-z0-9_])?)@(?P<domain>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", re.A), email),
    ("secret", "", re.compile(r"\b(?P<key>(?:AKIA|ASIA)[A-Z0-9]{16})\b|\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9+/_-]{8,})", re.I | re.A), secret),
    ("iban", "", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A), iban),
    ("card", "", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)", re.A), card),
    ("phone", "", re.compile(r"(?<![\w.+(-])(?:\+\d[\d ().-]{6,20}\d|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])", re.A), phone),
    ("ssn", "-", re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A), ssn),
    ("ip", ".", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", re.A), ip),
    ("date", "", re.compile(r"(?<![\w./-])(?P<a>\d{1,4})(?P<sign>[-/.])(?P<b>\d{1,2})(?P=sign)(?P<c>\d{1,4})(?![\w/-]|\.\d)", re.A), date),
]
WORTH_A_LOOK = re.compile(r"[0-9@=:]")


def pseudonymise(text: str, feistel: Feistel) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it had."""
    if not WORTH_A_LOOK.search(text):
        return text, {}
    spans: list[tuple[int, int, str]] = []  # in order, without overlaps
    found: dict[str, int] = {}
    for kind, needs, pattern, replace in DETECTORS:
        if needs not in text:
            continue
        fresh = []
        for m in pattern.finditer(text):
            new = replace(feistel, m)
            if new is None:
                continue
            at = bisect.bisect_left(spans, m.start(), key=lambda span: span[1] - 1)  # the first that ends later
            if at == len(spans) or m.end() <= spans[at][0]:
                fresh.append((m.start(), m.end(), new))
        if fresh:
            found[kind] = len(fresh)
            spans = sorted(spans + fresh)
    if not spans:
        return text, {}
    out, at = [], 0
    for a, b, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), found


def replaced(key: bytes):
    """A pandas UDF: struct of the new text and the number of values of each kind."""
    schema = "text string, " + ", ".join(f"n_{k} int" for k in KINDS)

    @F.pandas_udf(schema)
    def run(texts):
        import pandas as pd

        feistel, rows = Feistel(key), []
        for t in texts:
            new, found = (t, {}) if not t else pseudonymise(t, feistel)
            rows.append((new, *(found.get(k, 0) for k in KINDS)))
        return pd.DataFrame(rows, columns=["text", *(f"n_{k}" for k in KINDS)]).astype({f"n_{k}": "int32" for k in KINDS})

    return run


def with_pseudonyms(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All rows and columns, with pseudonyms in the text."""
    rows = whole(docs, p=replaced(key)(named(docs, text)))
    return rows.select(*(F.col("p.text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


def report(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """doc_id, text, n_values and the number of values of each kind."""
    out = docs.select(F.col("doc_id").alias("doc_id"), replaced(key)(named(docs, text)).alias("p"))
    total = sum((F.col(f"p.n_{k}") for k in KINDS), F.lit(0))
    return out.select("doc_id", "p.text", total.cast("long").alias("n_values"), *(f"p.n_{k}" for k in KINDS))
