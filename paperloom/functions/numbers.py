"""Numbers in table cells: what counts as one, in which format, and its value."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import WIDE, col

#: Label, thousands mark, decimal mark; in order of preference.
FORMATS = (("en", ",", "."), ("eu", ".", ","), ("fr", " ", ","), ("ch", "'", "."))
#: Hints and the format they stand for.
HINTS = {
    "en": "en", "en-au": "en", "en-us": "en", "en-gb": "en",
    "de": "eu", "de-de": "eu", "it": "eu", "it-it": "eu", "es": "eu", "es-es": "eu", "nl": "eu", "pt": "eu", "pt-br": "eu",
    "fr": "fr", "fr-fr": "fr",
    "ch": "ch", "de-ch": "ch",
}
#: Currency codes, and symbols in the order they are looked for (None: the default currency).
CODES = ("AUD", "USD", "EUR", "GBP", "NZD", "SGD", "JPY", "CAD", "CHF", "INR")
SYMBOLS = (("$", None), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("A$", "AUD"), ("US$", "USD"))
CODE = rf"\b({'|'.join(CODES)})\b"
LITERAL = WIDE + r"^[\s$€£¥+\-(]*\d[\d\s.,' ]*\)?\s*%?\s*$"
NUMBER_CHARS = WIDE + r"^[\d\s.,' -]+$"


def is_numeric_literal(x) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), CODE, ""), WIDE + r"^\s+|\s+$", "")
    return (body != "") & body.rlike(LITERAL)


def has_currency(x) -> Column:
    return F.coalesce(col(x), F.lit("")).rlike(rf"[$€£¥]|{CODE}")


def looks_like_money(x) -> Column:
    return has_currency(x) & is_numeric_literal(x)


def looks_like_percent(x) -> Column:
    return F.contains(F.coalesce(col(x), F.lit("")), F.lit("%")) & is_numeric_literal(x)


def currency(x, default: str = "AUD") -> Column:
    x = F.coalesce(col(x), F.lit(""))
    found = F.coalesce(F.nullif(F.regexp_extract(x, CODE, 1), F.lit("")), F.when(F.lit(False), F.lit("")))
    for symbol, code in SYMBOLS:
        found = F.coalesce(found, F.when(F.contains(x, F.lit(symbol)), F.lit(code or default)))
    return F.coalesce(found, F.lit(default))


def bare_number(x) -> Column:
    """Without what stands before the first digit or sign and after the last number character."""
    cut = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"^[^\d+-]+", "")
    return F.regexp_replace(cut, WIDE + r"[^\d.,'\s\x{A0}+-]+$", "")


def cleaned(x) -> Column:
    """What the parsers read; worth a column of its own where a cell is read more than once."""
    return F.regexp_replace(bare_number(x), WIDE + r"^\s+|\s+$", "")


def parse(x, label: str) -> Column:
    """Value of a cell in one format, the double next to it; null if it doesn't fit."""
    return parse_cleaned(cleaned(x), label)


def _shape(thousands: str, decimal: str) -> str:
    """Cells of a format: signs, one run of digits or groups of three, then a fraction with digits.

    A group may hold spaces; marks for thousands may lead, trail and repeat.
    """
    t, d, digit = re.escape(thousands), re.escape(decimal), r"\d" if thousands == " " else r"[\d ]"
    return rf"^(?=.*\d)-*{t}*(?:{digit}*|{digit}{{1,3}}(?:{t}+{digit}{{3}})+){t}*(?:{d}\d+)?$"


def parse_cleaned(bare, label: str) -> Column:
    """One look at the shape, then the text without its marks as a number."""
    thousands, decimal = next((t, d) for name, t, d in FORMATS if name == label)
    bare = col(bare)
    value = F.translate(bare, f"{decimal}{thousands} -", ".").try_cast("double")
    return F.when(bare.rlike(_shape(thousands, decimal)), F.when(bare.startswith("-"), -value).otherwise(value))


def repair(x) -> Column:
    """Value of a number whose separators were misread: `1.400.66` is 1400.66; null if its groups don't allow it."""
    return repair_cleaned(cleaned(x))


def repair_cleaned(bare) -> Column:
    bare = col(bare)
    negative = bare.startswith("-")
    groups = F.split(F.regexp_replace(F.regexp_replace(bare, r"^[+-]+", ""), WIDE + r"[.,'\s ]+", " "), " ")
    n = F.size(groups)
    middle = F.slice(groups, F.lit(2), F.greatest(n - 2, F.lit(0)))
    sound = (
        (n >= 3) & F.forall(groups, lambda g: g.rlike(r"^\d+$")) & F.length(F.element_at(groups, -1)).between(1, 2)
        & (F.length(F.element_at(groups, 1)) <= 3) & F.forall(middle, lambda g: F.length(g) == 3)
    )
    text = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), F.array_join(F.slice(groups, F.lit(1), F.greatest(n - 1, F.lit(0))), ""), F.lit("."), F.element_at(groups, -1))
    return F.when(sound, text.try_cast("double"))


def hinted(hint) -> Column:
    table = F.create_map(*(F.lit(x) for kv in HINTS.items() for x in kv))
    return table[F.lower(F.trim(F.coalesce(col(hint), F.lit(""))))]


def boolean(x) -> Column:
    t = F.lower(F.trim(col(x)))
    return F.when(t.isin("yes", "true", "y"), F.lit(True)).when(t.isin("no", "false", "n"), F.lit(False))


def parse_in(bare, label) -> Column:
    """Value of a cleaned cell in the format named by a column."""
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, _, _ in FORMATS:
        out = out.when(col(label) == name, parse_cleaned(bare, name))
    return out
