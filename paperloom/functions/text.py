"""Text functions as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns whose matches results depend on.
IDENTIFIER = r"\b(?=[A-Z0-9-]{5,})(?=[^\s]*[A-Z])(?=[^\s]*\d)[A-Z0-9][A-Z0-9-]{4,}\b"
CELL_NUMBER = r"[-+]?\d[\d,.]*\d|\d"
CHECK_NUMBER = r"[-+]?\d[\d,.]*"
GRID_NUMERIC = r"^[\s$€£]*[-+]?[\d.,\s]+%?$"
GRID_DATE = r"\b\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\b"
CELL_DATE = r"^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\s*$"
ENUMERATOR = r"^[(\[]?\s*([A-Za-z]{1,3}|\d{1,3})\s*[)\].:]?$"
FENCE = r"(?m)^```(?:html)?|```$"
#: Java's \s is ASCII only without this flag.
WIDE = "(?U)"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x, use) -> Column:
    """use(x), with x worked out once however often it is used."""
    return F.get(F.transform(F.array(col(x)), use), F.lit(0))


def norm_text(x) -> Column:
    """White space (no-break spaces too) as single spaces, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), WIDE + r"\s+", " "))


def escape_html(x) -> Column:
    return F.replace(F.replace(F.replace(col(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def strip_fence(x) -> Column:
    return F.regexp_replace(col(x), FENCE, "")


def identifiers(x) -> Column:
    """Distinct product-code-like tokens."""
    return F.array_distinct(F.regexp_extract_all(col(x), F.lit(IDENTIFIER), 0))


def key_base(label, index) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(label), F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when((base == "") | base.rlike(r"^\d+$"), F.concat(F.lit("col_"), col(index).cast("string"))).otherwise(base)


def numbered(base, nth) -> Column:
    """The nth (from 1) use of a key."""
    return F.when(col(nth) > 1, F.concat(col(base), F.lit("_"), col(nth).cast("string"))).otherwise(col(base))


def derive_keys(labels) -> Column:
    """Column keys of an array of labels, unique by a suffix within equal bases."""
    count = lambda bases, b, i: F.size(F.filter(F.slice(bases, F.lit(1), i + 1), lambda y: y == b))
    return let(F.transform(col(labels), lambda x, i: key_base(x, i)), lambda bases: F.transform(bases, lambda b, i: numbered(b, count(bases, b, i))))


def derived_keys(rows: DataFrame, group: str, order: str, label: str) -> DataFrame:
    """rows with `i`, the place from 0 in the order of each group, and `key`, as derive_keys makes them; groups may be long."""
    placed = rows.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).withColumn("base", key_base(label, "i"))
    return placed.withColumn("key", numbered("base", F.row_number().over(Window.partitionBy(group, "base").orderBy("i")))).drop("base")


def short_lines(x, longest: int = 45) -> Column:
    """Lines (or rows of markup) of more than 2 and fewer than `longest` characters without tags."""
    parts = F.transform(F.split(col(x), r"<tr>|\n"), lambda s: F.regexp_replace(s, WIDE + r"^\s+|\s+$", ""))
    size = F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.length(F.regexp_replace(s, r"<[^>]+>", "")))
    return F.size(F.filter(size, lambda n: (n > 2) & (n < longest)))


def title_label(key) -> Column:
    """A key as a label: underscores as spaces, letters after anything but a letter upper-case."""
    spaced = F.split(F.replace(col(key), F.lit("_"), F.lit(" ")), "")
    step = F.aggregate(
        spaced,
        F.struct(F.lit("").alias("out"), F.lit(False).alias("in_word")),
        lambda s, c: F.struct(F.concat(s["out"], F.when(s["in_word"], F.lower(c)).otherwise(F.upper(c))).alias("out"), c.rlike(r"\p{L}").alias("in_word")),
    )
    return step["out"]


def digits(x) -> Column:
    return F.regexp_replace(col(x), r"\D", "")


def canon_number(x) -> Column:
    kept = F.regexp_replace(col(x), r"[^\d.]", "")
    short = F.when(F.contains(kept, F.lit(".")), F.regexp_replace(F.regexp_replace(kept, r"0+$", ""), r"\.+$", "")).otherwise(kept)
    return F.when(short == "", F.lit("0")).otherwise(short)


def check_numbers(x) -> Column:
    """All matches of CHECK_NUMBER."""
    return F.regexp_extract_all(col(x), F.lit(CHECK_NUMBER), 0)


def check_canon(x) -> Column:
    """canon_number of a match of CHECK_NUMBER, which holds digits, marks and a sign only."""
    kept = F.translate(col(x), "+-,", "")
    return F.when(F.contains(kept, F.lit(".")), F.rtrim(F.rtrim(kept, F.lit("0")), F.lit("."))).otherwise(kept)


def cell_number(x) -> Column:
    """The match of CELL_NUMBER in one of CHECK_NUMBER: without marks behind it, and without a sign before a lone digit."""
    cut = F.rtrim(col(x), F.lit(",."))
    return F.when(F.length(cut) > 2, cut).otherwise(F.ltrim(cut, F.lit("+-")))


def number_digits(x) -> Column:
    """digits of a match of CELL_NUMBER."""
    return F.translate(col(x), "+-,.", "")


def spoken(x) -> Column:
    """Whether norm_text leaves anything."""
    return F.coalesce(col(x), F.lit("")).rlike(WIDE + r"\S")


def canon(x) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col(x), F.lit("")), WIDE + r"\s+", ""))


def similarity(a, b) -> Column:
    """1 minus edit distance over the longer length; equal blanks are 1, one blank is 0."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def row_similarity(a, b) -> Column:
    """Mean similarity of two rows of cells; 0 unless they have the same, non-zero width."""
    a, b = col(a), col(b)
    each = F.zip_with(F.transform(a, norm_text), F.transform(b, norm_text), similarity)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(F.lit(0.0))


def replace_all(x, pairs) -> Column:
    """Apply an array of struct(old, new) to a text one after the other."""
    return F.aggregate(col(pairs), col(x), lambda s, p: F.replace(s, p["old"], p["new"]))


def any_of(x: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words))
