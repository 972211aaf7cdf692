"""Lists in strings, arrays, safe casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.functions.text import strip

_EMPTY = ("", "nan", "none", "null", "[]")


def parse_list(c: Column, brackets: bool = True) -> Column:
    """A JSON list; else [a, b] split at commas without quotes (if `brackets`); else the text alone. Empty for null and its spellings."""
    text = strip(F.coalesce(c, F.lit("")))
    parsed = F.from_json(text, "array<string>")
    inner = F.transform(F.split(F.regexp_replace(text, r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(strip(x), "^['\"]+|['\"]+$", ""))
    out = F.when(F.lower(text).isin(*_EMPTY), F.array().cast("array<string>")).when(parsed.isNotNull() & text.startswith("["), F.filter(parsed, lambda x: x.isNotNull()))
    if brackets:
        out = out.when(text.startswith("[") & text.endswith("]"), F.filter(inner, lambda x: x != ""))
    return out.otherwise(F.array(text))


def strict_list(c: Column) -> Column:
    """A JSON list, or an error."""
    parsed = F.from_json(c, "array<string>")
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("not a JSON list")))


def list_count(c: Column) -> Column:
    """How many things a value stands for: digits are the number itself, a list its length, other text one."""
    text = strip(F.coalesce(c, F.lit("")))
    parsed = F.from_json(text, "array<string>")
    return (
        F.when(F.lower(text).isin("", "nan", "none", "null"), 0).when(text.rlike("^[0-9]+$"), F.expr("0") + F.coalesce(text.try_cast("int"), F.lit(0)))
        .when(text.startswith("[") & parsed.isNotNull(), F.size(parsed)).when(text.startswith("["), F.size(F.split(text, ","))).otherwise(1)
    ).cast("int")


def split_paths(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;\n,]+"), strip), lambda x: x != "")


def ordered_distinct(c: Column) -> Column:
    """Trimmed, without blanks, in first-seen order."""
    return F.array_distinct(F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != "")))


def safe_int(c: Column, default: int = 0) -> Column:
    """Through a double, cut towards zero; the default where that fails."""
    number = c.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("int"), F.lit(default))


def as_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def longest_first(c: Column) -> Column:
    """By falling length; equal lengths in their order."""
    ranked = F.transform(c, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda r: r["x"])


def next_number(ids: Column, prefix: str = "U") -> Column:
    """The prefix with one more than the largest number that it has in `ids`."""
    found = F.filter(F.transform(ids, lambda x: F.regexp_extract(x, rf"^{prefix}([0-9]+)$", 1)), lambda x: x != "")
    return F.concat(F.lit(prefix), F.coalesce(F.array_max(F.transform(found, lambda x: x.cast("int"))), F.lit(0)) + 1)
