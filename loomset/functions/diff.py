"""Unified diffs, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.functions.paths import canonical_path
from loomset.functions.text import lines


def diff_files(c: Column) -> Column:
    """The new paths of a diff in order, each once."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?dm)^diff --git a/(.*?) b/(.*?)$"), F.lit(2))
    return F.array_distinct(F.filter(F.transform(found, canonical_path), lambda p: ~p.isin("", "/dev/null")))


def diff_counts(c: Column) -> Column:
    """struct(added, removed, hunks): + but not +++, - but not ---, @@."""
    count = lambda test: F.size(F.filter(lines(c), test)).cast("int")
    return F.struct(
        count(lambda x: x.startswith("+") & ~x.startswith("+++")).alias("added"), count(lambda x: x.startswith("-") & ~x.startswith("---")).alias("removed"),
        count(lambda x: x.startswith("@@")).alias("hunks"),
    )


def size_bucket(changed: Column, ladder: str = "pool") -> Column:
    """small, medium, large (and very_large in the pool's ladder); test patches have two steps."""
    if ladder == "test":
        return F.when(changed <= 80, "small").otherwise("medium")
    out = F.when(changed <= 40, "small").when(changed <= 160, "medium")
    return out.when(changed <= 500, "large").otherwise("very_large") if ladder == "pool" else out.otherwise("large")


def leakage_level(changed: Column, files: Column) -> Column:
    return F.when((files > 8) | (changed > 500), "high").when((changed > 160) | (files > 3), "medium").otherwise("low")


_NAME = r"([A-Za-z_][A-Za-z0-9_]*)"


def context_symbol(c: Column, style: str = "pool") -> Column:
    """The symbol named in a line, or null. pool: the first def or class; gold: a def with its bracket before any class."""
    find = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    if style == "pool":
        return find(rf"\b(?:def|class)\s+{_NAME}\b")
    return F.coalesce(find(rf"\bdef\s+{_NAME}\s*\("), find(rf"\bclass\s+{_NAME}"))


def diff_symbols(c: Column, style: str = "pool") -> Column:
    """file::symbol of each changed part, sorted and distinct; file::<module> where no symbol is named.

    One fold over the lines of a diff: a part starts at a file or hunk line; a def or class in a changed line overrides the hunk
    header's; a part without a changed line tells nothing.
    """
    state = F.struct(
        F.lit("").alias("file"), F.lit(None).cast("string").alias("symbol"), F.lit(False).alias("changed"), F.array().cast("array<string>").alias("out")
    )
    told = lambda s: F.when(s["changed"] & (s["file"] != ""), F.concat(s["out"], F.array(F.concat(s["file"], F.lit("::"), F.coalesce(s["symbol"], F.lit("<module>")))))).otherwise(s["out"])
    none = F.lit(None).cast("string")

    def made(file, symbol, changed, out):
        return F.struct(file.alias("file"), symbol.alias("symbol"), changed.alias("changed"), out.alias("out"))

    def step(s, x):
        is_file = x.startswith("diff --git ")
        is_hunk = x.startswith("@@")
        is_change = (x.startswith("+") & ~x.startswith("+++")) | (x.startswith("-") & ~x.startswith("---"))
        file = canonical_path(F.regexp_extract(x, r"^diff --git a/.*? b/(.*)$", 1))
        header = context_symbol(F.regexp_extract(x, r"^@@ .*? @@\s*(.*)$", 1), style)
        return (
            F.when(is_file, made(file, none, F.lit(False), told(s)))
            .when(is_hunk, made(s["file"], header, F.lit(False), told(s)))
            .when(is_change, made(s["file"], F.coalesce(context_symbol(F.substr(x, F.lit(2)), style), s["symbol"]), F.lit(True), s["out"]))
            .otherwise(s)
        )

    return F.aggregate(lines(c), state, step, lambda s: F.array_sort(F.array_distinct(told(s))))
