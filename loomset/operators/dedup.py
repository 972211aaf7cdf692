"""First-wins deduplication and latest-wins state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset import patterns as P


def source_priority(c: Column, table: Mapping[str, int] = P.SOURCE_PRIORITY, unknown: int = 99) -> Column:
    """A source's rank; unknown ones come last."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), F.lit(unknown))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. The rank limit is pushed below the shuffle (WindowGroupLimit), so copies of a hot key go no further than their task."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def priority_dedup(df: DataFrame, key: str, source: str, ordinal: str) -> DataFrame:
    """One row per key: the best source, then the first loaded. Rows without a key are dropped."""
    held = df.where(F.coalesce(F.trim(F.col(key)), F.lit("")) != "")
    return first_by(held, [key], [source_priority(F.col(source)), F.col(ordinal)])


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_by(df, keys, [F.col(c).desc() for c in order])
