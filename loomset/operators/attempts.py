"""Attempt chains, budgets, event numbers and islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset import patterns as P


def attempt_chain(df: DataFrame, key: str, order: Sequence[str], status: str) -> DataFrame:
    """Adds attempt_id (1-based), previous_status, is_last and accepted_after_retry. Attempts stay rows; state is derived."""
    w = Window.partitionBy(key).orderBy(*order)
    out = df.withColumn("attempt_id", F.row_number().over(w)).withColumn("previous_status", F.lag(status).over(w)).withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())
    return out.withColumn("accepted_after_retry", (F.col("attempt_id") > 1) & F.col(status).isin(*P.ACCEPTED) & ~F.coalesce(F.col("previous_status").isin(*P.ACCEPTED), F.lit(False)))


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A key's last attempt, by a pre-aggregated maximum."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def calls_before(calls: Column, order: Sequence[str], within: Sequence[str] = ()) -> Column:
    """Calls of the rows before, for a budget that stops before a row. Without `within` the order is one of all rows."""
    w = (Window.partitionBy(*within) if within else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(calls).over(w), F.lit(0))


def within_budget(df: DataFrame, calls: str, order: Sequence[str], budget: int, parts: int = 256) -> DataFrame:
    """The rows that start before the budget is spent. The first column of the order is a number or a time.

    Running sums by ranges: quantiles of that column cut the order into parts, each part adds up its own rows, and the parts' totals (one row
    each) are carried on. No task gets all rows, and a row's part follows from its value alone, so a task that runs again agrees.
    """
    first = F.col(order[0]) if dict(df.dtypes)[order[0]] not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(F.col(order[0]).cast("timestamp"))
    place = first.cast("double")
    cuts = df.select(place.alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.002)
    bounds = sorted(set(cuts))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= place)) if bounds else F.lit(0)
    ranged = df.withColumn("_range", F.coalesce(F.when(place.isNull(), -1).otherwise(part), F.lit(-1)))
    totals = ranged.groupBy("_range").agg(F.sum(calls).alias("_total"))
    carried = totals.withColumn("_carried", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_carried")
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = ranged.withColumn("_own", F.coalesce(F.sum(calls).over(own), F.lit(0))).join(F.broadcast(carried), "_range")
    return told.withColumn("calls_before", F.col("_own") + F.col("_carried")).where(F.col("calls_before") < budget).drop("_range", "_own", "_carried")


def islands(df: DataFrame, key: str, order: Sequence[str], is_marker: Column, name: str = "island") -> DataFrame:
    """Numbers the stretches that start at a marker; 0 before the first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(is_marker.cast("int")).over(w))
