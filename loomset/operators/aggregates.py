"""Counters, shares, summaries, leaderboards. All are pre-aggregated by key; none gathers rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multi_counter(df: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """(counter, key, n) of several keys in one pass over the rows: each row is expanded to its keys and counted where it is."""
    pairs = F.array(*(F.struct(F.lit(n).alias("counter"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("key")) for n, c in keys.items()))
    return df.select(F.inline(pairs)).groupBy("counter", "key").agg(F.count("*").alias("n"))


def exploded_counts(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    return df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def share_percent(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds the share of each count in percent, to one place. For the few rows of an aggregate: they meet in one window."""
    total = F.greatest(F.sum(n).over(Window.partitionBy(F.lit(0))), F.lit(1))
    return counts.withColumn("percent", F.round(100.0 * F.col(n) / total, 1))


def ratio(test: Column) -> Column:
    return F.coalesce(F.count_if(test) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    key = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("unknown"))
    return df.groupBy(key.alias(column)).agg(F.count("*").alias("n"))


def source_summary(df: DataFrame, source: str, entity: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("rows"), F.countDistinct(entity).alias("entities"))


def step_stats(calls: DataFrame, keys: Sequence[str], error: str, ordinal: str, counters: Sequence[str], sums: Sequence[str] = (), models: str | None = None, latest: Sequence[str] = ()) -> DataFrame:
    """Per key: calls, one count for each error kind (others count as unknown), sums, models in first-seen order, last values."""
    known = F.coalesce(F.col(error), F.lit("none"))
    kind = F.when(known.isin("none", *counters), known).otherwise("unknown")
    aggs = [F.count("*").alias("calls"), *(F.count_if(kind == c).alias(c) for c in dict.fromkeys([*counters, "unknown"]))]
    aggs += [F.sum(c).alias(c) for c in sums] + [F.max_by(c, ordinal).alias(f"last_{c}") for c in latest]
    if models:  # the first place of each model: as many entries as there are models
        first = calls.groupBy(*keys, models).agg(F.min(ordinal).alias("_at")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", models))), lambda x: x[models]).alias("models"))
        return calls.groupBy(*keys).agg(*aggs).join(first, list(keys), "left")
    return calls.groupBy(*keys).agg(*aggs)


def quality_summary(df: DataFrame, flags: Sequence[str], verdict: str) -> DataFrame:
    """One row: how many rows, how many of each flag aren't true (null counts as failed), how many verdicts aren't pass."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(~F.col(f).eqNullSafe(True)).alias(f"not_{f}") for f in flags), F.count_if(~F.col(verdict).eqNullSafe("pass")).alias("not_pass"))


def leaderboard(df: DataFrame, key: str, resolved: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count_if(resolved).alias("resolved"), F.count("*").alias("total"), ratio(resolved).alias("rate"))


def probe_summary(df: DataFrame, keys: Sequence[str], ok: Column, empty: Column, seconds: str) -> DataFrame:
    """Per configuration; stable where all tasks succeeded and none was empty."""
    out = df.groupBy(*keys).agg(F.count("*").alias("tasks"), F.count_if(ok).alias("ok"), F.count_if(empty).alias("empty"), F.round(F.avg(seconds), 1).alias("avg_seconds"))
    return out.withColumn("stable", (F.col("ok") == F.col("tasks")) & (F.col("empty") == 0))


def funnel(df: DataFrame, status: Column, normalized: Column, after_retry: Column) -> DataFrame:
    return df.groupBy(status.alias("status"), normalized.alias("normalized_status")).agg(F.count("*").alias("n"), F.count_if(after_retry).alias("accepted_after_retry"))


def projected_calls(candidates: Column, accepted: Column, calls: Column, target: int) -> Column:
    """struct(per_candidate, per_accepted, candidates_needed, calls_needed)."""
    return F.struct(
        F.round(calls / candidates, 2).alias("per_candidate"), F.round(calls / accepted, 2).alias("per_accepted"),
        F.ceil(F.lit(target) * candidates / accepted).alias("candidates_needed"), F.round(F.lit(target) * calls / accepted).cast("bigint").alias("calls_needed"),
    )


def manifest(df: DataFrame, run: str, policy: Mapping[str, str] | None = None) -> DataFrame:
    """One row: rows, the runs in order, the policy."""
    policy_ = F.create_map(*(F.lit(x) for kv in (policy or {}).items() for x in kv)) if policy else F.create_map().cast("map<string,string>")
    return df.agg(F.count("*").alias("records"), F.array_sort(F.collect_set(run)).alias("runs")).withColumn("policy", policy_)
