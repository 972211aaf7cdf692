"""Sinks: tables, CSV, JSON lines, documents per key, guarded upserts, logs, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions.text import redact_url
from loomset.operators.upsert import guarded


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, lists of strings joined by ;."""
    out = {}
    for name, kind in df.dtypes:
        out[name] = F.array_join(name, ";") if kind == "array<string>" else F.to_json(name) if kind.startswith(("array", "map", "struct")) else F.col(name)
    return df.select(*(c.alias(n) for n, c in out.items()))


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    flat(df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Nulls are written too."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """A folder for each key; writing some keys again leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy(key).json(path)


def write_outputs(outputs: Mapping[str, DataFrame], base: str) -> None:
    """Several tables under a folder. They may overlap; a shared parent is best kept as a table first."""
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_index(existing: DataFrame, new: DataFrame, path: str, key: str = "instance_id", force: bool = False) -> None:
    """The upserted index, ordered by key; to a place that `existing` isn't read from."""
    guarded(existing, new, key, force).orderBy(key).write.mode("overwrite").option("ignoreNullFields", False).json(path)


#: Statuses that a person looks at.
REVIEWED = ("manual_review_required", "needs_revision", "review_failed", "step_failed", "backtest_failed", "validation_failed")
#: The columns of the review queue, in their order; the second name stands in where the first is null, and of two kinds.
QUEUE = (
    "instance_id", "repo", "status", "normalized_status", "review_mode", "human_review_expected", "filter_reason", "retry_eligible", "retry_policy", "failure_reason", "quality_gate_summary", "suggested_fix", "path",
    "models_used", "escalated_steps",
)
BLANK_FOR_NULL = ("normalized_status", "review_mode", "filter_reason", "retry_policy")


def review_queue(state: DataFrame) -> DataFrame:
    """The instances that a person looks at, in the queue's 15 columns: missing ones are null, models and escalations JSON text."""
    have = dict(state.dtypes)
    column = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    text = lambda n, empty: F.coalesce(F.when(F.size(n) > 0, F.to_json(n)), F.lit(empty)) if n in have and not have[n] == "string" else F.coalesce(column(n), F.lit(empty))
    made = {n: F.coalesce(column(n), F.lit("")) for n in BLANK_FOR_NULL} | {
        "failure_reason": F.coalesce(F.nullif(column("failure_reason"), F.lit("")), column("last_error")), "models_used": text("models_used", "{}"), "escalated_steps": text("escalations", "[]"),
    }
    return flat(state.where(F.col("status").isin(*REVIEWED)).select(*(made.get(n, column(n)).alias(n) for n in QUEUE)))


def call_envelope(calls: DataFrame, allowed_headers: Sequence[str] = ("content-type", "x-request-id", "retry-after")) -> DataFrame:
    """Calls as they may be stored: the prompt's hash for the prompt, addresses without queries, some headers."""
    out = calls.withColumn("prompt_sha256", F.sha2(F.coalesce("prompt", F.lit("")), 256)).drop("prompt")
    if "url" in calls.columns:
        out = out.withColumn("url", redact_url(F.col("url")))
    if "headers" in calls.columns:
        out = out.withColumn("headers", F.map_filter("headers", lambda k, _: F.lower(k).isin(*allowed_headers)))
    return out


def markdown_table(rows: Sequence[Mapping[str, object]]) -> str:
    """A report's table from a few rows of an aggregate."""
    if not rows:
        return ""
    names = list(rows[0])
    body = ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *body])
