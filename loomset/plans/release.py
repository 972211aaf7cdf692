"""From attempts and documents to a release: exportable instances, views, index, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.operators.aggregates import manifest, value_counts
from loomset.operators.upsert import content_hash, guarded
from loomset.plans.views import agent_view, evaluator_view, exportable


def collect_exportable(state: DataFrame, documents: DataFrame, quality: DataFrame, key: str = "instance_id") -> tuple[DataFrame, DataFrame]:
    """(documents of exportable instances with their quality, status counts of all)."""
    held = state.where(exportable(F.col("status"))).select(key, F.col("status").alias("export_status"))
    return documents.join(held, key).join(quality, key, "left"), value_counts(state, "status")


def provenance(documents: DataFrame, run: str, at: str = "") -> DataFrame:
    """One row per promoted instance: where it came from and the hash of what was promoted."""
    columns = [c for c in documents.columns if c != "instance_id"]
    return documents.select("instance_id", F.struct(F.lit(run).alias("source_run"), content_hash(columns).alias("content_sha256"), F.lit(at).alias("promoted_at")).alias("provenance"))


def interactive_results(results: DataFrame) -> dict[str, DataFrame]:
    """Patches, traces with event numbers in order, and scores of interactive runs."""
    placed = results.select("task_id", F.posexplode("trace").alias("at", "event"))
    return {"patch": results.select("task_id", "patch"), "trace": placed.select("task_id", (F.col("at") + 1).alias("event_id"), "event"), "scores": results.select("task_id", "scores")}


def release(documents: DataFrame, quality: DataFrame, index: DataFrame, rows: DataFrame, run: str = "run_id", force: bool = False) -> dict[str, DataFrame]:
    """The release's tables. The index replaces whole rows, and refuses changed content unless forced."""
    return {"agent": agent_view(documents), "evaluator": evaluator_view(documents, quality), "index": guarded(index, rows, "instance_id", force), "manifest": manifest(rows, run)}
