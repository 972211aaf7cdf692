"""Incremental forms: live funnel, event windows, upserts by micro-batch, attempts with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomset.operators.upsert import upsert
from loomset.plans.status import normalized


def event_counts(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Events and their values by window and type; on a stream with a bound for late ones."""
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        held = held.withWatermark("ts", late or "1 hour")
    counted = held.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    held = events.withColumn("ts", F.col("ts").cast("timestamp"))
    held = held.withWatermark("ts", late) if events.isStreaming else held
    out = held.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def live_funnel(attempts: DataFrame) -> DataFrame:
    """Counts by status of an append-only log; for the update or complete mode."""
    return attempts.groupBy(normalized(F.col("status")).alias("normalized_status")).agg(F.count("*").alias("n"))


def stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def upsert_batches(updates: DataFrame, path: str, key: str, checkpoint: str, order: str | None = None):
    """Keeps an index up to date: of a micro-batch's rows of a key that with the greatest `order` counts (where it is told; of equals, and without
    it, the one whose content sorts last). Versions alternate between two folders, so a batch that runs again reads what it read before."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old, new = f"{path}/v{(number + 1) % 2}", f"{path}/v{number % 2}"
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*([order] if order else []), *(c for c in batch.columns if c not in (key, order)))).alias("r")).select("r.*")
        known = spark.read.schema(batch.schema).parquet(old) if number else batch.limit(0)
        upsert(known, latest, key).write.mode("overwrite").parquet(new)

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHAIN = "instance_id string, attempts int, last_status string, accepted_after_retry boolean"


def attempt_states(attempts: DataFrame) -> DataFrame:
    """A stream's attempt chains by instance: how many, the last status, whether a retry was ever accepted."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, status, retried = state.get if state.exists else (0, None, False)
        for s in pd.concat(list(batches)).sort_values("attempt_id")["status"]:  # a key's attempts in a micro-batch are a few
            retried = retried or (n > 0 and s == "accepted" and status != "accepted")
            n, status = n + 1, s
        state.update((n, status, retried))
        yield pd.DataFrame([(key[0], n, status, retried)], columns=["instance_id", "attempts", "last_status", "accepted_after_retry"])

    return attempts.groupBy("instance_id").applyInPandasWithState(step, CHAIN, "n int, status string, retried boolean", "update", GroupStateTimeout.NoTimeout)
