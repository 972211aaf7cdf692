"""Index upserts and idempotent writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key the new row replaces the old as a whole."""
    old = existing.select(F.col(key).alias("_k"), F.struct(*existing.columns).alias("_old"))
    add = new.select(F.col(key).alias("_k"), F.struct(*existing.columns).alias("_new"))
    return old.join(add, "_k", "full").select(F.coalesce("_new", "_old").alias("_row")).select("_row.*")


def content_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def conflicts(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose content would change: (key, old_hash, new_hash)."""
    columns = [c for c in existing.columns if c != key]
    old, add = existing.select(key, content_hash(columns).alias("old_hash")), new.select(key, content_hash(columns).alias("new_hash"))
    return old.join(add, key).where("old_hash <> new_hash")


def guarded(existing: DataFrame, new: DataFrame, key: str, force: bool = False) -> DataFrame:
    """The upsert, or an error naming keys that it would change, unless forced."""
    if not force and (bad := [r[key] for r in conflicts(existing, new, key).limit(5).collect()]):
        raise ValueError(f"different content under existing keys: {bad}")
    return upsert(existing, new, key)
