"""The session that the library's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loomset", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """UTC, ANSI, adaptive plans; last value wins where maps are merged. On a cluster leave master and partitions to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    return builder.config(map=settings).getOrCreate()
