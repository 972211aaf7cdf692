"""Command line: python -m loomset.cli COMMAND ..., or through spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomset import schemas
from loomset.operators import aggregates, metrics
from loomset.operators.dedup import priority_dedup
from loomset.operators.quota import select_diverse
from loomset.plans import attempts, construct, gate, prefilter, release, scoring
from loomset.session import session
from loomset.sources import readers, sinks


def dedup(spark: SparkSession, a: argparse.Namespace) -> None:
    sources = dict(x.split("=", 1) for x in a.source)
    raw = {name: readers.json_lines(spark, path) for name, path in sources.items()}
    priority_dedup(readers.union_sources(raw), "instance_id", "source_name", "ordinal").drop("ordinal").write.mode("overwrite").parquet(a.out)


def pool(spark: SparkSession, a: argparse.Namespace) -> None:
    made = scoring.pool_features(spark.read.parquet(a.input))
    made.write.mode("overwrite").parquet(f"{a.out}/pool")
    outputs = scoring.pool_outputs(spark.read.parquet(f"{a.out}/pool"))
    sinks.write_outputs({k: v for k, v in outputs.items() if k != "pool"}, a.out)


def seeds(spark: SparkSession, a: argparse.Namespace) -> None:
    held = scoring.not_rejected(spark.read.parquet(a.input))
    select_diverse(held, scoring.seed_order(), "repo", "domain", a.target, a.per_repo, a.domain_share).write.mode("overwrite").parquet(a.out)


def run_prefilter(spark: SparkSession, a: argparse.Namespace) -> None:
    prefilter.prefilter(spark.read.parquet(a.input)).write.mode("overwrite").parquet(a.out)


def run_gate(spark: SparkSession, a: argparse.Namespace) -> None:
    gate.gate(spark.read.schema(gate.INPUT).json(a.input)).write.mode("overwrite").parquet(a.out)


def funnel(spark: SparkSession, a: argparse.Namespace) -> None:
    state = attempts.instance_state(spark.read.schema(schemas.RELATIONS["attempts"]).json(a.input))
    rows = aggregates.funnel(state, F.col("status"), F.col("normalized_status"), F.col("accepted_after_retry")).orderBy("status").collect()
    print(sinks.markdown_table([r.asDict() for r in rows]))


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    state, quality = spark.read.parquet(a.state), spark.read.parquet(a.quality)
    docs, _ = release.collect_exportable(state, spark.read.parquet(a.input), quality)
    made = release.release(docs, quality, spark.read.parquet(a.index), spark.read.parquet(a.rows), force=a.force)
    sinks.write_outputs(made, a.out)


def tasks(spark: SparkSession, a: argparse.Namespace) -> None:
    construct.tasks(readers.normalised(readers.json_lines(spark, a.input))).write.mode("overwrite").json(a.out)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    attempts.task_report(spark.read.schema(schemas.RELATIONS["scores"]).json(a.input)).write.mode("overwrite").json(a.out)


def localize(spark: SparkSession, a: argparse.Namespace) -> None:
    held = spark.read.parquet(a.input)
    metrics.report(held, {"file": ("pred_files", "gold_files", False), "function": ("pred_functions", "gold_functions", True)}).write.mode("overwrite").parquet(a.out)


def leaderboard(spark: SparkSession, a: argparse.Namespace) -> None:
    held = spark.read.schema(schemas.RELATIONS["scores"]).json(a.input).withColumn("file", F.col("_metadata.file_path"))
    print(sinks.markdown_table([r.asDict() for r in aggregates.leaderboard(held, "file", F.col("resolved")).orderBy(F.desc("rate"), "file").collect()]))


COMMANDS = {"dedup": dedup, "pool": pool, "seeds": seeds, "prefilter": run_prefilter, "gate": run_gate, "funnel": funnel, "export": export, "tasks": tasks, "score": score, "localize": localize, "leaderboard": leaderboard}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomset", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        if name == "dedup":
            p.add_argument("--source", action="append", required=True, help="name=path; may be given several times, in load order")
        else:
            p.add_argument("--input", required=True)
        if name not in ("funnel", "leaderboard"):
            p.add_argument("--out", required=True)
        if name == "seeds":
            p.add_argument("--target", type=int, default=20)
            p.add_argument("--per-repo", type=int, default=2)
            p.add_argument("--domain-share", type=float, default=0.3)
        if name == "export":
            for o in ("state", "quality", "index", "rows"):
                p.add_argument(f"--{o}", required=True)
            p.add_argument("--force", action="store_true")
    a = parser.parse_args(argv)
    COMMANDS[a.command](session(f"loomset {a.command}"), a)


if __name__ == "__main__":
    main()
