"""Scans: JSON lines, CSV as text, documents, state, configuration, model outputs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from loomset.functions.text import first_nonempty, strip
from loomset.operators.dedup import last_by

#: The columns of a normalised issue.
ISSUE_COLUMNS = (
    "instance_id", "repo", "source_name", "hf_dataset", "hf_split", "base_commit", "problem_statement", "hints_text", "created_at", "version", "patch", "test_patch",
    "FAIL_TO_PASS", "PASS_TO_PASS", "fail_to_pass", "pass_to_pass", "issue_url", "pr_url",
)
RAW = T.StructType([T.StructField(c, T.StringType()) for c in (
    "instance_id", "repo", "base_commit", "patch", "test_patch", "problem_statement", "hints_text", "created_at", "version", "environment_setup_commit", "FAIL_TO_PASS", "PASS_TO_PASS",
    "issue_url", "pr_url", "_hf_dataset", "_hf_split", "_source_name")])


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RAW, strict: bool = True, limit: int | None = None) -> DataFrame:
    """One record per line with a given schema (no inference pass). strict: a bad line fails the scan; else it is dropped."""
    out = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return out if limit is None else out.limit(limit)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and text of lines that aren't JSON objects, for diagnosis."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    return lines.where(F.try_parse_json("value").isNull())


def with_ordinal(df: DataFrame) -> DataFrame:
    """Adds the order of rows in the files of a scan, as a struct that sorts: by file, by the split's place in it, and by place in the split.

    Spark packs splits into tasks by size, so the number alone doesn't follow the files; within one split it does. A frame that isn't a scan has
    the number alone.
    """
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    try:
        df.select(file, block)
    except AnalysisException:
        file, block = F.lit(None).cast("string"), F.lit(None).cast("long")
    return df.withColumn("ordinal", F.struct(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("row")))


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, nothing taken for a missing value, cells of any size."""
    out = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "\x00none\x00").option("emptyValue", "").option("maxCharsPerColumn", -1).csv(path)
    return out.na.fill("")


def documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document per file, with its path."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def latest_index(spark: SparkSession, path: str, schema: T.StructType | str, key: str = "instance_id") -> DataFrame:
    """An index of JSON lines; the last row of a key counts."""
    return last_by(with_ordinal(spark.read.schema(schema).json(path)), [key], ["ordinal"]).drop("ordinal")


def normalised(raw: DataFrame, source: str | None = None) -> DataFrame:
    """Raw records in the 18 columns (16 unless spark.sql.caseSensitive is set: two are lower-case copies of others): alternatives merged, ids trimmed,
    lists as JSON text, rows without an id dropped."""
    have = set(raw.columns)
    kinds = dict(raw.dtypes)

    def value(*names: str):
        cols = [F.to_json(n) if kinds[n].startswith("array") else F.col(n).cast("string") for n in names if n in have]
        return first_nonempty(*cols) if cols else F.lit("")

    merged = {
        "source_name": value("_source_name", "source_name") if source is None else F.lit(source), "hf_dataset": value("_hf_dataset", "hf_dataset"), "hf_split": value("_hf_split", "hf_split"),
        "FAIL_TO_PASS": value("FAIL_TO_PASS", "fail_to_pass"), "PASS_TO_PASS": value("PASS_TO_PASS", "pass_to_pass"), "fail_to_pass": value("FAIL_TO_PASS", "fail_to_pass"), "pass_to_pass": value("PASS_TO_PASS", "pass_to_pass"),
        "problem_statement": value("problem_statement", "issue", "text"), "instance_id": strip(value("instance_id", "id")),
    }
    cased = raw.sparkSession.conf.get("spark.sql.caseSensitive")
    names = ISSUE_COLUMNS if cased == "true" else tuple(c for c in ISSUE_COLUMNS if c not in ("fail_to_pass", "pass_to_pass"))
    order = ["ordinal"] if "ordinal" in have else []  # of with_ordinal()
    return raw.select(*(merged.get(c, value(c)).alias(c) for c in names), *order).where(F.col("instance_id") != "")


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Normalised records of several sources in the order given, each with its place: source, then row."""
    out = None
    for n, (name, raw) in enumerate(sources.items()):
        part = normalised(with_ordinal(raw), name).withColumn("ordinal", F.struct(F.lit(n).alias("source"), F.col("ordinal").alias("row")))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class BatchConfig:
    """A batch's settings; what a file leaves out keeps its default."""

    limit: int | None = None
    max_api_calls: int = 0
    timeout_seconds: int = 90
    max_attempts: int = 2
    preserve_input_order: bool = True
    golden_instance: str = ""
    extra: dict = field(default_factory=dict)


def batch_config(path: str) -> BatchConfig:
    """Driver-side: one small YAML or JSON file."""
    import json

    text = Path(path).read_text(encoding="utf-8")
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text) or {}
    names = {f.name for f in fields(BatchConfig)} - {"extra"}
    return BatchConfig(**{k: v for k, v in data.items() if k in names}, extra={k: v for k, v in data.items() if k not in names})


#: What models said, as a table: the engine reads it and never calls a model.
MODEL_OUTPUTS = "instance_id string, attempt_id int, step string, model string, raw_text string, error_type string, status_code int, prompt_tokens int, completion_tokens int"


def model_outputs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_OUTPUTS).json(path)


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """The first row of a key, as a filter that reaches the scan; many keys are a semi-join and not many of these."""
    return df.where(F.col(key) == value).limit(1)


def environment(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a small file, without comments and quotes. Configuration of the driver only."""
    rows = (x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines())
    pairs = (x.removeprefix("export ").partition("=") for x in rows if x and not x.startswith("#") and "=" in x)
    return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}


SCENARIO = "struct<task_id: string, persona: struct<style: string, knowledge: string>, initial_user_query: string, hidden_problem_statement: string, traps: array<struct<type: string, severity: string, text: string>>, cues: array<struct<type: string, text: string>>>"


def scenarios(df: DataFrame, raw: str) -> DataFrame:
    """Scenarios from JSON text, typed; what doesn't parse is null."""
    return df.withColumn("scenario", F.from_json(raw, SCENARIO))
