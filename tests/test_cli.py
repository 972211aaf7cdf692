"""The command line from raw records to selections, and the batch's attempts."""

import json

from pyspark.sql import functions as F

from loomset import cli, schemas
from loomset.plans import attempts
from tests.test_operators import issue


def test_from_raw_records_to_seeds(spark, tmp_path, capsys):
    for name, ids in (("full", range(6)), ("lite", range(3))):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(issue(i, repo=f"r{i % 3}/x")) for i in ids))
    cli.main(["dedup", "--source", f"full={tmp_path}/full.jsonl", "--source", f"lite={tmp_path}/lite.jsonl", "--out", f"{tmp_path}/issues"])
    rows = spark.read.parquet(f"{tmp_path}/issues").collect()
    assert sorted((r.instance_id, r.source_name) for r in rows) == [(f"i-{i}", "lite" if i < 3 else "full") for i in range(6)]
    cli.main(["pool", "--input", f"{tmp_path}/issues", "--out", f"{tmp_path}/pool"])
    assert spark.read.parquet(f"{tmp_path}/pool/candidates").count() == 6
    cli.main(["seeds", "--input", f"{tmp_path}/pool/pool", "--out", f"{tmp_path}/seeds", "--target", "4", "--per-repo", "1"])
    assert spark.read.parquet(f"{tmp_path}/seeds").count() == 3
    cli.main(["prefilter", "--input", f"{tmp_path}/pool/pool", "--out", f"{tmp_path}/pre"])
    assert "prefilter_decision" in spark.read.parquet(f"{tmp_path}/pre").columns
    cli.main(["tasks", "--input", f"{tmp_path}/full.jsonl", "--out", f"{tmp_path}/tasks"])
    assert spark.read.json(f"{tmp_path}/tasks").count() == 6
    (tmp_path / "s.jsonl").write_text('{"task_id": "a", "resolved": true, "tests_passed": true, "intent": 1.0, "dialogue": 0.5}\n{"task_id": "b", "resolved": false, "tests_passed": true, "intent_matched": false}')
    cli.main(["leaderboard", "--input", f"{tmp_path}/s.jsonl"])
    assert "| 1 | 2 | 0.5 |" in capsys.readouterr().out
    cli.main(["score", "--input", f"{tmp_path}/s.jsonl", "--out", f"{tmp_path}/report"])
    got = {r.task_id: (r.resolved, round(r.intermediate_score, 5)) for r in spark.read.json(f"{tmp_path}/report").collect()}
    assert got == {"a": (True, 0.81818), "b": (False, 0.0)}


def test_attempts(spark):
    rows = [("a", 1, "manual_review_required", "semantic_reviewer", "semantic_reviewer"), ("a", 2, "accepted", "done", None), ("b", 1, "manual_review_required", "x", "no_supported_revision_fact"), ("c", 1, "manual_review_required", "s", "invalid_noisy_revision_event_plan"), ("d", 1, "accepted", "", None)]
    df = spark.createDataFrame([(*r, None, None, 1) for r in rows], schemas.RELATIONS["attempts"])
    state = {r.instance_id: r for r in attempts.instance_state(df).collect()}
    assert state["a"].accepted_after_retry and not state["d"].accepted_after_retry and state["b"].filter_reason == "weak_or_missing_revision_evidence" and state["b"].review_mode == "auto_filter"
    assert [tuple(r) for r in attempts.to_retry(df).collect()] == [("c", 2)]
    assert sorted(r.instance_id for r in attempts.to_run(df.select("instance_id").distinct(), df).collect()) == ["b", "c"]


def test_stage_routing(spark):
    def route(step, message, blob=""):
        return spark.range(1).select(attempts.stage_outcome(step, F.array(F.lit(message)), F.lit(blob)).alias("o")).first().o

    assert route("fact_extraction", "fact_units[0].source_span is not aligned to source").reason == "fact_grounding_validation_failed" and route("fact_extraction", "issue_summary is empty") is None
    assert route("realistic_utterance_realization", "utterances[0] leaks forbidden implementation/benchmark text", "the gold").status == "rejected"
    assert route("realistic_utterance_realization", "utterances[0] contains template artifact wording").reason == "utterance_template_artifact"
    assert route("initial_report_plan", "initial_report must withhold at least one later source-grounded unit").reason == "no_withheld_units_for_later_refinement"
    assert route("noisy_revision_event_plan", "turns[0].turn_id must be T1").reason == "invalid_noisy_revision_event_plan" and route("semantic_reviewer", "x") is None


def test_uncertainty_and_probe(spark):
    units = "array<struct<unit_id: string, type: string, text: string, active_by_default: boolean, expose_to_user: boolean>>"
    cases = [([("U1", "symptom", "x", True, True)], "Am I missing something?", ["U1", "U999"]), ([("U1", "ambiguity_or_correction", "x", True, True)], "Is this expected?", ["U999"]), ([("U1", "symptom", "x", True, True)], "It crashes.", ["U1"]), ([("U999", "symptom", "x", True, True), ("U4", "symptom", "y", True, True)], "Is it intended?", ["U5", "U4", "U999"])]
    for u, source, want in cases:
        df = spark.createDataFrame([(u, source)], f"u {units}, s string")
        assert [x.unit_id for x in df.select(attempts.with_uncertainty(F.col("u"), F.col("s")).alias("v")).first().v] == want
    probe = spark.createDataFrame([("m", "d", n, "t", False, "empty_response" if i < k else None, 0, 0, 1.0) for n, k in ((100, 3), (200, 1), (300, 0)) for i in range(3)], schemas.RELATIONS["probe"])
    r = attempts.probe_trend(probe).first()
    assert (r.empty_trend, list(r.ns)) == ("falls", [3, 1, 0]) and "fewer" in attempts.recommend(["m / non_reasoning_json"], "falls", [])[2]


def test_schemas_parse(spark):
    for ddl in schemas.RELATIONS.values():
        assert spark.createDataFrame([], ddl).count() == 0
