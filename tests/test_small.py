"""Small surfaces: blobs, scalars, scenarios, environment, provenance, results."""

from pyspark.sql import functions as F

from loomset.functions import nestedtext as N
from loomset.plans import release
from loomset.plans.extensions import judged, run_agent, simulated_user, stub_agent
from loomset.sources import readers


def test_nested_text(spark):
    df = spark.createDataFrame([(("a", [("b", 1), (None, 2)], {"k": "c"}, True, None),)], "x struct<p: string, q: array<struct<r: string, s: int>>, t: map<string, string>, u: boolean, v: double>")
    assert N.with_blob(df, "x").first().blob == "a\nb\n1\n\n2\nc\nTrue\n"
    assert N.nan_to_null(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first() == (None, 1)
    m = spark.createDataFrame([({"a": 1, "b": 2},)], "m map<string, int>")
    assert m.select(N.allowed(F.col("m"), ["a", "z"]).alias("v")).first().v == {"a": 1}
    t = spark.createDataFrame([("one two of the three",), ("short",)], "t string")
    assert [r.v for r in t.select(N.shorten(F.col("t"), 15).alias("v")).collect()] == ["one two", "short"]


def test_sources(spark, tmp_path):
    (tmp_path / "e").write_text("# c\nexport A='1'\nB = two\n\nbad")
    assert readers.environment(str(tmp_path / "e")) == {"A": "1", "B": "two"}
    (tmp_path / "c.json").write_text('{"limit": 3, "other": 1}')
    config = readers.batch_config(str(tmp_path / "c.json"))
    assert (config.limit, config.max_attempts, config.extra) == (3, 2, {"other": 1})
    df = spark.createDataFrame([("a", '{"task_id": "t", "cues": [{"type": "scope", "text": "x"}]}'), ("b", "bad")], "k string, raw string")
    rows = readers.scenarios(df, "raw").collect()
    assert rows[0].scenario.cues[0].type == "scope" and rows[1].scenario is None or rows[1].scenario.task_id is None
    assert readers.lookup(df, "k", "b").count() == 1


def test_results_and_plugins(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "instance_id string, body string")
    rows = {r.instance_id: r.provenance for r in release.provenance(docs, "run1").collect()}
    assert rows["a"].source_run == "run1" and rows["a"].content_sha256 != rows["b"].content_sha256
    made = run_agent(spark.createDataFrame([("t", "r")], "task_id string, repo string"), stub_agent).withColumn("scores", F.lit(1.0))
    out = release.interactive_results(made)
    assert out["trace"].first().event_id == 1 and out["patch"].first().patch == ""
    talk = spark.createDataFrame([("# Expected\nit works", "What do you expect to see? expected?")], "hidden_problem_statement string, agent_message string")
    assert simulated_user(talk).first().reply == "it works"
    r = judged(talk, {"intent": lambda df: F.lit(0.5), "process": None}).first()
    assert r.intent == 0.5 and r.process is None
