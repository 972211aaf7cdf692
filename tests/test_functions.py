"""Golden rows of the functions and rule engines."""

import random

import pytest
from pyspark.sql import functions as F

from loomset.functions import diff, jsonx, lists, paths, spans, text
from loomset.operators import metrics, nested
from loomset.plans import prefilter, status
from loomset.plans.delta import state_delta


def one(spark, column, **values):
    """A column's value on a row of string columns."""
    names = list(values) or ["_"]
    row = [tuple(values.values()) or ("",)]
    return spark.createDataFrame(row, ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [("./a/pkg/base.py", "pkg/base.py"), ("b//pkg/./x.py", "/pkg/x.py"), (" pkg\\mod.py ", "pkg/mod.py"), ("a/", ""), ("", ""), ("x/../y", "x/../y"), ("//n/x", "//n/x"), ("///n", "/n")])
def test_paths(spark, raw, want):
    assert one(spark, paths.canonical_path(F.col("x")), x=raw) == want


def test_symbols_and_repositories(spark):
    assert one(spark, paths.canonical_symbol(F.col("x")), x="./pkg/base.py:: Cls.meth ") == "pkg/base.py::Cls.meth"
    assert one(spark, paths.canonical_symbol(F.col("x")), x="no_separator") == "no_separator"
    for repo, slug, domain in [("django/django", "django", "web_framework"), ("scikit-learn__scikit-learn", "scikit-learn", "ml_library"), ("", "unknown", "other"), ("a/django-x", "django-x", "other")]:
        assert (one(spark, paths.repo_slug(F.col("x")), x=repo), one(spark, paths.domain(F.col("x")), x=repo)) == (slug, domain)


PATCH = "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -1,2 +1,2 @@ class A: def b(self)\n-x\n+y\ndiff --git a/n.py b/n.py\n@@ -1 +1 @@\n z\n@@ -3 +3 @@\n+def q(a):\n--- gone\n"


def test_diffs(spark):
    assert one(spark, diff.diff_files(F.col("p")), p=PATCH) == ["m.py", "n.py"]
    assert one(spark, diff.diff_symbols(F.col("p")), p=PATCH) == ["m.py::A", "n.py::q"]
    assert one(spark, diff.diff_symbols(F.col("p"), "gold"), p=PATCH) == ["m.py::b", "n.py::q"]
    assert one(spark, diff.diff_symbols(F.col("p")), p="diff --git a/m.py b/m.py\n@@ -1 +1 @@\n+x") == ["m.py::<module>"]
    assert tuple(one(spark, diff.diff_counts(F.col("p")), p=PATCH)) == (2, 1, 3)
    for n, want in [(40, ("small", "small", "small")), (80, ("medium", "medium", "small")), (81, ("medium", "medium", "medium")), (161, ("large", "large", "medium")), (501, ("very_large", "large", "medium"))]:
        c = F.lit(n)
        assert tuple(one(spark, F.struct(diff.size_bucket(c).alias("a"), diff.size_bucket(c, "summary").alias("b"), diff.size_bucket(c, "test").alias("c")))) == want


def test_lists(spark):
    for raw, want, n in [('["a", "b"]', ["a", "b"], 2), ("[x, 'y']", ["x", "y"], 2), ("one", ["one"], 1), ("NaN", [], 0), ("7", ["7"], 7), ("", [], 0)]:
        assert one(spark, lists.parse_list(F.col("x")), x=raw) == want and one(spark, lists.list_count(F.col("x")), x=raw) == n
    assert one(spark, lists.safe_int(F.col("x"), -1), x="3.7") == 3 and one(spark, lists.safe_int(F.col("x"), -1), x="z") == -1 and one(spark, lists.safe_int(F.col("x"), -1), x="nan") == -1
    a = F.array(F.lit("U2"), F.lit("U10"), F.lit("X"))
    assert one(spark, lists.next_number(a)) == "U11" and one(spark, lists.longest_first(F.array(F.lit("a"), F.lit("bbb"), F.lit("cc"), F.lit("ddd")))) == ["bbb", "ddd", "cc", "a"]


def test_texts(spark):
    t = "<!-- c -->\n## Title # \nBody\n# Steps to Reproduce:\ndo\nthen\n## Next\n```\nTraceback x\n```"
    assert one(spark, text.title(F.col("x")), x=t) == "Title" and one(spark, text.section(F.col("x"), ["reproduce"]), x=t) == "do\nthen"
    assert one(spark, text.error_block(F.col("x")), x=t) == "Traceback x" and one(spark, text.title(F.col("x")), x=" ") == "Repository issue"
    assert one(spark, text.scrub(F.col("x")), x=" the reference  patch in tests/a/b.py and test_x ") == "the implementation details in private test file and private_test"
    assert one(spark, text.patch_of(F.col("x")), x="hi\ndiff --git a b\n+x\n\n") == "diff --git a b\n+x\n" and one(spark, text.patch_of(F.col("x")), x="none") == ""
    assert one(spark, text.public_text(F.col("x")), x="then call a.b(1)  and call c()") == "then trigger that case and trigger that case"
    assert one(spark, text.simulated_reply(F.col("x"), F.lit("Any steps?")), x=t) == "do\nthen" and one(spark, text.revised_reply(F.col("x")), x="I ran it") .startswith("I cannot run")
    assert one(spark, text.uncertain(F.col("x")), x="Am I missing something?") and one(spark, text.initial_query(F.lit("a/b"), F.col("x"), F.lit("impatient")), x="T") == "I need a quick fix for `a/b`. I think the issue is: T."


@pytest.mark.parametrize("x, want", [
    ("Reproduce", ""), ("reproduce\n", ""), ("a\nREPRODUCE it\n  # next\nx", ""), ("a\nreproduce\n\n one \nreproduce again\ntwo\n \n\t# no heading\n # end\nx", "one \nreproduce again\ntwo\n \n\t# no heading"),
    ("# reproduce\n# reproduce\nx", ""), ("no name\n# x", ""), ("", ""), (None, ""),
])
def test_section_bounds(spark, x, want):
    assert one(spark, text.section(F.col("x"), ["steps to", "reproduce"]), x=x) == want


def test_section_takes_its_lines_once(spark):
    """The lines are split once and no lambda holds a column: each would be taken again for every line."""
    plan = spark.createDataFrame([("",)], "x string").select(text.section(F.col("x"), ["reproduce"]).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    n = 20_000
    long = F.concat(F.repeat(F.lit("some line\n"), n), F.lit("reproduce\n"), F.repeat(F.col("x"), n), F.lit("# next\nx"))
    assert one(spark, F.sha2(text.section(long, ["reproduce"]), 256) == F.sha2(F.concat(F.repeat(F.lit("do it\n"), n - 1), F.lit("do it")), 256), x="do it\n")


@pytest.mark.parametrize("x, want", [(" \t\n\r\x0b\x0ca b\x0c\x0b\r\n\t ", "a b"), ("\xa0a\u2028", "\xa0a\u2028"), ("a \u2028", "a \u2028"), (" \n", ""), ("", ""), (None, None)])
def test_strip(spark, x, want):
    assert one(spark, text.strip(F.col("x")), x=x) == want


def test_prefilter_boundaries(spark):
    cases = [
        ((1, 1, 1, 1, 1, 1), 900, 2, True, 6, "keep", 100), ((1, 1, 1, 0, 1, 0), 250, 1, True, 5, "keep", 62), ((1, 1, 1, 0, 1, 0), 250, 1, True, 4, "deprioritize", 62), ((0, 1, 0, 0, 1, 0), 500, 2, True, 3, "deprioritize", 42),
        ((1, 1, 1, 1, 0, 1), 900, 2, True, 5, "reject", 80), ((1, 1, 1, 1, 1, 1), 900, 2, False, 6, "reject", 100),
    ]
    names = list(prefilter.FEATURES)[:6]
    rows = [(*map(bool, f), n, m, g, r) for f, n, m, g, r, _, _ in cases]
    df = spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in names) + ", n int, m int, g boolean, estimated_fact_richness int")
    flags = {n: n for n in names}
    out = prefilter.decide(df, flags, "n", "m", "g", {}).collect()
    assert [(r.prefilter_decision, round(r.prefilter_score * 100)) for r in out] == [(d, h) for *_, d, h in cases]


def test_status_and_retry(spark):
    n = F.lit(None).cast("string")
    b = F.lit(None).cast("boolean")
    reason = lambda failure: status.filter_reason(F.lit(failure), n, n, n, b, b)
    assert one(spark, reason("utterance_template_artifact")) == "utterance_template_artifact"
    assert one(spark, reason("fact_grounding_validation_failed: source_span x")) == "source_span_unmatched_after_retry"
    assert one(spark, reason("semantic_reviewer")) == "semantic_reviewer_not_pass" and one(spark, reason("")) == "quality_gate_manual_review"
    assert one(spark, status.normalized(F.lit("accepted_with_template_dialogue"))) == "accepted" and one(spark, status.normalized(F.lit("manual_review_required"))) == "auto_filtered"
    plan = lambda s, r, ok: one(spark, status.retry(F.lit(s), F.lit(r), F.lit(ok)))
    assert plan("auto_filtered", "utterance_template_artifact", False).policy == "full_chain_retry_once" and plan("auto_filtered", "source_span_unmatched_after_retry", False).policy == "none"
    assert plan("step_failed", "", True).eligible and not plan("step_failed", "", False).eligible and plan("accepted", "", True).reason == "not_applicable"
    assert one(spark, status.transient(F.lit("x"), F.lit(0), F.lit(1))) and not one(spark, status.transient(F.lit("x"), F.lit(1), F.lit(1))) and not one(spark, status.transient(F.lit("an Exception"), F.lit(0), F.lit(1)))


TURN = "array<struct<turn_id: string, operation: string, revises_turns: array<string>, deactivates_claims: array<string>, activates_claims: array<string>, claim_status: string>>"


def test_claim_resolution(spark):
    t = lambda i, op, r=(), d=(), a=(), claim=None: (f"T{i}", op, list(r), list(d), list(a), claim)
    first = t(1, "initial_imperfect_report")
    cases = [
        ([first, t(2, "speculative_hypothesis"), t(3, "correct_previous_claim", ["T2"])], []), ([first, t(2, "speculative_hypothesis"), t(3, "confirm_final_active_intent")], ["T2"]),
        ([first, t(2, "mistaken_clarification"), t(3, "retract_previous_claim", d=["x"])], []), ([first, t(2, "narrow_scope", a=["x"]), t(3, "speculative_hypothesis")], ["T3"]),
        ([first, t(2, "add_detail", claim="mistaken"), t(3, "add_detail", claim="active")], ["T2"]), ([first, t(2, "add_detail", claim="speculative"), t(3, "narrow_scope", a=["x"])], []),
    ]
    for turns, want in cases:
        df = spark.createDataFrame([(turns,)], f"t {TURN}")
        assert df.select(nested.unresolved(F.col("t")).alias("v")).first().v == want


def test_metrics(spark):
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>") if xs else F.array().cast("array<string>")
    cases = [(["x", "y", "z"], ["y"], 0, 1, 1.0, 0.5), (["", "y"], ["y"], 1, 1, 1.0, 1.0), (["x"], [], 0, 0, 0.0, 0.0), (["y", "y", "z"], ["y", "z"], 1, 1, 1.0, 1.0)]
    for pred, gold, h1, h3, r3, mrr in cases:
        p, g = arr(pred), arr(gold)
        assert tuple(one(spark, F.struct(metrics.hit_at(p, g, 1).alias("a"), metrics.hit_at(p, g, 3).alias("b"), metrics.recall_at(p, g, 3).alias("c"), metrics.reciprocal_rank(p, g).alias("d")))) == (h1, h3, r3, mrr)
    p, g = arr(["x"]), arr([])
    assert one(spark, metrics.hit_at(p, g, 1, True)) is None and one(spark, metrics.reciprocal_rank(p, g, True)) is None
    none = F.lit(None).cast("double")
    assert one(spark, metrics.weighted_mean({"intent": F.lit(1.0), "process": none, "dialogue": F.lit(0.5), "exploration": none})) == pytest.approx(0.45 / 0.55)
    assert one(spark, metrics.weighted_mean(dict.fromkeys(("intent", "process", "dialogue", "exploration"), none))) == 0.0


@pytest.mark.parametrize("raw, want", [('```json\n{"ok": true}\n```', "json"), ('{"a": [1, 2,]}', "json_repaired"), ('{"a": [1, 2', "json_repaired"), ('note {"a": 1} end', "json"), ('{"a": "unterminated', "truncated_json"), ("", "invalid_json")])
def test_json_recovery(raw, want):
    ok, kind, found, error = jsonx.recover(raw)
    assert (kind or error) == want and ok == (kind is not None)


def test_json_frames(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"oracle": 2}]}}'), (2, "bad"), (3, "[1]")], "k int, raw string")
    assert {(r.k, r.parsed.format) for r in jsonx.recovered(df, "raw").collect()} == {(1, "json"), (2, None), (3, "json")}
    assert {r.path for r in jsonx.key_paths(df, "k", "raw").collect()} == {"$.a", "$.a.b", "$.a.b[1].oracle"}
    assert [r.v for r in df.select(jsonx.json_kind(F.col("raw")).alias("v")).collect()] == ["object", "invalid", "array"]


def test_spans(spark):
    source = "The widget “fails” when it is resized – always, on every single screen that we own."
    assert spans.match("fails", source)[0] == "exact" and spans.match("", source)[0] == "empty" and spans.match("x", "")[0] == "invalid_source"
    assert spans.match('the widget "fails" when it is resized - always', source)[0] == "normalized"
    assert spans.match("when it is resized always on every single screen", source)[0] in ("fuzzy", "normalized")
    assert spans.match("entirely other words that do not stand here", source)[0] == "unmatched"
    rng = random.Random(0)
    rows = [("".join(rng.choice("aB –“”…*`\xa0ﬁ.-'İ\n") for _ in range(rng.randrange(1, 40))), "".join(rng.choice("aB –“”…*`\xa0ﬁ.-'İ\n") for _ in range(9))) for _ in range(300)]
    rows += [(t, t[i : i + 12].upper()) for t, _ in rows for i in (0, 5) if len(t) > 15]
    bulk = spans.match_spans(spark.createDataFrame(rows, "t string, s string"), "s", "t").collect()
    assert len(bulk) == len(rows) and {r.match.status for r in bulk} >= {"exact", "normalized", "unmatched"}
    for r in bulk:  # built-ins and batches agree
        assert (r.match.status, r.match.matched_span, r.match.score) == spans.match(r.s, r.t), (r.s, r.t)
    assert spans.Source("see ﬁne  İx print").find("FINE i̇x") == "ﬁne  İx"
    df = spark.createDataFrame([("fails", source), ("", source), ("WHEN IT IS RESIZED", source)], "s string, t string")
    assert sorted(r.match.status for r in spans.match_spans(df, "s", "t").collect()) == ["empty", "exact", "normalized"]


UNIT = "array<struct<unit_id: string, type: string, text: string>>"


def test_state_delta(spark):
    def delta(op, claim="active", de=(), ac=(), units=()):
        df = spark.createDataFrame([(op, claim, list(de), list(ac), [(f"U{i}", t, x) for i, (t, x) in enumerate(units)], "goal")], f"o string, c string, d array<string>, a array<string>, u {UNIT}, g string")
        return df.select(state_delta(*(F.col(x) for x in "ocdaug")).alias("v")).first().v

    assert delta("initial_imperfect_report", units=[("symptom", "s")]) == {"add_active_goals": ["s"]}
    assert delta("confirm_final_active_intent") == {"add_active_goals": ["goal"]}
    got = delta("replace_previous_claim", de=["old"], ac=["new"])
    assert got["replace_assumptions"][:2] == ["old", "new"] and got["deactivate_assumptions"] == ["old"] and got["add_active_goals"] == ["new"]
    assert delta("resolve_conflict", units=[("conflict_or_tension", "c")])["resolve_conflicts"] == ["c"]
    assert delta("add_detail", units=[("obsolete_candidate", "x"), ("negative_constraint", "n")]) == {"add_active_goals": ["n"], "add_forbidden_actions": ["n"], "deactivate_assumptions": ["x"]}
    assert delta("speculative_hypothesis", ac=["maybe"]) == {"mark_claims_speculative": ["maybe"]}
