"""Operators against plain Python, and their bounds."""

import random

import pytest
from pyspark.sql import functions as F

from loomset.operators import attempts, containment, dedup, quota, upsert
from loomset.plans import construct, gate, release, scoring, validators, views
from loomset.sources import readers, sinks
from loomset.streaming import events
from tests.conftest import SF


def test_priority_dedup(spark):
    rows = [("a-1", "full", 1), ("a-1", "verified", 5), ("a-1", "lite", 3), ("b-2", "full", 2), ("b-2", "full", 4), ("", "lite", 6), (None, "lite", 7)]
    df = spark.createDataFrame(rows, "id string, source string, ordinal int")
    out = dedup.priority_dedup(df, "id", "source", "ordinal")
    assert sorted((r.id, r.ordinal) for r in out.collect()) == [("a-1", 5), ("b-2", 2)]
    assert sorted(map(tuple, dedup.priority_dedup(out, "id", "source", "ordinal").collect())) == sorted(map(tuple, out.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def greedy(rows, total, per_group, share):
    cap, chosen, groups, domains = max(1, int(total * share)), [], {}, {}
    for limited in (True, False):
        for i, (g, d) in enumerate(rows):
            if len(chosen) < total and i not in chosen and groups.get(g, 0) < per_group and (not limited or domains.get(d, 0) < cap):
                chosen.append(i)
                groups[g] = groups.get(g, 0) + 1
                domains[d] = domains.get(d, 0) + 1
    return chosen


@pytest.mark.parametrize("functional", [True, False])
def test_quota_is_the_greedy_choice(spark, functional):
    rng = random.Random(int(functional))
    assert greedy([("r1", "d1"), ("r1", "d1"), ("r1", "d1"), ("r2", "d1"), ("r3", "d2")], 4, 2, 0.5) == [0, 1, 4, 3]
    for _ in range(6):
        rows = [(g := rng.randrange(5), g % 2 if functional else rng.randrange(3)) for _ in range(rng.randrange(1, 25))]
        total, per_group, share = rng.randrange(1, 9), rng.randrange(1, 4), rng.choice([0.2, 0.5, 1.0])
        df = spark.createDataFrame([(i, g, d) for i, (g, d) in enumerate(rows)], "i int, g int, d int")
        out = quota.select_diverse(df, [F.col("i")], "g", "d", total, per_group, share).orderBy("position").collect()
        assert [r.i for r in out] == greedy(rows, total, per_group, share)


def test_upsert_and_guard(spark):
    old, new = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert sorted(map(tuple, upsert.upsert(old, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(ValueError):
        upsert.guarded(old, new, "k")
    assert upsert.guarded(old, new, "k", force=True).count() == 3 and upsert.guarded(old, old, "k").count() == 2


def test_attempts(spark):
    df = spark.createDataFrame([("a", 1, "step_failed"), ("a", 2, "accepted"), ("b", 1, "accepted")], "id string, n int, status string")
    rows = {(r.id, r.n): r for r in attempts.attempt_chain(df, "id", ["n"], "status").collect()}
    assert rows["a", 2].accepted_after_retry and rows["a", 2].previous_status == "step_failed" and not rows["b", 1].accepted_after_retry
    assert sorted(map(tuple, attempts.latest(df, "id", ["n"]).collect())) == [("a", 2, "accepted"), ("b", 1, "accepted")]
    calls = spark.createDataFrame([(i, (i * 7) % 5) for i in range(200)], "i int, c int")
    got = {r.i: r.calls_before for r in attempts.within_budget(calls, "c", ["i"], 150, 7).collect()}
    total, want = 0, {}
    for i in range(200):
        if total >= 150:
            break
        want[i], total = total, total + (i * 7) % 5
    assert got == want


def test_containment_blocks(spark, monkeypatch):
    needles, texts = spark.createDataFrame([("ab",), ("CD",)], "n string"), spark.createDataFrame([(1, "xaby"), (2, "cd ab")], "i int, t string")
    one = sorted((r.i, r.n) for r in containment.contained_in(needles, texts, "n", "t", fold=True).collect())
    monkeypatch.setattr(containment, "BLOCK_BYTES", 2)
    assert one == sorted((r.i, r.n) for r in containment.contained_in(needles, texts, "n", "t", fold=True).collect()) == [(1, "ab"), (2, "CD"), (2, "ab")]


def issue(i, **over):
    base = dict(instance_id=f"i-{i}", repo="sympy/sympy", problem_statement="It should work instead of a crash. " * 12, hints_text="do not break it", patch="diff --git a/sympy/x.py b/sympy/x.py\n@@ -1 +1 @@ def f(x)\n-a\n+b\n", test_patch="diff --git a/tests/test_x.py b/tests/test_x.py\n+x", FAIL_TO_PASS='["t"]', PASS_TO_PASS="[]", source_name="lite")
    return base | over


def test_pool(spark):
    names = list(issue(0))
    rows = [issue(1), issue(2, patch=""), issue(3, patch="diff --git a/README.md b/README.md\n+x"), issue(4, problem_statement="short")]
    pool = scoring.pool_features(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names)))
    by = {r.instance_id: r for r in pool.collect()}
    a = by["i-1"]
    assert (a.domain, a.rule_label, a.quality_risk_score, a.has_function_gold, a.function_symbols_touched) == ("symbolic_math", "candidate", 0, True, ["sympy/x.py::f"])
    assert a.rule_score == min(100, 15 + 10 + 10 + 15 + 5 + 15 + 8 + 8 + 12 + 5 + 6)
    assert by["i-2"].rule_label == "reject" and by["i-2"].quality_risk_reasons[0] == "missing_patch" and by["i-3"].docs_only and by["i-4"].rule_label == "manual_review"
    assert [r.instance_id for r in pool.orderBy(*scoring.pool_order()).collect()][0] == "i-1" and scoring.not_rejected(pool).count() == 2
    assert pool.select(F.explode(F.array("quality_risk_score", "rule_score")).alias("s")).where("s < 0 or s > 100").count() == 0
    from loomset.plans.prefilter import prefilter

    assert {r.prefilter_decision for r in prefilter(pool).collect()} <= {"keep", "deprioritize", "reject"}


def good_instance():
    u = lambda i, t, x: (f"U{i}", t, x, True, True)
    units = [u(1, "symptom", "slider jumps backwards"), u(2, "expected_behavior", "slider stays in place"), u(3, "ambiguity_or_correction", "only vertical sliders matter"), u(4, "reproduction", "drag quickly twice"), u(5, "regression_expectation", "keyboard movement remains")]
    said = ("When I drag a slider quickly twice it jumps backwards on the screen. I think every slider is affected, the slider stays wrong until I reload, and I am fairly sure that it happens everywhere in the tool.", "Maybe all sliders jump when dragging quickly.", "I was wrong: only vertical sliders matter here.", "So the slider stays in place, please.")
    t = lambda i, op, units_, r=(), de=(), ac=(): (f"T{i}", op, said[i - 1], list(units_), "active", list(r), [], list(de), list(ac))
    turns = [t(1, "initial_imperfect_report", ["U1", "U2", "U4"]), t(2, "speculative_hypothesis", ["U1"]), t(3, "correct_previous_claim", ["U3"], ["T2"]), t(4, "confirm_final_active_intent", ["U2"])]
    oracle = {k: ["keyboard movement remains unchanged everywhere"] for k in validators.ORACLE_KEYS}
    modes = dict.fromkeys(gate.MODES, "text")
    modes = {m.replace(r"\w+", "any"): "text" for m in modes}
    return ("i", True, units, ["U1", "U2", "U3", "U4", "U5"], (True, ["U3"]), ("Vertical sliders must not move while dragging", ["vertical sliders keep their place"]), oracle, turns, modes, list(said), "find the files", "{}", ["a.py"], ["a.py::f"], ["file_hit_at_k", "function_hit_at_k"], ["$.dialogue"], "clean", False, None)


def test_gate(spark):
    base = spark.createDataFrame([good_instance()], gate.INPUT)
    r = gate.gate(base).first()
    assert r.passed, r.hard_failures
    assert (r.status, r.action, r.scenario_fit, len(r.checks)) == ("accepted", "accept", True, 30)
    cases = [
        ({"suitable": F.lit(None).cast("boolean")}, "semantic_capsule_suitable", "manual_review_required"), ({"agent_paths": F.array(F.lit("$.oracle"))}, "agent_view_no_gold_or_leakage", "manual_review_required"), ({"agent_text": F.lit("see tests/x.py")}, "agent_view_no_gold_or_leakage", "rejected"),
        ({"intent": F.col("intent").withField("must_satisfy", F.array(F.lit("it uses the Hidden Cache class")))  , "units": F.concat("units", F.array(F.expr("named_struct('unit_id', 'U6', 'type', 'implementation_hint', 'text', 'the hidden cache class', 'active_by_default', false, 'expose_to_user', false)"))), "compact_unit_ids": F.concat("compact_unit_ids", F.array(F.lit("U6")))}, "non_goal_not_in_must_satisfy", "manual_review_required"),
        ({"turns": F.transform("turns", lambda t, i: t.withField("deactivates_claims", F.when(i == 2, F.array(F.lit("sliders keep their place"))).otherwise(t["deactivates_claims"])))}, "non_goal_not_in_must_satisfy", "manual_review_required"),
        ({"turns": F.transform("turns", lambda t, i: t.withField("claim_status", F.when(i == 3, "mistaken").otherwise(t["claim_status"])))}, "unresolved_wrong_claims_absent", "manual_review_required"),
        ({"modes": F.map_filter("modes", lambda k, _: k != "concat_dialogue_prompt")}, "evaluation_modes_complete", "manual_review_required"),
        ({"is_template": F.lit(True)}, "template_dialogue_specific", "manual_review_required"),
        ({"turns": F.slice("turns", 1, 2)}, "dialogue_turn_count_valid", "manual_review_required"), ({"gold_files": F.array().cast("array<string>")}, "keep_localization_metrics", "manual_review_required"),
        ({"turns": F.transform("turns", lambda t: t.withField("revises_turns", F.array().cast("array<string>")))}, "unresolved_wrong_claims_absent", "manual_review_required"),
    ]
    rows = [base.withColumns(change).select(*base.columns).first() for change, _, _ in cases]
    for r, (_, check, status) in zip(gate.gate(spark.createDataFrame(rows, base.schema).coalesce(1)).collect(), cases):
        assert not r.checks[check] and r.status == status and not r.passed, (check, r.status, r.hard_failures)


def test_validators(spark):
    units = "u array<struct<unit_id:string,type:string,text:string,source:string,source_span:string,source_match_status:string,active_by_default:boolean,expose_to_user:boolean>>"
    f = lambda i, t, s="exact": (f"U{i}", t, "text", "problem_statement", "span", s, True, True)
    ok = spark.createDataFrame([([f(1, "symptom"), f(2, "expected_behavior"), f(3, "non_goal", "unmatched")], "sum", "")], f"{units}, s string, b string")
    r = validators.validated(ok, "fact_extraction", F.col("u"), F.col("s"), F.col("b")).first()
    assert r.errors == [] and r.warnings == ["fact_units[2].source_span is not aligned to source"]
    bad = spark.createDataFrame([([f(1, "symptom"), f(1, "nonsense"), f(3, "implementation_hint")], "", "FAIL_TO_PASS")], f"{units}, s string, b string")
    e = validators.validated(bad, "fact_extraction", F.col("u"), F.col("s"), F.col("b")).first().errors
    assert "duplicate fact unit id: U1" in e and "issue_summary is empty" in e and "fact_units[1].type is invalid: nonsense" in e and "implementation_hint U3 must expose_to_user=false" in e
    kinds = "decision string, scenario_fit string, initial_report_quality string, noisy_refinement_quality string, has_non_monotonic_claim_evolution boolean, wrong_or_speculative_claims_resolved boolean, old_progressive_disclosure_pattern boolean, final_intent_consistent boolean, revision_grounded boolean, leakage_risk string, issues array<string>, required_fixes array<string>, unresolved_wrong_claims int"
    r = spark.createDataFrame([(("accept", "pass", "pass", "pass", True, True, False, True, True, "low", [], [], 0),), (("accept", "weak", "fail", "pass", True, None, False, True, True, "high", None, [], 1),)], f"r struct<{kinds.replace(' string', ': string').replace(' boolean', ': boolean').replace(' array', ': array').replace(' int', ': int')}>")
    a, b = (x.errors for x in validators.validated(r, "semantic_reviewer", F.col("r")).collect())
    assert a == [] and len(b) == 7
    assert list(validators.REGISTRY) == ["fact_extraction", "intent_revision", "initial_report_plan", "noisy_revision_event_plan", "realistic_utterance_realization", "semantic_reviewer"]


def test_remaining_validators(spark):
    row = good_instance()
    base = spark.createDataFrame([row], gate.INPUT)
    plan = F.struct(F.array(*map(F.lit, ["U1", "U2", "U4"])).alias("introduced_units"), F.array(F.lit("vague")).alias("imperfection_types"), F.array(F.lit("U1")).alias("noisy_or_imperfect_units"), F.array(F.lit("U3")).alias("withheld_units_for_later"), F.lit("why").alias("rationale"))
    assert validators.validated(base, "initial_report_plan", F.col("units"), plan, F.lit("")).first().errors == []
    support = F.struct(F.lit(True).alias("has_revision_fact"), F.lit("ambiguity_or_correction").alias("revision_type"), F.array(F.lit("U3"), F.lit("U9")).alias("revision_unit_ids"), F.lit("r").alias("reason"))
    assert validators.validated(base, "intent_revision", F.col("units"), F.col("intent"), support, F.col("oracle"), F.lit("")).first().errors == ["revision_support references unknown unit U9"]
    turns = F.transform("turns", lambda t: t.withField("must_be_resolved_later", F.lit(False)))
    out = validators.validated(base, "noisy_revision_event_plan", F.col("units"), turns, F.array(*map(F.lit, ["U1", "U2", "U4"])), F.lit(True), F.array(F.lit("U3")), F.lit("")).first()
    assert out.errors == [] and out.warnings == []
    said = F.transform("turns", lambda t: F.struct(t["turn_id"].alias("turn_id"), t["user_utterance"].alias("user_utterance")))
    assert validators.validated(base, "realistic_utterance_realization", F.col("units"), F.col("turns"), said, F.lit("")).first().errors == []


def test_construct(spark):
    base = spark.createDataFrame([good_instance()], gate.INPUT)
    compiled = base.select(construct.compiled_turns(F.col("turns"), F.col("units"), F.col("intent.objective")).alias("t")).first().t
    assert [t.turn_id for t in compiled] == ["T1", "T2", "T3", "T4"] and compiled[0].state_delta["add_active_goals"][0] == "slider jumps backwards" and "mark_claims_speculative" in compiled[1].state_delta
    made = construct.tasks(spark.createDataFrame([tuple(issue(1).values())], ", ".join(f"{n} string" for n in issue(1)))).first()
    assert made.issue_type == "maintenance"
    assert made.gold_intent.relevant_files == ["sympy/x.py"] and len(made.scenario.misleading_cues) == 4 and made.scenario.persona.style in {p[1] for p in construct.PERSONAS}
    assert made.gold_intent.symptom and made.gold_intent.constraints[0].startswith("The fix must resolve") and made.scenario.disclosure_policy.hidden_from_agent[0] == "patch"
    gold = spark.createDataFrame([(issue(1)["patch"],)], "p string").select(construct.localization_gold(F.col("p"), F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit("x")).alias("g")).first().g
    assert gold.files == ["sympy/x.py"] and gold.functions == ["sympy/x.py::f"]


UNITS = "array<struct<unit_id: string, type: string, text: string, source: string, source_span: string, active_by_default: boolean, expose_to_user: boolean>>"


def test_repairs(spark):
    def fixed(**change):
        unit = {"unit_id": "U1", "type": "symptom", "text": "it fails", "source": "hints_text", "source_span": "it fails", "active_by_default": True, "expose_to_user": True} | change
        return spark.createDataFrame([([tuple(unit.values())],)], f"u {UNITS}").select(construct.repaired_facts(F.col("u")).alias("u")).first().u[0].type

    assert fixed() == "symptom" and fixed(text="see line 5") == fixed(text="numpy 2 breaks") == fixed(text="took 3 hours") == "implementation_hint"
    assert fixed(text="see line 5", source="problem_statement") == "symptom" and fixed(text="since PR #12", source="problem_statement") == "implementation_hint"
    assert fixed(source_span="this case came in long ago", source="problem_statement") == fixed(text="originates from a gist", source=None) == "implementation_hint"
    long = [f"U{i}" for i in range(12)] + ["U1", " ", "hidden"]
    df = spark.createDataFrame([([(f"U{i}", "symptom", "t", None, None, True, True) for i in range(12)] + [("hidden", "symptom", "t", None, None, True, False)], (long, None, [" U2 "], None))], f"u {UNITS}, r struct<introduced_units: array<string>, noisy_or_imperfect_units: array<string>, withheld_units_for_later: array<string>, imperfection_types: array<string>>")
    r = df.select(construct.repaired_report(F.col("r"), F.col("u")).alias("r")).first().r
    assert r.introduced_units == long[:12] and r.noisy_or_imperfect_units == [] and r.withheld_units_for_later == ["U2"] and r.imperfection_types == []

    facts = [("U1", "symptom", "the reporter sees that rendering stops.", None, None, True, True), ("U2", "regression_expectation", "keyboard movement remains", None, None, True, True), ("U3", "symptom", "x" * 100 + " " + "y" * 60, None, None, True, True)]

    def said(op, text, ids, first=False):
        df = spark.createDataFrame([((op, text, ids), facts)], f"t struct<operation: string, user_utterance: string, introduced_units: array<string>>, u {UNITS}")
        return df.select(construct.repaired_utterance(F.col("t"), F.col("u"), first).alias("s")).first().s

    assert said("add_detail", "Rendering stops here.", ["U1"]) == "Rendering stops here." and said("add_detail", "", ["U1"]) == "I sees that rendering stops."
    assert said("add_detail", "see the patch, rendering stops", ["U1"]) == said("add_detail", "other words only", ["U1"]) == "I sees that rendering stops."
    assert said("add_detail", "", ["U2"]) == "One constraint I forgot: Keyboard movement remains." and said("add_detail", "", []) == "I confirmed one more detail from the report."
    assert said("speculative_hypothesis", "", ["U1"]) == "This may be my misunderstanding, but i sees that rendering stops." and said("confirm_final_active_intent", None, []) == "Yes, the final behavior should follow that corrected interpretation."
    assert said("retract_previous_claim", "", []) == "I checked that part again; my earlier read may be wrong. Please use this corrected detail instead."
    first = said("initial_imperfect_report", "too short", ["U1"], True)
    assert first.startswith("I sees that rendering stops. I may be missing") and 120 <= len(first) <= 900
    assert said("add_detail", "", ["U3"]) == "X" + "x" * 99 + "...."


def test_evaluation_prompts(spark):
    final = "objective string, must_satisfy array<string>, must_not_satisfy array<string>, non_goals array<string>, regression_expectations array<string>".replace(" string", ": string").replace(" array", ": array")
    df = spark.createDataFrame([(("Do it", ["a", "a", "b"], ["no"], ["never"], ["keep"]), ([], None), [("T1", "hello"), ("T2", "bye")])], f"f struct<{final}>, o struct<must_satisfy: array<string>, must_not_satisfy: array<string>>, t array<struct<turn_id: string, user_utterance: string>>")
    p = df.select(*(c.alias(n) for n, c in views.prompts(F.col("f"), F.col("o"), F.col("t"), F.lit("find"), "any").items())).first()
    assert p.final_issue_prompt == "Please implement the following final active issue intent.\n\nObjective: Do it\n\nMust satisfy:\n- a\n- b\n\nPreserve:\n- keep"
    assert p.concat_dialogue_prompt.endswith("rejected assumptions.\n\nT1: hello\nT2: bye\n\nInactive or rejected context:\n- no\n- never")
    assert p.recap_any_prompt.endswith("left unresolved.\n\nActive objective:\nDo it\n\nMust satisfy:\n- a\n- b\n\nInactive or rejected:\n- no\n- never")
    assert p.oracle_intent_prompt == "Judge whether a proposed patch satisfies the final active ANY intent.\n\nFinal active intent: Do it\n\nMust satisfy:\n- a\n- b\n\nMust not satisfy / must not keep active:\n- no"
    assert p.multi_turn_any_script == '[{"turn_id":"T1","user_utterance":"hello"},{"turn_id":"T2","user_utterance":"bye"}]'


def test_review_queue(spark):
    from loomset.sources import sinks

    state = spark.createDataFrame([("a", "needs_revision", "", "boom", {"s": "m"}), ("b", "accepted", None, None, {}), ("c", "step_failed", "why", None, {})], "instance_id string, status string, failure_reason string, last_error string, models_used map<string, string>")
    q = sinks.review_queue(state)
    assert tuple(q.columns) == sinks.QUEUE and len(q.columns) == 15
    rows = {r.instance_id: r for r in q.collect()}
    assert set(rows) == {"a", "c"} and rows["a"].failure_reason == "boom" and rows["c"].failure_reason == "why" and rows["a"].filter_reason == "" and rows["a"].models_used == '{"s":"m"}' and rows["c"].escalated_steps == "[]"


def test_release_and_views(spark):
    docs = spark.createDataFrame([("a", ("p", "secret"), "o"), ("b", ("p", "secret"), "o")], "instance_id string, localization_checkpoint struct<prompt: string, gold: string>, oracle string")
    state = spark.createDataFrame([("a", "accepted"), ("b", "rejected")], "instance_id string, status string")
    quality = spark.createDataFrame([("a", True, "accepted")], "instance_id string, passed boolean, status string")
    out, counts = release.collect_exportable(state, docs, quality)
    assert [r.instance_id for r in out.collect()] == ["a"] and {(r.status, r.n) for r in counts.collect()} == {("accepted", 1), ("rejected", 1)}
    seen = views.agent_view(docs)
    assert "oracle" not in seen.columns and seen.schema["localization_checkpoint"].dataType.names == ["prompt"]
    assert views.evaluator_view(docs, quality).where("instance_id = 'a'").first().quality_report_summary.passed


def test_sources_and_sinks(spark, tmp_path):
    raw = tmp_path / "raw.jsonl"
    raw.write_text('{"instance_id": " a ", "repo": "r", "FAIL_TO_PASS": "[1]"}\n\n{"instance_id": "", "repo": "x"}\n')
    rows = readers.normalised(readers.json_lines(spark, str(raw)), "lite").collect()
    assert [(r.instance_id, r.source_name, r.FAIL_TO_PASS) for r in rows] == [("a", "lite", "[1]")]
    (tmp_path / "bad.jsonl").write_text('{"instance_id": "a"}\nnot json\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    assert [r.value for r in readers.bad_lines(spark, str(tmp_path / "bad.jsonl")).collect()] == ["not json"]
    df = spark.createDataFrame([("a", 'x "q",\ny', ["p", "q"]), ("b", "", [])], "k string, t string, l array<string>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert {(r.k, r.t, r.l) for r in readers.csv_text(spark, str(tmp_path / "csv")).collect()} == {("a", 'x "q",\ny', "p;q"), ("b", "", "")}
    both = readers.union_sources({"full": readers.json_lines(spark, str(raw)), "lite": readers.json_lines(spark, str(raw))})
    assert dedup.priority_dedup(both, "instance_id", "source_name", "ordinal").first().source_name == "lite"
    sinks.write_json_lines(df, str(tmp_path / "json"))
    assert readers.latest_index(spark, str(tmp_path / "json"), "k string, t string, l array<string>", "k").count() == 2
    call = spark.createDataFrame([("p", "http://h/x?key=1", {"Authorization": "s", "retry-after": "1"})], "prompt string, url string, headers map<string,string>")
    r = sinks.call_envelope(call).first()
    assert r.url == "http://h/x?<redacted>" and r.headers == {"retry-after": "1"} and "prompt" not in r
    assert sinks.markdown_table([{"a": 1}]) == "| a |\n| --- |\n| 1 |"


def test_streams_are_their_batches(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    stream = events.event_counts(events.stream(spark, f"{SF}/events.parquet*", table.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(repr, spark.sql("select window_start, event_type, n from counts").collect())) == sorted(map(repr, events.event_counts(table).select("window_start", "event_type", "n").collect()))
    log = spark.createDataFrame([("a", 1, "step_failed"), ("a", 2, "accepted"), ("b", 1, "accepted")], "instance_id string, attempt_id int, status string")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    s = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = events.upsert_batches(s.select("instance_id", "attempt_id", "status"), str(tmp_path / "idx"), "instance_id", str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "idx/v0")).count() == 2
    q = events.attempt_states(s).writeStream.outputMode("update").format("memory").queryName("chains").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.instance_id, r.attempts, r.accepted_after_retry) for r in spark.sql("select * from chains").collect()} == {("a", 2, True), ("b", 1, False)}


def test_rows_keep_the_order_of_their_files(spark, tmp_path):
    import json

    from loomset.sources import readers

    one = lambda i, repo: json.dumps({"instance_id": i, "repo": repo}) + "\n"
    (tmp_path / "b.jsonl").write_text("".join(one(f"i{k % 50}", f"b{k}") for k in range(20000)))
    (tmp_path / "a.jsonl").write_text("".join(one(f"i{k}", f"a{k}") for k in range(5)))
    raw = readers.json_lines(spark, str(tmp_path))
    rows = readers.with_ordinal(raw).orderBy("ordinal").select("repo").collect()
    assert [r.repo for r in rows] == [f"a{k}" for k in range(5)] + [f"b{k}" for k in range(20000)]
    first = dedup.priority_dedup(readers.union_sources({"full": raw}), "instance_id", "source_name", "ordinal")
    assert {r.instance_id: r.repo for r in first.collect()} == {f"i{k}": f"a{k}" if k < 5 else f"b{k}" for k in range(50)}
    last = readers.latest_index(spark, str(tmp_path), "instance_id string, repo string")
    assert {r.instance_id: r.repo for r in last.collect()} == {f"i{k}": f"b{19950 + k}" for k in range(50)}


def test_paths_without_a_bound(spark):
    from loomset.functions import jsonx

    deep = '{"a": ' * 60 + "1" + "}" * 60
    df = spark.range(3).selectExpr("id", f"CASE id WHEN 0 THEN '{deep}' WHEN 1 THEN 'bad' ELSE '[{{\"b\": []}}]' END AS raw")
    got = [(r.id, r.path) for r in jsonx.key_paths(df, "id", "raw").collect()]
    assert len(got) == 61 and (2, "$[0].b") in got and (0, "$" + ".a" * 60) in got
