"""The quality gate: named checks, hard failures, soft warnings, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset import patterns as P
from loomset.functions.lists import ordered_distinct, same_set
from loomset.functions.text import hints_implementation, leaks_metadata, like
from loomset.functions.tokens import alignment_tokens, flat_text, overlap, repeats_intent
from loomset.operators import nested
from loomset.plans.validators import OPERATIONS, ORACLE_KEYS

#: Types that a revision may rest on, prompts that must be there, fields of a metrics block.
REVISION_TYPES = ("rejected_solution", "obsolete_candidate", "negative_constraint", "regression_expectation", "ambiguity_or_correction", "design_suggestion_non_goal", "workaround_to_reject", "conflict_or_tension")
SCRIPT_MODE, RECAP_MODE = r"multi_turn_\w+_script", r"recap_\w+_prompt"  # these two have the product's name in the middle, whichever it is
MODES = ("final_issue_prompt", "concat_dialogue_prompt", SCRIPT_MODE, RECAP_MODE, "oracle_intent_prompt", "localization_prompt")
#: Types of units that no must may speak of; claims that a turn must see resolved; a code-like name.
INACTIVE_TYPES = ("non_goal", "rejected_solution", "obsolete_candidate", "implementation_hint")
SNAKE_CASE = r"\b[A-Za-z]+_[A-Za-z0-9_]*\b"

#: The gate's input, one row per instance.
INPUT = """instance_id string, suitable boolean, units array<struct<unit_id: string, type: string, text: string, active_by_default: boolean, expose_to_user: boolean>>,
compact_unit_ids array<string>, revision struct<has_revision_fact: boolean, revision_unit_ids: array<string>>,
intent struct<objective: string, must_satisfy: array<string>>, oracle map<string, array<string>>,
turns array<struct<turn_id: string, operation: string, user_utterance: string, introduced_units: array<string>, claim_status: string, revises_turns: array<string>, revises_units: array<string>, deactivates_claims: array<string>, activates_claims: array<string>>>,
modes map<string, string>, script array<string>, prompt string, output_schema string, gold_files array<string>, gold_functions array<string>, metrics array<string>,
agent_paths array<string>, agent_text string, is_template boolean, template_supported boolean"""


def _lits(xs) -> Column:
    return F.array(*map(F.lit, xs))


def checks(df: DataFrame) -> tuple[dict[str, tuple[Column, str]], list[tuple[Column, str]]]:
    """(name -> (passes, severity), further hard rules without a name as (broken, message))."""
    c = F.col
    units, turns = c("units"), c("turns")
    shown, known = nested.exposed(units), nested.ids(units)
    ids = lambda x: ordered_distinct(F.coalesce(x, F.array().cast("array<string>")))
    types = lambda chosen: F.array_distinct(F.transform(chosen, lambda u: u["type"]))
    revision_ids, must = ids(c("revision.revision_unit_ids")), ids(c("intent.must_satisfy"))
    has = c("revision.has_revision_fact")
    ops = F.transform(turns, lambda t: t["operation"])
    said = F.array_join(F.transform(turns, lambda t: F.coalesce(t["user_utterance"], F.lit(""))), "\n")
    one = F.get(turns, F.lit(0))
    text1, units1 = F.trim(F.coalesce(one["user_utterance"], F.lit(""))), ids(one["introduced_units"])
    first_ok = one["operation"] == "initial_imperfect_report"
    loaded = lambda t: (F.size(ids(t["revises_units"])) > 0) | (F.size(ids(t["deactivates_claims"])) > 0) | (F.size(ids(t["activates_claims"])) > 0)
    introduces = lambda t: (F.size(ids(t["introduced_units"])) > 0) | loaded(t) | (t["operation"] == "confirm_final_active_intent")
    refs_ok = lambda t: F.size(F.array_except(ids(t["introduced_units"]), nested.ids(shown))) == 0
    aligned = lambda t: (F.size(ids(t["introduced_units"])) == 0) | F.exists(nested.pick(units, ids(t["introduced_units"])), lambda u: overlap(alignment_tokens(t["user_utterance"]), alignment_tokens(u["text"])) > 0)
    bound = lambda t: F.array_union(ids(t["introduced_units"]), ids(t["revises_units"]))
    revising = F.filter(turns, lambda t: t["operation"].isin(*P.REVISION))
    inactive = F.transform(F.filter(units, lambda u: u["type"].isin(*INACTIVE_TYPES)), lambda u: flat_text(u["text"]))
    withdrawn = F.transform(F.flatten(F.transform(turns, lambda t: ids(t["deactivates_claims"]))), flat_text)
    surface = flat_text(F.array_join(must, "\n"))
    stands = lambda held: F.exists(held, lambda x: (x != "") & F.contains(surface, x))
    no_inactive, no_stale = ~stands(inactive), ~stands(inactive) & ~stands(withdrawn)
    modes_text = F.array_join(F.map_values(c("modes")), "\n")
    oracle_must = ids(F.try_element_at(c("oracle"), F.lit("must_satisfy")))
    has_mode = lambda name: F.exists(F.map_entries(c("modes")), lambda e: e["key"].rlike(f"^{name}$") & (F.lit(name == SCRIPT_MODE) | (F.trim(F.coalesce(e["value"], F.lit(""))) != "")))
    modes_ok = F.forall(F.array(*map(has_mode, MODES)), lambda x: x)
    gold = F.size(F.coalesce(c("gold_files"), F.array().cast("array<string>"))) > 0
    templated = F.coalesce(c("is_template"), F.lit(False))
    artifact = F.exists(turns, lambda t: like(F.coalesce(t["user_utterance"], F.lit("")), P.TEMPLATE_ARTIFACT))
    template_issues = F.array_compact(F.array(
        F.when(like(text1, P.GENERIC_FIRST_TURN), "template T1 is generic"), F.when(artifact, "template contains mechanical or meta wording"),
        F.when(text1.rlike(SNAKE_CASE), "template T1 exposes code-like identifier"), F.when(~c("template_supported").eqNullSafe(True), "template lacks explicit revision fact support"),
    ))
    metric_ok = F.size(F.array_except(_lits(["file_hit_at_k", "function_hit_at_k"]), F.coalesce(c("metrics"), F.array().cast("array<string>")))) == 0
    deprecated = F.arrays_overlap(ops, _lits(P.DEPRECATED_OPERATIONS))
    confirm_ok = F.forall(turns, lambda t: (t["operation"] != "confirm_final_active_intent") | (F.length(t["user_utterance"]) <= 260) | ~repeats_intent(t["user_utterance"], c("intent.objective"), F.array_join(must, " ")))
    typed = F.array_intersect(types(nested.pick(units, revision_ids)), _lits(REVISION_TYPES))
    revision_ok = ~F.coalesce(has, F.lit(False)) | ((F.size(revision_ids) > 0) & (F.size(F.array_except(revision_ids, known)) == 0) & (F.size(typed) == F.size(types(nested.pick(units, revision_ids)))))
    told_all = (F.size(units1) >= F.size(shown)) & (F.size(shown) > 0)
    oracle_in_first = (F.size(oracle_must) > 0) & F.forall(oracle_must, lambda x: F.contains(flat_text(text1), flat_text(x)))
    core = F.size(F.array_intersect(types(nested.pick(units, units1)), _lits(P.CORE_INITIAL_TYPES))) >= 2
    basic = F.size(F.array_intersect(types(units), _lits(["symptom", "observed_behavior", "expected_behavior"]))) >= 2
    evaluator_only = F.exists(c("agent_paths"), lambda p: like(p, P.DENIED_KEYS)) | like(F.coalesce(c("agent_text"), F.lit("")), P.DENIED_TEXT)
    hard, soft = "hard", "soft"  # of kind told: a rule below says it; derived: other checks do
    named = {
        "semantic_capsule_suitable": (c("suitable").eqNullSafe(True), hard),
        "revision_support_declared": (c("revision").isNotNull(), hard),
        "fact_units_cover_basic_behavior": (basic, hard),
        "compact_semantic_capsule_present": ((F.size(units) > 0) & c("revision").isNotNull() & same_set(known, F.coalesce(c("compact_unit_ids"), F.array().cast("array<string>"))) & F.forall(units, lambda u: F.trim(u["text"]) != ""), hard),
        "revision_unit_ids_valid": (revision_ok, hard),
        "final_intent_objective_nonempty": (F.coalesce(F.trim(c("intent.objective")), F.lit("")) != "", hard),
        "must_satisfy_nonempty": (F.size(must) > 0, hard),
        "dialogue_turn_count_valid": (F.size(turns).between(3, 6), hard),
        "first_turn_initial_imperfect_report": (first_ok & F.size(units1).between(3, 7) & core & F.length(text1).between(120, 900) & ~leaks_metadata(text1) & ~hints_implementation(text1), hard),
        "initial_report_not_oracle": (~(oracle_in_first | (flat_text(text1) == flat_text(c("intent.objective"))) | told_all), hard),
        "no_old_progressive_disclosure": (~deprecated & (F.length(text1) >= 120) & first_ok, hard),
        "confirm_turn_not_full_prompt": (confirm_ok, hard),
        "compact_dialogue_introduced_units_present": ((F.size(turns) > 0) & F.forall(turns, lambda t: introduces(t) & refs_ok(t)), hard),
        "introduced_units_content_aligned": (F.forall(turns, aligned), hard),
        "noisy_refinement_present": (F.arrays_overlap(ops, _lits(P.NON_MONOTONIC)), hard),
        "unresolved_wrong_claims_absent": (F.size(nested.unresolved(turns)) == 0, hard),
        "has_revision_operation": ((F.size(revising) > 0) & F.coalesce(has, F.lit(False)), hard),
        "introduced_units_valid": (F.forall(turns, refs_ok) & ~deprecated, hard),
        "revision_operation_fact_supported": (F.forall(revising, lambda t: F.size(F.array_intersect(bound(t), known)) > 0), hard),
        "revision_operation_bound_to_revision_support": (F.exists(revising, lambda t: F.arrays_overlap(bound(t), revision_ids) | F.exists(nested.pick(units, bound(t)), lambda u: u["type"].isin(*REVISION_TYPES))), soft),
        "non_exposed_units_not_in_dialogue": (F.size(nested.leaked_texts(units, said)) == 0, hard),
        "implementation_hint_not_user_facing": (~hints_implementation(said) & ~hints_implementation(modes_text) & ~hints_implementation(F.array_join(must, "\n")), hard),
        "non_goal_not_in_must_satisfy": (no_stale, "told"),
        "final_active_intent_consistency": (no_stale & (F.size(must) > 0), "derived"),
        "evaluation_modes_complete": (modes_ok & (F.size(c("script")) == F.size(turns)), hard),
        "localization_checkpoint_ready": ((F.coalesce(F.trim(c("prompt")), F.lit("")) != "") & c("output_schema").isNotNull() & c("metrics").isNotNull() & gold, soft),
        "keep_localization_metrics": (gold & metric_ok, hard),
        "oracle_complete": ((F.size(F.array_except(_lits(ORACLE_KEYS), F.map_keys(c("oracle")))) == 0) & (F.size(oracle_must) > 0), hard),
        "agent_view_no_gold_or_leakage": (~evaluator_only & ~leaks_metadata(c("agent_text")), "told"),
        "template_dialogue_specific": (~templated | ((F.size(template_issues) == 0) & F.forall(turns, aligned) & F.forall(revising, lambda t: F.size(F.array_intersect(bound(t), known)) > 0)), "derived"),
    }
    other = [
        (F.exists(turns, lambda t: ~F.coalesce(t["operation"].isin(*OPERATIONS), F.lit(False))), "dialogue uses an unknown operation"),
        (F.exists(turns, lambda t: like(t["user_utterance"], P.TEMPLATE_ARTIFACT)), "dialogue contains template artifact wording"),
        (F.exists(turns, lambda t: leaks_metadata(t["user_utterance"]) | hints_implementation(t["user_utterance"])), "dialogue leaks benchmark metadata or implementation detail"),
        (~no_inactive, "non_goal/rejected/implementation unit appears in must_satisfy"), (no_inactive & ~no_stale, "deactivated/withdrawn claim appears in must_satisfy"),
        (evaluator_only, "agent view contains evaluator-only/private content"), (~evaluator_only & leaks_metadata(c("agent_text")), "agent view contains benchmark/private test metadata"),
        (F.exists(turns, lambda t: like(t["user_utterance"], P.RUNTIME_CLAIM)), "dialogue claims to have run or inspected code"),
        (leaks_metadata(modes_text), "evaluation modes leak benchmark metadata"),
        (F.exists(F.concat(F.coalesce("gold_files", F.array().cast("array<string>")), F.coalesce("gold_functions", F.array().cast("array<string>"))), lambda g: (g != "") & F.contains(c("prompt"), g)), "localization prompt leaks gold"),
        (leaks_metadata(c("prompt")) | leaks_metadata(F.array_join(oracle_must, "\n")), "localization prompt or oracle leaks benchmark metadata"),
    ]
    return named, other, F.when(templated, template_issues).otherwise(F.array().cast("array<string>"))


def gate(df: DataFrame) -> DataFrame:
    """Adds passed, status, action, hard_failures, soft_warnings, checks, scenario_fit, and the blocks localization, template and noisy_refinement.

    A null check has failed. A failure whose message says leak or benchmark rejects; any other asks for a review.

    Stages as columns of one narrow plan: checks first, then what follows from them, so no condition is written out twice.
    """
    named, other, template_issues = checks(df)
    ok = {n: F.coalesce(test, F.lit(False)) for n, (test, _) in named.items()}
    out = df.withColumn("checks", F.map_from_arrays(_lits(ok), F.array(*ok.values())))
    passed = lambda n: F.element_at("checks", F.lit(n))
    hard = [F.when(~passed(n), f"{n} failed") for n, (_, kind) in named.items() if kind == "hard"] + [F.when(F.coalesce(test, F.lit(False)), text) for test, text in other]
    soft = [F.when(~passed(n), f"{n} failed") for n, (_, kind) in named.items() if kind == "soft"]
    out = out.withColumn("template_issues", template_issues)
    told = F.transform("template_issues", lambda x: F.concat(F.lit("template_quality: "), x))
    out = out.withColumns({"hard_failures": F.concat(F.array_compact(F.array(*hard)), told), "soft_warnings": F.array_compact(F.array(*soft))})
    leaky = F.exists("hard_failures", lambda x: F.lower(x).rlike("leak|benchmark"))
    failed, warned = F.size("hard_failures") > 0, F.size("soft_warnings") > 0
    fit = passed("first_turn_initial_imperfect_report") & passed("noisy_refinement_present") & passed("unresolved_wrong_claims_absent") & passed("no_old_progressive_disclosure")
    size = lambda n: F.size(F.coalesce(F.col(n), F.array().cast("array<string>")))
    used = F.coalesce("is_template", F.lit(False))
    blocks = {
        "localization": F.struct(size("gold_files").alias("gold_files_count"), size("gold_functions").alias("gold_functions_count"), (size("gold_functions") > 0).alias("function_gold_available"), F.when(size("gold_files") > 0, "ready").otherwise("not_ready").alias("status")),
        "template": F.struct(used.alias("template_fallback_used"), F.when(~used, "not_used").when(F.size("template_issues") == 0, "pass").otherwise("fail").alias("template_quality_status"), F.col("template_issues").alias("issues")),
        "noisy_refinement": F.struct((~passed("no_old_progressive_disclosure")).alias("old_progressive_disclosure_pattern"), F.size(nested.unresolved(F.col("turns"))).alias("unresolved_wrong_claims"), F.when(fit, "pass").otherwise("fail").alias("scenario_fit")),
    }
    return out.withColumns(blocks).drop("template_issues").withColumns({
        "passed": ~failed, "status": F.when(~failed, "accepted").when(leaky, "rejected").otherwise("manual_review_required"),
        "action": F.when(failed, "manual_review").when(warned, "accept_with_warnings").otherwise("accept"), "scenario_fit": fit,
    })
