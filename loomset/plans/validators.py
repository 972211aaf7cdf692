"""Validators of the staged outputs: typed nested columns in, arrays of errors and warnings out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset import patterns as P
from loomset.functions.lists import ordered_distinct
from loomset.functions.text import hints_implementation, leaks_metadata, like
from loomset.functions.tokens import alignment_tokens, overlap
from loomset.operators import nested
from loomset.plans.rules import Rule, at_each, errors, warnings

#: Vocabularies of the staged outputs.
FACT_TYPES = (
    "symptom", "observed_behavior", "expected_behavior", "reproduction", "error_message", "environment", "affected_component", "active_constraint", "negative_constraint", "regression_expectation",
    "obsolete_candidate", "rejected_solution", "non_goal", "ambiguity_or_correction", "conflict_or_tension", "implementation_hint",
)
REVISION_TYPES = ("obsolete_candidate", "rejected_solution", "negative_constraint", "regression_expectation", "ambiguity_or_correction", "conflict_or_tension")
OPERATIONS = (
    "initial_imperfect_report", "add_detail", "add_missing_detail", "add_reproduction_detail", "speculative_hypothesis", "mistaken_clarification", "incorrect_reproduction_detail", "correct_previous_claim",
    "retract_previous_claim", "replace_previous_claim", "resolve_conflict", "narrow_scope", "broaden_scope", "add_regression_constraint", "confirm_final_active_intent",
)
CLAIMS = ("active", "partially_active_with_uncertainty", "speculative", "mistaken", "correction", "retraction", "replacement", "confirmation")
CORE_TYPES = (*P.CORE_INITIAL_TYPES, "uncertainty")
ORACLE_KEYS = ("must_satisfy", "must_not_satisfy", "obsolete_intent_checks", "regression_checks", "forbidden_checks", "clarification_checks")
FORBIDDEN = r"\bpatch\b|\bdiff\b|\btests?\b|\bbenchmark\b|\bgold\b|\boracle\b|FAIL_TO_PASS|PASS_TO_PASS|hidden\s+test|reference\s+patch"
FIRST_FORBIDDEN = r"\b(patch|diff|tests?|gold|oracle|reference patch|hidden test)\b"
ARTIFACT = r"\bUser initially\b|\bWhat I need is\b|\bthat call\b|\bseems off\b|\bPlease preserve this existing behavior\b"
ALIGNED = ("exact", "normalized", "fuzzy")

_blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
_at = lambda name, i, rest: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"), rest if isinstance(rest, Column) else F.lit(rest))


def _arr(c: Column) -> Column:
    return ordered_distinct(F.coalesce(c, F.array().cast("array<string>")))


def facts(units: Column, summary: Column, blob: Column) -> list[Rule]:
    """units need unit_id, type, text, source, source_span, source_match_status, active_by_default, expose_to_user."""
    n = F.size(units)
    ids = nested.ids(units)
    covered = F.array_intersect(F.transform(units, lambda u: u["type"]), F.array(*map(F.lit, ("symptom", "observed_behavior", "expected_behavior"))))
    hint = lambda u: u["type"] == "implementation_hint"
    loose = lambda u: ~_blank(u["source_span"]) & ~F.coalesce(u["source_match_status"].isin(*ALIGNED), F.lit(False))
    return [
        Rule(leaks_metadata(blob), "fact_extraction contains benchmark/private metadata"), Rule(_blank(summary), "issue_summary is empty"), Rule(units.isNull() | (n <= 0), "fact_units must be a non-empty list"),
        Rule(each=at_each(units, lambda u, i: _blank(u["unit_id"]), lambda u, i: _at("fact_units", i, ".unit_id is missing"))),
        Rule(each=at_each(units, lambda u, i: ~_blank(u["unit_id"]) & (F.array_position(ids, u["unit_id"]) <= i), lambda u, i: F.concat(F.lit("duplicate fact unit id: "), u["unit_id"]))),
        Rule(each=at_each(units, lambda u, i: ~F.coalesce(u["type"].isin(*FACT_TYPES), F.lit(False)), lambda u, i: _at("fact_units", i, F.concat(F.lit(".type is invalid: "), F.coalesce(u["type"], F.lit("")))))),
        Rule(each=at_each(units, lambda u, i: _blank(u["text"]), lambda u, i: _at("fact_units", i, ".text is empty"))),
        Rule(each=at_each(units, lambda u, i: ~F.coalesce(u["source"].isin("problem_statement", "hints_text"), F.lit(False)), lambda u, i: _at("fact_units", i, F.concat(F.lit(".source is invalid: "), F.coalesce(u["source"], F.lit("")))))),
        Rule(each=at_each(units, lambda u, i: _blank(u["source_span"]), lambda u, i: _at("fact_units", i, ".source_span is empty"))),
        Rule(each=at_each(units, lambda u, i: loose(u) & critical(u), lambda u, i: _at("fact_units", i, ".source_span is not aligned to source"))),
        Rule(each=at_each(units, lambda u, i: loose(u) & ~critical(u), lambda u, i: _at("fact_units", i, ".source_span is not aligned to source")), soft=True),
        Rule(each=at_each(units, lambda u, i: u["source_match_status"] == "fuzzy", lambda u, i: _at("fact_units", i, ".source_span matched by conservative fuzzy repair")), soft=True),
        Rule(each=at_each(units, lambda u, i: hint(u) & ~u["expose_to_user"].eqNullSafe(False), lambda u, i: F.concat(F.lit("implementation_hint "), u["unit_id"], F.lit(" must expose_to_user=false")))),
        Rule(each=at_each(units, lambda u, i: hint(u) & ~u["active_by_default"].eqNullSafe(False), lambda u, i: F.concat(F.lit("implementation_hint "), u["unit_id"], F.lit(" must active_by_default=false")))),
        Rule(each=at_each(units, lambda u, i: leaks_metadata(u["text"]), lambda u, i: _at("fact_units", i, " contains benchmark/private metadata"))),
        Rule(F.size(F.array_distinct(covered)) < 2, "fact_units must cover at least two of symptom/observed_behavior/expected_behavior"),
    ]


#: The unit types whose span must be in the source.
CRITICAL_TYPES = (
    "symptom", "observed_behavior", "expected_behavior", "reproduction", "error_message", "environment", "affected_component", "active_constraint", "negative_constraint", "regression_expectation",
    "ambiguity_or_correction", "conflict_or_tension",
)


def critical(u: Column) -> Column:
    return F.coalesce(u["type"].isin(*CRITICAL_TYPES), F.lit(False)) & ~u["active_by_default"].eqNullSafe(False) & ~u["expose_to_user"].eqNullSafe(False)


def intent(units: Column, final: Column, support: Column, oracle: Column, blob: Column) -> list[Rule]:
    """final: objective, must_satisfy; support: has_revision_fact, revision_type, revision_unit_ids, reason; oracle: a map of lists."""
    revised, must = _arr(support["revision_unit_ids"]), _arr(final["must_satisfy"])
    known = nested.ids(units)
    typed = F.map_from_entries(F.transform(units, lambda u: F.struct(u["unit_id"], u["type"])))
    has = support["has_revision_fact"]
    inactive = F.transform(F.filter(units, lambda u: u["type"].isin("obsolete_candidate", "rejected_solution", "non_goal", "implementation_hint")), lambda u: F.lower(F.trim(u["text"])))
    surface = F.lower(F.array_join(must, " "))
    said = lambda u, rest: F.concat(F.lit("revision_support unit "), u, F.lit(" has non-revision type "), rest)
    return [
        Rule(leaks_metadata(blob), "intent_revision contains benchmark/private metadata"), Rule(_blank(final["objective"]), "final_intent.objective is empty"), Rule(F.size(must) == 0, "final_intent.must_satisfy is empty"),
        Rule(support.isNull(), "revision_support is missing"), Rule(has.isNull(), "revision_support.has_revision_fact must be boolean"),
        Rule(has & ~F.coalesce(support["revision_type"].isin(*REVISION_TYPES), F.lit(False)), F.concat(F.lit("revision_support.revision_type is invalid: "), F.coalesce(support["revision_type"], F.lit("")))),
        Rule(has & (F.size(revised) == 0), "revision_support.has_revision_fact=true requires revision_unit_ids"),
        Rule(~has, "no supported revision fact; instance requires manual review before dialogue construction", soft=True),
        Rule(each=F.transform(F.array_except(revised, known), lambda u: F.concat(F.lit("revision_support references unknown unit "), u))),
        Rule(each=at_each(revised, lambda u, i: F.array_contains(known, u) & ~F.coalesce(F.try_element_at(typed, u).isin(*REVISION_TYPES), F.lit(False)), lambda u, i: said(u, F.coalesce(F.try_element_at(typed, u), F.lit("None"))))),
        Rule(_blank(support["reason"]), "revision_support.reason is empty"),
        Rule(F.exists(inactive, lambda x: (x != "") & F.contains(surface, x)), "obsolete/rejected/non_goal/implementation fact appears in final_intent.must_satisfy"),
        Rule(each=F.transform(F.array_except(F.array(*map(F.lit, ORACLE_KEYS)), F.coalesce(F.map_keys(oracle), F.array().cast("array<string>"))), lambda k: F.concat(F.lit("oracle."), k, F.lit(" is missing")))),
        Rule((F.size(F.map_keys(oracle)) > 0) & (F.size(_arr(F.try_element_at(oracle, F.lit("must_satisfy")))) == 0), "oracle.must_satisfy is empty"),
    ]


def _refs(name: str, values: Column, shown: Column) -> Rule:
    return Rule(each=F.transform(F.array_except(_arr(values), shown), lambda u: F.concat(F.lit(f"{name} references unknown or non-exposed unit "), u)))


def _core(ids: Column, units: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(F.transform(nested.pick(units, ids), lambda u: u["type"])), F.array(*map(F.lit, CORE_TYPES))))


def report(units: Column, plan: Column, blob: Column) -> list[Rule]:
    """plan: introduced_units, imperfection_types, noisy_or_imperfect_units, withheld_units_for_later, rationale."""
    shown = nested.ids(nested.exposed(units))
    first, later = _arr(plan["introduced_units"]), _arr(plan["withheld_units_for_later"])
    name = "initial_report"
    return [
        Rule(plan.isNull(), "initial_report_plan.initial_report is missing"), Rule(F.size(first) == 0, f"{name}.introduced_units must be non-empty"), _refs(f"{name}.introduced_units", first, shown),
        Rule(~F.size(first).between(3, 7), f"{name}.introduced_units must contain 3-7 ids"), Rule(_core(first, units) < 2, f"{name} must cover at least two core fact types"),
        Rule(F.size(_arr(plan["imperfection_types"])) == 0, f"{name}.imperfection_types must be non-empty"), _refs(f"{name}.noisy_or_imperfect_units", plan["noisy_or_imperfect_units"], shown),
        Rule(F.size(later) == 0, f"{name}.withheld_units_for_later must be non-empty"), _refs(f"{name}.withheld_units_for_later", later, shown),
        Rule(F.size(F.array_except(later, first)) == 0, f"{name} must withhold at least one later source-grounded unit"),
        Rule((F.size(first) >= F.size(shown)) & (F.size(shown) > 3), f"{name} must not introduce every user-exposable fact unit"),
        Rule(_blank(plan["rationale"]), f"{name}.rationale is empty"), Rule(leaks_metadata(blob), "initial_report_plan contains benchmark/private metadata"),
    ]


def events(units: Column, turns: Column, first_units: Column, has_revision: Column, revision_ids: Column, blob: Column) -> list[Rule]:
    """turns: turn_id, operation, claim_status, introduced_units, revises_turns, revises_units, deactivates_claims, activates_claims, must_be_resolved_later."""
    shown = nested.ids(nested.exposed(units))
    bound = lambda t: F.array_union(_arr(t["introduced_units"]), _arr(t["revises_units"]))
    revises = lambda t: t["operation"].isin(*P.REVISION) | t["claim_status"].isin("correction", "retraction", "replacement")
    loaded = lambda t: (F.size(bound(t)) > 0) | (F.size(_arr(t["deactivates_claims"])) > 0) | (F.size(_arr(t["activates_claims"])) > 0)
    one = F.get(turns, F.lit(0))
    t1 = _arr(one["introduced_units"])
    ops = F.transform(turns, lambda t: t["operation"])
    any_of = lambda names: F.arrays_overlap(ops, F.array(*map(F.lit, names)))
    unknown = lambda field: F.flatten(F.transform(turns, lambda t, i: F.transform(F.array_except(_arr(t[field]), shown), lambda u: F.concat(F.lit("turns["), i.cast("string"), F.lit(f"].{field} references unknown or non-exposed unit "), u))))
    has = F.coalesce(has_revision, F.lit(False))
    open_ = unresolved_claims(turns)
    tied = F.exists(turns, lambda t: revises(t) & F.arrays_overlap(bound(t), _arr(revision_ids)))
    return [
        Rule(~F.size(turns).between(3, 6), "noisy_revision_event_plan.turns must contain 3-6 turns"), Rule(each=unknown("introduced_units")), Rule(F.size(t1) == 0, "turns[0].introduced_units must be non-empty"),
        Rule(each=at_each(turns, lambda t, i: t["turn_id"] != F.concat(F.lit("T"), i + 1), lambda t, i: _at("turns", i, F.concat(F.lit(".turn_id must be T"), (i + 1).cast("string"))))),
        Rule(each=at_each(turns, lambda t, i: t["operation"].isin(*P.DEPRECATED_OPERATIONS), lambda t, i: _at("turns", i, F.concat(F.lit(".operation uses deprecated progressive operation: "), t["operation"])))),
        Rule(each=at_each(turns, lambda t, i: ~F.coalesce(t["operation"].isin(*OPERATIONS), F.lit(False)), lambda t, i: _at("turns", i, F.concat(F.lit(".operation is invalid: "), F.coalesce(t["operation"], F.lit("")))))),
        Rule(one["operation"] != "initial_imperfect_report", "T1 operation must be initial_imperfect_report"), Rule(~F.size(t1).between(3, 7), "T1 introduced_units must contain 3-7 ids"),
        Rule((F.size(_arr(first_units)) > 0) & (F.array_sort(t1) != F.array_sort(_arr(first_units))), "T1 introduced_units must match initial_report_plan.initial_report.introduced_units"),
        Rule(_core(t1, units) < 2, "T1 must cover at least two core fact types"),
        Rule(each=at_each(turns, lambda t, i: (i > 0) & (t["operation"] == "initial_imperfect_report"), lambda t, i: F.lit("Only T1 may use initial_imperfect_report"))),
        Rule(each=at_each(turns, lambda t, i: ~F.coalesce(t["claim_status"].isin(*CLAIMS), F.lit(False)), lambda t, i: _at("turns", i, F.concat(F.lit(".claim_status is invalid: "), F.coalesce(t["claim_status"], F.lit("")))))),
        Rule(each=unknown("revises_units")),
        Rule(each=at_each(turns, lambda t, i: (i > 0) & ~loaded(t) & (t["operation"] != "confirm_final_active_intent"), lambda t, i: _at("turns", i, " must introduce, revise, deactivate, or activate at least one source-grounded claim"))),
        Rule(each=at_each(turns, lambda t, i: revises(t) & ~has, lambda t, i: _at("turns", i, " uses revision operation without supported revision fact"))),
        Rule(each=at_each(turns, lambda t, i: revises(t) & (F.size(bound(t)) == 0), lambda t, i: _at("turns", i, " revision operation must bind source fact units"))),
        Rule(F.coalesce(F.try_element_at(turns, F.lit(-1))["must_be_resolved_later"], F.lit(False)), "final turn must not leave must_be_resolved_later unresolved"),
        Rule(~any_of(P.NON_MONOTONIC), "noisy_revision_event_plan must include at least one noisy/non-monotonic refinement operation"),
        Rule(F.size(open_) > 0, F.concat(F.lit("wrong or speculative turns are unresolved: "), F.array_join(open_, ", "))),
        Rule(has & ~any_of(P.REVISION), "noisy_revision_event_plan must include at least one revision/final-active operation"),
        Rule(has & ~tied, "noisy_revision_event_plan revision operation is not bound to revision_support", soft=True),
        Rule(leaks_metadata(blob), "noisy_revision_event_plan contains benchmark/private metadata"),
    ]


def unresolved_claims(turns: Column) -> Column:
    """As operators.nested.unresolved, with claims that are speculative or mistaken by status too."""
    marked = F.transform(turns, lambda t: F.when(t["claim_status"].isin("speculative", "mistaken") & ~t["operation"].isin(*P.WRONG_OR_SPECULATIVE) & ~t["operation"].isin(*P.RESOLUTION), t.withField("operation", F.lit("speculative_hypothesis"))).otherwise(t))
    return nested.unresolved(marked)


def utterances(units: Column, turns: Column, said: Column, blob: Column) -> list[Rule]:
    """said: turn_id, user_utterance."""
    wanted, got = nested.ids(turns, "turn_id"), nested.ids(said, "turn_id")
    by_id = F.map_from_entries(F.transform(turns, lambda t: F.struct(t["turn_id"], t)))
    one = F.get(said, F.lit(0))["user_utterance"]
    told = lambda u: F.try_element_at(by_id, u["turn_id"])
    matched = lambda u: F.exists(nested.pick(units, _arr(told(u)["introduced_units"])), lambda x: overlap(alignment_tokens(u["user_utterance"]), alignment_tokens(x["text"])) > 0)
    missing = F.array_except(wanted, got)
    name = "realistic_utterance_realization"
    return [
        Rule(F.size(said) != F.size(turns), f"{name} must contain one utterance per event-plan turn"),
        Rule(each=at_each(said, lambda u, i: ~F.array_contains(wanted, u["turn_id"]), lambda u, i: _at("utterances", i, F.concat(F.lit(".turn_id is unknown: "), u["turn_id"])))),
        Rule(each=at_each(said, lambda u, i: F.array_position(got, u["turn_id"]) <= i, lambda u, i: F.concat(F.lit("duplicate utterance turn_id: "), u["turn_id"]))),
        Rule(each=at_each(said, lambda u, i: _blank(u["user_utterance"]), lambda u, i: _at("utterances", i, ".user_utterance is empty"))),
        Rule((F.size(said) > 0) & ~F.length(F.trim(one)).between(120, 900), "T1 must be a realistic initial issue report of 120-900 chars"),
        Rule(like(one, FIRST_FORBIDDEN) | like(one, P.GENERIC_FIRST_TURN), "T1 must be an imperfect issue report without benchmark/private wording"),
        Rule(each=at_each(said, lambda u, i: like(u["user_utterance"], ARTIFACT), lambda u, i: _at("utterances", i, " contains template artifact wording"))),
        Rule(each=at_each(said, lambda u, i: like(u["user_utterance"], FORBIDDEN) | hints_implementation(u["user_utterance"]), lambda u, i: _at("utterances", i, " leaks forbidden implementation/benchmark text"))),
        Rule(each=at_each(said, lambda u, i: (told(u)["operation"] == "confirm_final_active_intent") & (F.length(u["user_utterance"]) > 420), lambda u, i: _at("utterances", i, " final confirmation turn is verbose")), soft=True),
        Rule(each=at_each(said, lambda u, i: (F.size(_arr(told(u)["introduced_units"])) > 0) & ~matched(u), lambda u, i: _at("utterances", i, " does not align with introduced_units"))),
        Rule(F.size(missing) > 0, F.concat(F.lit(f"{name} is missing turn ids: "), F.array_join(F.array_sort(missing), ", "))),
        Rule(leaks_metadata(blob), f"{name} contains benchmark/private metadata"),
    ]


def review(r: Column) -> list[Rule]:
    """r: the reviewer's verdict as a struct."""
    of = lambda c, *values: F.coalesce(c.isin(*values), F.lit(False))
    name, accepts = "semantic_reviewer", F.coalesce(r["decision"] == "accept", F.lit(False))
    flags = ("has_non_monotonic_claim_evolution", "wrong_or_speculative_claims_resolved", "old_progressive_disclosure_pattern", "final_intent_consistent", "revision_grounded")
    rules = [Rule(~of(r["decision"], "accept", "manual_review_required", "reject"), F.concat(F.lit(f"{name}.decision is invalid: "), F.coalesce(r["decision"], F.lit(""))))]
    rules += [Rule(~of(r[k], "pass", "weak", "fail"), f"{name}.{k} is invalid") for k in ("scenario_fit", "initial_report_quality", "noisy_refinement_quality")]
    rules += [Rule(r[k].isNull(), f"{name}.{k} must be boolean") for k in flags]
    rules += [Rule(~of(r["leakage_risk"], "low", "medium", "high"), f"{name}.leakage_risk is invalid"), Rule(r["issues"].isNull(), f"{name}.issues must be a list"), Rule(r["required_fixes"].isNull(), f"{name}.required_fixes must be a list")]
    true, false = (lambda c: c.eqNullSafe(True)), (lambda c: c.eqNullSafe(False))
    accepted = (
        (~r["scenario_fit"].eqNullSafe("pass"), "accepted without scenario_fit=pass"), (r["initial_report_quality"] == "fail", "accepted failing initial_report_quality"), (r["noisy_refinement_quality"] == "fail", "accepted failing noisy_refinement_quality"),
        (~true(r[flags[0]]), "accepted without non-monotonic claim evolution"), (~true(r[flags[1]]), "accepted with unresolved wrong/speculative claims"), (F.coalesce(r["unresolved_wrong_claims"], F.lit(0)) != 0, "accepted with unresolved_wrong_claims != 0"),
        (~false(r[flags[2]]), "accepted old progressive disclosure pattern"), (~true(r[flags[3]]), "accepted without final_intent_consistent=true"), (~true(r[flags[4]]), "accepted without revision_grounded=true"), (~r["leakage_risk"].eqNullSafe("low"), "accepted non-low leakage_risk"),
    )
    return rules + [Rule(accepts & test, f"{name} {text}") for test, text in accepted]


#: By step, in the order of the pipeline.
REGISTRY: dict[str, Callable[..., list[Rule]]] = {
    "fact_extraction": facts, "intent_revision": intent, "initial_report_plan": report, "noisy_revision_event_plan": events,
    "realistic_utterance_realization": utterances, "semantic_reviewer": review,
}


def validated(df: DataFrame, step: str, *columns: Column) -> DataFrame:
    """Adds errors and warnings of a step's validator."""
    rules = REGISTRY[step](*columns)
    return df.withColumns({"errors": errors(rules), "warnings": warnings(rules)})
