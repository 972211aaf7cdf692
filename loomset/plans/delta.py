"""What a dialogue turn changes in the intent: operation by unit types, as a sparse map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.operators.nested import texts_of

#: Operations and unit types by role.
ACTIVE_OPERATIONS = ("initial_imperfect_report", "add_detail", "add_missing_detail", "add_reproduction_detail", "narrow_scope", "broaden_scope", "confirm_final_active_intent")
ACTIVE_TYPES = (
    "symptom", "observed_behavior", "expected_behavior", "reproduction", "error_message", "affected_component", "active_constraint", "negative_constraint",
    "regression_expectation", "boundary_case", "acceptance_signal", "ambiguity_or_correction", "conflict_or_tension",
)
OBSOLETE_TYPES = ("obsolete_candidate", "rejected_solution", "non_goal", "design_suggestion_non_goal", "workaround_to_reject")
CONSTRAINT_TYPES = ("active_constraint", "negative_constraint", "conflict_or_tension", "ambiguity_or_correction")
CORRECTIONS = ("correct_previous_claim", "retract_previous_claim", "replace_previous_claim")
REPLACED = "User replaced an earlier claim during issue refinement."


def _or(*lists: Column) -> Column:
    """The first list that has anything."""
    out = lists[-1]
    for x in reversed(lists[:-1]):
        out = F.when(F.size(x) > 0, x).otherwise(out)
    return out


def state_delta(operation: Column, claim: Column, deactivates: Column, activates: Column, units: Column, objective: Column) -> Column:
    """map<string, array<string>>, without empty lists. A replacement is old, new and reason, in that order."""
    none = F.array().cast("array<string>")
    active, obsolete, constraint = texts_of(units, ACTIVE_TYPES), texts_of(units, OBSOLETE_TYPES), texts_of(units, CONSTRAINT_TYPES)
    regression, negative = texts_of(units, ("regression_expectation",)), texts_of(units, ("negative_constraint",))
    when = lambda test, value: F.when(F.coalesce(test, F.lit(False)), value)
    corrects, conflict = operation.isin(*CORRECTIONS), operation == "resolve_conflict"
    gone = when(corrects, _or(deactivates, obsolete, constraint)).when(conflict, _or(deactivates, obsolete)).when(F.size(obsolete) > 0, obsolete).otherwise(none)
    goals = when(corrects | conflict | (operation == "broaden_scope"), _or(activates, active)).when(operation.isin(*ACTIVE_OPERATIONS), active).otherwise(none)
    first = lambda x, other: F.coalesce(F.get(x, F.lit(0)), F.lit(other))
    replaced = F.array(first(gone, "previous claim"), first(goals, "corrected claim"), F.lit(REPLACED))
    fields = {
        "add_active_goals": goals,
        "add_constraints": when(operation == "add_regression_constraint", constraint).when(operation == "narrow_scope", _or(constraint, active)).otherwise(none),
        "add_regression_expectations": when(operation == "add_regression_constraint", _or(regression, active)).otherwise(none),
        "add_forbidden_actions": negative,
        "deactivate_goals": when(operation == "narrow_scope", deactivates).otherwise(none),
        "deactivate_assumptions": gone,
        "replace_assumptions": when((operation == "replace_previous_claim") & ((F.size(gone) > 0) | (F.size(goals) > 0)), replaced).otherwise(none),
        "mark_claims_speculative": when((operation == "speculative_hypothesis") | (claim == "speculative"), _or(active, activates)).otherwise(none),
        "mark_claims_mistaken": when(operation.isin("mistaken_clarification", "incorrect_reproduction_detail") | (claim == "mistaken"), _or(active, activates)).otherwise(none),
        "resolve_conflicts": when(conflict, _or(F.concat(deactivates, activates), constraint)).otherwise(none),
    }
    dense = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))
    sparse = F.map_filter(dense, lambda _, v: F.size(v) > 0)
    confirmed = F.create_map(F.lit("add_active_goals"), F.array(F.trim(objective)))
    return F.when((operation == "confirm_final_active_intent") & (F.size(sparse) == 0) & (F.trim(objective) != ""), confirmed).otherwise(sparse)
