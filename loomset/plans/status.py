"""Statuses, filter reasons and the retry policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset import patterns as P


def normalized(status: Column) -> Column:
    return F.when(status.isin(*P.ACCEPTED), "accepted").when(status.isin("rejected", "step_failed", "pending", "running"), status).otherwise("auto_filtered")


def filter_reason(failure: Column, manual: Column, summary: Column, stage: Column, old_pattern: Column, localization_ready: Column) -> Column:
    """Why an attempt was filtered: the first of these that its texts name."""
    text = lambda c: F.coalesce(c, F.lit(""))
    blob = F.lower(F.concat_ws(" ", F.nullif(failure, F.lit("")), F.nullif(manual, F.lit("")), F.nullif(summary, F.lit(""))))
    has = lambda *words: blob.rlike("|".join(words))
    return (
        F.when(has("fact_grounding_validation_failed", "aligned to source"), F.when(has("source_span", "aligned to source"), "source_span_unmatched_after_retry").otherwise("fact_grounding_validation_failed"))
        .when(has("utterance_template_artifact", "template artifact"), "utterance_template_artifact")
        .when(has("benchmark") & has("user-facing", "user facing", "implementation hint"), "benchmarkish_or_user_facing_implementation_hint")
        .when(has("realization_leakage_manual_review", "leaks forbidden", "benchmark/private wording"), "realization_leakage_manual_review")
        .when(has("invalid_noisy_revision_event_plan"), "invalid_noisy_revision_event_plan")
        .when((text(failure) == "semantic_reviewer") | (text(stage) == "semantic_reviewer"), "semantic_reviewer_not_pass")
        .when(has("no_withheld_units_for_later_refinement"), "no_withheld_units_for_later_refinement")
        .when(has("would_degenerate_into_progressive_disclosure") | F.coalesce(old_pattern, F.lit(False)), "would_degenerate_into_progressive_disclosure")
        .when(has("no_supported_revision_fact", "no supported revision fact", "no source-grounded revision"), "weak_or_missing_revision_evidence")
        .when(has("insufficient_source_facts_for_noisy_refinement"), "insufficient_source_facts_for_noisy_refinement")
        .when(localization_ready.eqNullSafe(False) & has("localization"), "localization_not_ready")
        .otherwise("quality_gate_manual_review")
    )


#: What manual-review messages mean, the first that is named.
MANUAL = (
    (("fact_grounding_validation_failed", "source_span is not aligned to source"), "fact_grounding_validation_failed"),
    (("utterance_template_artifact", "template artifact"), "utterance_template_artifact"),
    (("invalid_noisy_revision_event_plan",), "invalid_noisy_revision_event_plan"),
    (("realization_private_leakage_rejected",), "realization_private_leakage_rejected"),
    (("realization_leakage_manual_review", "leaks forbidden implementation/benchmark text", "benchmark/private wording"), "realization_leakage_manual_review"),
    (("no_withheld_units_for_later_refinement",), "no_withheld_units_for_later_refinement"),
    (("would_degenerate_into_progressive_disclosure",), "would_degenerate_into_progressive_disclosure"),
)


def manual_reason(messages: Column) -> Column:
    text, out = F.lower(F.array_join(messages, "; ")), F
    for words, reason in MANUAL:
        out = out.when(text.rlike("|".join(words)), reason)
    return out.otherwise("insufficient_source_facts_for_noisy_refinement")


def broad_reason(reason: Column) -> Column:
    return F.when(reason.isin("no_withheld_units_for_later_refinement", "would_degenerate_into_progressive_disclosure"), "insufficient_source_facts_for_noisy_refinement").otherwise(reason)


#: Counters of errors that pass.
TRANSIENT = ("timeout", "empty_response", "rate_limited", "server_error", "invalid_json", "truncated_json")


def transient_count(errors: Column) -> Column:
    """How many of a step's errors, a map of counts by kind, may pass."""
    return F.aggregate(F.map_values(F.map_filter(F.coalesce(errors, F.create_map().cast("map<string,int>")), lambda k, _: k.isin(*TRANSIENT))), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def transient(failure: Column, client_exceptions: Column, transients: Column) -> Column:
    """Whether a failed step may succeed again: some passing error, no client exception, no exception or schema in its reason."""
    low = F.lower(F.coalesce(failure, F.lit("")))
    return ~low.rlike("exception|schema") & (F.coalesce(client_exceptions, F.lit(0)) == 0) & (F.coalesce(transients, F.lit(0)) > 0)


def retry(status: Column, reason: Column, may_pass: Column) -> Column:
    """struct(eligible, policy, reason) for a normalized status."""
    made = lambda ok, why: F.struct(F.lit(ok).alias("eligible"), F.lit("full_chain_retry_once" if ok else "none").alias("policy"), F.lit(why).alias("reason"))
    return (
        F.when((status == "auto_filtered") & reason.isin(*P.RETRYABLE), made(True, "generation_boundary_instability"))
        .when(status == "auto_filtered", made(False, "not_retryable_content_unsuitability"))
        .when((status == "step_failed") & may_pass, made(True, "transient_technical_failure"))
        .when(status == "step_failed", made(False, "deterministic_technical_failure")).otherwise(made(False, "not_applicable"))
    )
