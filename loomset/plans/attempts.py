"""A batch's attempts: routing of failed stages, outcomes, resuming, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset import patterns as P
from loomset.functions.text import leak_severity, uncertain
from loomset.functions.lists import next_number
from loomset.operators import nested
from loomset.operators.attempts import attempt_chain, latest
from loomset.operators.metrics import resolved, weighted_mean
from loomset.plans import status as S


def stage_outcome(step: str, messages: Column, blob: Column) -> Column:
    """struct(status, reason) for a stage whose validation failed; null where it is an error of the step."""
    text = F.lower(F.array_join(messages, "\n"))
    made = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    review = lambda reason: made("manual_review_required", reason)
    if step == "fact_extraction":
        return F.when(text.rlike("source_span is not aligned to source|fact_grounding"), review("fact_grounding_validation_failed"))
    if step == "realistic_utterance_realization":
        leaks, artifact = text.rlike("leaks forbidden|benchmark/private"), text.rlike("template artifact")
        private = leak_severity(blob) == "private_or_evaluator_leakage"
        return F.when((leaks | artifact) & private, made("rejected", "realization_private_leakage_rejected")).when(artifact, review("utterance_template_artifact")).when(leaks, review("realization_leakage_manual_review"))
    if step not in ("initial_report_plan", "noisy_revision_event_plan"):
        return F.lit(None).cast("struct<status: string, reason: string>")
    out = F.when(text.rlike("withheld_units_for_later|withhold at least one|must not introduce every user-exposable fact unit"), review("no_withheld_units_for_later_refinement"))
    out = out.when(text.rlike("non-monotonic|wrong or speculative turns are unresolved|must introduce, revise, deactivate, or activate|final turn must not leave"), review("insufficient_source_facts_for_noisy_refinement"))
    out = out.when(text.rlike("old progressive|deprecated progressive"), review("would_degenerate_into_progressive_disclosure"))
    return out.when(F.size(messages) > 0, review("invalid_noisy_revision_event_plan")) if step == "noisy_revision_event_plan" else out


def outcomes(attempts: DataFrame) -> DataFrame:
    """Attempts with normalized status, filter reason, retry policy and review mode; one immutable row each."""
    c = F.col
    text = lambda n: c(n) if n in attempts.columns else F.lit(None).cast("string")
    flag = lambda n: c(n) if n in attempts.columns else F.lit(None).cast("boolean")
    count = lambda n: c(n) if n in attempts.columns else F.lit(0)
    out = attempts.withColumn("normalized_status", S.normalized(c("status")))
    filtered = c("normalized_status") == "auto_filtered"
    why = S.filter_reason(text("failure_reason"), text("manual_review_reason"), text("quality_gate_summary"), text("stage"), flag("old_progressive_disclosure_pattern"), flag("localization_checkpoint_ready"))
    out = out.withColumn("filter_reason", F.when(filtered, why))
    out = out.withColumn("retry", S.retry(c("normalized_status"), c("filter_reason"), S.transient(text("failure_reason"), count("client_exceptions"), count("transient_errors"))))
    return out.withColumns({"review_mode": F.when(filtered, "auto_filter").otherwise("none"), "human_review_expected": F.lit(False)})


def to_retry(attempts: DataFrame, most: int = 2) -> DataFrame:
    """Instances whose last attempt may run again."""
    last = latest(outcomes(attempts), "instance_id", ["attempt_id"])
    return last.where(F.col("retry.eligible") & (F.col("attempt_id") < most)).select("instance_id", (F.col("attempt_id") + 1).alias("attempt_id"))


def to_run(candidates: DataFrame, attempts: DataFrame, force: bool = False) -> DataFrame:
    """Resuming: candidates that no accepted attempt has; with `force` all."""
    if force:
        return candidates
    done = attempts.where(F.col("status").isin(*P.ACCEPTED)).select("instance_id").distinct()
    return candidates.join(done, "instance_id", "left_anti")


def instance_state(attempts: DataFrame) -> DataFrame:
    """The last attempt of each instance with its chain's outcome."""
    return attempt_chain(outcomes(attempts), "instance_id", ["attempt_id"], "status").where("is_last")


def task_report(scores: DataFrame) -> DataFrame:
    parts = {k: F.col(k) for k in P.SCORE_WEIGHTS}
    return scores.select("task_id", resolved(F.col("tests_passed"), F.col("intent_matched")).alias("resolved"), "tests_passed", weighted_mean(parts).alias("intermediate_score"), F.struct(*P.SCORE_WEIGHTS).alias("scores"))


#: The unit that stands for a source's own uncertainty.
UNCERTAIN_ID = "U999"
UNCERTAIN_TEXT = "User explicitly expresses uncertainty about whether the observed behavior is a bug or intended behavior."


def with_uncertainty(units: Column, source: Column) -> Column:
    """Units with one ambiguity unit U999 where the source says it isn't sure: the first of that type becomes it, else one is added."""
    at = F.array_position(F.transform(units, lambda u: u["type"]), "ambiguity_or_correction")
    named = lambda u: u.withField("unit_id", F.lit(UNCERTAIN_ID)).withField("text", F.lit(UNCERTAIN_TEXT)).withField("type", F.lit("ambiguity_or_correction")).withField("active_by_default", F.lit(True)).withField("expose_to_user", F.lit(True))
    moved = F.transform(units, lambda u: F.when((u["unit_id"] == UNCERTAIN_ID) & (u["type"] != "ambiguity_or_correction"), u.withField("unit_id", next_number(F.filter(nested.ids(units), lambda i: i != UNCERTAIN_ID)))).otherwise(u))
    replaced = F.transform(moved, lambda u, i: F.when(i == at - 1, named(u)).otherwise(u))
    added = F.concat(moved, F.array(named(F.get(moved, F.lit(0)))))
    return F.when(~uncertain(source) | (F.size(units) == 0), units).when(at > 0, replaced).otherwise(added)


def probe_trend(probe: DataFrame) -> DataFrame:
    """One row: whether more tokens mean fewer empty answers (falls, same or mixed), and how many settings are stable."""
    by = probe.groupBy("max_tokens").agg(F.count_if(F.col("error_type") == "empty_response").alias("n"))
    ordered = by.agg(F.transform(F.array_sort(F.collect_list(F.struct("max_tokens", "n"))), lambda x: x["n"]).alias("ns"))  # a few settings
    falls = F.forall(F.sequence(F.lit(1), F.size("ns") - 1), lambda i: F.get(F.col("ns"), i) <= F.get(F.col("ns"), i - 1))
    same = F.size(F.array_distinct("ns")) <= 1
    return ordered.select(F.when(same, "same").when(falls, "falls").otherwise("mixed").alias("empty_trend"), "ns")


def recommend(stable: list[str], trend: str, reasoning_only: list[str]) -> list[str]:
    """What a probe's few aggregated rows say, as lines of a report."""
    said = {"falls": "More tokens meant fewer empty answers.", "same": "More tokens did not change the number of empty answers.", "mixed": "More tokens had mixed effects."}
    plain = [s for s in stable if "non_reasoning" in s]
    route = "Route JSON steps to settings without reasoning." if plain and len(plain) == len(stable) else "Prefer settings without reasoning." if plain else "Keep the stable settings." if stable else "No stable route yet."
    return [f"- Stable settings: {'; '.join(stable) or 'none'}", f"- Empty answers with reasoning: {'; '.join(reasoning_only) or 'none'}", f"- Tokens: {said[trend]}", f"- Route: {route}"]
