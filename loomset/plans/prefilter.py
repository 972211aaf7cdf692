"""The noisy-refinement prefilter: features, score in hundredths, decision."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset import patterns as P
from loomset.functions.lists import as_bool, safe_int
from loomset.functions.text import like, strip

FEATURES = {
    "has_observed_behavior": P.OBSERVED, "has_expected_behavior": P.EXPECTED, "has_reproduction": P.REPRODUCTION, "has_component": P.COMPONENT,
    "has_refinement_clues": P.REFINEMENT, "has_regression_or_boundary": P.REGRESSION, "has_error": P.ERROR_MESSAGE, "has_environment": P.ENVIRONMENT,
}
#: What rejects at once, in the order told.
HARD = ("docs_only", "tests_only", "dependency_only", "formatting_only", "no_file_gold", "no_expected_behavior", "issue_too_short", "no_source_grounded_refinement_space")


def features(text: Column, words: Mapping[str, str] = FEATURES, component: Column | None = None, hints: Column | None = None) -> dict[str, Column]:
    """Eight flags; a component also by function gold, refinement also by hints of over 40 characters."""
    out = {k: like(text, p) for k, p in words.items()}
    if component is not None:
        out["has_component"] = out["has_component"] | component
    if hints is not None:
        out["has_refinement_clues"] = out["has_refinement_clues"] | (F.length(strip(hints)) > 40)
    return out


def richness(flags: Mapping[str, Column]) -> Column:
    out = F.lit(0)
    for k in FEATURES:
        out = out + flags[k].cast("int")
    return out


def hundredths(flags: Mapping[str, Column], length: Column, files: Column) -> Column:
    """The score in whole hundredths, 0 to 100: no sum of fractions stands beside a threshold."""
    out = F.lit(0)
    for k, w in P.PREFILTER_WEIGHTS.items():
        out = out + F.when(flags[k], w).otherwise(0)
    out = out + F.when(length >= 800, 6).when(length < 300, -10).otherwise(0) + F.when(files.between(1, 3), 4).when(files > 5, -8).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), out))


def decide(df: DataFrame, flags: Mapping[str, str], length: str, files: str, gold: str, hard: Mapping[str, Column]) -> DataFrame:
    """Adds prefilter_score, prefilter_decision, estimated_noisy_refinement_suitability, prefilter_reasons (joined by ;). `flags` name columns."""
    f = {k: F.col(v) for k, v in flags.items()}
    n, m, g = F.col(length), F.col(files), F.col(gold)
    out = df.withColumns({"_h": hundredths(f, n, m), "_rich": F.col("estimated_fact_richness")})
    tests = {
        **hard, "no_file_gold": ~g, "no_expected_behavior": ~f["has_expected_behavior"], "issue_too_short": n < 200,
        "no_source_grounded_refinement_space": ~f["has_refinement_clues"],
    }
    rejects = F.array_compact(F.array(*(F.when(tests[k], F.lit(f"reject:{k}")) for k in HARD if k in tests)))
    core = f["has_observed_behavior"] & f["has_expected_behavior"] & (f["has_reproduction"] | f["has_component"]) & f["has_refinement_clues"] & m.between(1, 3) & g
    out = out.withColumn("_rejects", rejects)
    keep = core & (F.col("_rich") >= P.KEEP_RICHNESS) & (F.col("_h") >= P.KEEP_SCORE)
    less = (F.col("_h") >= P.DEPRIORITIZE_SCORE) & (F.col("_rich") >= P.DEPRIORITIZE_RICHNESS)
    out = out.withColumn("prefilter_decision", F.when(F.size("_rejects") > 0, "reject").when(keep, "keep").when(less, "deprioritize").otherwise("reject"))
    d = F.col("prefilter_decision")
    noted = F.array_compact(F.array(
        F.when(n >= 800, "long_problem_statement").when(n < 300, "short_problem_statement"), F.when(m.between(1, 3), "focused_patch_files").when(m > 5, "patch_touches_many_files"), F.when(g, "file_gold_available")))
    final = F.when(d == "keep", F.array(F.lit("keep:core_signals_and_refinement_present"))).when(d == "deprioritize", F.array(F.lit("deprioritize:partial_signals")))
    final = final.when(F.size("_rejects") > 0, F.col("_rejects")).otherwise(F.array(F.lit("reject:insufficient_noisy_refinement_signals")))
    suitability = F.when(d == "keep", "high").when(d == "deprioritize", "medium").otherwise("low")
    return out.withColumns({"prefilter_score": F.col("_h") / 100.0, "estimated_noisy_refinement_suitability": suitability, "prefilter_reasons": F.array_join(F.concat(noted, final), ";")}).drop("_h", "_rich", "_rejects")


def prefilter(candidates: DataFrame) -> DataFrame:
    """The pool's candidates with the prefilter's columns."""
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    f = features(F.concat_ws("\n", text_of("problem_statement"), text_of("hints_text")), component=as_bool(F.col("has_function_gold")), hints=text_of("hints_text"))
    length = safe_int(F.col("problem_len"), 0) if "problem_len" in candidates.columns else F.length(text_of("problem_statement"))
    out = candidates.withColumns({**f, "_len": length, "_files": safe_int(F.col("patch_files_count")), "_gold": as_bool(F.col("has_file_gold"))})
    out = out.withColumn("estimated_fact_richness", richness({k: F.col(k) for k in FEATURES}))
    hard = {"docs_only": as_bool(F.col("docs_only")), "tests_only": as_bool(F.col("tests_only")), "dependency_only": as_bool(F.col("likely_dependency_only")), "formatting_only": as_bool(F.col("likely_formatting_only"))}
    return decide(out, {k: k for k in FEATURES}, "_len", "_files", "_gold", hard).drop("_len", "_files", "_gold", "has_error", "has_environment")


def bucket(score_hundredths: Column) -> Column:
    """The label of a score's tenth."""
    return F.format_string("%.1f", F.floor(score_hundredths / 10) / 10.0)
