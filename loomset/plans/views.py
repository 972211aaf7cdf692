"""Who may see what: agent and evaluator views, public records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions import lists
from loomset.functions.text import like, strip
from loomset import patterns as P
from loomset.operators.nested import exposed

#: Fields that only evaluators see, as struct and field.
EVALUATOR_ONLY = (("localization_checkpoint", "gold"), ("evaluation_modes", "oracle_intent_prompt"), ("metadata", "golden_instance"))


def agent_view(df: DataFrame) -> DataFrame:
    """Without the oracle, gold, hidden units and reasons. Structs lose fields; nothing is masked."""
    out = df.drop("oracle")
    for column, field in EVALUATOR_ONLY:
        if column in out.columns and field in out.schema[column].dataType.names:
            left = [n for n in out.schema[column].dataType.names if n != field]
            out = out.withColumn(column, F.col(column).dropFields(field)) if left else out.drop(column)
    if "semantic_capsule" in out.columns:
        capsule, names = F.col("semantic_capsule"), out.schema["semantic_capsule"].dataType.names
        if "fact_units" in names:
            capsule = capsule.withField("fact_units", exposed(F.col("semantic_capsule.fact_units")))
        if "suitability" in names and "reason" in out.schema["semantic_capsule"].dataType["suitability"].dataType.names:
            capsule = capsule.dropFields("suitability.reason")
        out = out.withColumn("semantic_capsule", capsule)
    return out


def evaluator_view(df: DataFrame, quality: DataFrame, key: str = "instance_id") -> DataFrame:
    """Everything, and a summary of the quality report where there is one."""
    fields = [c for c in ("passed", "status", "hard_failures", "soft_warnings", "localization") if c in quality.columns]
    return df.join(quality.select(key, F.struct(*fields).alias("quality_report_summary")), key, "left")


def exportable(status: Column) -> Column:
    return status.isin(*P.ACCEPTED)


def denied_paths(paths: Column) -> Column:
    return F.filter(paths, lambda p: like(p, P.DENIED_KEYS))


def public_record(df: DataFrame) -> DataFrame:
    """The source record without patches and test lists: texts, addresses, counts."""
    counts = [c for c in ("problem_len", "patch_files_count", "source_files_count", "test_files_count", "patch_added_lines", "patch_removed_lines", "patch_hunks") if c in df.columns]
    texts = [c for c in ("problem_statement", "hints_text", "issue_url", "pr_url") if c in df.columns]
    head = [c for c in ("instance_id", "repo", "base_commit", "version", "created_at") if c in df.columns]
    return df.select(*head, F.struct(*texts).alias("source"), F.struct(*counts).alias("candidate_metadata") if counts else F.lit(None).alias("candidate_metadata"))


#: What the evaluation prompts say. {0} is the product's name.
FINAL = "Please implement the following final active issue intent."
CONCAT = ("The user may add, revise, contradict, retract, or correct earlier claims.", "Infer the final active intent from the whole conversation.", "Do not implement withdrawn, obsolete, unresolved speculative, mistaken, or rejected assumptions.")
RECAP = ("Before implementing, recap the final active claims and separate withdrawn, mistaken, or speculative claims.", "Only implement the final active intent; do not implement intermediate guesses that were withdrawn or left unresolved.")
JUDGE = "Judge whether a proposed patch satisfies the final active {0} intent."
MUST, PRESERVE, INACTIVE, REJECTED, MUST_NOT = "Must satisfy:", "Preserve:", "Inactive or rejected context:", "Inactive or rejected:", "Must not satisfy / must not keep active:"


def listed(title: str, items: Column) -> Column:
    """A blank line, a title and a bullet for each item; null without items."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")))


def prompts(final: Column, oracle: Column, turns: Column, localization: Column, product: str) -> dict[str, Column]:
    """The evaluation modes by name: final, concatenated, recap and oracle prompts, the script of turns (JSON) and the localization prompt.

    final: objective, must_satisfy, must_not_satisfy, non_goals, regression_expectations; oracle: must_satisfy, must_not_satisfy, in whose place
    the final intent's stand where they are empty; turns: turn_id, user_utterance. `product` is the name that two modes and one prompt carry.
    """
    arr = lambda c: lists.ordered_distinct(F.coalesce(c, F.array().cast("array<string>")))
    objective, must = F.coalesce(final["objective"], F.lit("")), arr(final["must_satisfy"])
    unwanted = arr(final["must_not_satisfy"])
    inactive = F.concat(unwanted, arr(final["non_goals"]))
    or_else = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    text = lambda *parts: strip(F.concat_ws("\n", *parts))
    said = F.transform(turns, lambda t: F.concat(F.coalesce(t["turn_id"], F.lit("None")), F.lit(": "), F.coalesce(t["user_utterance"], F.lit("None"))))
    judged = or_else(arr(oracle["must_satisfy"]), must)
    return {
        "final_issue_prompt": text(F.lit(f"{FINAL}\n"), F.concat(F.lit("Objective: "), objective), listed(MUST, must), listed(PRESERVE, arr(final["regression_expectations"]))),
        "concat_dialogue_prompt": text(F.lit("\n".join(CONCAT) + "\n"), F.array_join(said, "\n"), listed(INACTIVE, inactive)),
        f"multi_turn_{product}_script": F.to_json(F.transform(turns, lambda t: F.struct(t["turn_id"].alias("turn_id"), t["user_utterance"].alias("user_utterance")))),
        f"recap_{product}_prompt": text(F.lit("\n".join(RECAP) + "\n\nActive objective:"), objective, listed(MUST, must), listed(REJECTED, inactive)),
        "oracle_intent_prompt": text(F.lit(JUDGE.format(product.upper()) + "\n"), F.concat(F.lit("Final active intent: "), objective), F.coalesce(listed(MUST, judged), F.lit(f"\n{MUST}")), listed(MUST_NOT, or_else(arr(oracle["must_not_satisfy"]), unwanted))),
        "localization_prompt": localization,
    }
