"""Turns, claims, deltas and views over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset import patterns as P
from loomset.operators import nested
from loomset.plans import views
from loomset.plans.delta import state_delta
from loomset.plans.gate import gate
from loomset.queries import query

OPERATIONS = ("initial_imperfect_report", "speculative_hypothesis", "add_detail", "correct_previous_claim", "narrow_scope", "mistaken_clarification", "replace_previous_claim", "confirm_final_active_intent")
TYPES = ("symptom", "expected_behavior", "negative_constraint", "obsolete_candidate", "regression_expectation")
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_OP = f"({_LIST(OPERATIONS)})[(turn + 1)::int]"
_CLEAN = "trim(text)"


def _pick(names, i):
    return F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))


def _turns(t):
    """Conversations as arrays of typed turns, in order. A conversation has a few turns, so gathering them is bounded."""
    c, empty = t("conversations"), F.array().cast("array<string>")
    k = F.col("turn")
    said = F.trim("text")
    turn = F.struct(
        k.alias("n"), F.concat(F.lit("T"), k + 1).alias("turn_id"), _pick(OPERATIONS, k % 8).alias("operation"), F.col("text").alias("user_utterance"), F.array(F.concat(F.lit("U"), k + 1)).alias("introduced_units"),
        F.when(k % 8 == 1, "speculative").otherwise("active").alias("claim_status"), F.when((k == 3) & (F.col("conv_id") % 2 == 0), F.array(F.lit("T2"))).otherwise(empty).alias("revises_turns"), empty.alias("revises_units"),
        empty.alias("deactivates_claims"), F.when((k == 6) & (F.col("conv_id") % 3 == 0), F.array(said)).otherwise(empty).alias("activates_claims"),
    )
    unit = F.struct(k.alias("n"), F.concat(F.lit("U"), k + 1).alias("unit_id"), _pick(TYPES, k % 5).alias("type"), said.alias("text"), F.lit(True).alias("active_by_default"), (F.col("conv_id") % 4 != k % 4).alias("expose_to_user"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.array_sort(F.collect_list(unit)).alias("units"))


@query("q25_turn_checks", """WITH c AS (SELECT conv_id, count(*) AS n, bool_and(CASE WHEN turn = 0 THEN role IN ('user', 'system') ELSE role <> 'system' END) AS roles, min(CASE WHEN turn = 0 THEN length(text) END) AS l0, count(DISTINCT role) AS kinds, max(turn) - min(turn) + 1 = count(*) AND min(turn) = 0 AS consecutive FROM conversations GROUP BY conv_id)
SELECT conv_id, n BETWEEN 3 AND 6 AS count_ok, roles AS roles_ok, l0 BETWEEN 20 AND 900 AS first_ok, kinds >= 2 AS kinds_ok, consecutive, n BETWEEN 3 AND 6 AND roles AND l0 BETWEEN 20 AND 900 AND kinds >= 2 AND consecutive AS passed FROM c""")
def q25(t):
    n, k = F.count("*"), F.col("turn")
    c = t("conversations").groupBy("conv_id").agg(
        n.between(3, 6).alias("count_ok"), F.bool_and(F.when(k == 0, F.col("role").isin("user", "system")).otherwise(F.col("role") != "system")).alias("roles_ok"),
        F.min(F.when(k == 0, F.length("text"))).between(20, 900).alias("first_ok"), (F.countDistinct("role") >= 2).alias("kinds_ok"), ((F.max("turn") - F.min("turn") + 1 == n) & (F.min("turn") == 0)).alias("consecutive"),
    )
    return c.withColumn("passed", F.col("count_ok") & F.col("roles_ok") & F.col("first_ok") & F.col("kinds_ok") & F.col("consecutive"))


_RES = "('correct_previous_claim', 'retract_previous_claim', 'replace_previous_claim', 'resolve_conflict', 'narrow_scope', 'broaden_scope', 'confirm_final_active_intent')"


@query("q26_claim_resolution", f"""WITH c AS (SELECT conv_id, turn, {_OP} AS op, turn = 3 AND conv_id % 2 = 0 AS names2, turn = 6 AND conv_id % 3 = 0 AND {_CLEAN} <> '' AS loaded FROM conversations),
w AS (SELECT c.conv_id, c.turn FROM c WHERE op IN ('speculative_hypothesis', 'mistaken_clarification', 'incorrect_reproduction_detail')),
u AS (SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM c r WHERE r.conv_id = w.conv_id AND r.op IN {_RES} AND r.turn > 0 AND ((r.names2 AND w.turn = 1) OR (r.loaded AND r.turn > w.turn))))
SELECT i.conv_id, coalesce((SELECT string_agg('T' || (turn + 1), ',' ORDER BY turn) FROM u WHERE u.conv_id = i.conv_id), '') AS unresolved FROM (SELECT DISTINCT conv_id FROM conversations) i""")
def q26(t):
    return _turns(t).select("conv_id", F.array_join(nested.unresolved(F.col("turns")), ",").alias("unresolved"))


_ACTIVE = "('symptom', 'expected_behavior', 'negative_constraint', 'regression_expectation')"


@query("q40_state_delta", f"""WITH c AS (SELECT conv_id, turn, {_OP} AS op, ({_LIST(TYPES)})[(turn % 5 + 1)::int] AS ty, {_CLEAN} AS said, CASE WHEN turn = 6 AND conv_id % 3 = 0 THEN {_CLEAN} ELSE '' END AS act FROM conversations),
a AS (SELECT *, CASE WHEN ty IN {_ACTIVE} THEN said ELSE '' END AS active, CASE WHEN ty = 'obsolete_candidate' THEN said ELSE '' END AS obsolete, CASE WHEN ty = 'negative_constraint' THEN said ELSE '' END AS cons FROM c),
b AS (SELECT *, op IN ('correct_previous_claim', 'replace_previous_claim') AS fixes FROM a),
g AS (SELECT *, CASE WHEN fixes THEN CASE WHEN act <> '' THEN act ELSE active END WHEN op IN ('initial_imperfect_report', 'add_detail', 'narrow_scope', 'confirm_final_active_intent') THEN active ELSE '' END AS goals,
 CASE WHEN fixes THEN CASE WHEN obsolete <> '' THEN obsolete ELSE cons END ELSE obsolete END AS gone FROM b),
k AS (SELECT conv_id, turn, 'add_active_goals' AS field, goals AS value FROM g UNION ALL SELECT conv_id, turn, 'add_constraints', CASE WHEN op = 'narrow_scope' THEN CASE WHEN cons <> '' THEN cons ELSE active END ELSE '' END FROM g
 UNION ALL SELECT conv_id, turn, 'add_forbidden_actions', cons FROM g UNION ALL SELECT conv_id, turn, 'deactivate_assumptions', gone FROM g
 UNION ALL SELECT conv_id, turn, 'mark_claims_speculative', CASE WHEN op = 'speculative_hypothesis' THEN active ELSE '' END FROM g UNION ALL SELECT conv_id, turn, 'mark_claims_mistaken', CASE WHEN op = 'mistaken_clarification' THEN active ELSE '' END FROM g
 UNION ALL SELECT conv_id, turn, 'replace_assumptions', CASE WHEN op = 'replace_previous_claim' AND (gone <> '' OR goals <> '') THEN CASE WHEN gone = '' THEN 'previous claim' ELSE gone END || '|' || CASE WHEN goals = '' THEN 'corrected claim' ELSE goals END || '|User replaced an earlier claim during issue refinement.' ELSE '' END FROM g
 UNION ALL SELECT conv_id, turn, 'add_active_goals', 'objective' FROM g WHERE op = 'confirm_final_active_intent' AND goals = '' AND gone = '' AND cons = '')
SELECT conv_id, (turn + 1)::bigint AS turn_no, field, value FROM k WHERE value <> ''""")
def q40(t):
    """What each turn changes, one row per field."""
    d = _turns(t).select("conv_id", "units", F.explode("turns").alias("x"))
    delta = state_delta(F.col("x.operation"), F.when(F.col("x.operation") == "x", "").otherwise(F.lit("")), F.col("x.deactivates_claims"), F.array_compact(F.transform("x.activates_claims", lambda v: F.when(v != "", v))), nested.pick(F.col("units"), F.col("x.introduced_units")), F.lit("objective"))
    told = d.select("conv_id", (F.col("x.n") + 1).alias("turn_no"), F.explode(delta).alias("field", "values"))
    return told.select("conv_id", "turn_no", "field", F.array_join("values", "|").alias("value"))


@query("q41_agent_view", """SELECT conv_id, count(*) FILTER (WHERE conv_id % 4 <> turn % 4) AS visible_units, string_agg(CASE WHEN conv_id % 4 <> turn % 4 THEN 'U' || (turn + 1) END, ',' ORDER BY turn) AS unit_ids, 'suitable' AS suitability, false AS has_gold, false AS has_oracle FROM conversations GROUP BY conv_id""")
def q41(t):
    """The agent's view of an instance: fields dropped from structs, hidden units filtered."""
    base = _turns(t).select(
        F.col("conv_id").alias("instance_id"), F.struct(F.struct(F.lit("suitable").alias("verdict"), F.lit("why").alias("reason")).alias("suitability"), F.col("units").alias("fact_units")).alias("semantic_capsule"),
        F.struct(F.lit("p").alias("prompt"), F.lit("secret").alias("gold")).alias("localization_checkpoint"), F.struct(F.lit(True).alias("golden_instance"), F.lit(1).alias("v")).alias("metadata"), F.lit("o").alias("oracle"),
    )
    seen = views.agent_view(base)
    ids = nested.ids(F.col("semantic_capsule.fact_units"))
    listed = F.when(F.size(ids) > 0, F.array_join(ids, ","))
    return seen.select(F.col("instance_id").alias("conv_id"), F.size(ids).cast("bigint").alias("visible_units"), listed.alias("unit_ids"), F.col("semantic_capsule.suitability.verdict").alias("suitability"), F.lit("gold" in seen.schema["localization_checkpoint"].dataType.names).alias("has_gold"), F.lit("oracle" in seen.columns).alias("has_oracle"))


@query("q44_concat_prompt", "SELECT conv_id, md5(string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn)) AS prompt_md5, count(*) AS turns FROM conversations GROUP BY conv_id")
def q44(t):
    c = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.trim("text")).alias("line")))).alias("ls"), F.count("*").alias("turns"))
    return c.select("conv_id", F.md5(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("prompt_md5"), "turns")


_LEAK = f"(regexp_matches(text, '{P.BENCHMARK_METADATA}', 'i') OR regexp_matches(text, '(?im){P.IMPLEMENTATION_HINT}'))"


@query("q55_quality_gate", f"""WITH c AS (SELECT conv_id, turn, {_OP} AS op, turn = 3 AND conv_id % 2 = 0 AS names2, turn = 6 AND conv_id % 3 = 0 AND {_CLEAN} <> '' AS loaded, {_LEAK} AS leaks FROM conversations),
w AS (SELECT conv_id, turn FROM c WHERE op IN ('speculative_hypothesis', 'mistaken_clarification', 'incorrect_reproduction_detail')),
u AS (SELECT w.conv_id, count(*) AS m FROM w WHERE NOT EXISTS (SELECT 1 FROM c r WHERE r.conv_id = w.conv_id AND r.op IN {_RES} AND r.turn > 0 AND ((r.names2 AND w.turn = 1) OR (r.loaded AND r.turn > w.turn))) GROUP BY w.conv_id),
g AS (SELECT conv_id, count(*) AS n, bool_or(op <> 'initial_imperfect_report' AND op <> 'add_detail') AS noisy, bool_or(op IN ('correct_previous_claim', 'replace_previous_claim', 'narrow_scope')) AS revises, bool_and(conv_id % 4 <> turn % 4) AS shown, bool_or(leaks) AS leaks FROM c GROUP BY conv_id)
SELECT g.conv_id, CASE WHEN leaks THEN 'rejected' ELSE 'manual_review_required' END AS status, n BETWEEN 3 AND 6 AS turn_count, noisy, revises, coalesce(u.m, 0) = 0 AS resolved, shown AS units_valid, n >= 3 AS revision_units_valid, false AS modes_complete, false AS localization_kept, coalesce(u.m, 0)::bigint AS unresolved FROM g LEFT JOIN u USING (conv_id)""")
def q55(t):
    """The quality gate over conversations as instances: the status, and checks that follow from the turns."""
    empty = F.array().cast("array<string>")
    d = _turns(t).select(
        "conv_id", F.lit(True).alias("suitable"), "units", nested.ids(F.col("units")).alias("compact_unit_ids"), F.struct(F.lit(True).alias("has_revision_fact"), F.array(F.lit("U3")).alias("revision_unit_ids")).alias("revision"),
        F.struct(F.lit("objective").alias("objective"), F.array(F.lit("keep it")).alias("must_satisfy")).alias("intent"), F.create_map(F.lit("must_satisfy"), F.array(F.lit("keep it"))).alias("oracle"), "turns",
        F.create_map(F.lit("oracle_intent_prompt"), F.lit("x")).alias("modes"), empty.alias("script"), F.lit("find it").alias("prompt"), F.lit("{}").alias("output_schema"), empty.alias("gold_files"), empty.alias("gold_functions"), empty.alias("metrics"),
        F.array(F.lit("$.a")).alias("agent_paths"), F.lit("").alias("agent_text"), F.lit(False).alias("is_template"), F.lit(False).alias("template_supported"),
    )
    names = {
        "turn_count": "dialogue_turn_count_valid", "noisy": "noisy_refinement_present", "revises": "has_revision_operation", "resolved": "unresolved_wrong_claims_absent", "units_valid": "introduced_units_valid",
        "revision_units_valid": "revision_unit_ids_valid", "modes_complete": "evaluation_modes_complete", "localization_kept": "keep_localization_metrics",
    }
    found = gate(d)
    return found.select("conv_id", "status", *(F.element_at("checks", F.lit(c)).alias(n) for n, c in names.items()), F.col("noisy_refinement.unresolved_wrong_claims").cast("bigint").alias("unresolved"))
