"""Schemas of the relations, as DDL, and the step parameters."""

from __future__ import annotations

from loomset.sources.readers import ISSUE_COLUMNS, MODEL_OUTPUTS

_strings = lambda names: ", ".join(f"`{n}` string" for n in names)

ISSUE = _strings(c for c in ISSUE_COLUMNS if c not in ("fail_to_pass", "pass_to_pass"))
UNIT = "struct<unit_id: string, type: string, text: string, source: string, source_span: string, original_source_span: string, source_match_status: string, source_match_score: double, active_by_default: boolean, expose_to_user: boolean, risk: string>"
TURN = "struct<turn_id: string, operation: string, user_utterance: string, introduced_units: array<string>, claim_status: string, revises_turns: array<string>, revises_units: array<string>, deactivates_claims: array<string>, activates_claims: array<string>, state_delta: map<string, array<string>>>"
INTENT = "struct<objective: string, must_satisfy: array<string>, must_not_satisfy: array<string>, non_goals: array<string>, regression_expectations: array<string>>"
REVISION = "struct<has_revision_fact: boolean, revision_type: string, revision_unit_ids: array<string>, reason: string>"
CHECKPOINT = "struct<prompt: string, gold: struct<files: array<string>, functions: array<string>>, metrics: struct<file_hit_at_k: array<int>, function_hit_at_k: array<int>>>"
REGION = "struct<path: string, start: int, end: int>"
PATCH_METADATA = "struct<files: array<string>, components: array<string>, change_size: struct<label: string, added_lines: int, removed_lines: int, hunks: int>, leakage_risk: string, test_size: string>"

RELATIONS = {
    "issue": ISSUE,
    "fact_units": f"instance_id string, units array<{UNIT}>",
    "intent": f"instance_id string, final_intent {INTENT}, revision_support {REVISION}, oracle map<string, array<string>>",
    "turns": f"instance_id string, turns array<{TURN}>",
    "instance": f"instance_id string, semantic_capsule struct<suitability: struct<is_suitable: boolean, reason: string>, fact_units: array<{UNIT}>, final_intent: {INTENT}, revision_support: {REVISION}>, dialogue array<{TURN}>, oracle map<string, array<string>>, evaluation_modes map<string, string>, localization_checkpoint {CHECKPOINT}, metadata map<string, string>",
    "patch_metadata": f"instance_id string, patch_metadata {PATCH_METADATA}",
    "quality_report": "instance_id string, passed boolean, status string, hard_failures array<string>, soft_warnings array<string>, checks map<string, boolean>",
    "attempts": "instance_id string, attempt_id int, status string, stage string, failure_reason string, manual_review_reason string, quality_gate_summary string, api_calls int",
    "model_outputs": MODEL_OUTPUTS,
    "release_index": "instance_id string, run_id string, status string, agent_path string, evaluator_path string, provenance struct<source_run: string, content_sha256: string>",
    "trace": "event_id bigint, turn_id bigint, actor string, event_type string, content string, tool string, command string, metadata map<string, string>",
    "scores": "task_id string, resolved boolean, tests_passed boolean, intent_matched boolean, intent double, process double, dialogue double, exploration double",
    "predictions": "instance_id string, ranked_files array<struct<rank: int, path: string, reason: string>>, ranked_functions array<struct<rank: int, symbol: string, reason: string>>",
    "probe": "model string, mode string, max_tokens int, task string, ok boolean, error_type string, content_len int, reasoning_content_len int, elapsed_seconds double",
}

#: Temperature and tokens of each step.
STEP_PARAMS = {
    "fact_extraction": (0.1, 3000), "intent_revision": (0.1, 3000), "initial_report_plan": (0.0, 1800), "noisy_revision_event_plan": (0.0, 2600),
    "realistic_utterance_realization": (0.4, 2400), "semantic_reviewer": (0.1, 3000), "json_repair": (0.0, 1000),
}
ALLOWED_PARAMS = ("temperature", "max_tokens", "thinking", "response_format")
STEP_TIMEOUT_SECONDS = 90
