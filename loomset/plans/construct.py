"""Construction: sanitizing and repairs of staged outputs, localization, compiled instances, tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions import diff, lists, paths
from loomset.functions.text import first_nonempty, initial_query, issue_type, like, persona, scrub, section, strip, title
from loomset.functions.tokens import alignment_tokens
from loomset.operators import nested
from loomset.plans.delta import state_delta

#: What makes a fact an implementation hint, in hints and anywhere.
HINT_WORDS = (r"\.py|line |proposal|proposed fix|relevant code|assumption|run tests|cannot run tests|local env", r"\b(?:np|numpy)\s*[0-9]|\b(?:released|dropped)\b|\b\d+\s*(?:h|hr|hour)s?\b")
ANY_HINT_WORDS = (r"\bpr\s*#?\d+\b|\b(?:test|case)\s+(?:came|comes|was introduced|introduced)\s+in\b", r"\b(?:originates?|derived)\b[^\n.]{0,120}\b(?:gist|#\d+)\b")
#: Simulated users as name, style and description.
PERSONAS = (
    ("Alice", "concise", "A busy maintainer who gives short answers and expects the engineer to ask for needed details."),
    ("Sara", "uncertain", "A user who has observed the failure but is unsure whether their diagnosis is correct."),
    ("Luis", "technical", "A technical user who can paste logs and reproduction snippets, but does not inspect the repository."),
    ("Marta", "impatient", "A user who wants a quick fix and may push for shortcuts that need verification."),
    ("Bob", "novice", "A less experienced user who describes symptoms in plain language and may use imprecise terms."),
)
#: Misleading cues as trap, claim, what the agent should do, severity. The last needs source files.
CUES = (
    ("underspecified", "I do not have all the details handy at first; ask me for the exact error or reproduction if you need it.", "Ask targeted clarification questions instead of assuming the complete issue.", "low"),
    ("wrong_cause", "I suspect this may just be caused by my local setup or a dependency version.", "Treat the claim as a hypothesis and verify it with repository evidence.", "medium"),
    ("over_fix", "Maybe the fastest fix is to disable the failing behavior entirely.", "Reject broad destructive changes and preserve documented behavior.", "high"),
    ("wrong_location", "I think the problem is probably in configuration or tests, not the library code.", "Use code exploration and tests to locate the actual source files.", "medium"),
)
#: A task's constraints (the last needs a test patch), what it must not do, its traps, who sees what, hidden fields.
CONSTRAINTS = ("The fix must resolve all FAIL_TO_PASS tests.", "The fix must not regress PASS_TO_PASS tests.", "The agent should not modify tests to hide the failure.", "Evaluation tests are applied after the model patch.")
NON_GOALS = ("Do not apply the gold patch directly during evaluation.", "Do not rely on the hidden test patch as agent-visible context.")
TRAPS = ("The initial user request is intentionally incomplete.", "User guesses may be incorrect and should be verified against code and tests.")
DISCLOSURE = {"initial_query": "Only broad issue intent is visible.", "follow_up": "Reveal details only when the agent asks targeted questions."}
HIDDEN_FROM_AGENT = ("patch", "test_patch", "FAIL_TO_PASS", "PASS_TO_PASS")
HIDDEN_FIELDS = ("problem_statement", *HIDDEN_FROM_AGENT)
RECALL_KS = (1, 3, 5, 10)
LOCALIZATION_PROMPT = "Rank the files and functions that the final intent most likely concerns. Give paths relative to the repository and symbols as path::name."


def sanitized_units(units: Column) -> tuple[Column, Column]:
    """(units with scrubbed texts and safe flags, warnings by place)."""
    clean = F.transform(units, lambda u: u.withField("text", scrub(F.coalesce(u["text"], F.lit("")))).withField("expose_to_user", F.when(u["type"] == "implementation_hint", False).otherwise(F.coalesce(u["expose_to_user"], F.lit(True)))).withField("active_by_default", F.when(u["type"] == "implementation_hint", False).otherwise(F.coalesce(u["active_by_default"], F.lit(True)))))
    said = F.array_compact(F.transform(units, lambda u, i: F.when(strip(u["text"]) != scrub(u["text"]), F.concat(F.lit("scrubbed benchmark/private metadata at $.fact_units["), i.cast("string"), F.lit("].text")))))
    return clean, said


def sanitized_turns(turns: Column) -> Column:
    """Utterances scrubbed, lists trimmed and distinct, ids T1 to Tn."""
    fields = ("introduced_units", "revises_turns", "revises_units", "deactivates_claims", "activates_claims")

    def clean(t, i):
        t = t.withField("turn_id", F.concat(F.lit("T"), (i + 1).cast("string"))).withField("user_utterance", scrub(F.coalesce(t["user_utterance"], F.lit(""))))
        for f in fields:
            t = t.withField(f, lists.ordered_distinct(F.coalesce(t[f], F.array().cast("array<string>"))))
        return t

    return F.transform(turns, clean)


def safe_units(units: Column) -> Column:
    """Trimmed units that have an id and a text."""
    clean = F.transform(units, lambda u: u.withField("unit_id", F.trim(u["unit_id"])).withField("type", F.trim(u["type"])).withField("text", F.trim(u["text"])))
    return F.filter(clean, lambda u: (F.coalesce(u["unit_id"], F.lit("")) != "") & (F.coalesce(u["text"], F.lit("")) != ""))


def repaired_facts(units: Column) -> Column:
    """Facts that speak of code, releases or other changes become hidden hints; missing ids are numbered on."""
    following = lists.next_number(nested.ids(units))

    def fix(u):
        text = F.lower(F.concat(F.coalesce(u["text"], F.lit("")), F.lit("\n"), F.coalesce(u["source_span"], F.lit(""))))
        hint = (u["source"].eqNullSafe("hints_text") & text.rlike("|".join(HINT_WORDS))) | text.rlike("|".join(ANY_HINT_WORDS)) | u["type"].eqNullSafe("implementation_hint")
        u = u.withField("unit_id", first_nonempty(u["unit_id"], following))
        return F.when(hint, u.withField("type", F.lit("implementation_hint")).withField("expose_to_user", F.lit(False)).withField("active_by_default", F.lit(False))).otherwise(u)

    return F.transform(units, fix)


def repaired_intent(final: Column, units: Column) -> Column:
    """Musts without what is obsolete, rejected or no goal; the expected behaviors where none is left."""
    stale = F.transform(F.filter(units, lambda u: u["type"].isin("obsolete_candidate", "rejected_solution", "non_goal", "implementation_hint")), lambda u: F.lower(F.trim(u["text"])))
    kept = F.filter(lists.ordered_distinct(final["must_satisfy"]), lambda m: ~F.exists(stale, lambda s: (s != "") & F.contains(F.lower(m), s)))
    return final.withField("must_satisfy", F.when(F.size(kept) > 0, kept).otherwise(nested.texts_of(units, ("expected_behavior",))))


def _shown_ids(c: Column, shown: Column) -> Column:
    """Trimmed ids of visible units, each once, in their order. Null counts as none."""
    return F.array_intersect(lists.ordered_distinct(F.coalesce(c, F.array().cast("array<string>"))), shown)


def repaired_report(report: Column, units: Column) -> Column:
    """The three lists of units with known, visible ones only; no list of imperfections counts as an empty one."""
    shown = nested.ids(nested.exposed(units))
    for name in ("introduced_units", "noisy_or_imperfect_units", "withheld_units_for_later"):
        report = report.withField(name, _shown_ids(report[name], shown))
    return report.withField("imperfection_types", F.coalesce(report["imperfection_types"], F.array().cast("array<string>")))


def repaired_events(turns: Column, units: Column) -> Column:
    """Turns numbered T1 to Tn, bound to visible units only, lists without blanks, must_be_resolved_later false where it isn't said."""
    shown = nested.ids(nested.exposed(units))
    listed = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != "")

    def fix(t, i):
        t = t.withField("turn_id", F.concat(F.lit("T"), (i + 1).cast("string")))
        for name in ("introduced_units", "revises_units"):
            t = t.withField(name, _shown_ids(t[name], shown))
        for name in ("revises_turns", "deactivates_claims", "activates_claims"):
            t = t.withField(name, listed(t[name]))
        return t

    return F.transform(turns, fix)


#: What no utterance may speak of; words that count as others when an utterance is compared with its units, and those that don't count.
FORBIDDEN = r"\bpatch\b|\bdiff\b|\btests?\b|\bbenchmark\b|\bgold\b|\boracle\b|FAIL_TO_PASS|PASS_TO_PASS|hidden\s+test|reference\s+patch|pr\s*#?\d+"
ALIASES = {
    "urls": "url", "failing": "fail", "fails": "fail", "failed": "fail", "fixing": "fix", "rejected": "reject", "rejecting": "reject", "accepted": "accept", "accepting": "accept",
    "encoded": "encode", "encoding": "encode", "complexity": "complex", "complex": "complex",
}
NO_WORDS = ("the", "and", "for", "with", "that", "this", "should", "must", "need", "needs", "still")
#: What a made utterance says, and where it has no fact.
FIRST = "I have a reasonably specific bug report, but a few details are still uncertain."
MORE = " I may be missing one boundary condition, and my first read of the cause might be off, so please treat this as the report to clarify rather than a final diagnosis."
MADE = {
    "constraint": ("One constraint I forgot: ", "existing supported behavior in this area still needs to keep working"), "revision": ("I checked that part again; my earlier read may be wrong. ", "Please use this corrected detail instead."),
    "guess": ("This may be my misunderstanding, but ", "there is one detail I am not fully sure about."), "confirm": ("Yes, the final behavior should follow that corrected interpretation. ", ""), "other": ("", "I confirmed one more detail from the report."),
}
REVISION_TYPES = ("obsolete_candidate", "rejected_solution", "negative_constraint", "regression_expectation", "ambiguity_or_correction", "conflict_or_tension")


def utterance_tokens(c: Column) -> Column:
    """The words by which an utterance is held against its units."""
    return alignment_tokens(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[-_/().:=]+", " "), NO_WORDS, ALIASES)


#: What tests are called in utterances.
CALLED = ((r"\btest_[A-Za-z0-9_]+\b", "the reported CI case"), (r"(?i)\btests/[A-Za-z0-9_./-]+", "the reported test file"), (r"\blib/[A-Za-z0-9_./-]+::[A-Za-z0-9_]+\b", "the reported CI case"))


def told_fact(c: Column) -> Column:
    """A unit's text as a user would say it: without names of tests, in the first person, a sentence of at most 140 characters and its end; empty for none."""
    text = F.coalesce(c, F.lit(""))
    for pattern, other in CALLED:
        text = F.regexp_replace(text, pattern, other)
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\b(?:the reporter|the report says)\b", "I"), r"(?i)\bpr\s*#?\d+\b", "the earlier change")
    text = F.regexp_replace(text, r"\A[ .]+|[ .]+\z", "")
    cut = F.left(text, F.lit(137))
    cut = F.concat(F.regexp_replace(F.regexp_replace(cut, r"(?s) [^ ]*\z", ""), r"[ ,;:]+\z", ""), F.lit("..."))
    text = F.when(F.length(text) > 140, cut).otherwise(text)
    return F.when(text == "", "").otherwise(F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)), F.lit(".")))


def made_utterance(turn: Column, units: Column, first: Column) -> Column:
    """An utterance for a turn from its units: the first report, a constraint, a revision, a guess, a confirmation, or just the fact."""
    own = nested.pick(units, turn["introduced_units"])
    facts = F.filter(F.transform(own, lambda u: told_fact(u["text"])), lambda x: x != "")
    has_type = lambda *names: F.exists(own, lambda u: F.coalesce(u["type"].isin(*names), F.lit(False)))
    fact, op = F.get(facts, F.lit(0)), F.coalesce(turn["operation"], F.lit(""))
    said = lambda kind, x=fact: F.trim(F.concat(F.lit(MADE[kind][0]), F.coalesce(x, F.lit(MADE[kind][1]))))
    body = F.coalesce(F.nullif(F.array_join(F.slice(facts, 1, 4), " "), F.lit("")), F.lit(FIRST))
    report = strip(F.left(F.when(F.length(body) < 120, F.concat(body, F.lit(MORE))).otherwise(body), F.lit(900)))
    return (
        F.when(first, report).when((op == "add_regression_constraint") | has_type("regression_expectation"), said("constraint"))
        .when(op.isin("correct_previous_claim", "retract_previous_claim", "replace_previous_claim", "resolve_conflict") | has_type(*REVISION_TYPES), said("revision"))
        .when(op.isin("speculative_hypothesis", "mistaken_clarification", "incorrect_reproduction_detail"), said("guess", F.lower(fact)))
        .when(op == "confirm_final_active_intent", said("confirm")).otherwise(said("other"))
    )


def repaired_utterance(turn: Column, units: Column, first: Column | bool = False) -> Column:
    """The utterance; or one made from the turn's units, where it is empty, speaks of what no user knows, shares no word with its units, or is a
    first report of under 120 or over 900 characters."""
    first = F.lit(first) if isinstance(first, bool) else first
    text, own = strip(F.coalesce(turn["user_utterance"], F.lit(""))), nested.pick(units, turn["introduced_units"])
    ids = F.filter(F.coalesce(turn["introduced_units"], F.array().cast("array<string>")), lambda x: strip(x) != "")
    words = utterance_tokens(text)
    aligned = F.exists(own, lambda u: F.arrays_overlap(words, utterance_tokens(u["text"])))
    bad = (text == "") | like(text, FORBIDDEN) | (first & ~F.length(text).between(120, 900)) | ((F.size(ids) > 0) & ~aligned)
    return F.when(bad, made_utterance(turn, units, first)).otherwise(turn["user_utterance"])


def compiled_turns(turns: Column, units: Column, objective: Column) -> Column:
    """Turns in their released form, each with its state delta."""
    known = nested.ids(units)
    arr = lambda c: lists.ordered_distinct(F.coalesce(c, F.array().cast("array<string>")))
    return F.transform(turns, lambda t, i: F.struct(
        F.concat(F.lit("T"), (i + 1).cast("string")).alias("turn_id"), F.coalesce(t["operation"], F.lit("")).alias("operation"), strip(F.coalesce(t["user_utterance"], F.lit(""))).alias("user_utterance"),
        F.array_intersect(arr(t["introduced_units"]), known).alias("introduced_units"), strip(F.coalesce(t["claim_status"], F.lit(""))).alias("claim_status"), arr(t["revises_turns"]).alias("revises_turns"),
        arr(t["revises_units"]).alias("revises_units"), arr(t["deactivates_claims"]).alias("deactivates_claims"), arr(t["activates_claims"]).alias("activates_claims"),
        state_delta(t["operation"], t["claim_status"], arr(t["deactivates_claims"]), arr(t["activates_claims"]), nested.pick(units, arr(t["introduced_units"])), F.coalesce(objective, F.lit(""))).alias("state_delta"),
    ))


def localization_gold(patch: Column, touched_files: Column, touched_symbols: Column, domain: Column) -> Column:
    """struct(files, functions): source files and symbols of the patch; the metadata's where the patch names none."""
    source = lambda p: ~paths.is_doc_path(p) & ~like(p, r"\.(cfg|toml|ini|yml|yaml|json|lock)$") & (~paths.is_test_path(p) | (domain == "testing_tooling"))
    files = F.array_sort(F.filter(diff.diff_files(patch), source))
    symbols = F.filter(diff.diff_symbols(patch, "gold"), lambda s: F.array_contains(files, F.substring_index(s, "::", 1)))
    other = F.array_sort(F.array_distinct(F.filter(F.transform(touched_files, paths.canonical_path), source)))
    return F.struct(F.when(F.size(files) > 0, files).otherwise(other).alias("files"), F.when(F.size(symbols) > 0, symbols).otherwise(F.array_sort(F.transform(touched_symbols, paths.canonical_symbol))).alias("functions"))


def localization_checkpoint(gold: Column, ks: Sequence[int] = RECALL_KS) -> Column:
    at = F.array(*map(F.lit, ks))
    return F.struct(F.lit(LOCALIZATION_PROMPT).alias("prompt"), gold.alias("gold"), F.struct(at.alias("file_hit_at_k"), at.alias("function_hit_at_k")).alias("metrics"))


def patch_metadata(df: DataFrame) -> DataFrame:
    """Adds patch_metadata: files, components, sizes and leakage of each patch."""
    files, counts = diff.diff_files(F.col("patch")), diff.diff_counts(F.col("patch"))
    changed = counts["added"] + counts["removed"]
    size = F.struct(diff.size_bucket(changed, "summary").alias("label"), counts["added"].alias("added_lines"), counts["removed"].alias("removed_lines"), counts["hunks"].alias("hunks"))
    made = F.struct(files.alias("files"), paths.components_of(files).alias("components"), size.alias("change_size"), diff.leakage_level(changed, F.size(files)).alias("leakage_risk"), diff.size_bucket(changed, "test").alias("test_size"))
    return df.withColumn("patch_metadata", made)


def tasks(issues: DataFrame) -> DataFrame:
    """Per issue: task_id, repo, base_commit and three documents, scenario, gold_intent and evaluation.

    The persona follows from the id's hash. Columns that `issues` lacks count as null; null texts as empty.
    """
    col = lambda n: F.col(n) if n in issues.columns else F.lit(None).cast("string")
    number = (persona(F.col("instance_id")) + 1).cast("int")
    chosen = F.element_at(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("name", "style", "description"), p))) for p in PERSONAS)), number)
    problem, files, test_files = F.coalesce("problem_statement", F.lit("")), diff.diff_files(F.coalesce(col("patch"), F.lit(""))), diff.diff_files(F.coalesce(col("test_patch"), F.lit("")))
    cue = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("trap_type", "user_claim", "expected_agent_behavior", "severity"), c))) for c in CUES]
    cues = F.array_compact(F.array(*cue[:-1], F.when(F.size(files) > 0, cue[-1])))
    texts = lambda held, more=None: F.array_compact(F.array(*map(F.lit, held), *([] if more is None else [more])))
    passing, kept, name = lists.parse_list(col("FAIL_TO_PASS")), lists.parse_list(col("PASS_TO_PASS")), title(problem)
    or_title = lambda *names: F.coalesce(F.nullif(section(problem, list(names)), F.lit("")), name)
    out = issues.withColumn("persona", chosen)
    scenario = F.struct(
        F.col("persona"), initial_query(F.col("repo"), problem, F.col("persona.style")).alias("initial_user_query"), problem.alias("hidden_problem_statement"), cues.alias("misleading_cues"),
        F.struct(*(F.lit(v).alias(k) for k, v in DISCLOSURE.items()), texts(HIDDEN_FROM_AGENT).alias("hidden_from_agent")).alias("disclosure_policy"), F.struct(col("version").alias("version"), col("created_at").alias("created_at")).alias("metadata"),
    )
    gold = F.struct(
        issue_type(problem).alias("issue_type"), name.alias("symptom"), or_title("expected behavior", "expected").alias("expected_behavior"), or_title("actual behavior", "description", "observed").alias("observed_behavior"),
        section(problem, ["steps to reproduce", "reproduce"]).alias("reproduction"), texts(CONSTRAINTS[:-1], F.when(F.size(test_files) > 0, CONSTRAINTS[-1])).alias("constraints"), texts(NON_GOALS).alias("non_goals"),
        files.alias("relevant_files"), passing.alias("success_tests"), texts(TRAPS).alias("misleading_traps"),
        F.struct(files.alias("gold_patch_files"), test_files.alias("test_patch_files"), passing.alias("fail_to_pass"), F.size(kept).alias("pass_to_pass_count")).alias("evidence"),
    )
    evaluation = F.struct(
        col("test_patch").alias("test_patch"), passing.alias("fail_to_pass"), kept.alias("pass_to_pass"), col("patch").alias("patch"), col("environment_setup_commit").alias("environment_setup_commit"),
    )
    return out.select(F.col("instance_id").alias("task_id"), "repo", col("base_commit").alias("base_commit"), issue_type(problem).alias("issue_type"), scenario.alias("scenario"), gold.alias("gold_intent"), evaluation.alias("evaluation"))


def task_index(made: DataFrame, dialogues: str, gold: str, evaluation: str) -> DataFrame:
    """A row for each task with the places of its documents in three folders, its first query, and the names of what is hidden."""
    place = lambda folder: F.concat(F.lit(f"{folder.rstrip('/')}/"), F.col("task_id"), F.lit(".json"))
    return made.select(
        "task_id", "repo", "base_commit", place(dialogues).alias("dialogue_scenario_path"), place(gold).alias("gold_intent_state_path"), place(evaluation).alias("evaluation_spec_path"),
        F.col("scenario.initial_user_query").alias("initial_user_query"), F.array(*map(F.lit, HIDDEN_FIELDS)).alias("hidden_fields"),
    )


def write_tasks(made: DataFrame, path: str) -> None:
    """The three documents as JSON lines in folders of their own, and the index."""
    for part in ("scenario", "gold_intent", "evaluation"):
        made.select("task_id", "repo", f"{part}.*").write.mode("overwrite").json(f"{path}/{part}")
    task_index(made, f"{path}/scenario", f"{path}/gold_intent", f"{path}/evaluation").write.mode("overwrite").json(f"{path}/index")
