"""Candidate pool: features, risk, rule score, label, order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset import patterns as P
from loomset.functions import diff, lists, paths
from loomset.functions.text import first_nonempty, like, strip

#: What adds to the risk, in the order in which reasons are told.
RISKS = {
    "missing_patch": 50, "docs_only": 45, "tests_only": 35, "missing_file_gold": 45, "many_patch_files": 25, "multi_file_patch": 10,
    "short_problem_statement": 20, "dependency_or_security_maintenance": 20, "formatting_typo_cleanup": 20, "missing_test_patch": 10,
}


def _total(points: Mapping[str, Column] | list[tuple[Column, int]]) -> Column:
    out = F.lit(0)
    for test, n in points:
        out = out + F.when(test, n).otherwise(0)
    return out


def risk(tests: Mapping[str, Column]) -> tuple[Column, Column]:
    """(score 0 to 100, reasons in order) from the test of each risk."""
    score = F.least(F.lit(100), _total([(tests[k], n) for k, n in RISKS.items()]))
    return score, F.array_compact(F.array(*(F.when(tests[k], F.lit(k)) for k in RISKS)))


def rule_score(problem: Column, text: Column, has_patch: Column, has_test_patch: Column, file_gold: Column, function_gold: Column, files: Column, hints: Column, f2p: Column, p2p: Column, risk_score: Column, words: Mapping[str, str] | None = None) -> Column:
    """0 to 100; risk counts against it by a quarter, whole points only."""
    w = {"expected": P.EXPECTED_WORDS, "repro": P.REPRO_WORDS, "error": P.ERROR_WORDS, "revision": P.REVISION_WORDS} | dict(words or {})
    n = F.length(problem)
    points = _total([
        (n.between(300, 5000), 15), (~n.between(300, 5000) & (n >= 200), 8), (has_patch, 10), (has_test_patch, 10), (file_gold, 15), (function_gold, 5),
        (files.between(1, 3), 15), (files.between(4, 6), 6), (like(text, w["expected"]), 8), (like(text, w["repro"]), 8), (like(text, w["error"]), 8), (like(text, w["revision"]), 12),
        (strip(hints) != "", 5), (f2p, 6), (p2p, 3),
    ])
    return lists.clamp(points - F.floor(risk_score / 4).cast("int"))


def label(reject: Column, file_gold: Column, risk_score: Column, files: Column, problem: Column, score: Column) -> Column:
    return F.when(reject, "reject").when(~file_gold | (risk_score >= 45) | (files > 8) | (F.length(problem) < 200), "manual_review").when(score >= 50, "candidate").otherwise("manual_review")


def tier(label_: Column) -> Column:
    return F.when(label_ == "reject", "reject").when(label_ == "candidate", "priority").otherwise("manual_review")


def pool_features(issues: DataFrame) -> DataFrame:
    """Issues with the 29 columns of the pool: sizes, flags, risk, score, label. Narrow: one pass, no shuffle, no Python."""
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = issues.withColumns({"_files": diff.diff_files(text_of("patch")), "_stats": diff.diff_counts(text_of("patch")), "_test_files": diff.diff_files(text_of("test_patch")), "domain": paths.domain(F.col("repo"))})
    testing = F.col("domain") == "testing_tooling"
    is_source = lambda p: p.endswith(".py") & ~paths.is_test_path(p) & ~paths.is_doc_path(p)
    source = F.filter("_files", is_source)
    tests = F.filter("_files", paths.is_test_path)
    out = out.withColumns({"_text": F.concat_ws("\n", text_of("problem_statement"), text_of("hints_text")), "_tests": tests, "_source": F.when((F.size(source) == 0) & testing, F.array_union(tests, F.col("_test_files"))).otherwise(source)})
    n = F.size("_files")
    has_patch, has_test_patch = strip(text_of("patch")) != "", strip(text_of("test_patch")) != ""
    docs_only = (n > 0) & F.forall("_files", paths.is_doc_path)
    tests_only = (n > 0) & F.forall("_files", paths.is_test_path)
    dependency = ((n > 0) & F.forall("_files", paths.is_dependency_path)) | (like(F.col("_text"), P.DEPENDENCY_WORDS) & F.exists("_files", paths.is_dependency_path))
    formatting = like(text_of("problem_statement"), P.FORMATTING_WORDS) & (F.col("_stats.added") + F.col("_stats.removed") <= 20)
    symbols = F.filter(diff.diff_symbols(text_of("patch")), lambda s: F.array_contains(F.col("_source"), F.substring_index(s, "::", 1)) & ~s.endswith("::<module>"))
    out = out.withColumns({
        "problem_len": F.length(text_of("problem_statement")), "patch_files_count": n, "source_files_count": F.size("_source"), "test_files_count": F.size("_test_files"),
        "docs_files_count": F.size(F.filter("_files", paths.is_doc_path)), "patch_added_lines": F.col("_stats.added"), "patch_removed_lines": F.col("_stats.removed"), "patch_hunks": F.col("_stats.hunks"),
        "patch_size_bucket": diff.size_bucket(F.col("_stats.added") + F.col("_stats.removed")), "has_patch": has_patch, "has_test_patch": has_test_patch, "docs_only": docs_only, "tests_only": tests_only,
        "has_file_gold": F.size("_source") > 0, "function_symbols_touched": symbols, "likely_dependency_only": dependency, "likely_formatting_only": formatting,
        "source_files_touched": F.array_sort("_source"), "test_files_touched": F.array_sort("_test_files"),
    })
    c = F.col
    out = out.withColumn("has_function_gold", F.size("function_symbols_touched") > 0)
    tests_bad = c("tests_only") & ~testing
    score, reasons = risk({
        "missing_patch": ~c("has_patch"), "docs_only": c("docs_only"), "tests_only": tests_bad, "missing_file_gold": ~c("has_file_gold"), "many_patch_files": c("patch_files_count") > 8,
        "multi_file_patch": c("patch_files_count").between(4, 8), "short_problem_statement": c("problem_len") < 200, "dependency_or_security_maintenance": c("likely_dependency_only"),
        "formatting_typo_cleanup": c("likely_formatting_only"), "missing_test_patch": ~c("has_test_patch"),
    })
    out = out.withColumns({"quality_risk_score": score, "quality_risk_reasons": reasons})
    listed = lambda a, b: F.size(lists.parse_list(first_nonempty(c(a), c(b)))) > 0
    known = set(issues.columns)
    pair = lambda a, b: listed(a, b if b in known else a)
    out = out.withColumn("rule_score", rule_score(text_of("problem_statement"), c("_text"), c("has_patch"), c("has_test_patch"), c("has_file_gold"), c("has_function_gold"), c("patch_files_count"), text_of("hints_text"), pair("FAIL_TO_PASS", "fail_to_pass"), pair("PASS_TO_PASS", "pass_to_pass"), c("quality_risk_score")))
    reject = c("docs_only") | tests_bad | ~c("has_patch") | c("likely_dependency_only") | c("likely_formatting_only")
    out = out.withColumn("rule_label", label(reject, c("has_file_gold"), c("quality_risk_score"), c("patch_files_count"), text_of("problem_statement"), c("rule_score")))
    rejected = c("rule_label") == "reject"
    out = out.withColumns({
        "rule_reject_reason": F.when(rejected, F.array_join("quality_risk_reasons", ";")).otherwise(""), "manual_override_label": F.when(rejected, "REJECT_OR_DOWNRANK").otherwise(""),
        "manual_review_tier": tier(c("rule_label")), "manual_recommended_categories": F.lit(""),
    })
    return out.drop(*(x for x in out.columns if x.startswith("_")))


_LABEL_RANK = {"candidate": 0, "manual_review": 1, "reject": 2}


def _rank(c: Column, table: Mapping[str, int], other: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), F.lit(other))


def pool_order() -> list[Column]:
    """Label, score down, risk, files, id."""
    return [_rank(F.col("rule_label"), _LABEL_RANK, 9), F.col("rule_score").desc(), F.col("quality_risk_score"), F.col("patch_files_count"), F.col("instance_id")]


def seed_order() -> list[Column]:
    """Label, risk, score down, source, files, id."""
    return [
        _rank(F.col("rule_label"), {"candidate": 0, "manual_review": 1, "reject": 9}, 5), F.col("quality_risk_score"), F.col("rule_score").desc(),
        _rank(F.col("source_name"), P.SOURCE_PRIORITY, 5), F.coalesce("patch_files_count", F.lit(999)), F.col("instance_id"),
    ]


def loader_order(golden: str) -> list[Column]:
    """The golden instance, then as the seed's with risk first, then how many tests are to pass (more first), id."""
    return [
        (F.col("instance_id") != golden).cast("int"), _rank(F.col("manual_override_label"), {"KEEP": 0, "": 1, "REJECT_OR_DOWNRANK": 9}, 1), F.col("quality_risk_score"), F.col("rule_score").desc(),
        _rank(F.col("source_name"), P.SOURCE_PRIORITY, 3), F.coalesce("patch_files_count", F.lit(9999)), F.size(lists.parse_list(F.col("FAIL_TO_PASS"))).desc(), F.col("instance_id"),
    ]


def not_rejected(df: DataFrame) -> DataFrame:
    """Drops rows that a label rejects, where the table has that label."""
    for name, value in (("rule_label", "reject"), ("manual_override_label", "REJECT_OR_DOWNRANK")):
        if name in df.columns:
            df = df.where(~F.col(name).eqNullSafe(value))
    return df


def pool_outputs(pool: DataFrame) -> dict[str, DataFrame]:
    """The whole pool, what isn't rejected, and what is risky; the last two overlap."""
    c = F.col
    return {"pool": pool, "candidates": pool.where(c("rule_label") != "reject"), "risky": pool.where((c("rule_label") == "reject") | (c("quality_risk_score") >= 45) | ~c("has_file_gold"))}
