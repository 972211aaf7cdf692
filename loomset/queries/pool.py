"""Candidate pool and prefilter over documents. The words are such as these tables have; the rules are the library's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomset.operators import aggregates
from loomset.operators.dedup import first_by
from loomset.operators.quota import select_diverse
from loomset.plans import prefilter, scoring
from loomset.queries import query

WORDS = {
    "has_observed_behavior": r"(^|[^A-Za-z])(the|with|for)([^A-Za-z]|$)", "has_expected_behavior": r"(licen[sc]e|copyright|(^|[^A-Za-z])that([^A-Za-z]|$))", "has_reproduction": r"[0-9]{3}", "has_component": r"@",
    "has_refinement_clues": r"(^|[^A-Za-z])(this|from|que|und)([^A-Za-z]|$)", "has_regression_or_boundary": r"(token|secret|password)", "has_error": r"[%*#&]{3}", "has_environment": r"(^|[^A-Za-z])(der|les|los)([^A-Za-z]|$)",
}
_FLAGS = ", ".join(f"regexp_matches(text, '(?i){p}') AS {k}" for k, p in WORDS.items())
_SUM = " + ".join(f"{k}::int" for k in WORDS)
_BASE = f"""f AS (SELECT doc_id, lang, source, length(text) AS n, doc_id % 8 AS files, doc_id % 3 <> 0 AS gold, doc_id % 11 = 0 AS docs_only, doc_id % 13 = 0 AS tests_only,
 doc_id % 17 = 0 AS dependency_only, doc_id % 19 = 0 AS formatting_only, {_FLAGS} FROM documents),
g AS (SELECT *, {_SUM} AS rich, greatest(0, least(100, has_observed_behavior::int*14 + has_expected_behavior::int*18 + has_reproduction::int*16 + has_component::int*12 + has_refinement_clues::int*20 + has_regression_or_boundary::int*10
  + CASE WHEN n >= 800 THEN 6 WHEN n < 300 THEN -10 ELSE 0 END + CASE WHEN files BETWEEN 1 AND 3 THEN 4 WHEN files > 5 THEN -8 ELSE 0 END)) AS h FROM f),
k AS (SELECT *, concat_ws(';', CASE WHEN docs_only THEN 'reject:docs_only' END, CASE WHEN tests_only THEN 'reject:tests_only' END, CASE WHEN dependency_only THEN 'reject:dependency_only' END, CASE WHEN formatting_only THEN 'reject:formatting_only' END,
  CASE WHEN NOT gold THEN 'reject:no_file_gold' END, CASE WHEN NOT has_expected_behavior THEN 'reject:no_expected_behavior' END, CASE WHEN n < 200 THEN 'reject:issue_too_short' END, CASE WHEN NOT has_refinement_clues THEN 'reject:no_source_grounded_refinement_space' END) AS rejects,
  has_observed_behavior AND has_expected_behavior AND (has_reproduction OR has_component) AND has_refinement_clues AND files BETWEEN 1 AND 3 AND gold AS core FROM g),
d AS (SELECT *, CASE WHEN rejects <> '' THEN 'reject' WHEN core AND rich >= 5 AND h >= 62 THEN 'keep' WHEN h >= 42 AND rich >= 3 THEN 'deprioritize' ELSE 'reject' END AS decision FROM k),
p AS (SELECT *, CASE decision WHEN 'keep' THEN 'high' WHEN 'deprioritize' THEN 'medium' ELSE 'low' END AS suitability,
  concat_ws(';', CASE WHEN n >= 800 THEN 'long_problem_statement' WHEN n < 300 THEN 'short_problem_statement' END, CASE WHEN files BETWEEN 1 AND 3 THEN 'focused_patch_files' WHEN files > 5 THEN 'patch_touches_many_files' END, CASE WHEN gold THEN 'file_gold_available' END,
  CASE WHEN decision = 'keep' THEN 'keep:core_signals_and_refinement_present' WHEN decision = 'deprioritize' THEN 'deprioritize:partial_signals' WHEN rejects <> '' THEN rejects ELSE 'reject:insufficient_noisy_refinement_signals' END) AS reasons FROM d)"""


def _features(t):
    docs = t("documents").select("doc_id", "lang", "source", "text")
    out = docs.withColumns(prefilter.features(F.col("text"), WORDS)).withColumns({
        "n": F.length("text"), "files": (F.col("doc_id") % 8).cast("int"), "gold": F.col("doc_id") % 3 != 0, "docs_only": F.col("doc_id") % 11 == 0, "tests_only": F.col("doc_id") % 13 == 0,
        "dependency_only": F.col("doc_id") % 17 == 0, "formatting_only": F.col("doc_id") % 19 == 0,
    })
    return out.withColumn("estimated_fact_richness", prefilter.richness({k: F.col(k) for k in WORDS})).drop("text")


def _decided(t):
    hard = {k: F.col(k) for k in ("docs_only", "tests_only", "dependency_only", "formatting_only")}
    return prefilter.decide(_features(t), {k: k for k in WORDS}, "n", "files", "gold", hard)


@query("q01_priority_dedup", """SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY substr(source, 4)::int, doc_id) AS rn FROM documents) WHERE rn = 1""")
def q01(t):
    """The best source's first row of each text; texts go into the shuffle as hashes."""
    docs = t("documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("key"))
    return first_by(docs, ["key"], [F.substring("source", 4, 9).cast("int"), F.col("doc_id")]).drop("key")


@query("q04_text_features", f"WITH {_BASE} SELECT doc_id, {', '.join(WORDS)}, rich::bigint AS richness FROM g")
def q04(t):
    return _features(t).select("doc_id", *WORDS, F.col("estimated_fact_richness").cast("bigint").alias("richness"))


@query("q05_prefilter_decision", f"WITH {_BASE} SELECT doc_id, h / 100.0::double AS score, decision, suitability, reasons FROM p")
def q05(t):
    return _decided(t).select("doc_id", F.col("prefilter_score").alias("score"), F.col("prefilter_decision").alias("decision"), F.col("estimated_noisy_refinement_suitability").alias("suitability"), F.col("prefilter_reasons").alias("reasons"))


@query("q10_multi_counter", f"""WITH {_BASE} SELECT 'decision' AS counter, decision AS key, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'suitability', suitability, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'domain', lang, count(*) FROM p GROUP BY 2
 UNION ALL SELECT 'bucket', printf('%.1f', floor(h / 10) / 10.0), count(*) FROM p GROUP BY 2""")
def q10(t):
    h = F.round(F.col("prefilter_score") * 100).cast("int")
    return aggregates.multi_counter(_decided(t), {"decision": F.col("prefilter_decision"), "suitability": F.col("estimated_noisy_refinement_suitability"), "domain": F.col("lang"), "bucket": prefilter.bucket(h)})


@query("q11_kept_by_domain", f"WITH {_BASE} SELECT lang, count(*) FILTER (WHERE decision <> 'reject') AS kept, count(*) AS total FROM p GROUP BY lang")
def q11(t):
    return _decided(t).groupBy("lang").agg(F.count_if(F.col("prefilter_decision") != "reject").alias("kept"), F.count("*").alias("total"))


@query("q12_reject_reasons", f"WITH {_BASE} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS reason FROM p) WHERE reason LIKE 'reject:%' GROUP BY reason")
def q12(t):
    return aggregates.exploded_counts(_decided(t), F.filter(F.split("prefilter_reasons", ";"), lambda x: x.startswith("reject:")), "reason")


@query("q13_share_percent", f"WITH {_BASE}, c AS (SELECT decision, count(*) AS n FROM p GROUP BY 1) SELECT decision, n, round(100.0 * n / greatest(1, sum(n) OVER ()), 1)::double AS percent FROM c")
def q13(t):
    counts = _decided(t).groupBy(F.col("prefilter_decision").alias("decision")).agg(F.count("*").alias("n"))
    return aggregates.share_percent(counts)


_RISK = """r AS (SELECT d.doc_id, d.lang, d.source, d.text, length(d.text) AS n, (d.doc_id % 12)::int AS files, l.quality IS NOT NULL AS has_patch, coalesce(l.toxic, 0) = 0 AS has_test, d.doc_id % 17 = 0 AS docs_only, d.doc_id % 13 = 0 AS tests_only, d.doc_id % 4 <> 0 AS gold, d.doc_id % 2 = 0 AS fgold,
 regexp_matches(d.text, '(?i)(token|secret)') AS dep, regexp_matches(d.text, '[%*#&]{3}') AS fmt FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT *, least(100, (NOT has_patch)::int*50 + docs_only::int*45 + tests_only::int*35 + (NOT gold)::int*45 + (files > 8)::int*25 + (files BETWEEN 4 AND 8)::int*10 + (n < 200)::int*20 + dep::int*20 + fmt::int*20 + (NOT has_test)::int*10) AS risk,
 concat_ws(';', CASE WHEN NOT has_patch THEN 'missing_patch' END, CASE WHEN docs_only THEN 'docs_only' END, CASE WHEN tests_only THEN 'tests_only' END, CASE WHEN NOT gold THEN 'missing_file_gold' END, CASE WHEN files > 8 THEN 'many_patch_files' END, CASE WHEN files BETWEEN 4 AND 8 THEN 'multi_file_patch' END,
 CASE WHEN n < 200 THEN 'short_problem_statement' END, CASE WHEN dep THEN 'dependency_or_security_maintenance' END, CASE WHEN fmt THEN 'formatting_typo_cleanup' END, CASE WHEN NOT has_test THEN 'missing_test_patch' END) AS reasons FROM r),
u AS (SELECT *, greatest(0, least(100, CASE WHEN n BETWEEN 300 AND 5000 THEN 15 WHEN n >= 200 THEN 8 ELSE 0 END + has_patch::int*10 + has_test::int*10 + gold::int*15 + fgold::int*5 + CASE WHEN files BETWEEN 1 AND 3 THEN 15 WHEN files BETWEEN 4 AND 6 THEN 6 ELSE 0 END
 + regexp_matches(text, '(?i)(^|[^A-Za-z])the([^A-Za-z]|$)')::int*8 + regexp_matches(text, '[0-9]{3}')::int*8 + regexp_matches(text, '(?i)error|fehler')::int*8 + regexp_matches(text, '(?i)(^|[^A-Za-z])(this|que|und)([^A-Za-z]|$)')::int*12 + (lang = 'en')::int*5 + (source = 'src0')::int*6 + (source = 'src1')::int*3 - risk // 4)) AS score FROM s),
v AS (SELECT *, CASE WHEN docs_only OR tests_only OR NOT has_patch OR dep OR fmt THEN 'reject' WHEN NOT gold OR risk >= 45 OR files > 8 OR n < 200 THEN 'manual_review' WHEN score >= 50 THEN 'candidate' ELSE 'manual_review' END AS label FROM u)"""


def _risky(t):
    labels = t("labels").select("doc_id", "quality", "toxic")
    d = t("documents").select("doc_id", "lang", "source", "text").join(labels, "doc_id", "left").withColumns({
        "n": F.length("text"), "files": (F.col("doc_id") % 12).cast("int"), "has_patch": F.col("quality").isNotNull(), "has_test": F.coalesce("toxic", F.lit(0)) == 0, "docs_only": F.col("doc_id") % 17 == 0, "tests_only": F.col("doc_id") % 13 == 0,
        "gold": F.col("doc_id") % 4 != 0, "fgold": F.col("doc_id") % 2 == 0, "dep": F.col("text").rlike("(?i)(token|secret)"), "fmt": F.col("text").rlike("[%*#&]{3}"),
    })
    c = F.col
    score, reasons = scoring.risk({
        "missing_patch": ~c("has_patch"), "docs_only": c("docs_only"), "tests_only": c("tests_only"), "missing_file_gold": ~c("gold"), "many_patch_files": c("files") > 8, "multi_file_patch": c("files").between(4, 8),
        "short_problem_statement": c("n") < 200, "dependency_or_security_maintenance": c("dep"), "formatting_typo_cleanup": c("fmt"), "missing_test_patch": ~c("has_test"),
    })
    return d.withColumns({"risk": score, "reasons": F.array_join(reasons, ";")})


def _labelled(t):
    c = F.col
    words = {"expected": r"(^|[^A-Za-z])the([^A-Za-z]|$)", "repro": "[0-9]{3}", "error": "error|fehler", "revision": r"(^|[^A-Za-z])(this|que|und)([^A-Za-z]|$)"}
    score = scoring.rule_score(c("text"), c("text"), c("has_patch"), c("has_test"), c("gold"), c("fgold"), c("files"), F.when(c("lang") == "en", "x").otherwise(""), c("source") == "src0", c("source") == "src1", c("risk"), words)
    out = _risky(t).withColumn("score", score)
    reject = c("docs_only") | c("tests_only") | ~c("has_patch") | c("dep") | c("fmt")
    return out.withColumn("label", scoring.label(reject, c("gold"), c("risk"), c("files"), c("text"), c("score")))


@query("q06_risk_score", f"WITH {_RISK} SELECT doc_id, risk::bigint AS risk, reasons FROM s")
def q06(t):
    return _risky(t).select("doc_id", F.col("risk").cast("bigint").alias("risk"), "reasons")


@query("q07_rule_score_label", f"WITH {_RISK} SELECT doc_id, score::bigint AS score, label, CASE label WHEN 'reject' THEN 'reject' WHEN 'candidate' THEN 'priority' ELSE 'manual_review' END AS tier FROM v")
def q07(t):
    return _labelled(t).select("doc_id", F.col("score").cast("bigint").alias("score"), "label", scoring.tier(F.col("label")).alias("tier"))


@query("q08_pool_order_top100", f"WITH {_RISK} SELECT row_number() OVER (ORDER BY CASE label WHEN 'candidate' THEN 0 WHEN 'manual_review' THEN 1 ELSE 2 END, score DESC, risk, files, doc_id) AS position, doc_id FROM v ORDER BY position LIMIT 100")
def q08(t):
    """The pool's order; a report of its first hundred (top-k before the numbering)."""
    renamed = _labelled(t).select(F.col("doc_id").alias("instance_id"), F.col("label").alias("rule_label"), F.col("score").alias("rule_score"), F.col("risk").alias("quality_risk_score"), F.col("files").alias("patch_files_count"))
    top = renamed.orderBy(*scoring.pool_order()).limit(100)
    return top.select(F.row_number().over(Window.orderBy(*scoring.pool_order())).cast("bigint").alias("position"), F.col("instance_id").alias("doc_id"))


@query("q09_diverse_quota", """WITH c AS (SELECT c_custkey, c_acctbal, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS rr FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY c_acctbal DESC, c_custkey) AS dr FROM a WHERE rr <= 2)
SELECT c_custkey, n_name, r_name, CASE WHEN dr <= 6 THEN 1 ELSE 2 END::bigint AS pass, row_number() OVER (ORDER BY CASE WHEN dr <= 6 THEN 1 ELSE 2 END, c_acctbal DESC, c_custkey) AS position FROM b ORDER BY position LIMIT 20""")
def q09(t):
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_acctbal", "n_name", "r_name")
    out = select_diverse(people, [F.col("c_acctbal").desc(), F.col("c_custkey")], "n_name", "r_name", 20, 2, 0.3)
    return out.select("c_custkey", "n_name", "r_name", F.col("pass").cast("bigint").alias("pass"), F.col("position").cast("bigint").alias("position"))


@query("q14_risky_split", f"WITH {_RISK} SELECT doc_id, label <> 'reject' AS is_candidate, label = 'reject' OR risk >= 45 OR NOT gold AS is_risky FROM v")
def q14(t):
    c = F.col
    return _labelled(t).select("doc_id", (c("label") != "reject").alias("is_candidate"), ((c("label") == "reject") | (c("risk") >= 45) | ~c("gold")).alias("is_risky"))
