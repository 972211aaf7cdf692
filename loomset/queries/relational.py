"""Joins, sets, upserts, attempts and aggregates over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.operators import aggregates, attempts
from loomset.operators.upsert import upsert
from loomset.plans import status as S
from loomset.queries import query
from loomset.streaming.events import event_counts


@query("q03_union_tagged_sources", """SELECT source, count(*) AS rows, count(DISTINCT name) AS entities FROM (SELECT 'nation' AS source, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region UNION ALL SELECT 'supplier', s_name FROM supplier) GROUP BY source""")
def q03(t):
    tagged = [t(n).select(F.lit(n).alias("source"), F.col(c).alias("name")) for n, c in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"))]
    return aggregates.source_summary(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]), "source", "name")


@query("q18_segments", """WITH m AS (SELECT *, sum((event_type = 'signup')::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events),
c AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM m)
SELECT user_id, seg::bigint AS seg, count(*) AS n, max(carried) AS last_carried, count(*) FILTER (WHERE event_type = 'error') AS errors FROM c GROUP BY user_id, seg""")
def q18(t):
    """Stretches of a user's events that begin at a marker, with the last symbol carried on."""
    from pyspark.sql import Window

    seg = attempts.islands(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", "seg")
    w = Window.partitionBy("user_id", "seg").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = seg.withColumn("carried", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return carried.groupBy("user_id", F.col("seg").cast("bigint").alias("seg")).agg(F.count("*").alias("n"), F.max("carried").alias("last_carried"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("q27_left_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q27(t):
    return t("customer").select("c_custkey", "c_name").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("q28_left_semi", "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45)")
def q28(t):
    back = t("lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select("l_orderkey")
    return t("orders").select("o_orderkey", "o_totalprice").join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("q29_left_default", "SELECT d.doc_id, coalesce(l.quality, -1)::bigint AS quality, coalesce(l.toxic, 0)::bigint AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def q29(t):
    joined = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("bigint").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("bigint").alias("toxic"))


@query("q30_index_upsert", """WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS id, 'X' AS status, o_totalprice * 2 AS price FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NOT NULL THEN b.status ELSE a.status END AS status, CASE WHEN b.id IS NOT NULL THEN b.price ELSE a.price END AS price FROM a FULL JOIN b ON a.id = b.id""")
def q30(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return upsert(o.where("id % 3 <> 0"), o.where("id % 2 = 0").select("id", F.lit("X").alias("status"), (F.col("price") * 2).alias("price")), "id")


@query("q31_conflict_guard", """WITH a AS (SELECT o_orderkey AS id, sha256(o_orderstatus || '|' || o_orderpriority) AS h FROM orders), b AS (SELECT o_orderkey AS id, sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END || '|' || o_orderpriority) AS h FROM orders WHERE o_orderkey % 2 = 1)
SELECT a.id, a.h AS old_hash, b.h AS new_hash FROM a JOIN b ON a.id = b.id WHERE a.h <> b.h""")
def q31(t):
    """Keys whose content would change, by content hashes."""
    hashed = lambda df, s, name: df.select(F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws("|", s, "o_orderpriority"), 256).alias(name))
    old = hashed(t("orders"), F.col("o_orderstatus"), "old_hash")
    new = hashed(t("orders").where("o_orderkey % 2 = 1"), F.when(F.col("o_orderkey") % 7 == 0, "Z").otherwise(F.col("o_orderstatus")), "new_hash")
    return old.join(new, "id").where("old_hash <> new_hash")


@query("q32_step_stats", """WITH e AS (SELECT *, CASE WHEN event_type IN ('error', 'click') THEN event_type WHEN event_type = 'view' THEN 'none' ELSE 'unknown' END AS kind FROM events)
SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE kind = 'error') AS error, count(*) FILTER (WHERE kind = 'click') AS click, count(*) FILTER (WHERE kind = 'unknown') AS unknown, arg_max(event_type, event_id) AS last_event_type,
(SELECT string_agg(x.event_type, ',' ORDER BY x.at) FROM (SELECT event_type, min(event_id) AS at FROM events i WHERE i.user_id = e.user_id GROUP BY event_type) x) AS models FROM e GROUP BY user_id""")
def q32(t):
    calls = t("events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") != "view", F.col("event_type")).alias("error"))
    out = aggregates.step_stats(calls, ["user_id"], "error", "event_id", ["error", "click"], models="event_type", latest=["event_type"])
    return out.withColumn("models", F.array_join("models", ","))


@query("q33_probe_summary_stable", """SELECT o_orderpriority, o_orderstatus, count(*) AS tasks, count(*) FILTER (WHERE o_totalprice > 1000) AS ok, count(*) FILTER (WHERE o_totalprice < 500) AS empty, round(avg(extract(day FROM o_orderdate)), 1) AS avg_seconds,
count(*) FILTER (WHERE o_totalprice > 1000) = count(*) AND count(*) FILTER (WHERE o_totalprice < 500) = 0 AS stable FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def q33(t):
    o = t("orders").withColumn("day", F.dayofmonth("o_orderdate"))
    return aggregates.probe_summary(o, ["o_orderpriority", "o_orderstatus"], F.col("o_totalprice") > 1000, F.col("o_totalprice") < 500, "day").where("tasks > 1")


@query("q34_leaderboard", "SELECT source, count(*) FILTER (WHERE quality = 1) AS resolved, count(*) AS total, count(*) FILTER (WHERE quality = 1) / count(*)::double AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source")
def q34(t):
    joined = t("documents").select("doc_id", "source").join(t("labels"), "doc_id")
    return aggregates.leaderboard(joined, "source", F.col("quality") == 1)


_CHAIN = """a AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'step_failed' ELSE 'manual_review_required' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt_id FROM events),
b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY attempt_id) AS prev FROM a WHERE attempt_id <= 2)"""


@query("q35_attempt_chain", f"WITH {_CHAIN} SELECT user_id, attempt_id, status, prev AS previous_status, attempt_id > 1 AND status = 'accepted' AND NOT coalesce(prev = 'accepted', false) AS accepted_after_retry FROM b")
def q35(t):
    e = t("events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "step_failed").otherwise("manual_review_required").alias("status"))
    out = attempts.attempt_chain(e, "user_id", ["ts", "event_id"], "status").where("attempt_id <= 2")
    return out.select("user_id", F.col("attempt_id").cast("bigint").alias("attempt_id"), "status", "previous_status", "accepted_after_retry")


@query("q36_running_budget", """WITH b AS (SELECT o_orderkey, (o_custkey % 9)::bigint AS calls, coalesce(sum(o_custkey % 9) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS calls_before FROM orders) SELECT o_orderkey, calls, calls_before FROM b WHERE calls_before < 20000""")
def q36(t):
    o = t("orders").select("o_orderkey", (F.col("o_custkey") % 9).cast("bigint").alias("calls"))
    return attempts.within_budget(o, "calls", ["o_orderkey"], 20000, 16).select("o_orderkey", "calls", "calls_before")


_STATUS = """s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'manual_review_required' WHEN 'O' THEN 'step_failed' ELSE 'accepted' END AS status,
CASE o_orderkey % 6 WHEN 0 THEN 'utterance_template_artifact' WHEN 1 THEN 'fact_grounding_validation_failed source_span' WHEN 2 THEN 'semantic_reviewer' WHEN 3 THEN 'client exception' WHEN 4 THEN 'no supported revision fact' ELSE '' END AS failure FROM orders),
n AS (SELECT *, CASE status WHEN 'manual_review_required' THEN 'auto_filtered' ELSE status END AS normalized,
CASE WHEN failure LIKE 'fact_grounding%' THEN 'source_span_unmatched_after_retry' WHEN failure LIKE '%template_artifact%' THEN 'utterance_template_artifact' WHEN failure = 'semantic_reviewer' THEN 'semantic_reviewer_not_pass' WHEN failure LIKE 'no supported%' THEN 'weak_or_missing_revision_evidence' ELSE 'quality_gate_manual_review' END AS reason FROM s)"""


@query("q39_status_retry", f"""WITH {_STATUS} SELECT o_orderkey, normalized, CASE WHEN normalized = 'auto_filtered' THEN reason ELSE '' END AS reason,
CASE WHEN normalized = 'auto_filtered' AND reason IN ('utterance_template_artifact', 'semantic_reviewer_not_pass') THEN 'full_chain_retry_once' WHEN normalized = 'step_failed' AND failure NOT LIKE '%exception%' AND o_orderkey % 5 > 0 THEN 'full_chain_retry_once' ELSE 'none' END AS policy FROM n""")
def q39(t):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "manual_review_required").when(F.col("o_orderstatus") == "O", "step_failed").otherwise("accepted")
    failure = F.element_at(F.array(*map(F.lit, ["utterance_template_artifact", "fact_grounding_validation_failed source_span", "semantic_reviewer", "client exception", "no supported revision fact", ""])), (k % 6 + 1).cast("int"))
    o = t("orders").select(k, S.normalized(status).alias("normalized"), failure.alias("failure"))
    none = F.lit(None).cast("string")
    o = o.withColumn("why", S.filter_reason(F.col("failure"), none, none, none, F.lit(None).cast("boolean"), F.lit(None).cast("boolean")))
    plan = S.retry(F.col("normalized"), F.col("why"), S.transient(F.col("failure"), F.lit(0), (k % 5).cast("int")))
    return o.select("o_orderkey", "normalized", F.when(F.col("normalized") == "auto_filtered", F.col("why")).otherwise("").alias("reason"), plan["policy"].alias("policy"))


@query("q46_quality_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS not_good, count(*) FILTER (WHERE nullif(toxic, 1) IS NULL) AS not_clean, count(*) FILTER (WHERE CASE WHEN doc_id % 5 = 0 THEN NULL WHEN quality = 1 THEN 'pass' ELSE 'fail' END IS DISTINCT FROM 'pass') AS not_pass FROM labels")
def q46(t):
    flags = t("labels").select((F.col("quality") == 1).alias("good"), (F.nullif("toxic", F.lit(1)) == 0).alias("clean"), F.when(F.col("doc_id") % 5 == 0, None).when(F.col("quality") == 1, "pass").otherwise("fail").alias("verdict"))
    return aggregates.quality_summary(flags, ["good", "clean"], "verdict")


@query("q47_manifest", "SELECT count(*) AS records, string_agg(DISTINCT source, ',' ORDER BY source) AS runs FROM documents")
def q47(t):
    return aggregates.manifest(t("documents"), "source").select("records", F.array_join("runs", ",").alias("runs"))


@query("q48_set_algebra", """SELECT 'both' AS part, count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL
SELECT 'only_orders', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'either', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def q48(t):
    """Set algebra in one pass: every key says where it stands, and one aggregate by key settles all three sets."""
    a = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("side"))
    b = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.lit(2).alias("side"))
    sides = a.unionByName(b).groupBy("k").agg(F.bit_or("side").alias("s"))
    counts = sides.agg(F.count_if(F.col("s") == 3).alias("both"), F.count_if(F.col("s") == 1).alias("only_orders"), F.count("*").alias("either"))
    return counts.select(F.expr("stack(3, 'both', both, 'only_orders', only_orders, 'either', either) AS (part, n)"))


@query("q49_sorted_longest", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, max(length(p_name))::bigint AS longest, count(DISTINCT p_size) AS sizes FROM part GROUP BY p_brand")
def q49(t):
    out = t("part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"), F.max(F.length("p_name")).cast("bigint").alias("longest"), F.countDistinct("p_size").alias("sizes"))
    return out.withColumn("types", F.array_join("types", ","))


@query("q52_event_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q52(t):
    """An extension: tumbling counts, the batch form of the stream."""
    out = event_counts(t("events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("q53_projected_calls", "SELECT round(count(*) * 7.0 / count(*), 2)::double AS per_candidate, round(count(*) * 7.0 / count(*) FILTER (WHERE quality = 1), 2)::double AS per_accepted, ceil(500.0 * count(*) / count(*) FILTER (WHERE quality = 1))::bigint AS candidates_needed, round(500 * (count(*) * 7.0) / count(*) FILTER (WHERE quality = 1))::bigint AS calls_needed FROM labels")
def q53(t):
    n = t("labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("ok"))
    return n.select(aggregates.projected_calls(F.col("n"), F.col("ok"), F.col("n") * 7, 500).alias("p")).select("p.*")
