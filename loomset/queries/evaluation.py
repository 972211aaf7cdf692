"""Ranking metrics and weighted scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomset.operators import metrics
from loomset.queries import query

_HITS = """l AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_returnflag) AS rk FROM l), g AS (SELECT DISTINCT l_orderkey, l_partkey FROM l WHERE l_returnflag = 'R'),
h AS (SELECT r.l_orderkey, rk, g.l_partkey AS gp FROM r LEFT JOIN g ON r.l_orderkey = g.l_orderkey AND r.l_partkey = g.l_partkey), n AS (SELECT l_orderkey, count(*) AS ng FROM g GROUP BY 1)"""


@query("q37_hit_recall_mrr", f"""WITH {_HITS} SELECT h.l_orderkey, CASE WHEN any_value(ng) IS NULL THEN 0 ELSE (count(*) FILTER (WHERE rk <= 1 AND gp IS NOT NULL) > 0)::bigint END AS hit1, CASE WHEN any_value(ng) IS NULL THEN NULL ELSE (count(*) FILTER (WHERE rk <= 3 AND gp IS NOT NULL) > 0)::bigint END AS hit3_optional,
coalesce(round(count(DISTINCT gp) FILTER (WHERE rk <= 3) / any_value(ng)::double, 6), 0.0) AS recall3, coalesce(round(1.0 / min(rk) FILTER (WHERE gp IS NOT NULL), 6), 0.0)::double AS mrr FROM h LEFT JOIN n ON h.l_orderkey = n.l_orderkey GROUP BY h.l_orderkey""")
def q37(t):
    """Parts of an order by price against the parts returned. An order has a few lines, so gathering them is bounded."""
    ranked = F.struct((-F.col("l_extendedprice")).alias("a"), "l_partkey", "l_linenumber", "l_returnflag")
    o = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(ranked)).alias("rows"))
    part = lambda x: x["l_partkey"].cast("string")
    o = o.select("l_orderkey", F.transform("rows", part).alias("pred"), F.array_distinct(F.transform(F.filter("rows", lambda x: x["l_returnflag"] == "R"), part)).alias("gold"))
    p, g = F.col("pred"), F.col("gold")
    return o.select("l_orderkey", metrics.hit_at(p, g, 1).cast("bigint").alias("hit1"), metrics.hit_at(p, g, 3, True).cast("bigint").alias("hit3_optional"), F.round(metrics.recall_at(p, g, 3), 6).alias("recall3"), F.round(metrics.reciprocal_rank(p, g), 6).alias("mrr"))


@query("q38_weighted_mean", """WITH s AS (SELECT d.doc_id, quality::double AS intent, CASE WHEN toxic IS NULL THEN NULL ELSE 1.0 - toxic END::double AS process, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE (d.doc_id % 10) / 10.0 END::double AS dialogue, CASE WHEN d.doc_id % 5 = 0 THEN 0.5 END::double AS exploration FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, round(coalesce((coalesce(intent * 0.35, 0) + coalesce(process * 0.25, 0) + coalesce(dialogue * 0.20, 0) + coalesce(exploration * 0.20, 0)) / nullif((intent IS NOT NULL)::int * 0.35 + (process IS NOT NULL)::int * 0.25 + (dialogue IS NOT NULL)::int * 0.20 + (exploration IS NOT NULL)::int * 0.20, 0), 0.0), 6)::double AS overall FROM s""")
def q38(t):
    i = F.col("doc_id")
    s = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    parts = {"intent": F.col("quality").cast("double"), "process": 1.0 - F.col("toxic"), "dialogue": F.when(i % 3 != 0, (i % 10) / 10.0), "exploration": F.when(i % 5 == 0, 0.5)}
    return s.select("doc_id", F.round(metrics.weighted_mean(parts), 6).alias("overall"))


@query("q56_rubric_overalls", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 0.25 + l_tax * 0.25 + l_discount * 0.20 + l_tax * 0.15 + l_discount * 0.15, 9) AS intent, round((l_discount + l_tax + l_discount + l_tax + l_discount) / 5, 9) AS process, round(l_discount * 0.30 + l_tax * 0.35 + l_discount * 0.20 + l_tax * 0.15, 9) AS dialogue,
round(l_discount * 0.20 + l_tax * 0.20 + l_discount * 0.20 + l_tax * 0.20 + l_discount * 0.10 + (1.0 - l_tax) * 0.10, 9) AS exploration, l_returnflag = 'R' AND coalesce(CASE WHEN l_linestatus = 'F' THEN l_discount > 0.05 END, true) AS resolved FROM lineitem""")
def q56(t):
    d, x = F.col("l_discount"), F.col("l_tax")
    r9 = lambda c: F.round(c, 9)
    known = F.when(F.col("l_linestatus") == "F", d > 0.05)
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r9(metrics.intent_overall(d, x, d, x, d)).alias("intent"), r9(metrics.process_overall(d, x, d, x, d)).alias("process"), r9(metrics.dialogue_overall(d, x, d, x)).alias("dialogue"),
        r9(metrics.exploration_overall(d, x, d, x, d, x)).alias("exploration"), metrics.resolved(F.col("l_returnflag") == "R", known).alias("resolved"),
    )
