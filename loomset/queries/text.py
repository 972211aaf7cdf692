"""Text, path, list and JSON functions over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from loomset import patterns as P
from loomset.functions import diff, jsonx, lists, paths, spans
from loomset.functions import text as X
from loomset.functions.tokens import alignment_tokens, overlap, overlap_ratio
from loomset.operators.containment import contained_in
from loomset.queries import query


@query("q02_coalesce_normalise", """SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), ''), nullif(url, ''), '') AS title, trim(lower(url)) AS url FROM pages WHERE trim(url) <> ''""")
def q02(t):
    p = t("pages").where("trim(url) <> ''")
    return p.select("page_id", X.first_nonempty(F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1)), F.col("url")).alias("title"), F.trim(F.lower("url")).alias("url"))


@query("q15_url_canonical", """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '^www\\.', '') AS path FROM pages),
q AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS parts FROM p)
SELECT page_id, array_to_string(parts, '/') AS canonical, array_to_string(parts[1:2], '/') AS component, array_to_string(parts, '/') || '::' || 'name' AS symbol FROM q""")
def q15(t):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", ""), r"^www\.", "")
    p = t("pages").select("page_id", paths.canonical_path(path).alias("canonical"), path.alias("path"))
    symbol = paths.canonical_symbol(F.concat("path", F.lit(":: name ")))
    return p.select("page_id", "canonical", F.array_join(paths.components_of(F.array("canonical")), "/").alias("component"), symbol.alias("symbol"))


@query("q16_line_stats", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), s AS (SELECT doc_id, len(ls)::bigint AS lines, len(list_filter(ls, lambda x: length(x) > 200))::bigint AS long_lines FROM l)
SELECT doc_id, lines, long_lines, CASE WHEN lines <= 40 THEN 'small' WHEN lines <= 160 THEN 'medium' WHEN lines <= 500 THEN 'large' ELSE 'very_large' END AS pool_size, CASE WHEN lines <= 80 THEN 'small' ELSE 'medium' END AS test_size,
CASE WHEN long_lines > 8 OR lines > 500 THEN 'high' WHEN lines > 160 OR long_lines > 3 THEN 'medium' ELSE 'low' END AS leakage FROM s""")
def q16(t):
    held = t("documents").select("doc_id", X.lines(F.col("text")).alias("ls"))
    s = held.select("doc_id", F.size("ls").cast("bigint").alias("lines"), F.size(F.filter("ls", lambda x: F.length(x) > 200)).cast("bigint").alias("long_lines"))
    n = F.col("lines")
    return s.select("doc_id", "lines", "long_lines", diff.size_bucket(n).alias("pool_size"), diff.size_bucket(n, "test").alias("test_size"), diff.leakage_level(n, F.col("long_lines")).alias("leakage"))


_STRIP = r"regexp_replace({0}, '^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$', '', 'g')"


@query("q17_title_and_type", f"""SELECT doc_id, coalesce(regexp_replace(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '' AND NOT starts_with(x, '<!--'))[1], '^[# ]+|[# ]+$', '', 'g'), 'Repository issue') AS title,
CASE WHEN regexp_matches(lower(text), 'error|failed|fails|bug|traceback|exception') THEN 'bug' WHEN regexp_matches(lower(text), 'feature|support|option|enable|allow') THEN 'feature' WHEN regexp_matches(lower(text), 'deprecat|upgrade|version') THEN 'upgrade' ELSE 'maintenance' END AS issue_type FROM documents""")
def q17(t):
    return t("documents").select("doc_id", X.title(F.col("text")).alias("title"), X.issue_type(F.col("text")).alias("issue_type"))


@query("q19_list_parse_count", """WITH e AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
v AS (SELECT event_id, k, CASE k % 5 WHEN 0 THEN '["a", "b"]' WHEN 1 THEN '[x, ''y'']' WHEN 2 THEN 'single' WHEN 3 THEN 'NaN' ELSE k::varchar END AS raw FROM e)
SELECT event_id, k::bigint AS k, CASE k % 5 WHEN 0 THEN 'a;b' WHEN 1 THEN 'x;y' WHEN 2 THEN 'single' WHEN 3 THEN '' ELSE k::varchar END AS parsed, CASE k % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE k END::bigint AS n FROM v""")
def q19(t):
    """Lists in strings, in each spelling, and how many things they stand for."""
    k = lists.safe_int(F.get_json_object("props", "$.k"), 0)
    raw = F.when(k % 5 == 0, '["a", "b"]').when(k % 5 == 1, "[x, 'y']").when(k % 5 == 2, "single").when(k % 5 == 3, "NaN").otherwise(k.cast("string"))
    e = t("events").select("event_id", k.cast("bigint").alias("k"), raw.alias("raw"))
    return e.select("event_id", "k", F.array_join(lists.parse_list(F.col("raw")), ";").alias("parsed"), lists.list_count(F.col("raw")).cast("bigint").alias("n"))


_SECRET = r"(token|secret|password|AKIA[A-Z0-9]+)"


@query("q20_leak_scan", f"""SELECT source, count(*) FILTER (WHERE regexp_matches(text, '{P.BENCHMARK_METADATA}', 'i')) AS metadata, count(*) FILTER (WHERE regexp_matches(text, '(?im){P.IMPLEMENTATION_HINT}')) AS hints, count(*) FILTER (WHERE regexp_matches(text, '{_SECRET}')) AS secrets, count(*) AS n FROM documents GROUP BY source""")
def q20(t):
    d, x = t("documents"), F.col("text")
    return d.groupBy("source").agg(F.count_if(X.leaks_metadata(x)).alias("metadata"), F.count_if(X.hints_implementation(x)).alias("hints"), F.count_if(x.rlike(_SECRET)).alias("secrets"), F.count("*").alias("n"))


_SCRUB = "text || ' see tests/unit/a.py and FAIL_TO_PASS, the reference  patch, hidden test test_abc ' || CASE WHEN doc_id % 2 = 0 THEN 'diff --git' ELSE '' END"
_CLEAN = "private failing-test metadata private regression-test metadata"


@query("q21_scrub", "WITH a AS (SELECT doc_id, " + _SCRUB + " AS raw FROM documents), b AS (SELECT doc_id, raw, " + (
    _STRIP.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, 'FAIL_TO_PASS', 'private failing-test metadata', 'gi'), 'PASS_TO_PASS', 'private regression-test metadata', 'gi'), 'reference\\s+patch', 'implementation details', 'gi'), 'hidden\\s+test', 'private test', 'gi'), 'diff --git', 'implementation diff', 'gi'), '\\btest_[A-Za-z0-9_]+\\b', 'private_test', 'g'), '\\btests/[A-Za-z0-9_./-]+', 'private test file', 'gi')")
) + " AS clean FROM a) SELECT doc_id, md5(clean) AS clean_md5, clean <> raw AS changed FROM b")
def q21(t):
    raw = F.concat("text", F.lit(" see tests/unit/a.py and FAIL_TO_PASS, the reference  patch, hidden test test_abc "), F.when(F.col("doc_id") % 2 == 0, "diff --git").otherwise(""))
    a = t("documents").select("doc_id", raw.alias("raw"))
    a = a.withColumn("clean", X.scrub(F.col("raw")))
    return a.select("doc_id", F.md5("clean").alias("clean_md5"), (F.col("clean") != F.col("raw")).alias("changed"))


@query("q22_leak_severity", f"""SELECT doc_id, CASE WHEN regexp_matches(text || ' ' || CASE WHEN doc_id % 3 = 0 THEN 'gold' ELSE 'x' END, '{X.PRIVATE}', 'i') THEN 'private_or_evaluator_leakage' ELSE 'benchmarkish_or_implementation_hint' END AS severity FROM documents""")
def q22(t):
    return t("documents").select("doc_id", X.leak_severity(F.concat("text", F.lit(" "), F.when(F.col("doc_id") % 3 == 0, "gold").otherwise("x"))).alias("severity"))


@query("q23_containment_join", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q23(t):
    """Benchmark items contained in documents: the small side in measured blocks."""
    found = contained_in(t("benchmark").select("item_id", F.col("text").alias("needle")), t("documents").select("doc_id", "text"), "needle", "text")
    return found.select("doc_id", "item_id")


_TOKENS = """list_filter(list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9]{{2,}}'), lambda x: CASE WHEN lower(x) LIKE '%ing' AND length(x) > 5 THEN left(lower(x), length(x)::int - 3) WHEN lower(x) LIKE '%ed' AND length(x) > 4 THEN left(lower(x), length(x)::int - 2)
 WHEN lower(x) LIKE '%s' AND length(x) > 4 THEN left(lower(x), length(x)::int - 1) ELSE lower(x) END)), lambda x: x NOT IN ({1}))"""
_STOPS = ", ".join(f"'{w}'" for w in P.STOP_WORDS)


@query("q24_token_overlap", f"""WITH b AS MATERIALIZED (SELECT item_id, {_TOKENS.format('text', _STOPS)} AS bt FROM benchmark), d AS MATERIALIZED (SELECT doc_id, (doc_id % (SELECT count(*) FROM benchmark))::bigint AS item_id, {_TOKENS.format('text', _STOPS)} AS dt FROM documents)
SELECT doc_id, item_id, len(list_intersect(bt, dt))::bigint AS shared, round(len(list_intersect(bt, dt)) / nullif(len(bt), 0)::double, 6) AS ratio FROM d JOIN b USING (item_id) WHERE len(bt) > 0""")
def q24(t):
    """Every document against the item of its number: distinct tokens shared."""
    b = t("benchmark").select("item_id", alignment_tokens(F.col("text")).alias("bt"))
    n = F.nullif(t("benchmark").agg(F.count("*")).scalar(), F.lit(0))
    d = t("documents").select("doc_id", (F.col("doc_id") % n).alias("item_id"), alignment_tokens(F.col("text")).alias("dt"))
    j = d.join(b, "item_id").where(F.size("bt") > 0)
    return j.select("doc_id", "item_id", overlap(F.col("bt"), F.col("dt")).alias("shared"), F.round(overlap_ratio(F.col("bt"), F.col("dt")), 6).alias("ratio"))


@query("q42_key_paths", """SELECT event_id, replace(fullkey, '"', '') AS path FROM (SELECT event_id, unnest(j).fullkey AS fullkey, unnest(j).key AS key FROM (SELECT event_id, list(t) AS j FROM events, json_tree('{"a": {"b": [1, {"oracle": ' || event_id || '}]}, "p": ' || props || '}') t GROUP BY event_id)) WHERE key IS NOT NULL AND NOT regexp_matches(fullkey, '\\]$')""")
def q42(t):
    raw = F.concat(F.lit('{"a": {"b": [1, {"oracle": '), F.col("event_id").cast("string"), F.lit('}]}, "p": '), F.col("props"), F.lit("}"))
    return jsonx.key_paths(t("events").select("event_id", raw.alias("raw")), "event_id", "raw")


@query("q43_json_recovery", """WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"a": [1, 2' WHEN 3 THEN '' WHEN 4 THEN 'note ' || props || ' end' ELSE '{"a": [1, 2,]}' END AS raw FROM events)
SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'json_repaired' WHEN 3 THEN 'invalid_json' WHEN 5 THEN 'json_repaired' ELSE 'json' END AS outcome, CASE event_id % 6 WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"a": [1, 2]}' WHEN 3 THEN NULL WHEN 5 THEN '{"a": [1, 2]}' ELSE props END AS value,
CASE WHEN event_id % 6 IN (0, 4) THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM r JOIN events USING (event_id)""")
def q43(t):
    """Answers of models, recovered: valid JSON by built-ins, the rest in Arrow batches."""
    k = F.col("event_id") % 6
    raw = F.when(k == 0, F.col("props")).when(k == 1, "[1, 2]").when(k == 2, '{"a": [1, 2').when(k == 3, "").when(k == 4, F.concat(F.lit("note "), "props", F.lit(" end"))).otherwise('{"a": [1, 2,]}')
    parsed = jsonx.recovered(t("events").select("event_id", raw.alias("raw")), "raw")
    return parsed.select("event_id", F.coalesce("parsed.format", "parsed.error_type").alias("outcome"), F.col("parsed.json").alias("value"), F.get_json_object("parsed.json", "$.k").cast("bigint").alias("k"))


@query("q45_persona_hash", """SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 8))::bigint % 5 AS persona, sha256(c_name) AS prompt_sha256, regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g')[1:80] AS slug FROM customer""")
def q45(t):
    n = F.col("c_name")
    return t("customer").select("c_custkey", X.persona(n).alias("persona"), F.sha2(n, 256).alias("prompt_sha256"), X.slug(n).alias("slug"))


@query("q50_span_match")
def q50(t):
    """Spans quoted from benchmark items against the whole of every document, by its number modulo the items': exact and normalised in bulk, fuzzy in batches. Not in SQL: similarity of sequences."""
    items = t("benchmark").select((F.row_number().over(Window.orderBy("item_id")) - 1).cast("bigint").alias("item"), F.col("text").alias("item_text"))
    n = F.nullif(t("benchmark").agg(F.count("*")).scalar(), F.lit(0))
    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))
    d = t("documents").select(F.pmod(number, n).alias("item"), F.col("text").alias("source_text"))
    k, start = F.col("item") % 4, F.substring("source_text", 1, 60)
    quoted = d.join(items, "item", "left").select("item", F.when(k == 0, "").when(k == 1, start).when(k == 2, F.upper(start)).otherwise(F.substring("item_text", 1, 60)).alias("source_span"), "source_text")
    matched = spans.match_spans(quoted, "source_span", "source_text")
    return matched.groupBy("match.status").agg(F.count("*").alias("n"))


_FOLDED = r"trim(regexp_replace(lower(replace(replace(replace({0}, '…', '...'), '`', ' '), '*', ' ')), '\s+', ' ', 'g'))"
_SPAN = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN trim(substr(text, 11, 60)) WHEN 2 THEN translate(trim(substr(text, 11, 60)), 'abcdefghijklmnopqrstuvwxyz ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ`') ELSE 'qqxz ' || doc_id || ' zzxq' END"


_LONG = "length(regexp_replace(span, '^[ \t\r\n.;:]+|[ \t\r\n.;:]+$', '', 'g')) >= 8"


@query("q57_span_tiers", f"""WITH d AS (SELECT doc_id, text, {_SPAN} AS span FROM documents WHERE regexp_full_match(text, '[ -~\n]*'))
SELECT doc_id, CASE WHEN span = '' THEN 'empty' WHEN text = '' THEN 'invalid_source' WHEN contains(text, span) THEN 'exact' WHEN {_LONG} AND contains({_FOLDED.format('text')}, {_FOLDED.format('span')}) THEN 'normalized' ELSE 'unmatched' END AS status,
CASE WHEN span <> '' AND text <> '' AND (contains(text, span) OR {_LONG} AND contains({_FOLDED.format('text')}, {_FOLDED.format('span')})) THEN 1.0 ELSE 0.0 END::double AS score FROM d""")
def q57(t):
    """The tiers of span alignment that SQL can say, over the whole of every document of plain characters: empty, exact, normalised, unmatched."""
    k, start = F.col("doc_id") % 4, F.trim(F.substring("text", 11, 60))
    upper = F.translate(start, "abcdefghijklmnopqrstuvwxyz ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ`")
    span = F.when(k == 0, "").when(k == 1, start).when(k == 2, upper).otherwise(F.concat(F.lit("qqxz "), F.col("doc_id").cast("string"), F.lit(" zzxq")))
    d = t("documents").where(F.col("text").rlike(r"\A[ -~\n]*\z")).select("doc_id", "text", span.alias("span"))
    return spans.match_spans(d, "span", "text").select("doc_id", "match.status", "match.score")


@query("q51_patch_section_extract", f"""WITH d AS (SELECT doc_id, '# Intro' || chr(10) || text || chr(10) || '# Steps to reproduce' || chr(10) || 'do ' || doc_id || chr(10) || 'then' || chr(10) || '## Next' || chr(10) || 'x' || chr(10) || 'diff --git a/f' || doc_id || '.py b/f' || doc_id || '.py' || chr(10) || '@@ -1 +1 @@ class A: def b(self)' || chr(10) || '+ y' AS raw FROM documents)
SELECT doc_id, 'do ' || doc_id || chr(10) || 'then' AS section, 'f' || doc_id || '.py' AS files, 'f' || doc_id || '.py::A' AS pool_symbols, 'f' || doc_id || '.py::b' AS gold_symbols, 1::bigint AS added,
'diff --git a/f' || doc_id || '.py b/f' || doc_id || '.py' || chr(10) || '@@ -1 +1 @@ class A: def b(self)' || chr(10) || '+ y' || chr(10) AS patch FROM d""")
def q51(t):
    """Sections, patches and their symbols out of long texts."""
    i = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("# Intro\n"), F.col("text"), F.lit("\n# Steps to reproduce\ndo "), i, F.lit("\nthen\n## Next\nx\ndiff --git a/f"), i, F.lit(".py b/f"), i, F.lit(".py\n@@ -1 +1 @@ class A: def b(self)\n+ y"))
    d = t("documents").select("doc_id", raw.alias("raw")).withColumn("patch", X.patch_of(F.col("raw")))
    p = F.col("patch")
    join = lambda c: F.array_join(c, ";")
    return d.select("doc_id", X.section(F.col("raw"), ["steps to reproduce"]).alias("section"), join(diff.diff_files(p)).alias("files"), join(diff.diff_symbols(p)).alias("pool_symbols"), join(diff.diff_symbols(p, "gold")).alias("gold_symbols"), diff.diff_counts(p)["added"].cast("bigint").alias("added"), "patch")


@query("q54_repo_domain", """WITH r AS (SELECT s_suppkey, (['django/django', 'scikit-learn__scikit-learn', 'pydata/xarray', 'astropy__astropy', 'pylint-dev/pylint', 'x/y', '', ' Sphinx-doc/Sphinx ', 'a/sklearn', 'pytest-dev__pytest'])[(s_suppkey % 10 + 1)::int] AS repo FROM supplier)
SELECT s_suppkey, (['django', 'scikit-learn', 'xarray', 'astropy', 'pylint', 'y', 'unknown', 'sphinx', 'scikit-learn', 'pytest'])[(s_suppkey % 10 + 1)::int] AS slug, (['web_framework', 'ml_library', 'scientific_computing', 'scientific_computing', 'static_analysis', 'other', 'other', 'documentation_tooling', 'ml_library', 'testing_tooling'])[(s_suppkey % 10 + 1)::int] AS domain FROM r""")
def q54(t):
    names = ["django/django", "scikit-learn__scikit-learn", "pydata/xarray", "astropy__astropy", "pylint-dev/pylint", "x/y", "", " Sphinx-doc/Sphinx ", "a/sklearn", "pytest-dev__pytest"]
    repo = F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % 10 + 1).cast("int"))
    return t("supplier").select("s_suppkey", paths.repo_slug(repo).alias("slug"), paths.domain(repo).alias("domain"))
