"""Scans, joins, aggregations, windows, sorts and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.catalog import query
from tessera.functions import text, urls
from tessera.operators import graph, incremental, qa, relations, search
from tessera.sources import files, model

t = model.table
FILES = "SELECT doc_id AS id, doc_id % 5 AS repo_id, concat(lang, '/', source, '/', doc_id, '.txt') AS path, lang AS language, text AS content FROM documents"
LINES = "SELECT doc_id AS file_id, doc_id % 5 AS repo_id, concat(lang, '/', source, '/', doc_id, '.txt') AS path, unnest(string_split(text, chr(10))) AS code_text, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line FROM documents"
EDGES = "SELECT o_custkey AS source, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % (SELECT count(*) FROM customer) END AS target, CAST(o_orderkey % (SELECT count(*) FROM customer) AS VARCHAR) AS symbol, o_orderstatus AS call_type, o_orderkey % 500 AS call_line FROM orders"
IMPORTS = "SELECT o_custkey % 97 AS source, o_orderkey % 97 AS target, o_orderstatus AS symbol, o_orderpriority AS import_type, o_orderkey % 50 AS line FROM orders"
SPANS = "SELECT l_orderkey AS file_id, l_partkey AS name, l_linenumber * 10 AS line_start, l_linenumber * 10 + CAST(floor(l_quantity) AS BIGINT) AS line_end FROM lineitem"


@query(f"SELECT id, len(string_split(content, chr(10))) AS lines, list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) AS longest FROM ({FILES})")
def line_measures(spark, d):
    count, longest = files.line_measures(F.col("content"))
    return model.files(spark, d).select("id", count.cast("long").alias("lines"), longest.cast("long").alias("longest"))


@query(f"""SELECT CASE WHEN regexp_matches(path, '\\.min\\.(js|css)$|\\.bundle\\.js$|\\.chunk\\.js$|(^|/)(dist|build)/') THEN 'build-output' WHEN strlen(content) > 1000000 THEN 'too-large'
WHEN list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) > 5000 AND length(content) / len(string_split(content, chr(10))) > 2000 THEN 'minified' ELSE 'accept' END AS reason, count(*) AS n FROM ({FILES}) GROUP BY 1""")
def index_guards(spark, d):
    return files.skip_summary(model.files(spark, d))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS without_value, round(coalesce(avg(value), 0), 6) AS mean_ms, round(coalesce(max(value), 0), 6) AS most_ms, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def search_log_statistics(spark, d):
    e = t(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("without_value"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean_ms"), F.round(F.coalesce(F.max("value"), F.lit(0.0)), 6).alias("most_ms"), F.count_distinct("user_id").alias("users"))


@query("SELECT count(*) AS files, count(DISTINCT lang) AS languages, (SELECT count(*) FROM pages) AS patterns, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM conversations) AS turns FROM documents")
def repository_counts(spark, d):
    one = lambda name, alias: t(spark, d, name).agg(F.count(F.lit(1)).alias(alias))
    docs = t(spark, d, "documents").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("lang").alias("languages"))
    return docs.join(F.broadcast(one("pages", "patterns"))).join(F.broadcast(one("embeddings", "vectors"))).join(F.broadcast(one("conversations", "turns")))  # one row each


@query(f"WITH r AS (SELECT r_regionkey AS id, r_name AS name FROM region) SELECT r.id, r.name, count(f.id) AS n_files, coalesce(sum(length(f.content)), 0)::BIGINT AS n_chars FROM r LEFT JOIN ({FILES}) f ON f.repo_id = r.id GROUP BY ALL")
def repositories(spark, d):
    r = t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    per = model.files(spark, d).groupBy(F.col("repo_id").alias("id")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("content")).alias("n_chars"))
    return r.join(per, "id", "left").select("id", "name", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))


@query(f"WITH p AS (SELECT file_id, line, lower(regexp_extract(code_text, '^\\W*(\\w+)', 1)) AS symbol FROM ({LINES})) SELECT symbol, count(*) AS n, min(file_id) AS first_file FROM p GROUP BY 1 HAVING count(*) = 1")
def unique_symbols(spark, d):
    lines = model.files(spark, d).select("id", F.posexplode(F.split("content", "\n")).alias("p", "code_text"))
    return lines.groupBy(F.lower(F.regexp_extract("code_text", r"^\W*(\w+)", 1)).alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_file")).where("n = 1")


@query(f"WITH pts AS (SELECT DISTINCT l_orderkey AS file_id, l_linenumber * 7 + 5 AS line FROM lineitem), s AS ({SPANS}) SELECT p.file_id, p.line, (SELECT arg_max(name, (line_start, -line_end, -name)) FROM s WHERE s.file_id = p.file_id AND p.line BETWEEN line_start AND line_end) AS name FROM pts p")
def enclosing_spans(spark, d):
    points = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber").cast("long") * 7 + 5).alias("line_start")).distinct().withColumn("line_end", F.col("line_start"))
    got = relations.enclosing(points, model.spans(spark, d))
    return got.select("file_id", F.col("line_start").alias("line"), "name")


@query(f"WITH s AS ({SPANS}), a AS (SELECT DISTINCT file_id, name, line_start, line_end FROM s) SELECT x.file_id, count(*) AS overlapping FROM a x JOIN a y ON x.file_id = y.file_id AND (x.name, x.line_start, x.line_end) < (y.name, y.line_start, y.line_end) AND x.line_start <= y.line_end AND y.line_start <= x.line_end GROUP BY 1")
def overlapping_spans(spark, d):
    s = model.spans(spark, d).distinct()
    y = s.select("file_id", *(F.col(c).alias(f"_{c}") for c in ("name", "line_start", "line_end")))
    before = F.struct("name", "line_start", "line_end") < F.struct(F.col("_name").alias("name"), F.col("_line_start").alias("line_start"), F.col("_line_end").alias("line_end"))
    pairs = s.join(y, "file_id").where(before & relations.overlaps(F.col("line_start"), F.col("line_end"), F.col("_line_start"), F.col("_line_end")))
    return pairs.groupBy("file_id").agg(F.count(F.lit(1)).alias("overlapping"))


@query(f"SELECT source, target, count(*) AS dependency_count, array_to_string(list_sort(list(DISTINCT import_type)), ',') AS dependency_types FROM (SELECT DISTINCT * FROM ({IMPORTS}) WHERE source <> target) GROUP BY 1, 2")
def file_dependencies(spark, d):
    return graph.file_dependencies(model.imports(spark, d)).withColumn("dependency_types", F.array_join("dependency_types", ","))


@query(f"""SELECT source, target, CAST(sum(w) AS BIGINT) AS strength FROM (SELECT source, target, 2 * count(*) AS w FROM ({IMPORTS}) GROUP BY 1, 2 UNION ALL SELECT source % 97, target % 97, count(*) FROM ({EDGES}) WHERE target IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2""")
def dependency_strength(spark, d):
    calls = model.calls(spark, d).where("target IS NOT NULL").select((F.col("source") % 97).alias("source"), (F.col("target") % 97).alias("target"))
    return graph.dependency_strength(model.imports(spark, d), calls)


@query(f"WITH p AS (SELECT source, count(*) AS n FROM ({IMPORTS}) GROUP BY 1) SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS imports, round(avg(n), 6) AS avg_imports, round(sum(n * n) / sum(n), 6) AS avg_imports_import_weighted, max(n) AS max_imports FROM p")
def import_statistics(spark, d):
    return graph.import_statistics(model.imports(spark, d))


@query("""WITH c AS (SELECT l_suppkey AS root, l_linenumber AS call_line, l_suppkey + l_partkey % 2 AS caller, CASE WHEN l_returnflag <> 'R' THEN l_suppkey + l_orderkey % 2 END AS callee FROM lineitem)
SELECT root AS symbol, count(*) AS incoming, count(*) FILTER (WHERE callee IS NULL) AS unresolved, count(*) FILTER (WHERE caller = root AND callee = root AND call_line = 2) AS artifact_self_loops, count(*) FILTER (WHERE callee <> root) AS resolved_elsewhere FROM c GROUP BY 1""")
def edge_statistics(spark, d):
    root = F.col("l_suppkey")
    callee = F.when(F.col("l_returnflag") != "R", root + F.col("l_orderkey") % 2)
    calls = t(spark, d, "lineitem").select(root.alias("symbol"), root.alias("root"), F.lit(2).alias("root_line"), F.col("l_linenumber").alias("call_line"), (root + F.col("l_partkey") % 2).alias("caller"), callee.alias("callee"))
    return graph.edge_statistics(calls)


@query(f"SELECT source, symbol, min(target) AS callee, min(call_line) AS call_line FROM ({EDGES}) GROUP BY 1, 2 HAVING NOT bool_and(coalesce(source = target AND call_line = source % 500, false))")
def calls_without_artefacts(spark, d):
    c = model.calls(spark, d).select(F.col("source").alias("caller"), "symbol", F.col("target").alias("callee"), "call_line", (F.col("source") % 500).alias("line_start"))
    return graph.without_artefacts(c).withColumnRenamed("caller", "source")


@query("SELECT conv_id AS session_id, turn AS id, role, text AS answer, age FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS age FROM conversations) WHERE age <= 3")
def recent_turns(spark, d):
    return qa.recent_turns(model.turns(spark, d), 3)


@query("SELECT conv_id AS session_id, turn AS id, used FROM (SELECT conv_id, turn, CAST(sum(length(text[1:800])) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 3000")
def context_budget(spark, d):
    return qa.context_budget(model.turns(spark, d)).select("session_id", "id", "used")


@query("SELECT count(*) AS n_turns, count(DISTINCT conv_id) AS n_sessions, round(coalesce(avg(length(text)), 0), 6) AS mean_length FROM conversations")
def session_statistics(spark, d):
    return qa.session_statistics(model.turns(spark, d))


@query("""SELECT d.doc_id AS id, coalesce(array_to_string(f, ','), '') AS feedback, coalesce(n, 0) AS n_helpful FROM documents d LEFT JOIN (SELECT doc_id, list(CASE WHEN quality = 1 THEN 'true' ELSE 'false' END ORDER BY toxic DESC, quality DESC) AS f, count(*) FILTER (WHERE quality = 1) AS n FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id WHERE contains(lower(d.text), 'license')""")
def questions_with_feedback(spark, d):
    q = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("query"))
    f = t(spark, d, "labels").select(F.col("doc_id").alias("question_id"), F.col("toxic").alias("created"), (F.col("quality") == 1).alias("is_helpful"))
    got = qa.questions_with_feedback(q, f, "license")
    return got.select("id", F.array_join(F.transform("feedback", lambda x: x.cast("string")), ",").alias("feedback"), "n_helpful")


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def chunk_file_join(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    return o.join(t(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def resume_skip_set(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT count(*) AS n FROM labels l WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = l.doc_id + 500)")
def orphan_count(spark, d):
    child = t(spark, d, "labels").select((F.col("doc_id") + 500).alias("doc_id"))
    return relations.orphans(child, "doc_id", t(spark, d, "documents"), "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2")
def duplicates_removed(spark, d):
    return relations.first_of_duplicates(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("SELECT o_orderkey, o_orderstatus, s.only_key FROM orders LEFT JOIN (SELECT o_totalprice AS p, min(o_orderkey) AS only_key FROM orders GROUP BY 1 HAVING count(*) = 1) s ON s.p = o_totalprice WHERE o_orderstatus <> 'F'")
def unambiguous_backfill(spark, d):
    o = t(spark, d, "orders")
    calls = o.where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("symbol"), F.lit(None).cast("long").alias("callee"))
    got = relations.unambiguous_backfill(calls, o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("symbol")))
    return got.select("o_orderkey", "o_orderstatus", F.col("callee").alias("only_key"))


@query("""WITH c AS (SELECT o_custkey AS caller, o_orderpriority AS symbol, o_custkey % 7 AS caller_file, o_orderkey AS candidate, o_orderkey % 7 AS candidate_file FROM orders),
g AS (SELECT caller, symbol, count(*) FILTER (WHERE caller_file = candidate_file) AS same, min(candidate) FILTER (WHERE caller_file = candidate_file) AS own, count(*) AS n, min(candidate) AS first FROM c GROUP BY 1, 2)
SELECT caller, symbol, CASE WHEN same = 1 THEN own ELSE first END AS candidate, same <> 1 AND n > 1 AS ambiguous FROM g""")
def picked_candidates(spark, d):
    o = t(spark, d, "orders")
    c = o.select(F.col("o_custkey").alias("caller"), F.col("o_orderpriority").alias("symbol"), (F.col("o_custkey") % 7).alias("caller_file"), F.col("o_orderkey").alias("candidate"), (F.col("o_orderkey") % 7).alias("candidate_file"))
    return graph.pick_candidate(c)


@query("SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name LIKE '%1%'")
def left_outer_join(spark, d):
    n = t(spark, d, "nation").where(F.col("n_name").like("%1%"))
    r = t(spark, d, "region")
    return r.join(n, r["r_regionkey"] == n["n_regionkey"], "left").select("r_name", "n_name")


@query("SELECT p_partkey, p_name, CASE WHEN p_name = 'red widget' THEN 1 WHEN p_brand = 'red widget' THEN 2 ELSE 3 END AS match_rank FROM part WHERE contains(lower(p_name), 'red widget') OR contains(lower(p_brand), 'red widget') ORDER BY match_rank, p_partkey LIMIT 50")
def exact_search(spark, d):
    return search.exact(t(spark, d, "part"), "p_name", "red widget", "p_brand").orderBy("match_rank", "p_partkey").limit(50).select("p_partkey", "p_name", "match_rank")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%1%' AND (c_mktsegment ILIKE '%build%' OR c_mktsegment ILIKE '%auto%')")
def ilike_any(spark, d):
    c = t(spark, d, "customer")
    return c.where(F.col("c_name").ilike("%1%") & (F.col("c_mktsegment").ilike("%build%") | F.col("c_mktsegment").ilike("%auto%"))).select("c_custkey", "c_name")


@query("SELECT event_type, user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_per_key(spark, d):
    return graph.latest_by_key(t(spark, d, "events"), ["event_type", "user_id"], [F.col("ts"), F.col("event_id")]).select("event_type", "user_id", "ts", "value")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def per_key_cap(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY (o_orderstatus = 'P'), o_orderstatus, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 10")
def paged_sort(spark, d):
    o = t(spark, d, "orders")
    return o.orderBy(F.col("o_orderstatus") == "P", "o_orderstatus", F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(10).limit(40).select("o_orderkey", "o_orderstatus")


@query("""WITH k AS (SELECT o_orderkey AS id, o_totalprice AS score, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS arrival FROM orders QUALIFY arrival <= 20), s AS (SELECT o_orderkey AS id, o_totalprice / 2 AS score, 1000000 + row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS arrival FROM orders WHERE o_orderstatus = 'F' QUALIFY arrival <= 1000010)
SELECT id, round(arg_max(score, arrival), 4) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM s) GROUP BY id ORDER BY min(arrival) LIMIT 20""")
def keyword_and_semantic(spark, d):
    o = t(spark, d, "orders")
    first = Window.orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = lambda rows, n, score: rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(n).select(F.col("o_orderkey").alias("id"), score.alias("score"), F.row_number().over(first).alias("ord"))  # noqa: E731  windows over n rows
    k, s = top(o, 20, F.col("o_totalprice")), top(o.where("o_orderstatus = 'F'"), 10, F.col("o_totalprice") / 2)
    return search.keyword_and_semantic(k, s).select("id", F.round("score", 4).alias("score"))


@query("""WITH b AS (SELECT o_orderstatus AS kind, CAST(o_custkey AS VARCHAR) AS path, o_orderpriority AS symbol, min(o_orderkey) AS from_line FROM orders WHERE o_totalprice < 200000 GROUP BY ALL), a AS (SELECT o_orderstatus AS kind, CAST(o_custkey AS VARCHAR) AS path, o_orderpriority AS symbol, min(o_orderkey) AS to_line FROM orders WHERE o_totalprice > 100000 GROUP BY ALL)
SELECT kind, path, symbol, from_line, to_line, CASE WHEN from_line IS NULL THEN 'added' WHEN to_line IS NULL THEN 'removed' ELSE 'moved' END AS change FROM b FULL JOIN a USING (kind, path, symbol) WHERE from_line IS DISTINCT FROM to_line""")
def snapshot_diff(spark, d):
    e = t(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_custkey").cast("string").alias("path"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("line"), "o_totalprice")
    return incremental.snapshot_diff(e.where("o_totalprice < 200000"), e.where("o_totalprice > 100000"))


@query(f"""WITH c AS (SELECT DISTINCT source AS file FROM ({IMPORTS}) WHERE line = 7 AND symbol = 'P') SELECT DISTINCT file FROM (SELECT source AS file FROM ({IMPORTS}) WHERE target IN (SELECT file FROM c) UNION ALL SELECT target % 97 FROM ({EDGES}) WHERE source % 97 IN (SELECT file FROM c) AND target IS NOT NULL) WHERE file NOT IN (SELECT file FROM c)""")
def changed_referrers(spark, d):
    i = model.imports(spark, d)
    changed = i.where("line = 7 AND symbol = 'P'").select(F.col("source").alias("file")).distinct()
    usages = model.calls(spark, d).where("target IS NOT NULL").select((F.col("target") % 97).alias("usage_file"), (F.col("source") % 97).alias("definition_file"))
    return incremental.referrers(changed, i.select(F.col("source").alias("importer"), F.col("target").alias("imported")), usages)


@query("""WITH f AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'A' WHEN 'click' THEN 'M' WHEN 'error' THEN 'D' ELSE 'R' END AS status FROM events) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'A') AS added, count(*) FILTER (WHERE status = 'M') AS modified, count(*) FILTER (WHERE status = 'D') AS deleted, count(*) FILTER (WHERE status = 'R') AS renamed FROM f""")
def change_summary(spark, d):
    kind = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "click", "M").when(F.col("event_type") == "error", "D").otherwise("R")
    return incremental.change_summary(t(spark, d, "events").select(kind.alias("status")))


@query("SELECT DISTINCT path FROM (SELECT CAST(user_id AS VARCHAR) AS path FROM events UNION ALL SELECT CAST(user_id + 10000 AS VARCHAR) FROM events WHERE event_type = 'view')")
def candidate_paths(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "view", (F.col("user_id") + 10000).cast("string")).alias("from_path"))
    return incremental.candidate_paths(e)


@query(f"""WITH b AS (SELECT path, content FROM ({FILES}) WHERE language <> 'es'), a AS (SELECT path, CASE WHEN language = 'de' THEN concat(content, 'x') ELSE content END AS content FROM ({FILES}) WHERE language <> 'fr')
SELECT path, CASE WHEN b.content IS NULL THEN 'added' WHEN a.content IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM b FULL JOIN a USING (path) WHERE b.content IS DISTINCT FROM a.content""")
def content_changes(spark, d):
    f = model.files(spark, d)
    after = f.where("language <> 'fr'").select("path", F.when(F.col("language") == "de", F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    return incremental.content_changes(f.where("language <> 'es'"), after)


@query("""WITH tg AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING'), sr AS (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_acctbal > 5000) SELECT * FROM tg WHERE k NOT IN (SELECT k FROM sr) UNION ALL SELECT * FROM sr""")
def entity_upsert(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), "c_mktsegment")
    return files.upsert(c.where("c_mktsegment <> 'BUILDING'").drop("c_mktsegment"), c.where("v > 5000").drop("c_mktsegment").withColumn("v", F.col("v") + 1), ["k"])


@query("""WITH tg AS (SELECT DISTINCT o_custkey AS k, CAST(0 AS BIGINT) AS v FROM orders WHERE o_orderpriority = '1-URGENT'), sr AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders GROUP BY 1) SELECT * FROM tg UNION ALL SELECT * FROM sr WHERE k NOT IN (SELECT k FROM tg)""")
def insert_ignore(spark, d):
    o = t(spark, d, "orders")
    target = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), F.lit(0).cast("long").alias("v")).distinct()
    return files.insert_ignore(target, o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")), ["k"], [F.col("v")])


@query("SELECT o_orderkey, CASE WHEN t > 0 THEN CAST(floor(CAST(p AS DOUBLE) / t * 100) AS BIGINT) ELSE 0 END AS percent, CASE WHEN p > 10 THEN CAST(floor(90000.0 / p * (t - p) * 1.2 / 1000 + 0.5) AS BIGINT) END AS seconds_left FROM (SELECT o_orderkey, o_orderkey % 50 AS p, 50 AS t FROM orders)")
def index_progress(spark, d):
    percent, left = files.progress(F.col("o_orderkey") % 50, F.lit(50), F.lit(90000.0))
    return t(spark, d, "orders").select("o_orderkey", percent.cast("long").alias("percent"), left.cast("long").alias("seconds_left"))


@query(f"WITH i AS (SELECT DISTINCT source, target FROM ({IMPORTS})) SELECT node, direction FROM (SELECT target AS node, 'out' AS direction FROM i WHERE source = 5 UNION SELECT source, 'in' FROM i WHERE target = 5)")
def one_hop(spark, d):
    return graph.neighbours(model.imports(spark, d), 5)


@query(f"SELECT DISTINCT path, line FROM ({LINES}) WHERE regexp_matches(code_text, '\\bthe\\b')")
def usages_in_lines(spark, d):
    return relations.usages_in_lines(model.files(spark, d), "the").select("path", "line").distinct()


@query("SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names, count(*) AS n FROM nation GROUP BY 1")
def collected_names(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def ambiguous_exports(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("n")).where("n > 1").select("p_brand")


@query("SELECT o_custkey, round(floor((0.45 * least(n / 3, 1) + 0.25 * least(f / 2, 1) + 0.3 * m) * 100 + 0.5) / 100, 2) AS sufficiency FROM (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS f, avg(least(greatest(s, 0), 1)) FILTER (WHERE rn <= 3) AS m FROM (SELECT *, o_totalprice / 500000 AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rn FROM orders) GROUP BY 1)")
def sufficiency_scores(spark, d):
    e = t(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("file_path"), (F.col("o_totalprice") / 500000).alias("score"))
    return search.sufficiency(e, "o_custkey").withColumn("sufficiency", F.round("sufficiency", 2))


@query("SELECT o_custkey, round(floor((m * 0.7 + least(n / 5, 1) * 0.3) * 100 + 0.5) / 100, 2) AS confidence FROM (SELECT o_custkey, count(*) AS n, avg(least(greatest(s, 0), 1)) FILTER (WHERE rn <= 5) AS m FROM (SELECT *, o_totalprice / 500000 AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1)")
def confidence_scores(spark, d):
    e = t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), (F.col("o_totalprice") / 500000).alias("score"))
    return search.confidence(e, "o_custkey").withColumn("confidence", F.round("confidence", 2))
