"""Feeds, evidence, reference builders, trees and the URL search as one call."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text
from tessera.operators import evidence, graph, incremental, layers, qa, relations, search, urls as url_ops
from tessera.plans.queries_relational import EDGES
from tessera.plans.queries_rules import cases, dealt, dealt_sql, matches
from tessera.sources import feeds, model

t = model.table
CHANGES = ("A\tsrc/new.ts", "M\tsrc/a.JS", "D\tsrc/gone.md", "T\tlink", "R100\tsrc/old.ts\tsrc/new.tsx", "C75\tsrc/a.ts\tsrc/b.vue", "X\tsrc/x.ts", "M", "R100\tonly.ts", " M \t a b.ts ", "")
LETTERS = "CASE substr(trim(p[1]), 1, 1) WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' WHEN 'D' THEN 'deleted' WHEN 'T' THEN 'modified' WHEN 'R' THEN 'renamed' WHEN 'C' THEN 'added' END"


@query(f"""WITH l AS (SELECT o_orderkey, string_split({dealt_sql("o_orderkey", CHANGES)}, chr(9)) AS p FROM orders), r AS (SELECT o_orderkey, {LETTERS} AS status, CASE WHEN substr(trim(p[1]), 1, 1) IN ('R', 'C') THEN trim(p[3]) ELSE trim(p[2]) END AS path, CASE WHEN substr(trim(p[1]), 1, 1) = 'R' THEN trim(p[2]) END AS from_path FROM l) SELECT *, regexp_matches(lower(path), '[^/]\\.(ts|tsx|js|jsx|mjs|cjs|vue)$') AS indexable FROM r WHERE status IS NOT NULL AND path <> ''""")
def name_status_feed(spark, d):
    return feeds.name_status(t(spark, d, "orders").select("o_orderkey", dealt(F.col("o_orderkey"), CHANGES).alias("line")))


@query("SELECT o_orderkey, concat('sha', o_orderkey) AS sha, concat('s', o_orderkey) AS short_sha, o_orderstatus AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'me' ELSE '' END AS author, '' AS date FROM orders ORDER BY o_orderkey LIMIT 50")
def commit_log(spark, d):
    o = t(spark, d, "orders")
    fields = [F.concat(F.lit("sha"), F.col("o_orderkey").cast("string")), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "me")]
    return feeds.commits(o.select("o_orderkey", F.concat_ws("\u001f", *fields).alias("line")), "o_orderkey")


@query("SELECT page_id AS id, 0 AS file_id, coalesce(url, '') AS file_path, CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id END AS line_start, coalesce(html, '') AS content, CASE page_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' ELSE 'page' END AS symbol_type, CAST(CASE page_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0 END AS DOUBLE) AS score, concat(coalesce(url, ''), ':', CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id END) AS source FROM pages")
def evidence_rows(spark, d):
    kind = F.when(F.col("page_id") % 3 == 2, "page").when(F.col("page_id") % 3 == 1, "")
    rows = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("file_path"), F.when(F.col("page_id") % 3 != 0, F.col("page_id")).alias("line_start"), F.col("html").alias("code_text"), kind.alias("symbol_type"), F.when(F.col("page_id") % 3 == 0, 0.5).alias("similarity"), F.when(F.col("page_id") % 3 == 1, 0.25).alias("score"))
    got = evidence.evidence(rows)
    return got.select("id", F.col("file_id").cast("int").alias("file_id"), "file_path", "line_start", "content", "symbol_type", "score", evidence.source(F.col("file_path"), F.col("line_start")).alias("source"))


RESULT_IDS = ("code_chunks:12", "t:7:8", "t: 5x", "t:x5", "12", "t:", "t:-3", "")


@query(f"""SELECT page_id, coalesce(TRY_CAST(regexp_extract({dealt_sql("page_id", RESULT_IDS)}, '^[^:]*:\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS id FROM pages""")
def evidence_ids(spark, d):
    return t(spark, d, "pages").select("page_id", evidence.evidence_id(dealt(F.col("page_id"), RESULT_IDS)).alias("id"))


@query("SELECT event_type, count(*) FILTER (WHERE value >= 5) AS hits, count(*) FILTER (WHERE value < 5) AS misses, CASE WHEN count(value) > 0 THEN round(count(*) FILTER (WHERE value >= 5) / count(value), 6) ELSE 0 END AS hit_rate FROM events GROUP BY 1")
def cache_hit_rates(spark, d):
    return evidence.hit_rates(t(spark, d, "events").select("event_type", (F.col("value") >= 5).alias("hit")), "event_type")


NOW = datetime.datetime(1996, 1, 1)


@query("SELECT o_orderkey, epoch_ms(TIMESTAMP '1996-01-01') - epoch_ms(CAST(o_orderdate AS TIMESTAMP)) > 86400000 AS expired, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.000Z') AS written FROM orders")
def expiry(spark, d):
    day = F.col("o_orderdate").cast("timestamp")
    now = F.to_date(F.lit(NOW.date().isoformat())).cast("timestamp")
    return t(spark, d, "orders").select("o_orderkey", evidence.expired(day, now, 86_400).alias("expired"), evidence.iso(day).alias("written"))


TASKS = ("为什么失败", "一个 BUG", "修改它会怎样", "影响范围", "整体架构", "如果我改了", "hello", "")
TASK_RULES = tuple((matches("lower(v)", pattern), name) for name, pattern in text.TASK_TYPES)


@query(f"""SELECT page_id, {cases(TASK_RULES, "general_query")} AS task FROM (SELECT page_id, {dealt_sql("page_id", TASKS)} AS v FROM pages)""")
def task_types(spark, d):
    return t(spark, d, "pages").select("page_id", text.task_type(dealt(F.col("page_id"), TASKS)).alias("task"))


@query("SELECT DISTINCT term FROM (SELECT unnest(string_split_regex(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[_\\-\\s]+')) AS term FROM part) WHERE length(term) >= 3")
def dictionary_terms(spark, d):
    return search.dictionary(t(spark, d, "part"), "p_name")


VALUES = ("/a/${b}", "/a/:id", "/a/{b}", "/a/b", "", "a:b")


@query(f"""SELECT page_id, v LIKE '%:%' OR v LIKE '%{{%' AS templated FROM (SELECT page_id, {dealt_sql("page_id", VALUES)} AS v FROM pages)""")
def templated_values(spark, d):
    return t(spark, d, "pages").select("page_id", search.is_templated(dealt(F.col("page_id"), VALUES)).alias("templated"))


@query("SELECT p_partkey AS id, p_brand AS symbol, p_type AS path, p_size AS line_start FROM part WHERE lower(p_brand) IN ('brand#11', 'brand#23')")
def case_insensitive_symbols(spark, d):
    definitions = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("symbol"), F.col("p_type").alias("path"), F.col("p_size").alias("line_start"))
    return search.named_symbols(definitions, ["brand#11", "Brand#23"])


@query("SELECT p_partkey AS id, p_brand AS symbol, p_type AS path, p_size AS line_start FROM part WHERE p_brand = 'Brand#23'")
def definitions_of_symbol(spark, d):
    definitions = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("symbol"), F.col("p_type").alias("path"), F.col("p_size").alias("line_start"))
    return search.symbol_candidates(definitions, "Brand#23")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS score, l_returnflag AS file_path, l_suppkey AS line_start FROM lineitem) SELECT id, score, file_path, line_start FROM r WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey % 7 = 0 AND o_custkey = r.line_start) QUALIFY row_number() OVER (PARTITION BY file_path, line_start ORDER BY score DESC, id) = 1""")
def unseen_results(spark, d):
    modes = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("score"), F.col("l_returnflag").alias("file_path"), F.col("l_suppkey").alias("line_start"))
    shown = t(spark, d, "orders").where("o_custkey % 7 = 0").select(F.col("o_custkey").alias("line_start")).join(modes.select("file_path").distinct())
    return evidence.unseen(modes, shown)


@query("""WITH c AS (SELECT p_partkey AS id, p_partkey % 100 AS file_id, list_extract(['the', 'and', 'with', 'of'], CAST(p_partkey % 4 AS BIGINT) + 1) AS symbol, p_partkey % 2 = 0 AS exported FROM part),
i AS (SELECT DISTINCT o_custkey % 100 AS importer, o_orderkey % 100 AS imported, list_extract(['the', 'and', 'with', 'of'], CAST(o_orderkey % 4 AS BIGINT) + 1) AS symbol, CASE WHEN o_orderkey % 3 = 0 THEN 'from' END AS alias, CASE WHEN o_orderkey % 5 = 0 THEN 'namespace' ELSE 'named' END AS import_type FROM orders WHERE o_orderkey % 10 < 3),
w AS (SELECT c.id, i.importer AS file_id, coalesce(i.alias, c.symbol) AS word, CASE WHEN import_type = 'namespace' THEN 'namespace_access' ELSE 'direct_reference' END AS reference_type FROM c JOIN i ON c.exported AND i.imported = c.file_id AND (i.symbol = c.symbol OR i.import_type = 'namespace') UNION SELECT id, file_id, symbol, 'local_reference' FROM c WHERE NOT exported),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
x AS (SELECT doc_id, doc_id % 100 AS file_id, line, i, unnest(list_distinct(regexp_extract_all(line, '\\w+'))) AS word FROM l)
SELECT DISTINCT w.id AS constant_id, x.file_id, x.doc_id AS chunk_id, x.i AS line, reference_type FROM x JOIN w ON w.file_id = x.file_id AND w.word = x.word""")
def constant_references(spark, d):
    pick = lambda key: F.get(F.array(*(F.lit(x) for x in ("the", "and", "with", "of"))), (key % 4).cast("int"))
    c = t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).alias("file_id"), pick(F.col("p_partkey")).alias("symbol"), (F.col("p_partkey") % 2 == 0).alias("exported"))
    o = F.col("o_orderkey")
    i = t(spark, d, "orders").where(o % 10 < 3).select((F.col("o_custkey") % 100).alias("importer"), (o % 100).alias("imported"), pick(o).alias("symbol"), F.when(o % 3 == 0, "from").alias("alias"), F.when(o % 5 == 0, "namespace").otherwise("named").alias("import_type")).distinct()
    chunks = t(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100).alias("file_id"), F.lit(1).alias("line_start"), F.col("text").alias("code_text"))
    return relations.constant_references(c, i, chunks, context=False)


@query("""WITH k AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' END AS method, concat('p', page_id % 50) AS np, page_id % 20 AS file_id, page_id % 7 AS line FROM pages), p AS (SELECT coalesce(method, '') AS m, np, min(page_id) AS pattern_id FROM k GROUP BY ALL) SELECT pattern_id, file_id, line, any_value(method) AS method FROM k JOIN p ON p.m = coalesce(k.method, '') AND p.np = k.np GROUP BY 1, 2, 3""")
def url_usage_sites(spark, d):
    p = F.col("page_id")
    patterns = t(spark, d, "pages").select(F.lit(1).alias("repo_id"), p.alias("id"), F.expr(model.METHOD).alias("method"), (p % 20).alias("file_id"), (p % 7).alias("line"), F.concat(F.lit("/p"), (p % 50).cast("string")).alias("pattern"), F.concat(F.lit("p"), (p % 50).cast("string")).alias("normalized_pattern"), F.lit("axios.get(url)").alias("code"))
    spans = spark.createDataFrame([], "file_id long, name string, line_start long, line_end long")
    return relations.url_usages(patterns, spans).select("pattern_id", "file_id", "line", "method")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (SELECT min(p_partkey) FROM part WHERE p_partkey % 2 = 0 AND p_size = o_orderkey % 60) END AS pattern_id FROM orders""")
def indirect_usage_sites(spark, d):
    o, p = F.col("o_orderkey"), F.col("p_partkey")
    sites = t(spark, d, "orders").select(F.lit(1).alias("repo_id"), o.alias("file_id"), F.lit(1).alias("line"), F.lit("indirect_call").alias("kind"), F.concat(F.when(o % 3 == 0, "/Size/").otherwise("/other/"), (o % 60).cast("string"), F.lit("/")).alias("url"))
    patterns = t(spark, d, "part").where(p % 2 == 0).select(F.lit(1).alias("repo_id"), p.alias("id"), F.lit("GET").alias("method"), F.concat(F.lit("size/"), F.col("p_size").cast("string")).alias("pattern"), F.lit(None).cast("string").alias("normalized_pattern"))
    return relations.indirect_usages(sites, patterns)[0].select(F.col("file_id").alias("o_orderkey"), "pattern_id")


@query("SELECT DISTINCT concat('src/f', p_partkey % 30, '.ts') AS file FROM part WHERE p_partkey % 10 IN (2, 4)")
def promoted_importers(spark, d):
    p = F.col("p_partkey")
    unresolved = t(spark, d, "part").select(F.concat(F.lit("src/f"), (p % 30).cast("string"), F.lit(".ts")).alias("importer"), F.concat(F.lit("./lib/m"), (p % 10).cast("string")).alias("target"))
    added = spark.createDataFrame([("src/lib/m2.ts",), ("src/lib/m4/index.vue",), ("lib/m5.ts",)], "path string")
    return incremental.promoted(unresolved, added)


@query("SELECT doc_id AS file_id, length(text) AS n, doc_id % 4 = 1 AS fresh FROM documents WHERE doc_id % 4 <> 2")
def rebuilt_measures(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text"))
    derive = lambda rows: {"measures": rows.select(F.col("id").alias("file_id"), F.length("text").alias("n"), F.lit(True).alias("fresh"))}
    before = incremental.reindexed(docs, derive)["measures"].withColumn("fresh", F.lit(False))
    return incremental.rebuilt({"measures": before}, docs.where("id % 4 <> 2"), docs.where("id % 4 IN (1, 2)").select("id"), derive)["measures"]


IMPORTED = "SELECT o_custkey % 97 AS source, o_orderkey % 97 AS target FROM orders"


@query(f"WITH i AS ({IMPORTED}), r AS (SELECT 3 AS node UNION SELECT target FROM i WHERE source = 3) SELECT source, target, 'imports' AS type, count(*) AS weight FROM i WHERE source IN (SELECT node FROM r) GROUP BY ALL")
def file_graph_edges(spark, d):
    imports = model.imports(spark, d).select("source", "target")
    files = spark.range(97).select("id", F.concat(F.lit("src/f"), F.col("id").cast("string"), F.lit(".ts")).alias("path"))
    _, edges = graph.file_graph(files, imports, imports.where("false"), 3, 2)
    return edges.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("weight"))


@query(f"""WITH e AS ({EDGES}), d AS (SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS symbol FROM customer), x AS (SELECT source, symbol, min(call_line) AS call_line FROM e WHERE source IN (SELECT id FROM d) GROUP BY 1, 2)
SELECT 'root' AS direction, 0 AS depth, '4' AS symbol, CAST(4 AS BIGINT) AS node UNION ALL SELECT 'callers', 1, CAST(source AS VARCHAR), source FROM x WHERE symbol = '4' UNION ALL SELECT 'callees', 1, x.symbol, d.id FROM x LEFT JOIN d ON d.symbol = x.symbol WHERE source = 4""")
def symbol_call_tree(spark, d):
    definitions = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("symbol"), F.lit("f.ts").alias("path"), F.lit(-1).alias("line_start"))
    tree = graph.symbol_tree(definitions, model.calls(spark, d).select("source", "target", "symbol", "call_line"), "4", depth=1, most=100_000)
    return tree.select("direction", "depth", "symbol", "node")


@query("""SELECT coalesce(method, '(undecided)') AS method, count(*) AS n FROM (SELECT DISTINCT CASE page_id % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' END AS method, concat('/api/p', page_id % 50) AS path FROM pages) GROUP BY 1""")
def listed_interfaces(spark, d):
    p = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.expr(model.METHOD).alias("method"), F.concat(F.lit("/api/p"), (F.col("page_id") % 50).cast("string")).alias("path"))
    return qa.enumeration("列出所有接口", url_ops.inventory(p))["by_method"]


@query("""WITH i AS (SELECT DISTINCT CASE page_id % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' END AS method, concat('/g', page_id % 3, '/p', page_id % 50) AS path FROM pages), g AS (SELECT *, CASE WHEN method IS NULL THEN 'undecided methods' ELSE path[1:3] END AS grp FROM i) SELECT concat('| ', coalesce(method, '(undecided)'), ' | `', path, '` | 0 |') AS line FROM g UNION ALL SELECT concat('### ', grp, ' (', count(*), ')') FROM g GROUP BY grp UNION ALL SELECT unnest(['| Method | Path | Usages |', '| --- | --- | --- |']) FROM (SELECT DISTINCT grp FROM g)""")
def inventory_lines(spark, d):
    p = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.expr(model.METHOD).alias("method"), F.concat(F.lit("/g"), (F.col("page_id") % 3).cast("string"), F.lit("/p"), (F.col("page_id") % 50).cast("string")).alias("path"))
    return qa.inventory_markdown(url_ops.inventory(p)).select("line")


@query()
def url_search(spark, d):
    pages = model.url_patterns(spark, d)
    constants = pages.select("id", F.lit("").alias("name"), F.col("pattern").alias("value"), "file_path", (F.col("id") + 1).alias("line"))
    patterns = pages.select("id", "pattern", "normalized_pattern", "method", "file_path", (F.col("id") + 1).alias("line"), F.col("url").alias("code"))
    usages = model.url_usages(spark, d).select(F.concat_ws("-", "pattern_id", "usage_line").alias("id"), "file_path", F.col("usage_line").alias("line"), F.col("href").alias("code"), F.lit("api_call").alias("context"), F.col("href").alias("pattern"), F.lower("href").alias("normalized_pattern"))
    chunks = model.chunks(spark, d).select(F.concat_ws(":", "path", "line_start").alias("id"), F.col("path").alias("file_path"), "line_start", "code_text")
    return layers.search_url("where is /en/shop/item", constants, patterns, usages, chunks)
