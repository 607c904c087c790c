"""Questions, views, usages and layers of URL search."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.catalog import query
from tessera.functions import questions, text, urls
from tessera.operators import incremental, relations, urls as url_ops
from tessera.plans.queries_relational import EDGES, FILES, IMPORTS, LINES
from tessera.plans.queries_urls import NORMALIZED, PATH, SEGMENTS
from tessera.sources import model

t = model.table
HREFS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages"


@query(f"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '^\\$\\{{[^}}]*\\}}', ''), '/[0-9]+(/|$)', '/:id\\1', 'g'), '\\$\\{{([A-Za-z_][A-Za-z0-9_]*)\\}}', ':\\1', 'g'), '/+', '/', 'g'), '/') AS pattern FROM pages""")
def indexed_url_patterns(spark, d):
    p = t(spark, d, "pages")
    return p.select("page_id", urls.normalize_indexed_url(F.col("url")).alias("pattern"))


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'GET' END AS method, {PATH} AS path FROM pages WHERE length({PATH}) > 1 AND regexp_full_match({PATH}, '/[A-Za-z0-9_:{{}}/.-]+')")
def asked_interfaces(spark, d):
    p = model.url_patterns(spark, d).where((F.length("pattern") > 1) & F.col("pattern").rlike("^/[A-Za-z0-9_:{}/.-]+$"))
    q = F.concat(F.when(F.col("id") % 2 == 0, "get ").otherwise("list "), F.col("pattern"))
    return p.select(F.col("id").alias("page_id"), questions.asked_method(q).alias("method"), questions.asked_path(q).alias("path"))


@query("SELECT page_id, list_aggregate(list_transform(list_filter(string_split(regexp_replace(href, '[?#].*$', ''), '/'), lambda s: s <> ''), lambda s: url_decode(s)), 'string_agg', '|') AS parts FROM (SELECT page_id, href FROM (" + HREFS + ") WHERE href LIKE '/%')")
def decoded_links(spark, d):
    u = model.url_usages(spark, d).where("href LIKE '/%'")
    return u.select(F.col("pattern_id").alias("page_id"), F.nullif(F.array_join(questions.decoded_segments(F.col("href")), "|"), F.lit("")).alias("parts"))


@query("SELECT s_suppkey, concat('group/', s_name) AS project, 'git.example.com' AS host FROM supplier")
def repository_addresses(spark, d):
    s = t(spark, d, "supplier")
    url = F.concat(F.lit("https://git.example.com/group/"), F.col("s_name"), F.lit(".git"))
    return s.select("s_suppkey", questions.project_path(url).alias("project"), questions.project_host(url).alias("host"))


@query("SELECT p_partkey, concat(p_name, chr(10), p_type) AS constant_text FROM part")
def embedding_texts(spark, d):
    return t(spark, d, "part").select("p_partkey", questions.embedding_text("constant", name=F.col("p_name"), value=F.col("p_type")).alias("constant_text"))


@query("""SELECT conv_id, string_agg(concat('[', rn, '] ', role, ':', turn, '-', turn, chr(10), text[1:2000]), chr(10) || chr(10) ORDER BY rn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 5 GROUP BY 1""")
def prompts(spark, d):
    c = t(spark, d, "conversations").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("rn <= 5")
    block = questions.prompt_block(F.col("rn"), F.col("role"), F.col("turn"), F.col("turn"), F.col("text"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("prompt"))


@query(f"""WITH p AS (SELECT page_id, {NORMALIZED} AS pattern FROM pages) SELECT p.page_id, pattern, coalesce(n, 0) AS usage_count FROM p LEFT JOIN (SELECT page_id, count(*) AS n FROM ({HREFS}) GROUP BY 1) u ON u.page_id = p.page_id""")
def url_patterns_detailed(spark, d):
    p = model.url_patterns(spark, d)
    n = model.url_usages(spark, d).groupBy(F.col("pattern_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, "id", "left").select(F.col("id").alias("page_id"), F.col("normalized_pattern").alias("pattern"), F.coalesce("n", F.lit(0)).alias("usage_count"))


@query("SELECT p_partkey, p_name, count(l_orderkey) AS reference_count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL")
def constants_with_references(spark, d):
    n = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return t(spark, d, "part").select("p_partkey", "p_name").join(n, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("n", F.lit(0)).alias("reference_count"))


@query(f"SELECT DISTINCT a.source, a.symbol, b.target AS defined_in FROM ({EDGES}) a JOIN ({EDGES}) b ON CAST(b.source AS VARCHAR) = a.symbol")
def name_join(spark, d):
    c = model.calls(spark, d)
    right = c.select(F.col("source").cast("string").alias("symbol"), F.col("target").alias("defined_in"))
    return c.select("source", "symbol").join(right, "symbol").select("source", "symbol", "defined_in").distinct()


@query(f"SELECT source AS file, symbol, 'reference' AS how FROM ({IMPORTS}) WHERE target = 3 UNION SELECT file_id % 97, 'F', 'text' FROM ({LINES}) WHERE regexp_matches(code_text, '\\bthese\\b')")
def constant_usages(spark, d):
    direct = model.imports(spark, d).where("target = 3").select(F.col("source").alias("file"), "symbol", F.lit("reference").alias("how"))
    lines = model.chunks(spark, d).where(F.col("code_text").rlike(r"\bthese\b")).select((F.col("file_id") % 97).alias("file"), F.lit("F"), F.lit("text"))
    return direct.union(lines).distinct()


@query("SELECT event_type, count(*) AS pending FROM events WHERE value < 5 GROUP BY 1")
def resume_set(spark, d):
    stamped = t(spark, d, "events").withColumn("entities_indexed_at", F.when(F.col("value") >= 5, F.col("ts")))
    return incremental.pending(stamped.where("value IS NOT NULL")).groupBy("event_type").agg(F.count(F.lit(1)).alias("pending"))


@query("SELECT o_orderkey, CAST(o_orderkey % 10 + 1 AS INTEGER) AS processed, 'index' AS phase FROM orders")
def progress_update(spark, d):
    state = F.struct(F.lit(10).alias("total"), (F.col("o_orderkey") % 10).cast("int").alias("processed"), F.lit("scan").alias("phase"))
    o = t(spark, d, "orders").select("o_orderkey", state.alias("s"))
    o = o.withColumn("s", F.col("s").withField("processed", F.col("s.processed") + 1).withField("phase", F.lit("index")))
    return o.select("o_orderkey", "s.processed", "s.phase")


@query(f"""WITH p AS (SELECT page_id, {PATH} AS path FROM pages), x AS (SELECT page_id, path, array_length(list_intersect(['en', 'shop', 'item'], list_filter(string_split(path, '/'), lambda s: s <> ''))) AS hits FROM p) SELECT page_id, CAST(CASE WHEN hits >= 2 THEN 0.35 ELSE 0.28 END AS DOUBLE) AS score FROM x WHERE hits >= 1""")
def related_layer(spark, d):
    wanted = F.array(F.lit("en"), F.lit("shop"), F.lit("item"))
    p = model.url_patterns(spark, d).withColumn("hits", F.size(F.array_intersect(wanted, urls.segments(F.col("pattern")))))
    return p.where("hits >= 1").select(F.col("id").alias("page_id"), F.when(F.col("hits") >= 2, 0.35).otherwise(0.28).alias("score"))


@query("SELECT o_orderkey, concat('src/f', o_orderkey % 9, '.ts') AS path, CAST(o_orderkey % 50 AS INTEGER) AS first, CAST(o_orderkey % 50 + 3 AS INTEGER) AS last FROM orders")
def citations(spark, d):
    n = (F.col("o_orderkey") % 50).cast("int")
    answer = F.concat(F.lit("see src/f"), (F.col("o_orderkey") % 9).cast("string"), F.lit(".ts:"), n.cast("string"), F.lit("-"), (n + 3).cast("string"), F.lit(" for it"))
    return t(spark, d, "orders").select("o_orderkey", F.explode(text.citations(answer)).alias("c")).select("o_orderkey", "c.path", "c.first", "c.last")


@query(f"SELECT id, length(content) AS n_chars, sha256(content) AS digest FROM ({FILES}) WHERE path LIKE 'en/%'")
def file_scan(spark, d):
    f = model.files(spark, d).where(F.col("path").like("en/%"))
    return f.select("id", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("digest"))


@query("SELECT method, count(*) AS n FROM (SELECT page_id, " + model.METHOD + " AS method FROM pages) GROUP BY 1 ORDER BY list_position(['GET', 'POST', 'PUT', 'DELETE', 'PATCH'], method) NULLS LAST")
def method_order(spark, d):
    order = F.array_position(F.array(*(F.lit(m) for m in urls.METHODS)), F.col("method"))
    return model.url_patterns(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_last(order))


@query("SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status FROM lineitem WHERE l_returnflag NOT IN ('A') AND l_linenumber IN (1, 2)")
def facet_values(spark, d):
    return t(spark, d, "lineitem").where(~F.col("l_returnflag").isin("A") & F.col("l_linenumber").isin(1, 2)).select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).distinct()


@query(f"WITH s AS (SELECT DISTINCT source, target FROM ({IMPORTS}) WHERE import_type = '1-URGENT'), x AS (SELECT DISTINCT source, target FROM ({IMPORTS}) WHERE symbol = 'P') SELECT * FROM s INTERSECT SELECT * FROM x")
def common_edges(spark, d):
    i = model.imports(spark, d)
    return i.where("import_type = '1-URGENT'").select("source", "target").intersect(i.where("symbol = 'P'").select("source", "target"))
