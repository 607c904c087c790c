"""Strategies and layers of the search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import layers
from tessera.plans.queries_relational import EDGES, IMPORTS
from tessera.plans.queries_urls import LADDER, NORMALIZED
from tessera.sources import model

t = model.table
TARGET = "/shop/item/42"
CONSTANTS = f"SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN '/shop/:kind/${{id}}' WHEN page_id % 7 = 0 THEN '/shop/item/' || page_id WHEN page_id % 5 = 0 THEN '/SHOP/' || page_id || '/42' ELSE {NORMALIZED} END AS value FROM pages"
VALUES = "CASE WHEN id % 3 = 0 THEN '/shop/:kind/$' || '{id}' WHEN id % 7 = 0 THEN '/shop/item/' || id WHEN id % 5 = 0 THEN '/SHOP/' || id || '/42' ELSE normalized_pattern END"


def constants(spark, d):
    return model.url_patterns(spark, d).select("id", F.expr(VALUES).alias("value"))


@query(f"""WITH t AS (SELECT 'shop/item/42' AS w, ['shop', 'item', '42'] AS s), c AS ({CONSTANTS}), p AS (SELECT id, value, regexp_replace(lower(trim(value)), '^/+|/+$', '', 'g') AS v, list_filter(string_split(value, '/'), lambda x: x <> '') AS x FROM c),
r AS (SELECT *, len(x) AS n, CASE WHEN v = w THEN 0 WHEN contains(v, w) THEN 1 WHEN contains(w, v) AND v <> '' THEN 2 ELSE 3 END AS rank, len(list_filter(s, lambda y: contains(v, y))) AS hits FROM p, t),
l AS (SELECT id, 'constant' AS kind, round({LADDER}, 6) AS score FROM (SELECT * FROM r WHERE rank < 3 OR hits > 0 ORDER BY rank, hits DESC, length(value), value, id LIMIT 400)),
m AS (SELECT id, 'template' AS kind, 0.95::DOUBLE AS score FROM (SELECT * FROM r WHERE contains(value, ':') OR contains(value, '{{') ORDER BY id LIMIT 50) WHERE len(x) = 3 AND len(list_filter(list_zip(s, x), lambda y: NOT (lower(y[1]) = lower(y[2]) OR regexp_matches(y[2], '^(:[a-zA-Z_][a-zA-Z0-9_]*|[$]?[{{][^}}]+[}}])$')))) = 0),
f AS (SELECT id, 'constant' AS kind, round(0.7 * sim, 6) AS score FROM (SELECT id, len(list_filter(list_zip(s, x), lambda y: coalesce(lower(y[1]) = lower(y[2]), false))) / greatest(3, len(x)) AS sim FROM (SELECT * FROM r ORDER BY id LIMIT 100)) WHERE sim > 0.6 AND id NOT IN (SELECT id FROM l))
SELECT * FROM l UNION ALL SELECT * FROM m UNION ALL SELECT * FROM f""")
def url_constant_layer(spark, d):
    return layers.constant_layer(constants(spark, d), TARGET)


@query(f"""WITH u AS (SELECT page_id, unnest(h) AS code, CAST(generate_subscripts(h, 1) AS INTEGER) AS usage_line FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
j AS (SELECT u.page_id, usage_line, lower(code) AS c, lower(value) AS v FROM u JOIN ({CONSTANTS}) k ON k.id = u.page_id), x AS (SELECT *, len(list_filter(['shop', 'item', '42'], lambda y: contains(c || chr(10) || v, y))) AS hits, len(list_filter(string_split(v, '/'), lambda y: y <> '')) AS n FROM j)
SELECT page_id AS pattern_id, usage_line, round(CASE WHEN regexp_replace(v, '^/+|/+$', '', 'g') = 'shop/item/42' OR contains(c, 'shop/item/42') THEN 0.98 ELSE 0.8 * (hits / 3) * (3 / greatest(3, n)) END, 6) AS score FROM x""")
def url_usage_layer(spark, d):
    u = model.url_usages(spark, d).select("pattern_id", "usage_line", F.col("href").alias("code"))
    rows = u.join(constants(spark, d).select(F.col("id").alias("pattern_id"), F.col("value").alias("normalized_pattern")), "pattern_id")
    return layers.usage_layer(rows, TARGET).select("pattern_id", "usage_line", "score")


@query(f"""SELECT id, CAST(hits AS INTEGER) AS seg_hits, round(CASE WHEN contains(v, 'shop/item/42') THEN 0.6 ELSE 0.5 * hits / 3 END, 6) AS score FROM (SELECT id, value, lower(value) AS v, len(list_filter(['shop', 'item', '42'], lambda y: contains(lower(value), y))) AS hits FROM ({CONSTANTS})) WHERE hits >= 2 ORDER BY hits DESC, length(value), id LIMIT 10""")
def url_usage_chunks(spark, d):
    return layers.usage_chunks(constants(spark, d), TARGET, column="value").select("id", "seg_hits", "score")


@query(f"""WITH RECURSIVE i AS (SELECT DISTINCT source, target, symbol, import_type FROM ({IMPORTS})), s AS (SELECT unnest([3, 11]) AS file, 'P' AS symbol),
e AS (SELECT source, target FROM i WHERE symbol = 'P' OR import_type = '1-URGENT'), r(root, file, depth) AS (SELECT file, file, 0 FROM s UNION SELECT root, e.source, depth + 1 FROM r JOIN e ON e.target = r.file WHERE depth < 5)
SELECT 'dep:' || file || ':P' AS id, round(0.7 / (min(depth) + 1), 6) AS score, CAST(file AS VARCHAR) AS file_path, 'Imports P from ' || root AS content FROM r GROUP BY root, file HAVING min(depth) > 0 ORDER BY score DESC, id, content LIMIT 150""")
def dependency_strategy(spark, d):
    imports = model.imports(spark, d).select(F.col("source").cast("string").alias("importer"), F.col("target").cast("string").alias("imported"), "symbol", F.when(F.col("import_type") == "1-URGENT", "namespace").otherwise("named").alias("import_type"))
    starts = spark.createDataFrame([("3", "P"), ("11", "P")], "file_path string, symbol string")
    return layers.dependency_results(starts, imports, 150)


@query(f"""WITH e AS (SELECT DISTINCT source, target FROM ({EDGES}) WHERE target IS NOT NULL), f AS (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS id),
x AS (SELECT target AS function, source AS id, 'caller' AS direction, row_number() OVER (PARTITION BY target ORDER BY source) AS rn FROM e WHERE target IN (SELECT id FROM f) UNION ALL SELECT source, target, 'callee', row_number() OVER (PARTITION BY source ORDER BY target) FROM e WHERE source IN (SELECT id FROM f))
SELECT function, id, direction FROM x WHERE rn <= 10 ORDER BY function, direction, id LIMIT 60""")
def graph_strategy(spark, d):
    return layers.graph_results(spark.range(1, 6), model.calls(spark, d), 60)


@query("""WITH res AS (SELECT doc_id AS id, concat_ws('/', lang, source, concat(doc_id, '.txt')) AS file_path, CASE doc_id % 3 WHEN 0 THEN 'constant' WHEN 1 THEN 'function' ELSE 'chunk' END AS type, CAST(doc_id % 7 AS VARCHAR) AS symbol, doc_id % 9 + 1 AS line, text FROM documents WHERE doc_id <= 40),
im AS (SELECT concat_ws('/', lang, source, concat(doc_id, '.txt')) AS file_path, list_slice(list_sort(['lib' || (doc_id % 4), 'lib' || (doc_id % 3)]), 1, 10) AS l FROM documents), rf AS (SELECT CAST(l_orderkey % 11 AS VARCHAR) AS symbol, 'f' || l_suppkey AS path, l_linenumber AS line FROM lineitem),
us AS (SELECT symbol, string_agg(path || ':' || line, ',' ORDER BY path, line) AS usages FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY path, line) AS rn FROM rf) WHERE rn <= 5 GROUP BY 1)
SELECT id, type, array_to_string(list_slice(string_split(text, chr(10)), greatest(line - 5, 1), line + 5), chr(10)) AS context, array_to_string(list_sort(list_distinct(l)), ',') AS imports, CASE WHEN type <> 'chunk' THEN usages END AS usages FROM res JOIN im USING (file_path) LEFT JOIN us USING (symbol)""")
def enriched_results(spark, d):
    files = model.files(spark, d)
    id_ = F.col("id")
    kind = F.when(id_ % 3 == 0, "constant").when(id_ % 3 == 1, "function").otherwise("chunk")
    results = files.where("id <= 40").select("id", kind.alias("type"), F.col("path").alias("file_path"), (id_ % 7).cast("string").alias("symbol"), (id_ % 9 + 1).cast("int").alias("line_start"), (id_ % 9 + 1).cast("int").alias("line_end"))  # a search's results
    imports = files.select(F.col("path").alias("file_path"), F.explode(F.array(F.concat(F.lit("lib"), id_ % 4), F.concat(F.lit("lib"), id_ % 3))).alias("import_path"))
    references = t(spark, d, "lineitem").select((F.col("l_orderkey") % 11).cast("string").alias("symbol"), F.concat(F.lit("f"), "l_suppkey").alias("path"), F.col("l_linenumber").alias("line"))
    got = layers.enriched(results, files, imports, references)
    return got.select("id", "type", "context", F.array_join("imports", ",").alias("imports"), F.array_join(F.transform("usages", lambda u: F.concat(u["path"], F.lit(":"), u["line"])), ",").alias("usages"))


@query("SELECT 'function' AS kind, term FROM (SELECT DISTINCT p_name AS term FROM part ORDER BY 1 LIMIT 500) UNION ALL SELECT 'class', term FROM (SELECT DISTINCT c_name AS term FROM customer ORDER BY 1 LIMIT 500) UNION ALL SELECT 'constant', term FROM (SELECT DISTINCT s_name AS term FROM supplier ORDER BY 1 LIMIT 500)")
def available_terms(spark, d):
    return layers.available_terms({"function": (t(spark, d, "part"), "p_name"), "class": (t(spark, d, "customer"), "c_name"), "constant": (t(spark, d, "supplier"), "s_name")})
