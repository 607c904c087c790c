"""Graph queries over the sparse call edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import graph
from tessera.plans.queries_relational import EDGES, IMPORTS
from tessera.sources import model

E = f"e AS (SELECT DISTINCT source, target FROM ({EDGES}) WHERE target IS NOT NULL)"


def _closure_sql(start: str, depth: int, edge: str, source: str = "source", target: str = "target") -> str:
    """Least depth of each node reached; set semantics (UNION) keep the recursion small."""
    return f"WITH RECURSIVE {edge}, r(node, depth) AS ({start} UNION SELECT e.{target}, depth + 1 FROM r JOIN e ON e.{source} = r.node WHERE depth < {depth}) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node HAVING min(depth) > 0"


@query(_closure_sql("SELECT 1::BIGINT, 0", 3, E))
def impact_closure(spark, d):
    start = spark.createDataFrame([(1,)], "node long")
    return graph.closure(model.calls(spark, d), start, 3).select("node", "depth")


@query(_closure_sql("SELECT c::BIGINT, 0 FROM (SELECT unnest(range(1, 6)) AS c)", 3, E, "target", "source"))
def dependents_closure(spark, d):
    e = model.calls(spark, d).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return graph.closure(e, spark.range(1, 6).withColumnRenamed("id", "node"), 3).select("node", "depth")


@query(f"SELECT depth, count(*) AS n_nodes, array_to_string(list_sort(list(node)), ',') AS nodes FROM ({_closure_sql('SELECT 1::BIGINT, 0', 3, E)}) GROUP BY depth")
def closure_by_depth(spark, d):
    got = graph.by_depth(graph.closure(model.calls(spark, d), spark.createDataFrame([(1,)], "node long"), 3))
    return got.withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ","))


@query(f"SELECT least(count(*), 500) AS total, count(*) > 500 AS truncated, CAST(max(depth) AS INTEGER) AS deepest FROM ({_closure_sql('SELECT 1::BIGINT, 0', 3, E, 'target', 'source')})")
def impact_summary(spark, d):
    _, summary = graph.impact(model.calls(spark, d), 1, 3)
    return summary


@query(f"""WITH RECURSIVE {E}, r(node, path) AS (SELECT target, [source, target] FROM e WHERE source = 1 UNION ALL SELECT e.target, list_append(path, e.target) FROM r JOIN e ON e.source = r.node WHERE len(path) < 5 AND NOT list_contains(path, e.target))
SELECT array_to_string(arg_min(path, (len(path), path)), ',') AS path, min(len(path)) AS n FROM r WHERE node = (SELECT max(node) FROM r WHERE len(path) <= 4) HAVING count(*) > 0""")
def shortest_path(spark, d):
    edges = model.calls(spark, d)
    reached = graph.closure(edges, spark.createDataFrame([(1,)], "node long"), 3)
    far = reached.agg(F.max("node").alias("node"))
    path = graph.closure(edges, spark.createDataFrame([(1,)], "node long"), 4).join(F.broadcast(far), "node")  # one row
    return path.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), F.size("path").cast("long").alias("n"))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM ({IMPORTS}) WHERE source <> target), r(a, b) AS (SELECT source, target FROM e UNION SELECT r.a, e.target FROM r JOIN e ON e.source = r.b),
m AS (SELECT x.a AS node, min(x.b) AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1) SELECT node, least(node, other) AS cycle FROM m""")
def cycle_members(spark, d):
    return graph.cycle_members(model.imports(spark, d).where("source <> target"))


@query(f"""WITH {E}, l0 AS (SELECT CAST(c AS BIGINT) AS node FROM (SELECT unnest(range(1, 4)) AS c)), l1 AS (SELECT concat(l0.node, '/', e.target) AS key, CAST(l0.node AS VARCHAR) AS parent_key, e.target AS node, 1 AS depth, e.target = l0.node AS cycle, l0.node AS a FROM l0 JOIN e ON e.source = l0.node),
l2 AS (SELECT concat(l1.key, '/', e.target) AS key, l1.key AS parent_key, e.target AS node, 2 AS depth, e.target IN (l1.a, l1.node) AS cycle FROM l1 JOIN e ON e.source = l1.node WHERE NOT l1.cycle),
x AS (SELECT CAST(node AS VARCHAR) AS key, NULL AS parent_key, node, 0 AS depth, false AS cycle FROM l0 UNION ALL SELECT key, parent_key, node, depth, cycle FROM l1 UNION ALL SELECT * FROM l2) SELECT * FROM x ORDER BY depth, key LIMIT 300""")
def call_tree(spark, d):
    return graph.call_tree(model.calls(spark, d), spark.range(1, 4).withColumnRenamed("id", "node"), 2)


@query(f"""WITH c AS (SELECT *, row_number() OVER () AS id FROM ({EDGES})), f AS (SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS name FROM customer)
SELECT f.id, count(DISTINCT c1.id) AS calls_to, count(DISTINCT c2.id) AS called_by FROM f LEFT JOIN c c1 ON c1.source = f.id LEFT JOIN c c2 ON c2.symbol = f.name GROUP BY f.id""")
def functions_with_calls(spark, d):
    functions = model.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("name"))
    return graph.functions_with_calls(functions, model.calls(spark, d))


@query(f"SELECT call_type, count(*) AS edges, count(*) FILTER (WHERE target IS NULL) AS unresolved, count(DISTINCT source) AS callers FROM ({EDGES}) GROUP BY 1")
def graph_state(spark, d):
    return model.calls(spark, d).groupBy("call_type").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("target").isNull()).alias("unresolved"), F.count_distinct("source").alias("callers"))
