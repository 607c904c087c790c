"""Search strategies and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text
from tessera.operators import search
from tessera.sources import model

t = model.table


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 20")
def vector_search(spark, d):
    e = t(spark, d, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("_q"))
    return search.vector_top_k(e.join(F.broadcast(first)), F.col("_q"), 20).select("vec_id", "label", "similarity")  # one query row


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT *, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q)
SELECT label, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) <= 3""")
def vector_search_by_table(spark, d):
    from pyspark.sql import Window

    e = t(spark, d, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("_q"))
    s = e.join(F.broadcast(first)).select("label", "vec_id", F.round(text.cosine(F.col("embedding"), F.col("_q")), 6).alias("similarity"))
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id"))).where("rn <= 3").drop("rn")


RESULTS = "SELECT CAST(l_orderkey AS VARCHAR) AS file_path, l_linenumber % 3 AS line_start, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_returnflag) AS arrival, CASE l_returnflag WHEN 'A' THEN 'vector' WHEN 'N' THEN 'exact' ELSE 'fuzzy' END AS strategy, l_discount * 5 AS score FROM lineitem"


@query(f"""WITH r AS (SELECT file_path, line_start, arrival, score * CASE strategy WHEN 'vector' THEN 1.0 WHEN 'exact' THEN 0.9 ELSE 0.7 END AS w FROM ({RESULTS})), l AS (SELECT file_path, line_start, list(w ORDER BY arrival) AS s FROM r GROUP BY 1, 2)
SELECT file_path, line_start, round(list_reduce(s, lambda a, b: greatest(a, b) + 0.1), 6) AS score FROM l""")
def fused_scores(spark, d):
    from pyspark.sql import Window

    li = t(spark, d, "lineitem")
    r = li.select(F.col("l_orderkey").cast("string").alias("file_path"), (F.col("l_linenumber") % 3).alias("line_start"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag").alias("arrival"), F.when(F.col("l_returnflag") == "A", "vector").when(F.col("l_returnflag") == "N", "exact").otherwise("fuzzy").alias("strategy"), (F.col("l_discount") * 5).alias("score"))
    r = r.withColumn("weighted", F.col("score") * search.strategy_weight(F.col("strategy"), "general", 0.5))
    return search.fuse(r).select("file_path", "line_start", "score")


@query(f"SELECT file_path, line_start, arg_min(strategy, (-score, arrival)) AS strategy, round(max(score), 6) AS score FROM ({RESULTS}) GROUP BY 1, 2")
def best_per_place(spark, d):
    li = t(spark, d, "lineitem")
    r = li.select(F.col("l_orderkey").cast("string").alias("file_path"), (F.col("l_linenumber") % 3).alias("line_start"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag").alias("arrival"), F.when(F.col("l_returnflag") == "A", "vector").when(F.col("l_returnflag") == "N", "exact").otherwise("fuzzy").alias("strategy"), (F.col("l_discount") * 5).alias("score"))
    return search.best_per_place(r).select("file_path", "line_start", "strategy", F.round("score", 6).alias("score"))


@query("""WITH w AS (SELECT unnest(['part', 'brandd', 'promo']) AS word), tm AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS term FROM part UNION SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) FROM part),
p AS (SELECT word, term, round(1 - levenshtein(word, term) / greatest(length(word), length(term)), 6) AS similarity FROM w, tm WHERE word <> term AND length(word) >= 3) SELECT word, term, similarity FROM p WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY word ORDER BY similarity DESC, term) <= 3""")
def similar_terms(spark, d):
    p = t(spark, d, "part")
    terms = p.select(F.explode(F.split(F.lower("p_type"), " ")).alias("term")).union(p.select(F.explode(F.split(F.lower("p_name"), " ")))).distinct()
    return search.similar_terms(terms, spark.createDataFrame([("part",), ("brandd",), ("promo",)], "word string"), 0.5)


@query("SELECT vec_id, round(coalesce(nullif(CASE WHEN vec_id % 3 = 0 THEN 0.0 WHEN vec_id % 3 = 1 THEN vec_id / 1000 END, 0), nullif(CASE WHEN vec_id % 2 = 0 THEN 0.25 END, 0), 0.5), 6) AS score FROM embeddings")
def row_scores(spark, d):
    v = F.col("vec_id")
    return t(spark, d, "embeddings").select("vec_id", F.round(search.row_score(F.when(v % 3 == 0, 0.0).when(v % 3 == 1, v / 1000), F.when(v % 2 == 0, 0.25)), 6).alias("score"))


@query("""WITH a AS (SELECT concat('f', doc_id) AS file_path, CAST(1.0 / (1 + doc_id) AS DOUBLE) AS score FROM documents ORDER BY score DESC, file_path LIMIT 8), e AS (SELECT concat('f', o_custkey % 50) AS file_path, o_orderpriority AS symbol, concat('g', o_orderkey % 30) AS target_path FROM orders),
i AS (SELECT e.*, a.score AS s, row_number() OVER (PARTITION BY e.file_path ORDER BY symbol, target_path) AS rn FROM e JOIN a USING (file_path)), df AS (SELECT DISTINCT concat('g', l_orderkey % 30) AS file_path, o_orderpriority AS symbol FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT df.file_path, df.symbol, round(greatest(max(s) * 0.6, 0.01), 6) AS score FROM i JOIN df ON df.file_path = i.target_path AND df.symbol = i.symbol WHERE rn <= 12 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 6""")
def dependency_expansion(spark, d):
    found = t(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), (1.0 / (1 + F.col("doc_id"))).alias("score"), F.lit(1).alias("line_start"))
    o = t(spark, d, "orders")
    named = lambda letter, key, n: F.concat(F.lit(letter), (F.col(key) % n).cast("string"))
    imports = o.select(named("f", "o_custkey", 50).alias("file_path"), F.col("o_orderpriority").alias("symbol"), named("g", "o_orderkey", 30).alias("target_path"))
    definitions = t(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(named("g", "l_orderkey", 30).alias("file_path"), F.col("o_orderpriority").alias("symbol")).distinct().withColumn("line_start", F.lit(1))
    return search.expanded(search.anchors(found), imports, definitions, 20).select("file_path", "symbol", "score")


def hybrid_search(spark, d):
    """The whole search pipeline over chunks (its result depends on trigram and greedy steps: rows only)."""
    from tessera.plans import planner

    return planner.search(planner.Tables.of(spark, d), "thing reaor the thoned", limit=10, threshold=0.1)


query()(hybrid_search)
