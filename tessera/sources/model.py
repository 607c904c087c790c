"""The engine's tables as views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, repo_id, path, language, content."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("repo_id"), path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, repo_id, path, symbol_name, line_start, line_end, code_text: one chunk a line."""
    f = files(spark, sf_dir).select("id", "repo_id", "path", F.posexplode(F.split("content", "\n")).alias("p", "code_text"))
    return f.select(F.col("id").alias("file_id"), "repo_id", "path", F.regexp_extract("code_text", r"^\W*(\w+)", 1).alias("symbol_name"), (F.col("p") + 1).alias("line_start"), (F.col("p") + 1).alias("line_end"), "code_text")


METHOD = "CASE page_id % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' END"


def url_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, method, url, pattern, normalized_pattern, file_path."""
    p = table(spark, sf_dir, "pages")
    path = urls.path_of(F.col("url"))
    return p.select(F.col("page_id").alias("id"), F.expr(METHOD).alias("method"), "url", path.alias("pattern"), urls.normalize_url_pattern(path).alias("normalized_pattern"), F.concat(F.lit("src/file"), (F.col("page_id") % 17).cast("string"), F.lit(".ts")).alias("file_path"))


def url_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pattern_id, usage_line, href, file_path: links in page text."""
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("i", "href"))
    return links.select(F.col("page_id").alias("pattern_id"), (F.col("i") + 1).alias("usage_line"), "href", F.concat(F.lit("src/file"), (F.col("page_id") % 17).cast("string"), F.lit(".ts")).alias("file_path"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target (null: unresolved), symbol, call_type, call_line: call edges, one for each order."""
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    o = o.join(F.broadcast(n))  # one row: the number of nodes
    to = F.col("o_orderkey") % F.col("n")
    return o.select(F.col("o_custkey").alias("source"), F.when(F.col("o_orderstatus") != "P", to).alias("target"), to.cast("string").alias("symbol"), F.col("o_orderstatus").alias("call_type"), (F.col("o_orderkey") % 500).alias("call_line"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, symbol, import_type, line: file imports."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 97).alias("source"), (F.col("o_orderkey") % 97).alias("target"), F.col("o_orderstatus").alias("symbol"), F.col("o_orderpriority").alias("import_type"), (F.col("o_orderkey") % 50).alias("line"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, name, line_start, line_end: code spans of a file."""
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber").cast("long") * 10
    return li.select(F.col("l_orderkey").alias("file_id"), F.col("l_partkey").alias("name"), start.alias("line_start"), (start + F.floor("l_quantity")).alias("line_end"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, id, role, answer."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("answer"))
