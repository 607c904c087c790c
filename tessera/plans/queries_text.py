"""Scalar text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text, urls
from tessera.sources import model

t = model.table
TRIGRAM = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring(concat('  ', w, ' '), i, 3)))))"


@query("WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part) SELECT p_partkey, CAST(levenshtein(a, b) AS INTEGER) AS distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS ratio FROM p WHERE b IS NOT NULL")
def edit_distances(spark, d):
    p = t(spark, d, "part")
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(following, "p_partkey").select("p_partkey", F.levenshtein("p_name", "b").alias("distance"), F.round(text.similarity_ratio(F.col("p_name"), F.col("b")), 6).alias("ratio"))


@query(f"WITH q AS (SELECT {TRIGRAM.format(chr(39) + 'red widgets' + chr(39))} AS q), p AS (SELECT p_partkey, {TRIGRAM.format('p_name')} AS x FROM part), s AS (SELECT p_partkey, round(len(list_intersect(x, q)) / (len(x) + len(q) - len(list_intersect(x, q))), 6) AS similarity FROM p, q) SELECT p_partkey, similarity FROM s WHERE similarity >= 0.3 ORDER BY similarity DESC, p_partkey LIMIT 20")
def trigram_search(spark, d):
    from tessera.operators import search

    return search.trigram_top_k(t(spark, d, "part"), "p_name", "red widgets", 20).select("p_partkey", "similarity")


@query("SELECT doc_id, array_to_string(list_filter(list_distinct(string_split_regex(lower(regexp_replace(source, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[_\\-\\s]+')), lambda w: w <> ''), ' ') AS words FROM documents")
def keyword_split(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(text.keywords(F.col("source")), " ").alias("words"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 12), chr(10)) AS context FROM documents")
def context_windows(spark, d):
    return t(spark, d, "documents").select("doc_id", text.context_lines(F.col("text"), F.lit(7), F.lit(7)).alias("context"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g'), '//[^\\n]*', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents")
def normalized_code(spark, d):
    return t(spark, d, "documents").select("doc_id", text.normalize_code(F.col("text")).alias("plain"))


@query("SELECT event_id, round(floor(least(greatest(value / 100, 0), 1) * 100 + 0.5) / 100, 2) AS score FROM events")
def clamped_scores(spark, d):
    return t(spark, d, "events").select("event_id", F.round(text.round2(text.clamp01(F.col("value") / 100)), 2).alias("score"))


@query("SELECT c_custkey, nullif(substring(trim(c_mktsegment), 1, 128), '') AS session_id, regexp_replace(concat('https://user:', c_custkey, '@host/', c_name), '://[^/@]+@', '://***@') AS safe, lower(regexp_replace(concat('https://host/group/', c_name, '.git'), '^.*/(.*)\\.git$', '\\1')) AS repo FROM customer")
def identifiers(spark, d):
    c = t(spark, d, "customer")
    url = F.concat(F.lit("https://user:"), F.col("c_custkey").cast("string"), F.lit("@host/"), F.col("c_name"))
    return c.select("c_custkey", text.session_id(F.col("c_mktsegment")).alias("session_id"), urls.redact_credentials(url).alias("safe"), urls.repository_name(F.concat(F.lit("https://host/group/"), F.col("c_name"), F.lit(".git"))).alias("repo"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_columns(spark, d):
    return t(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))
