"""The search planner: kind of query, strategies, tables, fusion, filtering, expansion."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions import text
from tessera.operators import layers, search as ops
from tessera.sources import model

#: Columns of a result row.
RESULT = ("id", "type", "strategy", "score", "file_path", "line_start", "line_end", "content")


@dataclass
class Tables:
    """What is searched: entity tables by name, each with id, file_path, name, line_start, line_end, content (and embedding).

    imports: file_path, symbol, target_path (and import_type); calls: source,
    target (ids of functions).  A strategy whose table is missing finds nothing.
    """

    entities: dict[str, DataFrame]
    imports: DataFrame | None = None
    definitions: DataFrame | None = None
    query_vector: Column | None = None
    calls: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Tables:
        c = model.chunks(spark, sf_dir)
        row = c.select(F.concat_ws(":", "file_id", "line_start").alias("id"), F.col("path").alias("file_path"), F.col("symbol_name").alias("name"), "line_start", "line_end", F.col("code_text").alias("content"))
        p = model.url_patterns(spark, sf_dir)
        pats = p.select(F.col("id").cast("string").alias("id"), "file_path", F.col("normalized_pattern").alias("name"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.col("url").alias("content"))
        return cls({"code_chunks": row, "functions": row, "url_patterns": pats, "string_constants": pats})


def analyze(query: str) -> tuple[str, float]:
    """Kind and confidence of one query string; the rules of ``functions.text.intent``."""
    if re.search(r"/(api|rest|v\d+|graphql|endpoint)/|:\w+|/\{|\bhttps?://", query, re.IGNORECASE) or re.search(r"^/[a-z0-9_-]+/[a-z0-9_-]+", query, re.IGNORECASE) or re.search(r"/(get|post|put|delete|patch)\b", query, re.IGNORECASE):
        return "url", 0.9
    if re.search(r"\w+\s*\(|function\s+\w+|=>\s*\{", query):
        return "function", 0.85
    if re.search(r"class\s+\w+|interface\s+\w+|type\s+\w+", query, re.IGNORECASE):
        return "class", 0.85
    return ("constant", 0.8) if re.search(r"^[A-Z_]+$|^E\d+$", query) else ("general", 0.5)


def searched_name(query: str, kind: str) -> str:
    """The name that a query of a kind asks for: a URL's path, the function or class named, else the query."""
    patterns = {"url": r"(?:https?://[^/\s]+)?(/[^\s?#]+)", "function": r"function\s+(\w+)|(\w+)\s*\(", "class": r"(?i:class|interface|type)\s+(\w+)"}
    m = re.search(patterns[kind], query) if kind in patterns else None
    return next((g for g in m.groups() if g), query) if m else query


def strategies(kind: str, confidence: float, wanted: tuple[str, ...]) -> list[str]:
    """Exact search only beyond a confidence of 0.8; dependencies for URLs and functions, the graph for functions."""
    rule = {"exact": confidence > 0.8, "dependency": kind in ("url", "function"), "graph": kind == "function"}
    return [s for s in wanted if rule.get(s, True)]


def _rows(frame: DataFrame, kind: str, strategy: str, score: Column, order: str = "id") -> DataFrame:
    return frame.select(F.col("id").cast("string").alias("id"), F.lit(kind).alias("type"), F.lit(strategy).alias("strategy"), score.alias("score"), "file_path", "line_start", "line_end", "content")


def _imports_of(tables: Tables, matches: DataFrame, limit: int) -> DataFrame:
    """Files that import what was found, as result rows."""
    kind = F.col("import_type") if "import_type" in tables.imports.columns else F.lit("named")
    imports = tables.imports.select(F.col("file_path").alias("importer"), F.col("target_path").alias("imported"), "symbol", kind.alias("import_type"))
    rows = layers.dependency_results(matches.select("file_path", F.col("name").alias("symbol")), imports, limit)
    return _rows(rows.withColumns({"line_start": F.lit(0), "line_end": F.lit(0)}), "chunk", "dependency", F.col("score"))


def search(tables: Tables, query: str, limit: int = 20, threshold: float = 0.5, wanted: tuple[str, ...] = ("vector", "exact", "fuzzy", "dependency", "graph"), follow: bool = False, reranker=None, legacy_weights: bool = False) -> DataFrame:
    """Results, best first: typos corrected, strategies run over the tables of the kind, fused by place, filtered, freed of near duplicates, reranked.

    Every strategy is cut to a top-k before anything is joined, so all steps
    after the scans work on a few rows.
    """
    query = " ".join(text.TYPOS.get(w.lower(), w) for w in query.split())
    kind, confidence = analyze(query)
    names = [n for n in ops.TABLES[kind] if n in tables.entities]
    width = max(limit, 50) if reranker else limit
    found: list[DataFrame] = []
    if kind in ("url", "constant", "function"):
        first = lambda name, n: ops.exact(tables.entities[name], "name", searched_name(query, kind)).orderBy("match_rank", "id").limit(n)
    for strategy in strategies(kind, confidence, wanted):
        if strategy == "dependency" and names and tables.imports is not None:
            found.append(_imports_of(tables, first(names[0], 5), width))
            continue
        if strategy == "graph" and tables.calls is not None and "functions" in tables.entities:
            functions = tables.entities["functions"]
            near = layers.graph_results(first("functions", 5).select("id"), tables.calls, width).select("id").distinct()
            found.append(_rows(functions.join(F.broadcast(near), "id", "left_semi"), "call_graph", strategy, F.lit(0.5)))  # a limit's rows
            continue
        for name in ["code_chunks"] if strategy == "fuzzy" and "code_chunks" in tables.entities else names:
            rows = tables.entities[name]
            if strategy == "vector" and tables.query_vector is not None and "embedding" in rows.columns:
                top = ops.vector_top_k(rows, tables.query_vector, width)
                found.append(_rows(top, name, strategy, ops.row_score(F.col("similarity"), F.lit(None).cast("double"))))
            elif strategy == "exact" and kind in ("url", "constant", "function"):
                found.append(_rows(first(name, width), name, strategy, F.lit(0.5)))
            elif strategy == "fuzzy" and name == "code_chunks":
                top = ops.trigram_top_k(rows, "content", query, width, threshold=0.1)
                found.append(_rows(top, name, strategy, ops.row_score(F.col("similarity"), F.lit(None).cast("double"))))
    if not found:
        frame = next(iter(tables.entities.values()))
        return _rows(frame.limit(0), "", "", F.lit(0.0)).drop("strategy")
    results = found[0]
    for more in found[1:]:
        results = results.unionByName(more)
    results = results.withColumn("arrival", F.struct("strategy", F.col("score") * -1, "type", "id"))
    results = results.withColumn("weighted", F.col("score") * ops.strategy_weight(F.col("strategy"), kind, confidence, legacy_weights))
    fused = ops.fuse(results, keep=("id", "type", "line_end", "content")).where(F.col("score") >= threshold * min(1.0, 0.4 if kind == "general" else 1.0))
    top = fused.orderBy(F.desc("score"), "arrival").limit(width).select("id", "type", "score", "file_path", "line_start", "line_end", "content")
    kept = ops.near_duplicates_removed(top)
    if reranker:
        kept = ops.rerank(kept, query, reranker).orderBy(F.desc("rerank_score"), F.desc("score"), "id").drop("rerank_score")
    if follow and tables.imports is not None and tables.definitions is not None:
        more = ops.expanded(ops.anchors(kept), tables.imports, tables.definitions, limit)
        kept = kept.unionByName(more.select(F.concat_ws(":", "file_path", "symbol").alias("id"), F.lit("dependency").alias("type"), "score", "file_path", "line_start", F.col("line_start").alias("line_end"), F.col("symbol").alias("content")))
    return kept.orderBy(F.desc("score"), "file_path", "line_start").limit(limit)


def suggestions(query: str, terms: DataFrame) -> DataFrame:
    """kind, suggestion: the corrected query, similar known terms, and the query's keywords, where they differ from it."""
    spark = terms.sparkSession
    fixed = " ".join(text.TYPOS.get(w.lower(), w) for w in query.split())
    rows = [("typo", fixed)] if fixed != query else []
    words = [w.lower() for w in re.split(r"[_\-\s]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query)) if w]
    keywords = list(dict.fromkeys(words))
    if len(keywords) > 1 and " ".join(keywords) != query:
        rows.append(("keyword", " ".join(keywords)))
    similar = ops.similar_terms(terms, spark.createDataFrame([(w,) for w in query.split()] or [("",)], "word string"))
    return spark.createDataFrame(rows, "kind string, suggestion string").union(similar.select(F.lit("similar"), "term"))
