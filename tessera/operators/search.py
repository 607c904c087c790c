"""Search strategies, fusion and near-duplicate removal."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import text

#: Weight of a strategy's score, by strategy and kind of query.
WEIGHTS = {"vector": {"general": 1.0, "": 0.8}, "exact": {"confident": 1.2, "": 0.9}, "fuzzy": {"": 0.7}, "dependency": {"url": 1.1, "": 0.8}, "graph": {"function": 1.1, "": 0.8}}
#: Tables that a kind of query looks into.
TABLES = {"url": ("url_patterns", "string_constants"), "constant": ("string_constants",), "function": ("functions",), "class": ("classes",), "general": ("code_chunks", "functions", "classes", "string_constants")}


def vector_top_k(rows: DataFrame, query: Column, k: int, vector: str = "embedding") -> DataFrame:
    """The k rows most similar to a vector, with their similarity; ties by the first column."""
    return rows.where(F.col(vector).isNotNull()).withColumn("similarity", F.round(text.cosine(F.col(vector), query), 6)).orderBy(F.desc_nulls_last("similarity"), rows.columns[0]).limit(k)


def trigram_top_k(rows: DataFrame, column: str, query: str, k: int, threshold: float = 0.3) -> DataFrame:
    """The k rows whose text is most similar by trigrams, at or over the threshold."""
    wanted = text.trigrams(F.lit(query))
    scored = rows.withColumn("similarity", F.round(text.trigram_similarity(text.trigrams(F.col(column)), wanted), 6))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), rows.columns[0]).limit(k)


def exact(rows: DataFrame, name: str, query: str, other: str | None = None) -> DataFrame:
    """Rows whose name (or other column) contains the query, whatever the case; equal names first, then equal others."""
    contains = F.lower(F.col(name)).contains(query.lower())
    rank = F.when(F.col(name) == query, 1)
    if other:
        contains |= F.lower(F.col(other)).contains(query.lower())
        rank = rank.when(F.col(other) == query, 2)
    return rows.where(contains).withColumn("match_rank", rank.otherwise(3))


def row_score(similarity: Column, other: Column) -> Column:
    """The first score that is neither missing nor 0, else a half."""
    return F.coalesce(F.nullif(similarity, F.lit(0.0)), F.nullif(other, F.lit(0.0)), F.lit(0.5))


def strategy_weight(strategy: Column, kind: str, confidence: float, legacy_weights: bool = False) -> Column:
    """Weight of a strategy for a kind of query; legacy_weights: dependency rows count 1."""
    out = F.lit(1.0)
    for name, by_kind in WEIGHTS.items():
        key = "confident" if name == "exact" and confidence > 0.8 else kind
        value = 1.0 if name == "dependency" and legacy_weights else by_kind.get(key, by_kind[""])
        out = F.when(strategy == name, value).otherwise(out)
    return out


def fuse(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """file_path, line_start, score, arrival of each place found: weights in order of arrival, each later one the larger of both and 0.1 more.

    results: file_path, line_start, arrival, weighted.  The fold is by order,
    so it runs over the sorted scores of a place, not over a maximum.
    """
    scores = F.transform(F.array_sort(F.collect_list(F.struct("arrival", "weighted"))), lambda x: x["weighted"])
    first = [F.min_by(c, "arrival").alias(c) for c in keep]
    got = results.groupBy("file_path", "line_start").agg(scores.alias("_s"), F.min("arrival").alias("arrival"), *first)
    fold = F.aggregate(F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), F.get("_s", F.lit(0)), lambda s, w: F.greatest(s, w) + 0.1)
    return got.select("file_path", "line_start", F.round(fold, 6).alias("score"), "arrival", *keep)


def near_duplicates_removed(results: DataFrame, threshold: float = 0.85, overlap: bool = True) -> DataFrame:
    """Best rows first, each kept unless a kept one has its id, overlaps its lines in its file or has almost its text.

    results: id, score, file_path, line_start, line_end, content.  This runs on
    a search's result list, whose length its limit bounds, so one task may
    hold it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        kept: list[dict] = []
        for r in pdf.to_dict("records"):
            plain = _plain(r["content"])
            for k in kept:
                same = k["id"] == r["id"] or (overlap and k["file_path"] == r["file_path"] and k["line_start"] <= r["line_end"] and r["line_start"] <= k["line_end"])
                if same or _ratio(k["_plain"], plain) >= threshold:
                    break
            else:
                kept.append(r | {"_plain": plain})
        return pd.DataFrame(kept, columns=[*pdf.columns, "_plain"])[list(pdf.columns)]

    return results.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda _, pdf: run(pdf), results.schema)


def clusters_merged(results: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Per file: the best row of each cluster of almost equal texts, with the cluster's mean score."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list[dict]] = []
        for r in pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").to_dict("records"):
            for c in clusters:
                if _ratio(_plain(c[0]["content"]), _plain(r["content"])) >= threshold:
                    c.append(r)
                    break
            else:
                clusters.append([r])
        return pd.DataFrame([c[0] | {"score": sum(x["score"] for x in c) / len(c)} for c in clusters], columns=pdf.columns)

    return results.groupBy("file_path").applyInPandas(run, results.schema)


def _plain(code: str | None) -> str:
    import re

    out = re.sub(r"/\*.*?\*/", "", code or "", flags=re.DOTALL)
    return re.sub(r"\s+", " ", re.sub(r"//[^\n]*", "", out)).strip()


def _ratio(a: str, b: str) -> float:
    """1 less the edit distance over the longer length."""
    most = max(len(a), len(b))
    if not most:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / most


def rerank(results: DataFrame, query: str, scorer: Callable[[str, pd.Series], pd.Series] | None = None, content: str = "content") -> DataFrame:
    """Adds rerank_score by a scorer of (query, texts); the default counts the share of query words that a text has."""
    scorer = scorer or lexical_overlap

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return scorer(query, texts)

    return results.withColumn("rerank_score", score(F.col(content)))


def lexical_overlap(query: str, texts: pd.Series) -> pd.Series:
    import re

    words = lambda x: set(re.findall(r"[a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", x or "").lower()))
    wanted = words(query)
    return texts.map(lambda x: len(wanted & words(x)) / max(1, len(wanted)))


def similar_terms(terms: DataFrame, words: DataFrame, threshold: float = 0.7, top: int = 3) -> DataFrame:
    """word, term, similarity: the most similar known terms of each searched word of three signs or more, others than itself."""
    words = words.where(F.length("word") >= 3)
    ratio = text.similarity_ratio(F.lower("word"), F.lower("term"))
    # lengths that differ too much cannot reach the threshold: that bounds the pairs compared by edit distance
    close = F.least(F.length("word"), F.length("term")) >= threshold * F.greatest(F.length("word"), F.length("term"))
    pairs = terms.join(F.broadcast(words), close).withColumn("similarity", F.round(ratio, 6)).where((F.col("similarity") >= threshold) & (F.lower("word") != F.lower("term")))
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("similarity"), "term"))
    return pairs.withColumn("_rn", rank).where(F.col("_rn") <= top).select("word", "term", "similarity")


def keyword_and_semantic(keyword: DataFrame, semantic: DataFrame, limit: int = 20) -> DataFrame:
    """id, score, position: a row stands where its id came first and has the values that came last.

    Both: id, score, ord.
    """
    both = keyword.select("id", "score", F.col("ord").alias("arrival")).union(semantic.select("id", "score", F.col("ord") + 1_000_000))
    return both.groupBy("id").agg(F.min("arrival").alias("position"), F.max_by("score", "arrival").alias("score")).orderBy("position").limit(limit)


def best_per_place(results: DataFrame) -> DataFrame:
    """The best row of each (file_path, line_start); the first to arrive of equal ones."""
    order = Window.partitionBy("file_path", "line_start").orderBy(F.desc("score"), "arrival")
    return results.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def anchors(results: DataFrame, most: int = 8) -> DataFrame:
    """The best row of each file, of at most so many files."""
    order = Window.partitionBy("file_path").orderBy(F.desc("score"), "line_start")
    return results.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn").orderBy(F.desc("score"), "file_path").limit(most)


def expanded(anchor_rows: DataFrame, imports: DataFrame, definitions: DataFrame, limit: int, discount: float = 0.6, per_file: int = 12) -> DataFrame:
    """Definitions of what the anchors' files import, at a discount of the anchor's score, 0.01 at least; max(2, min(6, 40 % of the limit)) rows.

    anchor_rows: file_path, score; imports: file_path, symbol, target_path; definitions: file_path, symbol, line_start.
    """
    order = Window.partitionBy("file_path").orderBy("symbol", "target_path")
    edges = imports.join(anchor_rows.select("file_path", F.col("score").alias("_s")), "file_path").withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_file)
    got = edges.select(F.col("target_path").alias("file_path"), "symbol", "_s").join(definitions, ["file_path", "symbol"])
    got = got.groupBy("file_path", "symbol", "line_start").agg(F.round(F.greatest(F.max("_s") * discount, F.lit(0.01)), 6).alias("score"))
    return got.orderBy(F.desc("score"), "file_path", "symbol").limit(max(2, min(6, -(-limit * 2 // 5))))


def confidence(evidence: DataFrame, by: str) -> DataFrame:
    """Per answer: 0.7 x mean of the first five scores (0 to 1) + 0.3 x share of five rows, rounded to hundredths; scores that are no numbers do not count.

    evidence: ``by``, ord, score.
    """
    clean = evidence.where(~F.isnan("score") & (F.abs("score") < float("inf")))
    ranked = clean.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy("ord")))
    got = ranked.groupBy(by).agg(F.avg(F.when(F.col("_rn") <= 5, text.clamp01(F.col("score")))).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return got.select(by, text.round2(F.col("_m") * 0.7 + F.least(F.col("_n") / 5, F.lit(1.0)) * 0.3).alias("confidence"))


def sufficiency(evidence: DataFrame, by: str) -> DataFrame:
    """Per answer: 0.45 x share of three rows + 0.25 x share of two files + 0.3 x mean of the three best scores, rounded to hundredths."""
    ranked = evidence.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"))))
    got = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("file_path").alias("_f"), F.avg(F.when(F.col("_rn") <= 3, text.clamp01(F.col("score")))).alias("_t"))
    return got.select(by, text.round2(0.45 * F.least(F.col("_n") / 3, F.lit(1.0)) + 0.25 * F.least(F.col("_f") / 2, F.lit(1.0)) + 0.3 * F.col("_t")).alias("sufficiency"))


def named_symbols(definitions: DataFrame, names: list[str]) -> DataFrame:
    """Definitions (symbol, path, line_start, …) of the names, as they are or in other case, ordered by symbol and place."""
    return definitions.where(F.col("symbol").isin(names) | F.lower("symbol").isin([x.lower() for x in names])).orderBy("symbol", "path", "line_start")


def symbol_candidates(definitions: DataFrame, name: str) -> DataFrame:
    """All definitions of exactly this name by place; nothing is picked."""
    return definitions.where(F.col("symbol") == name).orderBy("path", "line_start")


def dictionary(terms: DataFrame, column: str) -> DataFrame:
    """term: the distinct keywords of three signs or more."""
    return terms.select(F.explode(text.keywords(F.col(column))).alias("term")).where(F.length("term") >= 3).distinct()


def is_templated(value: Column) -> Column:
    """Whether a text holds a placeholder's sign."""
    return value.like("%${%") | value.like("%:%") | value.like("%{%")
