"""Strategies over relations, layers of the URL search, and the context of results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import text, urls
from tessera.operators import search, urls as url_ops
from tessera.operators.evidence import unseen
from tessera.sources import lineage


def importers_of(imports: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """root, file, symbol, depth, import_type: files that import a start's symbol directly or through others, each once for a start.

    imports: importer, imported, symbol, import_type; starts: file, symbol (a
    few rows).  A namespace import takes every symbol.  All starts go level by
    level together: two equi-joins and an anti-join a level.
    """
    frontier = seen = starts.select(F.concat_ws("#", "file", "symbol").alias("root"), "file", "symbol", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("import_type")).distinct()
    imports = imports.select("importer", "imported", F.col("symbol").alias("_symbol"), "import_type")
    for d in range(1, depth + 1):
        near = frontier.select("root", F.col("file").alias("imported"), "symbol")
        named = imports.join(near.withColumn("_symbol", F.col("symbol")), ["imported", "_symbol"])
        whole = imports.where("import_type = 'namespace'").join(near, "imported")
        columns = ["root", F.col("importer").alias("file"), "symbol", "import_type"]
        step = named.select(*columns).union(whole.select(*columns)).groupBy("root", "file").agg(F.min(F.struct("symbol", "import_type")).alias("_m"))
        step = step.select("root", "file", "_m.symbol", F.lit(d).alias("depth"), "_m.import_type").join(seen.select("root", "file"), ["root", "file"], "left_anti")
        frontier = lineage.cut(step.select(*seen.columns))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def dependency_results(matches: DataFrame, imports: DataFrame, limit: int) -> DataFrame:
    """id, score, file_path, content: files that import what was found; 0.7 over the depth plus one.

    matches: file_path, symbol (the first few exact matches).
    """
    found = importers_of(imports, matches.select(F.col("file_path").alias("file"), "symbol"))
    origin = F.substring_index("root", "#", 1)
    rows = found.select(F.concat_ws(":", F.lit("dep"), "file", "symbol").alias("id"), F.round(F.lit(0.7) / (F.col("depth") + 1), 6).alias("score"), F.col("file").alias("file_path"), F.concat(F.lit("Imports "), F.col("symbol"), F.lit(" from "), origin).alias("content"))
    return rows.orderBy(F.desc("score"), "id", "content").limit(limit)


def graph_results(functions: DataFrame, calls: DataFrame, limit: int, most: int = 10) -> DataFrame:
    """id, direction: up to ``most`` callers and callees of each of a few functions.

    functions: id; calls: source, target.
    """
    parts = []
    for own, other, direction in (("target", "source", "caller"), ("source", "target", "callee")):
        edges = calls.where(F.col(other).isNotNull()).join(F.broadcast(functions.select(F.col("id").alias(own))), own)  # a few rows
        order = Window.partitionBy(own).orderBy(other)
        near = edges.select(own, other).distinct().withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most)
        parts.append(near.select(F.col(own).alias("function"), F.col(other).alias("id"), F.lit(direction).alias("direction")))
    return parts[0].union(parts[1]).orderBy("function", "direction", "id").limit(limit)


def enriched(results: DataFrame, files: DataFrame, imports: DataFrame, references: DataFrame, around: int = 5) -> DataFrame:
    """Results with context (lines around), imports (up to 10 paths) and usages (up to 5 places, for constants and functions).

    results: id, type, file_path, symbol, line_start, line_end (a limit's
    rows); files: path, content; imports: file_path, import_path; references:
    symbol, path, line.
    """
    few = results.select("file_path").distinct()
    order = Window.partitionBy("file_path").orderBy("import_path")
    paths = imports.join(F.broadcast(few), "file_path").select("file_path", "import_path").distinct().withColumn("_rn", F.row_number().over(order)).where("_rn <= 10")
    paths = paths.groupBy("file_path").agg(F.array_sort(F.collect_list("import_path")).alias("imports"))
    wanted = results.where(F.col("type").isin("constant", "function")).select("symbol").distinct()
    places = references.join(F.broadcast(wanted), "symbol").withColumn("_rn", F.row_number().over(Window.partitionBy("symbol").orderBy("path", "line"))).where("_rn <= 5")
    places = places.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("usages"))
    out = results.join(files.select(F.col("path").alias("file_path"), F.col("content").alias("_content")), "file_path", "left")
    out = out.withColumn("context", text.context_lines(F.col("_content"), F.col("line_start"), F.col("line_end"), around)).drop("_content")
    out = out.join(paths, "file_path", "left").join(places, "symbol", "left")
    return out.withColumn("usages", F.when(F.col("type").isin("constant", "function"), F.col("usages")))


def available_terms(tables: dict[str, tuple[DataFrame, str]], most: int = 500) -> DataFrame:
    """kind, term: the distinct names of each table (frame, column), up to so many."""
    parts = [frame.select(F.lit(kind).alias("kind"), F.col(column).alias("term")).where("term IS NOT NULL").distinct().orderBy("term").limit(most) for kind, (frame, column) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def constant_layer(constants: DataFrame, target: str, templates: int = 50, similar: int = 100) -> DataFrame:
    """id, kind, score: constants by the ladder of exactness, templates that match (0.95), and similar URLs (0.7 of a similarity over 0.6) that the ladder lacks.

    constants: id, value.  Templates and similar URLs come from the first so many by id.
    """
    ladder = url_ops.ranked_candidates(constants, "value", target).select("id", F.lit("constant").alias("kind"), F.round(url_ops.ladder_score(F.col("value"), F.lit(target)), 6).alias("score"))
    marked = constants.where(F.col("value").contains("${") | F.col("value").contains(":") | F.col("value").contains("{")).orderBy("id").limit(templates)
    match = urls.template_match(F.lit(target), F.col("value"))
    fitting = marked.withColumn("_m", match).where("_m.score > 0.5").select("id", F.lit("template").alias("kind"), F.round(0.95 * F.col("_m.score"), 6).alias("score"))
    near = constants.orderBy("id").limit(similar).withColumn("_s", urls.url_similarity(F.lit(target), F.col("value"))).where("_s > 0.6")
    near = near.join(ladder.select("id"), "id", "left_anti").select("id", F.lit("constant").alias("kind"), F.round(0.7 * F.col("_s"), 6).alias("score"))
    return ladder.union(fitting).union(near)


def _parts(target: str) -> list[str]:
    return [s for s in (x.strip().lower() for x in target.split("?")[0].split("#")[0].split("/")) if len(s) >= 2]


def _hits(haystack: Column, parts: list[str]) -> Column:
    out = F.lit(0)
    for part in parts:
        out = out + haystack.contains(part).cast("int")
    return out


def usage_layer(usages: DataFrame, target: str) -> DataFrame:
    """Usages (code, normalized_pattern, …) with score: 0.98 where the pattern is the target or the code holds it, else 0.8 by the parts found."""
    parts, plain = _parts(target), target.lower().strip("/")
    code, pattern = F.lower(F.coalesce("code", F.lit(""))), F.lower(F.coalesce("normalized_pattern", F.lit("")))
    score = urls.segment_score(0.8, F.array(*(F.lit(x) for x in parts)), _hits(F.concat(code, F.lit("\n"), pattern), parts), pattern)
    exact = (F.regexp_replace(pattern, "^/+|/+$", "") == plain) | code.contains(plain)
    return usages.withColumn("score", F.round(F.when(exact, 0.98).otherwise(score), 6))


def usage_chunks(chunks: DataFrame, target: str, limit: int = 10, column: str = "code_text") -> DataFrame:
    """The chunks that hold most parts of a target, at least two and half of them, with seg_hits and score: 0.6 with the whole target, else half the share."""
    parts, plain = _parts(target), target.lower().strip("/")
    code = F.lower(F.col(column))
    rows = chunks.withColumn("seg_hits", _hits(code, parts)).where(F.col("seg_hits") >= max(2, -(-len(parts) // 2)))
    rows = rows.withColumn("score", F.round(F.when(code.contains(plain), 0.6).otherwise(0.5 * F.col("seg_hits") / max(len(parts), 1)), 6))
    return rows.orderBy(F.desc("seg_hits"), F.length(column), *chunks.columns[:1]).limit(limit)


def vector_layer(constants: DataFrame, query: Column, limit: int = 10) -> DataFrame:
    """The most similar constants, at 0.8 of their similarity."""
    return search.vector_top_k(constants, query, limit).withColumn("score", F.round(F.col("similarity") * 0.8, 6))


#: Fixed scores: usages by way of a wrapper that share two parts, template helpers for a templated target, paths with a version in place of a placeholder.
INDIRECT, HELPER, VERSIONS = 0.35, 0.3, 0.28


def related_layer(usages: DataFrame, patterns: DataFrame, target: str, shown: DataFrame, most: int = 30) -> DataFrame:
    """id, kind, score, file_path, line_start, content: what is near a target but no answer, at places not shown yet.

    usages: file_path, line, code, context, pattern, normalized_pattern;
    patterns: id, pattern, file_path, line, code; shown: file_path, line_start.
    """
    segments = [s for s in target.split("?")[0].split("#")[0].split("/") if s]
    lits = [s.strip().lower() for s in segments if len(s.strip()) >= 2 and not re.match(r"^(\$\{[^}]+\}|:[a-zA-Z_][a-zA-Z0-9_]*|\{[^}]+\}|<[^>]+>)$", s.strip())]
    hay = F.lower(F.concat_ws(" ", F.coalesce("pattern", F.lit("")), F.coalesce("normalized_pattern", F.lit(""))))
    shared = _hits(hay, lits)
    near = usages.where(F.col("context").isin("indirect_call", "template_helper")).withColumn("_shared", shared)
    if lits:
        near = near.where("_shared > 0")
    templated = re.search(r"[:$]\{?[A-Za-z_][\w$]*", target) is not None
    score = F.when((F.col("context") == "indirect_call") & (F.col("_shared") >= 2), INDIRECT).when((F.col("context") == "template_helper") & F.lit(templated), HELPER)
    name = F.concat_ws("-", F.lit("related"), "context", "file_path", F.col("line").cast("string"))
    out = near.select(name.alias("id"), F.col("context").alias("kind"), score.alias("score"), "file_path", F.col("line").alias("line_start"), F.coalesce("code", "pattern").alias("content"))
    if any(re.fullmatch(r"v\d+", s.strip().lower()) for s in segments):
        family = patterns.where(urls.version_family(F.lit(target), F.col("pattern")))
        out = out.union(family.select(F.concat(F.lit("related-version_family-"), F.col("id").cast("string")), F.lit("version_family"), F.lit(VERSIONS), "file_path", F.col("line"), F.coalesce("code", "pattern")))
    out = out.where("score IS NOT NULL AND file_path <> '' AND line_start > 0")
    return unseen(out, shown).select(*out.columns).orderBy(F.desc("score"), "file_path", "line_start").limit(most)


def search_url(question: str, constants: DataFrame, patterns: DataFrame, usages: DataFrame, chunks: DataFrame, limit: int = 20, more: DataFrame | None = None, wanted: str | None = None) -> DataFrame:
    """id, type, score, file_path, line_start, content, usage_chain: places that answer a question for a URL, best first, then what is related to them.

    constants: id, name, value, file_path, line; patterns: id, pattern,
    normalized_pattern, method, file_path, line, code; usages: id, and the
    columns of ``related_layer``; chunks: id, file_path, line_start, code_text.
    ``more`` holds further scored rows (derivations, vector results), taken for
    general questions only; ``wanted`` is the method asked for.  The best of a
    place stays; constants get up to five chunks that hold their name.
    """
    spark = constants.sparkSession
    got = spark.createDataFrame([(question,)], "q string").select(text.action(F.col("q")).alias("action"), F.regexp_extract("q", r"(https?://\S+|/[A-Za-z0-9_\-.:{}$/]+)", 1).alias("t")).first()
    target = got["t"] or question
    cast = lambda rows, kind, score, line, content: rows.select(F.concat_ws(":", F.lit(kind), F.col("id").cast("string")).alias("id"), F.lit(kind).alias("type"), score.cast("double").alias("score"), "file_path", F.col(line).cast("long").alias("line_start"), F.col(content).alias("content"))
    scored = constant_layer(constants.select("id", "value"), target).groupBy("id").agg(F.max("score").alias("_s"))
    found = cast(constants.join(scored, "id"), "constant", F.col("_s"), "line", "value")
    ranked = url_ops.ranked_candidates(patterns, "pattern", target)
    ladder = url_ops.method_adjusted(url_ops.ladder_score(F.col("pattern"), F.lit(target)), F.col("method"), wanted)
    found = found.union(cast(ranked, "pattern", F.round(ladder, 6), "line", "code"))
    used = usage_layer(usages, target).where("score > 0")
    found = found.union(cast(used, "usage", F.col("score"), "line", "code"))
    found = found.union(cast(usage_chunks(chunks, target), "chunk", F.col("score"), "line_start", "code_text"))
    if more is not None and got["action"] not in ("find_usages", "find_definition"):
        found = found.union(more.select("id", "type", F.col("score").cast("double"), "file_path", F.col("line_start").cast("long"), "content"))
    place = found.groupBy("file_path", "line_start").agg(F.min_by(F.struct(*found.columns), F.struct(-F.col("score"), F.col("type"), F.col("id"))).alias("_r")).select("_r.*")
    top = place.orderBy(F.desc("score"), "file_path", "line_start").limit(limit)
    names = constants.where("name <> ''").select(F.concat(F.lit("constant:"), F.col("id").cast("string")).alias("id"), F.col("name").alias("_name"))
    named = top.where("type = 'constant'").join(names, "id").select("id", "_name")  # a limit's rows at most
    holding = chunks.join(F.broadcast(named), F.contains(F.lower("code_text"), F.lower("_name")))
    holding = holding.select(named["id"].alias("_id"), F.struct(F.col("file_path").alias("file"), F.col("line_start").cast("long").alias("line"), F.substring("code_text", 1, 200).alias("code")).alias("_u"))
    chain = holding.withColumn("_rn", F.row_number().over(Window.partitionBy("_id").orderBy("_u"))).where("_rn <= 5").groupBy(F.col("_id").alias("id")).agg(F.array_sort(F.collect_list("_u")).alias("usage_chain"))
    answers = top.join(chain, "id", "left").withColumn("_last", F.lit(False))
    near = related_layer(usages, patterns, target, top)
    near = near.select("id", F.lit("related").alias("type"), "score", "file_path", F.col("line_start").cast("long").alias("line_start"), "content").withColumns({"usage_chain": F.lit(None).cast(chain.schema["usage_chain"].dataType), "_last": F.lit(True)})
    return answers.select(*near.columns).union(near).orderBy("_last", F.desc("score"), "file_path", "line_start").drop("_last")
