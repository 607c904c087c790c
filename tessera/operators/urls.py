"""URL analytics: inventory, ranked search, helper expansion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import urls


def inventory(patterns: DataFrame, usages: DataFrame | None = None) -> DataFrame:
    """method, path, patterns, usages, files: every interface once, merged by method and real path.

    patterns: id, method, path; usages: pattern_id, file_path.  Usages are
    summed by pattern first, so that a join never multiplies them.
    """
    rows = patterns.select("id", F.upper("method").alias("method"), "path")
    if usages is not None:
        per = usages.groupBy(F.col("pattern_id").alias("id")).agg(F.count(F.lit(1)).alias("_u"), F.collect_set("file_path").alias("_f"))
        rows = rows.join(per, "id", "left")
    else:
        rows = rows.withColumns({"_u": F.lit(0), "_f": F.array().cast("array<string>")})
    return rows.groupBy("method", "path").agg(
        F.count(F.lit(1)).alias("patterns"), F.sum(F.coalesce("_u", F.lit(0))).alias("usages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("_f", F.array().cast("array<string>")))))).alias("files"),
    )


def inventory_filter(rows: DataFrame, method: str | None = None, with_method: bool = False, keyword: str | None = None, columns: tuple[str, ...] = ("method", "path")) -> DataFrame:
    """Rows of a method, rows with any method, rows in whose columns a keyword occurs."""
    if method:
        rows = rows.where(F.upper("method") == method.upper())
    if with_method:
        rows = rows.where("method IS NOT NULL")
    if keyword:
        rows = rows.where(F.lower(F.concat_ws(" ", *columns)).contains(keyword.lower()))
    return rows


def prefix_groups(rows: DataFrame, path: str = "path") -> DataFrame:
    """prefix, n: rows by first path part, largest groups first."""
    prefix = F.concat(F.lit("/"), F.coalesce(F.get(urls.segments(F.col(path)), F.lit(0)), F.lit("")))
    return rows.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix")


def ranked_candidates(rows: DataFrame, column: str, target: str, limit: int = 400) -> DataFrame:
    """Rows in which the target or one of its parts occurs, with match_rank (0 equal, 1 contains, 2 contained, 3 part) and seg_hits; best first."""
    value = urls.normalize_target(F.col(column))
    wanted = urls.normalize_target(F.lit(target))
    parts = urls.usable_segments(F.lit(target))
    hits = F.aggregate(parts, F.lit(0), lambda n, s: n + F.contains(value, s).cast("int"))
    rank = F.when(value == wanted, 0).when(F.contains(value, wanted), 1).when(F.contains(wanted, value) & (value != ""), 2).otherwise(3)
    got = rows.withColumns({"match_rank": rank, "seg_hits": hits})
    return got.where((F.col("match_rank") < 3) | (F.col("seg_hits") > 0)).orderBy("match_rank", F.desc("seg_hits"), F.length(column), column, rows.columns[0]).limit(limit)


def ladder_score(candidate: Column, target: Column, base: float = 0.7) -> Column:
    """1 for an equal path, 0.95 if it contains the target, 0.85 if the target contains it, else by shared parts."""
    value, wanted = urls.normalize_target(candidate), urls.normalize_target(target)
    parts = urls.usable_segments(target)
    matched = F.aggregate(parts, F.lit(0), lambda n, s: n + F.contains(value, s).cast("int"))
    return F.when(value == wanted, 1.0).when(F.contains(value, wanted), 0.95).when(F.contains(wanted, value) & (value != ""), 0.85).otherwise(urls.segment_score(base, parts, matched, candidate))


def method_adjusted(score: Column, method: Column, wanted: str | None) -> Column:
    """A fifth more, 1 at most, for the wanted method; half for another."""
    if wanted is None:
        return score
    return F.when(method.isNull(), score).when(F.upper(method) == wanted.upper(), F.least(score * 1.2, F.lit(1.0))).otherwise(score * 0.5)


def matched_patterns(calls: DataFrame, patterns: DataFrame, wild: Callable[[Column], Column] = lambda s: urls.is_placeholder(s) | urls.is_wild(s)) -> DataFrame:
    """Each URL with the pattern that fits the end of its path best (most literals; of equal ones the smallest id).

    calls: url; patterns: id, pattern; wild tells the parts that stand for any
    value.  Patterns that differ in such parts alone fit the same URLs equally
    well, so the one of the smallest id is kept.  The last literal part of a
    pattern must stand at a fixed distance from the URL's end, so pairs come from
    an equi-join on (part, distance); patterns of placeholders alone join by length.
    """
    p = patterns.select("id", "pattern", urls.segments(F.col("pattern")).alias("_p"))
    shape = F.transform("_p", lambda s: F.when(~wild(s), s))
    p = p.groupBy(shape.alias("_f")).agg(F.min(F.struct("id", "pattern", "_p")).alias("_b")).select("_b.*")
    n = F.size("_p")
    distance = F.coalesce(F.array_max(F.transform("_p", lambda s, i: F.when(~wild(s), i))), F.lit(-1))
    p = p.where(n > 0).withColumn("_i", distance).select("id", "pattern", (n - F.col("_i")).alias("_d"), F.when(F.col("_i") >= 0, F.get("_p", F.col("_i"))).otherwise("").alias("_s"))
    u = calls.select("url").distinct().withColumn("_u", urls.segments(F.col("url")))
    u = u.select("url", F.explode(F.concat(F.transform("_u", lambda s, i: F.struct(s.alias("_s"), (F.size("_u") - i).alias("_d"))), F.transform(F.sequence(F.lit(2), F.size("_u") + 1), lambda d: F.struct(F.lit("").alias("_s"), d.alias("_d"))))).alias("_k"))
    pairs = u.select("url", "_k.*").join(p, ["_s", "_d"])
    pairs = pairs.withColumn("score", urls.suffix_match_score(F.col("url"), F.col("pattern"), wild)).where("score IS NOT NULL")
    best = pairs.groupBy("url").agg(F.max(F.struct(F.col("score"), -F.col("id"), F.col("pattern"))).alias("_b"))
    return best.select("url", F.col("_b.score").alias("score"), F.col("_b.pattern").alias("pattern"))


#: Helper calls at the front of a template: ${name} or ${name(…)}.
_HELPER = r"^\$\{([A-Za-z_][A-Za-z0-9_]*)(\([^)]*\))?\}"


def expand_patterns(patterns: DataFrame, helpers: DataFrame, levels: int = 6) -> DataFrame:
    """id, path: leading helpers replaced by their templates, up to so many levels; null for names only known at run time.

    patterns: id, pattern, file_path; helpers: file_path, name, template,
    exported.  A name means the helper of the same file, else the exported
    helper of that name, if all exported ones agree.
    """
    every = helpers.where("exported").groupBy("name").agg(F.min("template").alias("g_template"), F.min("file_path").alias("g_file"), F.count_distinct("template").alias("_n")).where("_n = 1").drop("_n")
    own = helpers.groupBy(F.col("file_path").alias("file"), "name").agg(F.min("template").alias("template"))
    rows = patterns.select("id", F.col("pattern").alias("rest"), F.col("file_path").alias("file"), F.lit(False).alias("failed"))
    for _ in range(levels):
        named = rows.withColumn("name", F.nullif(F.regexp_extract("rest", _HELPER, 1), F.lit("")))
        joined = named.join(own, ["file", "name"], "left").join(every, "name", "left")
        template = F.coalesce("template", "g_template")
        rows = joined.select(
            "id", F.when(F.col("name").isNull() | template.isNull(), F.col("rest")).otherwise(F.concat(template, F.regexp_replace("rest", _HELPER, ""))).alias("rest"),
            F.when(F.col("template").isNull() & F.col("g_file").isNotNull(), F.col("g_file")).otherwise(F.col("file")).alias("file"),
            (F.col("failed") | (F.col("name").isNotNull() & template.isNull())).alias("failed"),
        )
    open_end = F.col("rest").rlike(_HELPER) | ~F.col("rest").contains("/") | F.col("failed")
    return rows.select("id", F.when(~open_end, urls.normalize_tail(F.col("rest"))).alias("path"))


def helper_index(files: DataFrame) -> DataFrame:
    """file_path, name, template, exported: constants and arrow functions of one template in the code.

    files: path, content.
    """
    pattern = r"(export\s+)?const\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:\([^)]*\)\s*(?::\s*\w+\s*)?=>\s*)?[`'\"]([^`'\"]*)[`'\"]"
    found = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("_m"))
    return found.select(F.col("path").alias("file_path"), F.regexp_extract("_m", pattern, 2).alias("name"), F.regexp_extract("_m", pattern, 3).alias("template"), (F.regexp_extract("_m", pattern, 1) != "").alias("exported"))
