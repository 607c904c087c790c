"""Result rows as evidence: projections, ids, sources, expiry and hit rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evidence(rows: DataFrame) -> DataFrame:
    """id, file_id, file_path, line_start, line_end, content, code_text, symbol_name, symbol_type, score, similarity of chunk rows.

    Missing texts are empty, missing numbers 0, a missing or empty type
    ``unknown``; the score is the similarity, else the row's own score, else 0.
    Columns that the rows lack count as missing.
    """
    of = lambda name, kind: F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    score = F.coalesce(of("similarity", "double"), of("score", "double"), F.lit(0.0))
    text = lambda name: F.coalesce(of(name, "string"), F.lit(""))
    number = lambda name: F.coalesce(of(name, "long"), F.lit(0))
    kind = F.coalesce(F.nullif(of("symbol_type", "string"), F.lit("")), F.lit("unknown"))
    return rows.select(
        "id", number("file_id").alias("file_id"), text("file_path").alias("file_path"), number("line_start").alias("line_start"), number("line_end").alias("line_end"),
        text("code_text").alias("content"), text("code_text").alias("code_text"), text("symbol_name").alias("symbol_name"), kind.alias("symbol_type"), score.alias("score"), score.alias("similarity"),
    )


def evidence_id(result_id: Column) -> Column:
    """The whole number at the front of what stands after the first colon; 0 if none does."""
    return F.coalesce(F.regexp_extract(result_id, r"^[^:]*:\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))


def source(path: Column, line: Column) -> Column:
    """path:line, for display."""
    return F.concat(path, F.lit(":"), line.cast("string"))


def expired(written: Column, now: Column, ttl_seconds: float) -> Column:
    """Whether more than the time to live has gone by."""
    return F.unix_millis(now) - F.unix_millis(written) > int(ttl_seconds * 1000)


def iso(time: Column) -> Column:
    """A timestamp of a UTC session as ISO 8601 with milliseconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hit_rates(requests: DataFrame, by: str, hit: str = "hit") -> DataFrame:
    """Per cache: hits, misses and hits / (hits + misses), 0 without any; a null outcome counts as neither."""
    hits, misses = F.count_if(F.col(hit)), F.count_if(~F.col(hit))
    return requests.groupBy(by).agg(hits.alias("hits"), misses.alias("misses"), F.when(hits + misses > 0, F.round(hits / (hits + misses), 6)).otherwise(0.0).alias("hit_rate"))


def unseen(results: DataFrame, shown: DataFrame) -> DataFrame:
    """Results (id, score, file_path, line_start, …) at places that are not shown yet, one each: the best, of equal ones the smallest id."""
    new = results.join(shown.select("file_path", "line_start").distinct(), ["file_path", "line_start"], "left_anti")
    best = F.min_by(F.struct(*results.columns), F.struct(-F.col("score"), F.col("id"))).alias("_r")
    return new.groupBy("file_path", "line_start").agg(best).select("_r.*")
