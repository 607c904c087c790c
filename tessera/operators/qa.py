"""Conversations, feedback and answers held against evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions import text


def recent_turns(turns: DataFrame, n: int = 3) -> DataFrame:
    """The latest n (1 to 20) turns of each session, with their place from the newest."""
    n = max(1, min(n, 20))
    order = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return turns.withColumn("age", F.row_number().over(order)).where(F.col("age") <= n)


def context_budget(turns: DataFrame, budget: int = 3000, most: int = 800) -> DataFrame:
    """Turns from the newest back until the first that would go beyond the budget of characters; answers are cut to ``most``."""
    cut = turns.withColumn("answer", F.substring("answer", 1, most))
    newest = Window.partitionBy("session_id").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("used", F.sum(F.coalesce(F.length("answer"), F.lit(0))).over(newest)).where(F.col("used") <= budget)


def session_statistics(turns: DataFrame) -> DataFrame:
    """n_turns, n_sessions, mean_length."""
    return turns.agg(F.count(F.lit(1)).alias("n_turns"), F.count_distinct("session_id").alias("n_sessions"), F.round(F.coalesce(F.avg(F.length("answer")), F.lit(0.0)), 6).alias("mean_length"))


def questions_with_feedback(questions: DataFrame, feedback: DataFrame, contains: str) -> DataFrame:
    """Questions that contain a text, with their feedback, newest first ([] without any)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("created", "is_helpful")), False), lambda x: x["is_helpful"])
    per = feedback.groupBy("question_id").agg(ordered.alias("feedback"), F.count_if("is_helpful").alias("n_helpful"))
    got = questions.where(F.lower("query").contains(contains.lower())).join(per, questions["id"] == per["question_id"], "left").drop("question_id")
    return got.withColumns({"feedback": F.coalesce("feedback", F.array().cast("array<boolean>")), "n_helpful": F.coalesce("n_helpful", F.lit(0))})


def consistency(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """id, verdict, unsupported: empty_evidence, no_refs, unsupported_refs, line_mismatch or ok for each answer.

    answers: id, answer; evidence: id, file_path, line_start, line_end.
    """
    cited = answers.select("id", F.explode(text.citations(F.col("answer"))).alias("c"))
    base = lambda path: F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)  # noqa: E731  equal paths end alike: an equi-join
    pairs = cited.withColumn("_base", base(F.col("c.path"))).join(evidence.withColumn("_base", base(F.col("file_path"))), ["id", "_base"], "left")
    same = F.coalesce(text.same_file(F.col("file_path"), F.col("c.path")), F.lit(False))
    in_lines = same & (F.col("c.first") <= F.col("line_end")) & (F.col("c.last") >= F.col("line_start"))
    per = pairs.groupBy("id", "c").agg(F.bool_or(same).alias("_file"), F.bool_or(F.coalesce(in_lines, F.lit(False))).alias("_line"))
    per = per.groupBy("id").agg(F.bool_and("_file").alias("_files"), F.bool_and("_line").alias("_lines"), F.array_sort(F.collect_list(F.when(~F.col("_file"), F.concat_ws(":", "c.path", "c.first")))).alias("unsupported"))
    n = evidence.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    got = answers.select("id").join(n, "id", "left").join(per, "id", "left")
    verdict = F.when(F.coalesce("_n", F.lit(0)) == 0, "empty_evidence").when(F.col("_files").isNull(), "no_refs").when(~F.col("_files"), "unsupported_refs").when(~F.col("_lines"), "line_mismatch").otherwise("ok")
    return got.select("id", verdict.alias("verdict"), F.when(verdict == "unsupported_refs", F.col("unsupported")).otherwise(F.array().cast("array<string>")).alias("unsupported"))


def enumeration(question: str, inventory: DataFrame, most: int = 20) -> dict | None:
    """The inventory's answer to a question that asks for a list of interfaces, None for any other question.

    inventory: method, path, patterns, usages, …  rows holds all rows that fit
    the method and the path that the question names, evidence the first
    ``most`` of them, by_method their number for each method.
    """
    from tessera.functions import questions
    from tessera.operators import urls

    spark = inventory.sparkSession
    q = F.col("q")
    asked = spark.createDataFrame([(question,)], "q string").select(text.question_kind(q).alias("kind"), questions.asked_method(q).alias("method"), questions.asked_path(q).alias("path")).first()
    if asked["kind"] != "enumeration":
        return None
    rows = urls.inventory_filter(inventory, method=asked["method"], keyword=asked["path"])
    name = F.concat_ws(" ", F.coalesce("method", F.lit("(undecided)")), "path")
    evidence = rows.orderBy("path", "method").limit(most).select("path", name.alias("content"), F.lit("url_pattern").alias("symbol_type"), F.lit(1.0).alias("score"))
    by_method = rows.groupBy(F.coalesce("method", F.lit("(undecided)")).alias("method")).agg(F.count(F.lit(1)).alias("n"))
    return {"method": asked["method"], "path": asked["path"], "rows": rows, "evidence": evidence, "by_method": by_method}


def inventory_markdown(rows: DataFrame) -> DataFrame:
    """part, place, line: an inventory (method, path, usages) as Markdown: a table for each first path part, largest first, and one of undecided methods last.

    Lines are ordered by part and place within it; no line needs more than its
    group's number of rows, so the answer is whole whatever its length.
    """
    plain = F.coalesce(F.col("path"), F.lit(""))
    first = F.regexp_extract(plain, "^/([^/]+)", 1)
    group = F.when(F.col("method").isNull(), "undecided methods").when(F.startswith(plain, F.lit("http")), "external URLs").when(first != "", F.concat(F.lit("/"), first)).otherwise("(not expanded)")
    listed = rows.select(group.alias("_g"), "method", plain.alias("path"), F.coalesce("usages", F.lit(0)).alias("usages"))
    sizes = listed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    part = F.concat(F.when(F.col("_g") == "undecided methods", "1").otherwise("0"), F.lpad((F.lit(10**12) - F.col("_n")).cast("string"), 13, "0"), "_g")
    heads = sizes.select(part.alias("part"), F.explode(F.array(F.struct(F.lit("0").alias("place"), F.concat(F.lit("### "), "_g", F.lit(" ("), F.col("_n").cast("string"), F.lit(")")).alias("line")), *(F.struct(F.lit(i).alias("place"), F.lit(x).alias("line")) for i, x in (("1", "| Method | Path | Usages |"), ("2", "| --- | --- | --- |"))))).alias("_h")).select("part", "_h.*")
    body = listed.join(sizes, "_g").select(part.alias("part"), F.concat_ws("\t", F.lit("3"), "path", "method").alias("place"), F.concat(F.lit("| "), F.coalesce("method", F.lit("(undecided)")), F.lit(" | `"), "path", F.lit("` | "), F.col("usages").cast("string"), F.lit(" |")).alias("line"))
    return heads.union(body).orderBy("part", "place")


#: Fixed plan: rows, threshold and strategies of each retrieval round.
ROUNDS = ((10, 0.3, ("vector", "exact")), (15, 0.25, ("vector", "dependency")), (20, 0.2, ("vector", "exact", "fuzzy", "graph")))


def answer_loop(question: str, retrieve: Callable, generate: Callable, enough: float = 0.85, most_rounds: int = 5) -> dict:
    """Retrieves until the evidence suffices or the rounds end, then answers once; without evidence there is no answer.

    retrieve(question, limit, threshold, strategies) gives rows (score,
    file_path, …) of a bounded result list; generate(question, rows) the text.
    """
    rows, used, rounds = [], set(), 0
    for limit, threshold, strategies in ROUNDS[: min(most_rounds, len(ROUNDS))]:
        rounds += 1
        got = list(retrieve(question, limit, threshold, strategies))[:15]
        rows += got
        used |= set(strategies)
        if _sufficiency(rows) >= enough:
            break
    enough_found = _sufficiency(rows) >= enough
    return {"answer": generate(question, rows) if rows else None, "rounds": rounds, "evidence": len(rows), "strategies": sorted(used), "degraded": not enough_found, "confidence": _confidence(rows)}


def _clean(rows: list) -> list:
    return [r for r in rows if r["score"] == r["score"] and abs(r["score"]) != float("inf")]


def _half_up(x: float) -> float:
    import math

    return math.floor(x * 100 + 0.5) / 100


def _sufficiency(rows: list) -> float:
    rows = _clean(rows)
    if not rows:
        return 0.0
    top = sorted((min(max(r["score"], 0), 1) for r in rows), reverse=True)[:3]
    return _half_up(0.45 * min(len(rows) / 3, 1) + 0.25 * min(len({r["file_path"] for r in rows}) / 2, 1) + 0.3 * sum(top) / len(top))


def _confidence(rows: list) -> float:
    rows = _clean(rows)
    if not rows:
        return 0.0
    first = [min(max(r["score"], 0), 1) for r in rows[:5]]
    return _half_up(sum(first) / len(first) * 0.7 + min(len(rows) / 5, 1) * 0.3)
