"""Incremental re-indexing: change feeds, snapshot differences, propagation, rebuilds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def candidate_paths(changes: DataFrame) -> DataFrame:
    """Distinct paths of a change feed (status, path, from_path); a rename gives both sides."""
    return changes.select(F.explode(F.array_compact(F.array("path", "from_path"))).alias("path")).distinct()


def change_summary(changes: DataFrame) -> DataFrame:
    """total and the number of each status, whether it is a letter or a word."""
    by = {"added": "A", "modified": "M", "deleted": "D", "renamed": "R"}
    return changes.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status").isin(k, v)).alias(k) for k, v in by.items()))


def content_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, modified, deleted) of files (path, content) whose content differs; by digests, so that no text is compared twice."""
    b = before.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("_b"))
    a = after.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("_a"))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "modified")
    return b.join(a, "path", "full_outer").select("path", kind.alias("change")).where("change IS NOT NULL")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind, path, symbol, change, from_line, to_line: entities (kind, path, symbol, line) added, removed or moved."""
    key = ["kind", "path", "symbol"]
    b = before.groupBy(*key).agg(F.min("line").alias("from_line"))
    a = after.groupBy(*key).agg(F.min("line").alias("to_line"))
    change = F.when(F.col("from_line").isNull(), "added").when(F.col("to_line").isNull(), "removed").when(F.col("from_line") != F.col("to_line"), "moved")
    return b.join(a, key, "full_outer").withColumn("change", change).where("change IS NOT NULL")


def referrers(changed: DataFrame, imports: DataFrame, usages: DataFrame) -> DataFrame:
    """file: importers of changed files and users of their URLs, without the changed files themselves.

    changed: file; imports: importer, imported; usages: usage_file, definition_file.
    """
    by_import = imports.join(changed.select(F.col("file").alias("imported")), "imported", "left_semi").select(F.col("importer").alias("file"))
    by_url = usages.join(changed.select(F.col("file").alias("definition_file")), "definition_file", "left_semi").select(F.col("usage_file").alias("file"))
    return by_import.union(by_url).distinct().join(changed.select("file"), "file", "left_anti")


def merged(target: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """The target after a change feed: rows of changed keys replaced by the feed's, keys whose content is null dropped.

    changes: the target's columns; content null deletes.
    """
    return target.join(changes.select(key), key, "left_anti").unionByName(changes.where("content IS NOT NULL"))


def pending(files: DataFrame) -> DataFrame:
    """Files whose entities are not indexed yet."""
    return files.where("entities_indexed_at IS NULL")


def capped(diff: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """At most so many rows of each change (a report's list), and the true number of each with a truncated flag."""
    from pyspark.sql import Window

    rows = diff.withColumn("_rn", F.row_number().over(Window.partitionBy("change").orderBy("path", "symbol"))).where(F.col("_rn") <= most).drop("_rn")
    return rows, diff.groupBy("change").agg(F.count(F.lit(1)).alias("n")).withColumn("truncated", F.col("n") > most)


def promoted(unresolved: DataFrame, added: DataFrame) -> DataFrame:
    """file: importers whose unresolved import (importer, target) may mean a file that was added (path)."""
    from tessera.operators import relations

    may = unresolved.select("importer", "target").distinct().select("importer", F.explode(relations.import_candidates(F.col("importer"), F.col("target"))).alias("path"))
    return may.join(added.select("path").distinct(), "path", "left_semi").select(F.col("importer").alias("file")).distinct()


def rebuilt(tables: dict[str, DataFrame], files: DataFrame, targets: DataFrame, derive: Callable[[DataFrame], dict[str, DataFrame]], key: str = "file_id") -> dict[str, DataFrame]:
    """The derived tables with the rows of target files taken out of all of them and then derived anew.

    files: id, …; targets: id.  Targets that are no files any more lose their
    rows.  Both passes are one plan: nothing derived reads what is taken out.
    """
    gone = targets.select(F.col("id").alias(key)).distinct()
    new = derive(files.join(targets.select("id").distinct(), "id", "left_semi"))
    return {name: table.join(gone, key, "left_anti").unionByName(new[name]) if name in new else table.join(gone, key, "left_anti") for name, table in tables.items()}


def reindexed(files: DataFrame, derive: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """All derived tables from all files, nothing kept."""
    return derive(files)
