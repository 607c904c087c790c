"""A file table kept up to date by a stream of change batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import incremental

SCHEMA = "path string, content string, version long"


def refresh(spark: SparkSession, feed: str, table: str, checkpoint: str, files_per_batch: int = 10) -> StreamingQuery:
    """Applies change files (Parquet of path, content, version; null content deletes) to a versioned folder.

    Each batch writes the next version of the table beside the current one and
    a batch that is run again after a failure writes the same version, so the
    result does not depend on retries.
    """
    changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(feed)

    def apply(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct("content", "version"), "version").alias("_v")).select("path", "_v.content", "_v.version")
        session = batch.sparkSession
        before = session.read.schema(SCHEMA).parquet(f"{table}/v{number - 1}") if number else session.createDataFrame([], SCHEMA)
        incremental.merged(before, latest).write.mode("overwrite").parquet(f"{table}/v{number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dependency_counts(imports: DataFrame) -> DataFrame:
    """Running (source, target) counts of a stream of import rows; self edges count, too."""
    return imports.groupBy("source", "target").agg(F.count(F.lit(1)).alias("dependency_count"))
