"""Session settings and shared-folder helpers of the llm operators."""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import tokens
from tessera.sources import lineage


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, for good, as frames run after the call; sets a checkpoint folder where none is set (see ``lineage.folder``)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(tokens.BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(lineage.folder(spark))
    return spark


def cut(frame: DataFrame) -> DataFrame:
    """Writes a frame to the shared checkpoint folder and cuts its lineage."""
    prepare(frame.sparkSession)
    return frame.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (never null) and some more columns."""
    return documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """A bit for each residue of the 64-bit hashes in the only column, as bytes of 8 bits, lowest first.

    Its size is at most 2**bits / 8 bytes (gathered as at most 2**bits / 64
    words), and about 32 bits for each value where they are few.  It is a filter before a shuffle; what passes wrongly
    is dropped by the join that follows, so a full bitmap costs time only.
    """
    bit = F.col(values.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    words = values.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_at"))
    got = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63L AS int))")).alias("_word")).toArrow()
    out = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    out[got.column("_at").to_numpy()] = got.column("_word").to_numpy()
    out = out.view(np.uint8)
    held = 32 * int(np.bitwise_count(out).sum(dtype=np.int64))
    while len(out) > 1024 and 8 * len(out) > 2 * held:  # few values need a smaller map only: fewer of the low bits
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return np.ascontiguousarray(out)


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes have their bit set."""
    bit = hashes & np.uint64(8 * len(words) - 1)
    return words[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of undirected edges u, v (64-bit ids).

    Alternating large-star and small-star steps: each is one aggregation and
    one join, edges are written to the shared folder after every round, and
    the number of rounds grows with the logarithm of the longest path.
    """
    edges = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    children = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return children.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(children.select("node"), "node", "left_anti"))
