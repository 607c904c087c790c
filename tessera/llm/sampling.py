"""Folds, and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_GRID = 1_000_003


def fold(key: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(of))


def held_out(key: Column, of: int, remainder: int) -> Column:
    """Whether a row is kept from learning; rows without an id are not held out (nothing learns from them either)."""
    return F.coalesce(fold(key, of) == remainder, F.lit(False))


def _share(key: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(_GRID)) < share * _GRID


def labelled(labels: DataFrame, column: str, of: int, remainder: int, bound: int) -> DataFrame:
    """doc_id, label of about ``bound`` learnable rows at most, chosen by a hash of the id.

    Rows with a null id or label are left out; of several labels of one
    document the largest counts.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id"), of, remainder))
    own = own.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    n = own.count()
    return own.where(_share(F.col("doc_id"), bound / n)) if n > bound else own


def by_class(documents: DataFrame, column: str, of: int, remainder: int, bound: int) -> DataFrame:
    """Documents with a non-null class: about ``bound`` of each class at most, chosen by a hash of the id."""
    own = documents.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), of, remainder))
    counts = {r[column]: r["n"] for r in own.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for name, n in counts.items():
        keep = keep | ((F.col(column) == name) & _share(F.col("doc_id"), min(1.0, bound / n)))
    return own.where(keep)
