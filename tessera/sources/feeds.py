"""Change feeds of version control and archives as frames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.sources.files import EXTENSIONS

#: Bytes of file content that a batch of unpacked files holds at most (one file may be larger).
BATCH_BYTES = 32 << 20
#: Status letters; a copy is a new file, a change of type a modification.
STATUSES = {"A": "added", "M": "modified", "D": "deleted", "T": "modified", "R": "renamed", "C": "added"}


def _stripped(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def indexable(path: Column) -> Column:
    """Whether a parser takes files of this extension (the last one, in any case)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)).isin(*EXTENSIONS)


def name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines' other columns, path, status, from_path, indexable of ``--name-status`` lines.

    Renames and copies name the old path first; only a rename keeps it, since a
    copy leaves the old file as it is.  Lines without a path or with another letter are left out.
    """
    part = lambda i: _stripped(F.get(F.split(F.col(line), "\t"), F.lit(i)))
    letter = F.substring(part(0), 1, 1)
    status = F.element_at(F.create_map(*(F.lit(x) for pair in STATUSES.items() for x in pair)), letter)
    path = F.when(letter.isin("R", "C"), part(2)).otherwise(part(1))
    rows = lines.withColumns({"_path": path, "_status": status, "_from": F.when(letter == "R", part(1))}).where("_path <> '' AND _status IS NOT NULL")
    others = [c for c in lines.columns if c != line]
    return rows.select(*others, F.col("_path").alias("path"), F.col("_status").alias("status"), F.col("_from").alias("from_path"), indexable(F.col("_path")).alias("indexable"))


def commits(lines: DataFrame, order: str, most: int = 50, line: str = "line") -> DataFrame:
    """sha, short_sha, subject, author, date of the first ``most`` log lines in order, whose fields a unit separator (0x1f) parts; missing ones are empty."""
    first = lines.where(_stripped(F.col(line)) != "").orderBy(order).limit(most)
    fields = F.split(F.col(line), "\u001f")
    return first.select(order, *(F.coalesce(F.get(fields, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("sha", "short_sha", "subject", "author", "date"))))


def unpacked(spark: SparkSession, path: str) -> DataFrame:
    """archive, path, content, length of the files in zip archives; content is null where it is no UTF-8, a broken archive gives one row without a path.

    An archive is one task's; its files leave in batches of bounded bytes.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                held, size = [], 0
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for entry in z.infolist():
                            if entry.is_dir():
                                continue
                            raw = z.read(entry)
                            try:
                                text = raw.decode("utf-8")
                            except UnicodeDecodeError:
                                text = None
                            held.append((name, entry.filename, text, len(raw)))
                            size += len(raw)
                            if size >= BATCH_BYTES:
                                yield pd.DataFrame(held, columns=["archive", "path", "content", "length"])
                                held, size = [], 0
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                    held.append((name, None, None, None))
                if held:
                    yield pd.DataFrame(held, columns=["archive", "path", "content", "length"]).astype({"length": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "archive string, path string, content string, length long")
