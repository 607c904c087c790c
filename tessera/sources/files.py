"""Reading and writing: directory scans with guards, tables with natural keys, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Fixed names: folders that a scan leaves out.
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", "build", "out", "coverage", ".next", ".nuxt", ".cache", "vendor", "target", "tmp", ".idea", ".vscode", "__pycache__", "public")
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue")
#: Fixed limits: bytes of a file, longest and mean line of a minified one.
MOST_BYTES, LONGEST_LINE, MEAN_LINE = 1_000_000, 5000, 2000
BUILD_OUTPUT = (r"\.min\.(js|css)$", r"\.bundle\.js$", r"\.chunk\.js$", r"(^|/)(dist|build)/")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, content, length of the source files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    skipped = "/(" + "|".join(x.replace(".", r"\.") for x in SKIPPED_FOLDERS) + ")/"
    wanted = "(" + "|".join(x.replace(".", r"\.") for x in EXTENSIONS) + ")$"
    return rows.where(~F.col("path").rlike(skipped) & F.col("path").rlike(wanted)).select("path", F.col("content").cast("string").alias("content"), "length")


def line_measures(text: Column) -> tuple[Column, Column]:
    """Number of lines and length of the longest."""
    lines = F.split(text, "\n", -1)
    return F.size(lines), F.array_max(F.transform(lines, F.length))


def guard(path: Column, text: Column) -> Column:
    """build-output, too-large, minified or accept, by the first that holds."""
    count, longest = line_measures(text)
    built = F.lit(False)
    for pattern in BUILD_OUTPUT:
        built = built | path.rlike(pattern)
    return F.when(built, "build-output").when(F.octet_length(text) > MOST_BYTES, "too-large").when((longest > LONGEST_LINE) & (F.length(text) / count > MEAN_LINE), "minified").otherwise("accept")


def skip_summary(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """reason, n."""
    return files.groupBy(guard(F.col(path), F.col(content)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """The target with the source's rows in place of rows of the same key; null keys are equal."""
    return target.join(source.select(*key).distinct(), on=[target[k].eqNullSafe(source[k]) for k in key], how="left_anti").unionByName(source)


def insert_ignore(target: DataFrame, source: DataFrame, key: list[str], order: list) -> DataFrame:
    """The target with those source rows whose key it lacks; of equal keys in the source the first in order."""
    first = source.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
    return target.unionByName(first.join(target.select(*key), on=[first[k].eqNullSafe(target[k]) for k in key], how="left_anti"))


def pattern_upsert(patterns: DataFrame) -> DataFrame:
    """repo_id, method, normalized_pattern, pattern, id: the first pattern of each key."""
    got = patterns.groupBy("repo_id", F.coalesce("method", F.lit("")).alias("method"), "normalized_pattern")
    return got.agg(F.min_by("pattern", "id").alias("pattern"), F.min("id").alias("id"))


def without_repository(target: DataFrame, repo_id: int) -> DataFrame:
    """The table without a repository's rows (with tables partitioned by repo_id: without its partition)."""
    return target.where(F.col("repo_id") != repo_id)


def progress(processed: Column, total: Column, elapsed_ms: Column) -> tuple[Column, Column]:
    """Percent done, and seconds left (a fifth added) once more than ten are done."""
    percent = F.when(total > 0, F.floor(processed / total * 100)).otherwise(0)
    left = F.when(processed > 10, F.floor(elapsed_ms / processed * (total - processed) * 1.2 / 1000 + 0.5))
    return percent, left


def write_report(rows: DataFrame, path: str) -> None:
    """CSV files with a header and, before it, a byte order mark; every column in quotes where it needs them."""
    first, *rest = rows.columns
    rows.select(F.col(first).alias("\ufeff" + first), *rest).write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line."""
    return spark.read.schema(schema).json(path)
