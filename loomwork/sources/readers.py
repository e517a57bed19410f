"""Sources: Parquet by domain folders, JSON lines with lineage and bad lines kept apart, JSON documents, file manifests."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGES = "array<struct<role: string, content: string>>"
EXAMPLE = f"id string, category string, domain string, lang string, difficulty string, source string, messages {MESSAGES}"
PROMPTS = "name string, count long, prompts array<struct<id: string, lang: string, kind: string, category: string, tag: string, prompt: string, expect: string>>"
_BAD = "_corrupt_record"


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows anew if the files give fewer tasks than there are cores; larger tables stay as they were read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def domain_parquet(spark: SparkSession, root: str, pattern: str = "*/train-*.parquet", subset: int | None = None) -> DataFrame:
    """(messages, domain, source, seq-able file name) of Parquet files whose folder names the domain; only `messages` is read.

    `subset` keeps that many rows, the first by files (in the order of their names) and by the rows within a file.
    How many rows a file has is told by its footer, so only files with a wanted row are read, and nothing is sorted.
    """
    read = spark.read.schema(f"messages {MESSAGES}")
    rows, place = read.parquet(f"{root.rstrip('/')}/{pattern}"), F.col("_metadata.file_path")
    if subset:
        sizes = rows.groupBy(place.alias("file")).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per file
        files = sizes.withColumn("before", before).filter(F.col("before") < subset).orderBy("file").collect()  # `subset` of them at most
        rows = read.parquet(*[unquote(f["file"]) for f in files]) if files else rows.limit(0)
        if files:
            rows = rows.filter((place != files[-1]["file"]) | (F.col("_metadata.row_index") < subset - files[-1]["before"]))
    return rows.select("messages", F.element_at(F.split(place, "/"), -2).alias("domain"), F.lit("raw").alias("source"), place.alias("_file"))


def json_lines(spark: SparkSession, paths, schema: str = EXAMPLE) -> DataFrame:
    """Rows of one or many JSON-lines files with `_src` (file name) and `_bad` (the line, if it isn't JSON); blank lines are skipped."""
    rows = spark.read.text(paths).filter(F.trim("value") != "").select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_src"))
    parsed = F.from_json("value", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    return rows.select(parsed.alias("x"), "_src").select("x.*", "_src").withColumnRenamed(_BAD, "_bad")


def malformed_counts(rows: DataFrame) -> DataFrame:
    return rows.filter("_bad is not null").groupBy("_src").agg(F.count(F.lit(1)).alias("malformed"))


def existing(spark: SparkSession, paths: str) -> list[str]:
    """Of a comma-separated list the paths that exist."""
    out = []
    for p in filter(None, (x.strip() for x in paths.split(","))):
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            out.append(p)
    return out


def optional_json_lines(spark: SparkSession, paths: str, schema: str = EXAMPLE) -> DataFrame:
    """`json_lines` of the paths that exist; no rows if none does."""
    have = existing(spark, paths)
    return json_lines(spark, have, schema) if have else json_lines_of_nothing(spark, schema)


def json_lines_of_nothing(spark: SparkSession, schema: str = EXAMPLE) -> DataFrame:
    return spark.createDataFrame([], f"{schema}, _bad string, _src string")


def prompt_set(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of one JSON document: an object with `prompts`, or the bare array."""
    rows = spark.read.text(path, wholetext=True)
    item = PROMPTS.split("array<", 1)[1][:-1]
    whole = F.from_json("value", PROMPTS)["prompts"]
    bare = F.from_json("value", f"array<{item}>")
    return rows.select(F.posexplode(F.when(F.ltrim("value").startswith("["), bare).otherwise(whole)).alias("seq", "p")).select("seq", "p.*")


def json_or_null(spark: SparkSession, path: str, schema: str) -> dict | None:
    """A JSON file as a dictionary; None if it is missing or broken."""
    have = existing(spark, path)
    row = spark.read.text(have, wholetext=True).select(F.from_json("value", schema).alias("x")).first() if have else None
    return row["x"].asDict(True) if row and row["x"] is not None and any(v is not None for v in row["x"]) else None


def line_count(spark: SparkSession, paths) -> DataFrame:
    """Lines that aren't blank, per file."""
    return spark.read.text(paths).filter(F.trim("value") != "").groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines of one file, by Spark's order of reading."""
    return spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).orderBy("seq").limit(n).select("value")


def manifest(spark: SparkSession, paths) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
