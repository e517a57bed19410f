"""The stateless preparation steps on a file stream, with exact duplicates dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def turns(spark: SparkSession, path: str, schema: str = "conv_id long, turn long, role string, text string", files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def prepared(stream: DataFrame, seed: int = 42) -> DataFrame:
    """Each message normalized, checked for secrets and repetition, and dealt to a split."""
    rows = stream.withColumn("content", T.normalize_segment(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_w", T.words("content"))
    return rows.withColumns({"repetition": T.repetition(F.col("_w")), "secret": T.secret("content"), "split": F.when(T.split_bucket(seed, "conv_id") < 100, "validation").otherwise("train")}).drop("_w")


def without_duplicates(stream: DataFrame, at: str, key: list[str], within: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and values per window and type; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there as Parquet and stops; a rerun goes on where this one ended."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
