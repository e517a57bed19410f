"""Sinks: JSON lines, split-wise and resumable output, statistics, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from ..tables import cut, unused
from .readers import existing


def write_json_lines(rows: DataFrame, path: str, columns=("messages", "domain", "source"), mode: str = "overwrite") -> None:
    rows.select(*columns).write.mode(mode).json(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, without lineage columns."""
    rows.drop(*[c for c in rows.columns if c.startswith("_")]).write.mode("overwrite").partitionBy(split).json(path)


def append_new(rows: DataFrame, path: str, key: str = "id", before: str = "#") -> int:
    """Appends the rows whose key (up to `before`) isn't in the output yet; returns how many.

    Rows that repeat a key are written once, the smallest by their JSON. Rows without a key cannot be told apart, so
    all of them are written. What is new is fixed before it is written; of the output only the keys are read.
    """
    spark = rows.sparkSession
    new = not_done(rows, spark.read.schema(f"`{key}` string").json(path), key, before) if existing(spark, path) else rows
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    keyed = new.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), row.alias("x"))
    once = keyed.groupBy("k").agg(F.min_by("x", F.to_json("x")).alias("x")).select("x.*")
    fixed = cut(once.unionByName(new.filter(F.col(key).isNull())), "append-new")
    fixed.write.mode("append").json(path)
    return fixed.count()


def not_done(rows: DataFrame, done: DataFrame, key: str = "id", before: str = "#") -> DataFrame:
    """Anti-join on the key's part before a mark; rows without a key stay."""
    stem = lambda c: F.substring_index(F.col(c).cast("string"), before, 1)
    (mark,) = unused(rows, "_stem")
    seen = done.select(stem(key).alias(mark)).filter(F.col(mark).isNotNull()).distinct()
    return rows.withColumn(mark, stem(key)).join(seen, mark, "left_anti").select(*rows.columns)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON string."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def markdown(rows: DataFrame, title: str) -> str:
    """A report table of all rows of a small result, which the driver holds."""
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in rows.collect()]) + "\n"


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """Replaces one small file (stats, report, progress) at any path that Spark knows.

    It is written beside the old one and renamed over it, so a reader finds the old or the new one at any time.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    where = hadoop.FileContext.getFileContext(at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    where.rename(where.makeQualified(beside), where.makeQualified(at), options)


def write_stats(stats: DataFrame, path: str) -> None:
    """A one-row frame as one JSON document."""
    write_document(stats.sparkSession, path, json.dumps(stats.toPandas().iloc[0].to_dict(), ensure_ascii=False, indent=2, default=lambda v: v.item()))


def write_progress(spark: SparkSession, path: str, done: int, total: int, **more) -> None:
    """How far a run is, for whoever polls the file."""
    write_document(spark, path, json.dumps({"running": done < total, "done": done, "total": total, **more}, ensure_ascii=False))


def died(rows: DataFrame, order: list, failed, in_a_row: int = 2) -> bool:
    """Whether so many rows failed one after another, in the given order."""
    bad = sampling.ranked(rows, order).filter(failed).select("rank")
    for k in range(1, in_a_row):
        bad = bad.join(bad.select((F.col("rank") - k).alias("rank")), "rank", "left_semi")
    return bad.limit(1).count() > 0


def write_unless_died(rows: DataFrame, path: str, order: list, failed, text) -> bool:
    """Writes the report `text(rows)` over the old one, unless the run died: then the old one stays and False comes back."""
    if died(rows, order, failed):
        return False
    write_document(rows.sparkSession, path, text(rows))
    return True


def keep_newest(spark: SparkSession, folder: str, keep: int = 5) -> list[str]:
    """Removes all but the last files, by name, of a report folder at any path that Spark knows; returns what went."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted((s.getPath() for s in fs.listStatus(at) if s.isFile()), key=lambda p: p.getName())[: -keep or None]
    for p in old:
        fs.delete(p, False)
    return [p.getName() for p in old]


def safe_files(rows: DataFrame, root: str) -> DataFrame:
    """Rows (path, code) with `target` under a folder: leading slashes go, paths that climb are left out."""
    path = F.regexp_replace(F.translate("path", "\\", "/"), "^/+", "")
    return rows.withColumn("target", F.concat(F.lit(root.rstrip("/") + "/"), path)).filter(~F.contains(path, F.lit("..")))


def write_files(rows: DataFrame, root: str) -> int:
    """Writes rows (path, code) as files under a folder, each with a line end; of rows with one path the last by code stays. Returns how many.

    The rows are the files of a few answers: they pass the driver one at a time.
    """
    files = safe_files(rows, root).groupBy("target").agg(F.max("code").alias("code"))
    n = 0
    for r in files.toLocalIterator():
        write_document(rows.sparkSession, r["target"], r["code"] + "\n")
        n += 1
    return n
