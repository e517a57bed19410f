"""Tables between steps: written to the folder that the driver and all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Delta encodings and zstd: tables between stages take about a third less disk.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. One of our own only where none is set and all runs on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="loomwork-")
        where = _own_dirs[app]
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/loomwork/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: later stages survive lost executors without recomputing."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.options(**PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(rows: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `rows` is called so."""
    taken, out = {c.lower() for c in rows.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
