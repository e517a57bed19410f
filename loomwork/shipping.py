"""Sends this package to the executors, so that Python workers find it wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of a batch handed to Python at a time: 10,000 long texts would fill a worker's memory.
ARROW_BATCH_BYTES = 16 << 20
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package's sources as a zip file, fetched by each executor from the driver.

    The installed package is only read, so it may be on a read-only file system.
    """
    app = spark.sparkContext.applicationId
    if app not in _sent:
        target, here = Path(tempfile.mkdtemp(prefix="loomwork-")) / "loomwork.zip", Path(__file__).parent
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(here.rglob("*.py")):
                z.write(source, source.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(target))
        _sent.add(app)


def tune(spark: SparkSession) -> None:
    """For plans with Python code: sends the package to the executors and bounds Arrow batches by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
