"""A sink that takes each micro-batch once, however often it is replayed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import existing
from ..sources.sinks import write_document

_BATCH = "_batch"


class BatchLedger:
    """Tables under one folder, a part per micro-batch, and the number of the last batch that is complete.

    A batch's parts are written first, each over what a failed attempt left; then one small file is replaced in one
    step, which makes them count. Readers take the parts up to that number only. So a batch that fails half-way isn't
    seen, and one that is replayed is skipped or written anew with the same rows. The folder goes with one stream
    checkpoint: batches are numbered by it. What is kept about batches doesn't grow with their number.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def last(self) -> dict:
        """What was committed last: `batch` (-1 before the first) and whatever else came with it."""
        path = f"{self.root}/last.json"
        row = self.spark.read.text(path, wholetext=True).first() if existing(self.spark, path) else None
        return json.loads(row["value"]) if row else {"batch": -1}

    def write(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/{_BATCH}={batch}")

    def commit(self, batch: int, **more) -> None:
        write_document(self.spark, f"{self.root}/last.json", json.dumps({"batch": batch, **more}))

    def read(self, name: str, schema: str) -> DataFrame:
        """The rows of all complete batches, without those of a batch under way."""
        if not existing(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, {_BATCH} long").parquet(f"{self.root}/{name}")
        return rows.filter(F.col(_BATCH) <= self.last()["batch"]).drop(_BATCH)

    def part(self, name: str, batch: int, schema: str) -> DataFrame:
        """One batch's rows alone; none if it has no such part."""
        path = f"{self.root}/{name}/{_BATCH}={batch}"
        return self.spark.read.schema(schema).parquet(path) if existing(self.spark, path) else self.spark.createDataFrame([], schema)


def exactly_once(ledger: BatchLedger, name: str, made: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: each batch's rows, as `made`, into the table `name`."""

    def take(rows: DataFrame, batch: int) -> None:
        if batch <= ledger.last()["batch"]:
            return
        ledger.write(name, made(rows), batch)
        ledger.commit(batch)

    return take


def run_batches(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands all that is there to `take` and stops; a rerun goes on where this one ended, from its last batch that didn't end."""
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
