"""Keep-first on a stream, in event order: arbitrary state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..shipping import ship
from ..tables import unused

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _First(StatefulProcessor):
    """Per key the first row seen so far, until the watermark has passed it; then it comes out and the key is done.

    One state of each key, as every access is a call to the JVM. A row that gives way to an earlier one leaves its
    timer behind: it is the later one, and finds the key done. Times are micros.
    """

    def __init__(self, schema: StructType, order: list[int], at: int) -> None:
        self.schema, self.order, self.at = schema, order, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", StructType([*self.schema.fields, StructField("done", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = self.first.get()
        if state is None or not state[-1]:
            before = None if state is None else tuple(state)[:-1]
            names = self.schema.names
            place = lambda r: tuple((r[i] is not None, r[i]) for i in self.order)
            best = min((tuple(r[n] for n in names) for r in rows), key=place, default=None)
            if best is not None and (before is None or place(best) < place(before)):
                self.first.update((*best, False))
                self.handle.registerTimer(best[self.at] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state = self.first.get()
        if state is None or state[-1]:
            return iter(())
        row = tuple(state)[:-1]
        self.first.update((*[v if i == self.at else None for i, v in enumerate(row)], True))
        return iter((Row(**dict(zip(self.schema.names, row))),))

    def close(self) -> None:
        pass


def _combined(stream: DataFrame, key: list[str], order: list[str], at: str) -> DataFrame:
    """Of each Arrow batch the first row of each key and the latest row: a hot key is few rows when it is shuffled, and the watermark moves on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b]).sort_by([(o, "ascending") for o in order])
            seen, keep = set(), []
            for i, k in enumerate(zip(*[table[c].to_pylist() for c in key])):
                if k not in seen or i == table.num_rows - 1:
                    seen.add(k)
                    keep.append(i)
            yield from table.take(keep).combine_chunks().to_batches()

    return stream.mapInArrow(run, stream.schema)


def first_of_key(stream: DataFrame, key: list[str], at: str, tie: list[str], late: str) -> DataFrame:
    """A stream of the first row of each key, by time and then by `tie`, as batch keep-first gives it.

    A row comes out once the watermark (the largest time seen less `late`) has passed its time, as an earlier one
    could still come before; rows later than the watermark are dropped. Later rows of a key that is done are ignored:
    a key that is done keeps its time only. Rows without a time are left out; null is a key. State and timers are the
    stream's checkpoint, so a restart goes on where the stream ended. Start it by `start`: it needs the RocksDB store.
    """
    ship(stream.sparkSession)
    order = [at, *tie]
    rows = _combined(stream.filter(f"`{at}` is not null"), key, order, at).withWatermark(at, late)
    micros = unused(rows, "_micros")[0]
    kept = StructType([StructField(micros, LongType()) if f.name == at else StructField(f.name, f.dataType) for f in rows.schema.fields])
    places = [kept.names.index(micros if o == at else o) for o in order]
    timed = rows.withColumn(micros, F.unix_micros(at))
    out = timed.groupBy(*key).transformWithState(_First(kept, places, places[0]), kept, "append", "eventTime")
    return out.select(*[F.timestamp_micros(micros).alias(at) if c == at else F.col(f"`{c}`") for c in rows.columns])


def start(spark: SparkSession, writer):
    """Starts a stream's writer with the state store that arbitrary state needs, and leaves the session as it was."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.set(STATE_STORE, before)
