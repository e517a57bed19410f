"""Sessions of a stream: state that merges under a watermark, with late rows counted apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut
from .commit import BatchLedger

SESSION = "{key}, first_at timestamp, last_at timestamp, n long, total decimal(38,6)"
LATE = "{key}, at timestamp, value decimal(38,6)"


def merged(parts: DataFrame, key: list[str], gap: int) -> DataFrame:
    """Sessions of parts (key, first_at, last_at, n, total): parts less than `gap` microseconds apart are one.

    Per key there are as many parts as stretches of `gap` at most, plus those that are open.
    """
    us = lambda c: F.unix_micros(F.col(c))
    w = Window.partitionBy(*key).orderBy("first_at", "last_at").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(us("first_at") - F.max(us("last_at")).over(w) >= gap, F.lit(True))
    to_here = Window.partitionBy(*key).orderBy("first_at", "last_at").rowsBetween(Window.unboundedPreceding, 0)
    told = parts.withColumn("_new", new.cast("int")).withColumn("_session", F.sum("_new").over(to_here))
    return told.groupBy(*key, "_session").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n"), F.sum("total").cast("decimal(38,6)").alias("total")).drop("_session")


def stretches(rows: DataFrame, key: list[str], gap: int) -> DataFrame:
    """Rows (key, at, value) as parts: what lies in one stretch of `gap` is surely one session, so a hot key is combined before the shuffle."""
    stretch = F.expr(f"unix_micros(at) div {gap}") - (F.unix_micros("at") < 0).cast("long")
    return rows.groupBy(*key, stretch.alias("_stretch")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"), F.sum("value").cast("decimal(38,6)").alias("total")).drop("_stretch")


def sessions(ledger: BatchLedger, key: dict[str, Column], at: Column, value: Column, gap: int, delay: int) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: tables `closed`, `open` and `late` of the ledger.

    A session of a key ends when no row comes for `gap` microseconds. The watermark is the largest time of all
    earlier batches less `delay`. Rows before it are late: they go to `late` and change no session. A session whose
    end lies at or before the new watermark is closed: no row can join it any more. Others are the state: they are
    written with the batch and merge with the next one's rows. Rows without a time are late; null is a key.
    The batch's tables count from its commit on, together with its watermark, so a replay changes nothing.
    """
    names = list(key)

    def take(batch: DataFrame, number: int) -> None:
        last = ledger.last()
        if number <= last["batch"]:
            return
        rows = cut(batch.select(*[c.alias(n) for n, c in key.items()], at.cast("timestamp").alias("at"), value.cast("decimal(38,6)").alias("value")), "session-batch")
        kinds = ", ".join(f"`{n}` {k}" for n, k in rows.select(*names).dtypes)
        mark, newest = last.get("watermark"), rows.agg(F.max(F.unix_micros("at"))).first()[0]
        in_time = F.col("at").isNotNull() & (F.lit(True) if mark is None else F.unix_micros("at") >= mark)
        moved = max([m for m in (mark, None if newest is None else newest - delay) if m is not None], default=None)
        before = ledger.part("open", last["batch"], SESSION.format(key=kinds))
        now = cut(merged(stretches(rows.filter(in_time), names, gap).unionByName(before), names, gap), "session-state")
        over = F.lit(False) if moved is None else F.unix_micros("last_at") + gap <= moved
        ledger.write("closed", now.filter(over), number)
        ledger.write("open", now.filter(~over), number)
        ledger.write("late", rows.filter(~in_time), number)
        ledger.commit(number, watermark=moved, keys=kinds)

    return take


def results(ledger: BatchLedger) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(closed sessions, sessions still open, late rows) of the batches up to the last commit."""
    last = ledger.last()
    kinds = last.get("keys", "key string")
    schema = SESSION.format(key=kinds)
    return ledger.read("closed", schema), ledger.part("open", last["batch"], schema), ledger.read("late", LATE.format(key=kinds))
