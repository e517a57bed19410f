"""Queries that run streams over the tables to their end, in several sittings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import commit, first, sessions
from ..tables import fresh_dir
from .queries import query, t

HOUR = 3_600_000_000
SITTINGS = 4
GAP, DELAY = 12 * HOUR, 6 * HOUR
LATE = "5 days"


def arrivals(s, d, place, sittings=SITTINGS):
    """Events with the sitting they arrive in: `place` is their place in the order of arrival."""
    rows = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = rows.count()
    at = place(F.col("event_id"))
    return rows.withColumn("sitting", F.greatest(F.lit(0), F.least(F.lit(sittings - 1), F.floor(at * sittings / max(1, n)))).cast("int"))


def in_sittings(s, rows, run, sittings=SITTINGS):
    """Writes each sitting's rows to a folder that a stream reads and calls `run(stream)`, which goes on where it ended before."""
    where = fresh_dir(s, "arrivals")
    for k in range(sittings):
        rows.filter(F.col("sitting") == k).drop("sitting").write.mode("append").parquet(f"{where}/{k}")
        run(s.readStream.schema(rows.drop("sitting").schema).parquet(f"{where}/*"))


@query
def sessions_with_late_rows(s, d):
    """Each user's sessions of a stream in four sittings, and the rows that came too late"""
    where = fresh_dir(s, "sessions")
    ledger = commit.BatchLedger(s, f"{where}/tables")
    take = sessions.sessions(ledger, {"user_id": F.col("user_id")}, F.col("ts"), F.round("value", 2), GAP, DELAY)
    late = lambda k: k + F.when(k % 37 == 5, 100_000_000).otherwise(0)  # noqa: E731  (arrives in the last sitting)
    in_sittings(s, arrivals(s, d, late), lambda stream: commit.run_batches(stream, take, f"{where}/state"))
    closed, left, too_late = sessions.results(ledger)
    both = closed.withColumn("kind", F.lit("closed")).unionByName(left.withColumn("kind", F.lit("open")))
    gone = too_late.select("user_id", F.col("at").alias("first_at"), F.col("at").alias("last_at"), F.lit(1).cast("long").alias("n"), F.col("value").alias("total"), F.lit("late").alias("kind"))
    return both.unionByName(gone).select("kind", "user_id", F.unix_micros("first_at").alias("first_at"), F.unix_micros("last_at").alias("last_at"), "n", (F.col("total") * 100).cast("long").alias("cents"))


@query
def first_events_of_a_stream(s, d):
    """The first event of each user and type, of a stream out of order that is stopped and started again"""
    where = fresh_dir(s, "firsts")

    def run(stream):
        rows = first.first_of_key(stream.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", ["event_id"], LATE)
        first.start(s, rows.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True)).awaitTermination()

    in_sittings(s, arrivals(s, d, lambda k: k + k * 7919 % 50, 2), run, 2)
    return s.read.parquet(f"{where}/out").select("user_id", "event_type", "event_id")


@query
def events_written_once(s, d):
    """A sink whose batches are replayed and half-written; totals by type"""
    where = fresh_dir(s, "once")
    ledger = commit.BatchLedger(s, f"{where}/table")
    take = commit.exactly_once(ledger, "events", lambda rows: rows.select("event_id", "event_type", "value"))

    def run(stream):
        last = ledger.last()["batch"]
        junk = s.range(50).selectExpr("id as event_id", "'junk' as event_type", "0D as value")
        ledger.write("events", junk, last + 1)  # as an attempt that died before its commit leaves it
        commit.run_batches(stream, take, f"{where}/state")
        take(junk, ledger.last()["batch"])  # a replay

    in_sittings(s, arrivals(s, d, lambda k: k), run)
    got = ledger.read("events", "event_id long, event_type string, value double")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
