"""Streams against batch results: replays, crashes before a commit, late rows, restarts; and mergeable state."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomwork.operators import sketches
from loomwork.streaming import commit, first, prep, sessions

MINUTE = 60_000_000
START = datetime(2024, 1, 1)


def arriving(spark, tmp_path, batches, schema, run):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/{k}")
        run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"))


def test_batches_count_once(spark, tmp_path):
    ledger = commit.BatchLedger(spark, str(tmp_path / "t"))
    take = commit.exactly_once(ledger, "rows")
    one = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    seen = lambda: sorted(r["k"] for r in ledger.read("rows", "k long").collect())
    assert seen() == [] and ledger.last() == {"batch": -1}
    take(one(1, 1, 2), 0)
    ledger.write("rows", one(9), 1)  # an attempt that never committed
    assert seen() == [1, 1, 2]
    take(one(3), 1)
    take(one(7), 0)
    take(one(8), 1)
    assert seen() == [1, 1, 2, 3] and ledger.part("rows", 1, "k long").count() == 1 and ledger.part("rows", 5, "k long").count() == 0


def test_a_stream_that_fails_half_way_goes_on(spark, tmp_path):
    ledger, tries = commit.BatchLedger(spark, str(tmp_path / "t")), []
    take = commit.exactly_once(ledger, "rows")

    def fails_first(rows, batch):
        tries.append(batch)
        if len(tries) == 2:
            ledger.write("rows", rows, batch)
            raise RuntimeError("lost")
        take(rows, batch)

    def run(stream):
        try:
            commit.run_batches(stream, fails_first, str(tmp_path / "state"))
        except Exception:
            commit.run_batches(stream, fails_first, str(tmp_path / "state"))

    arriving(spark, tmp_path, [[(1,), (2,)], [(3,)], [(4,)]], "k long", run)
    assert sorted(r["k"] for r in ledger.read("rows", "k long").collect()) == [1, 2, 3, 4] and tries == [0, 1, 1, 2]


def sessions_by_hand(rows, gap):
    by = defaultdict(list)
    for k, at, v in rows:
        by[k].append((at, v))
    out = []
    for k, items in by.items():
        now = None
        for at, v in sorted(items):
            if now is None or at - now[2] >= gap:
                now = [k, at, at, 0, 0]
                out.append(now)
            now[2], now[3], now[4] = at, now[3] + 1, now[4] + v
    return sorted(map(tuple, out), key=repr)


def test_sessions_merge_over_batches_and_count_late_rows_apart(spark, tmp_path):
    random.seed(5)
    gap, delay = 10, 30
    batches = []
    for k in range(4):
        base = 100 * k
        rows = [(random.choice(["a", "a", "b", None]), START + timedelta(minutes=base + random.randint(-25, 100)), random.randint(0, 5)) for _ in range(60)]
        batches.append(rows + [("a", START + timedelta(minutes=base + 100), 1), ("b", START - timedelta(days=1), 7), ("b", None, 7)])
    ledger = commit.BatchLedger(spark, str(tmp_path / "t"))
    take = sessions.sessions(ledger, {"k": F.col("k")}, F.col("at"), F.col("v"), gap * MINUTE, delay * MINUTE)
    arriving(spark, tmp_path, batches, "k string, at timestamp, v long", lambda s: commit.run_batches(s, take, str(tmp_path / "state")))
    mark, kept, late = None, [], []
    for rows in batches:
        for r in rows:
            (late if r[1] is None or (mark and r[1] < mark) else kept).append(r)
        mark = max([r[1] for r in rows if r[1]] + ([mark + timedelta(minutes=delay)] if mark else [])) - timedelta(minutes=delay)
    closed, left, too_late = sessions.results(ledger)
    plain = lambda df: [(r["k"], r["first_at"], r["last_at"], r["n"], int(r["total"])) for r in df.collect()]
    assert sorted(plain(closed) + plain(left), key=repr) == sessions_by_hand(kept, timedelta(minutes=gap))
    assert all(r[2] + timedelta(minutes=gap) <= mark for r in plain(closed)) and all(r[2] + timedelta(minutes=gap) > mark for r in plain(left))
    assert sorted(map(repr, ((r["k"], r["at"], int(r["value"])) for r in too_late.collect()))) == sorted(map(repr, late))
    take(spark.createDataFrame(batches[0], "k string, at timestamp, v long"), 0)  # a replay
    assert sessions.results(ledger)[2].count() == len(late)


def test_stretches_combine_a_hot_key(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("k"), F.timestamp_micros(F.col("id") * 1000 - 2_500_000).alias("at"), F.lit(1).alias("value"))
    parts = sessions.stretches(rows, ["k"], 1_000_000)
    assert parts.count() == 6 and sessions.merged(parts, ["k"], 1_000_000).count() == 1


def test_first_of_key_equals_batch_after_restarts(spark, tmp_path):
    random.seed(6)
    rows = [(random.choice(["x", "y", "z", None]), k % 40, START + timedelta(minutes=k + random.randint(-20, 20)), k) for k in range(400)]
    batches = [rows[:150], rows[150:300], rows[300:] + [("end", 0, START + timedelta(days=9), 999)]]
    schema = "a string, b long, at timestamp, id long"

    def run(stream):
        kept = first.first_of_key(stream, ["a", "b"], "at", ["id"], "2 hours")
        first.start(spark, kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True)).awaitTermination()

    arriving(spark, tmp_path, batches, schema, run)
    want = {}
    for r in rows:
        if (r[0], r[1]) not in want or (r[2], r[3]) < (want[r[0], r[1]][2], want[r[0], r[1]][3]):
            want[r[0], r[1]] = r
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=repr) == sorted(want.values(), key=repr)


def test_without_duplicates_within_a_watermark(spark, tmp_path):
    rows = [(k % 3, START + timedelta(minutes=k)) for k in range(30)]

    def run(stream):
        prep.run_to_end(prep.without_duplicates(stream, "at", ["k"], "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state")

    arriving(spark, tmp_path, [rows, rows], "k long, at timestamp", run)
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2]


def test_sketches_keep_their_bounds_however_they_are_merged(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 20_000).alias("item"), (F.col("id") * 7919 % 60_000).alias("v"), (F.col("id") % 5).alias("batch"))
    rows = rows.unionByName(spark.createDataFrame([(None, None, None, 0)] * 2, "g long, item long, v long, batch long"))
    parts = None
    for k in range(5):
        p = sketches.state(rows.filter(F.col("batch") == k), ["g"], F.col("item"), F.col("v"))
        parts = p if parts is None else parts.unionByName(p)
    got = {r["g"]: r for r in sketches.report(sketches.merged(parts, ["g"]), [0.1, 0.5, 0.9]).collect()}
    assert set(got) == {0, 1, 2, None} and got[None]["n"] == 2 and got[None]["quantiles"] is None and got[None]["distinct"] == 0
    true = defaultdict(list)
    for r in rows.filter("g is not null").collect():
        true[r["g"]].append((r["item"], r["v"]))
    for g, items in true.items():
        n = len({i for i, _ in items})
        assert got[g]["n"] == len(items) and got[g]["total"] == sum(v for _, v in items) and abs(got[g]["distinct"] - n) <= sketches.DISTINCT_ERROR * n
        for share, q in zip([0.1, 0.5, 0.9], got[g]["quantiles"]):
            assert abs(sum(v <= q for _, v in items) / len(items) - share) <= sketches.RANK_ERROR
    all_in_one = sketches.merged(sketches.merged(parts, ["g"]).select(F.lit("all").alias("x"), "n", "total", "items", "sizes"), ["x"])
    assert sketches.report(all_in_one, [0.5]).first()["n"] == 60_002
    with pytest.raises(Exception):
        sketches.merged(parts, ["none"]).count()
