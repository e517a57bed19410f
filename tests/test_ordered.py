"""Ordered computations against brute force: hot keys over many ranges, nulls, ties, empty tables, and their plans."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomwork.operators import bags, dedup, intervals, quantiles, sampling, scans
from loomwork.sources import sinks
from loomwork.tables import unused


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_statistics_by_counting(spark):
    random.seed(1)
    values = [random.choice([0, 1, 5, -7, 2**62, -(2**63), 2**63 - 1, random.randint(-(10**12), 10**12)]) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(5)
    places = [0, 1, 17, 1500, 2998, 2999]
    facts, got = quantiles.order_statistics(rows, "v", lambda n: places)
    assert got == [sorted(values)[p] for p in places] and facts == {"n": 3000, "sum": sum(values), "min": min(values), "max": max(values)}
    assert [r["value"] for r in quantiles.quantiles(rows, "v", [0.0, 0.5, 1.0]).collect()] == [sorted(values)[p] for p in (0, 1500, 2999)]
    assert quantiles.quantiles(rows.limit(0), "v", [0.5]).count() == 0 and sampling.nearest_rank(rows.limit(0), "v").count() == 0
    assert sampling.nearest_rank(spark.createDataFrame([(7,)] * 4, "v long"), "v").first() == (4, 7.0, 7, 7, 7)
    with pytest.raises(ValueError):
        quantiles.order_statistics(rows, "v", lambda n: [n])


def events(seed, n=600):
    random.seed(seed)
    start = datetime(2024, 1, 1)
    return [(k, random.choice([1, 1, 1, 1, 2, 3, None]), start + timedelta(minutes=random.randint(0, 300)), random.choice([None, random.randint(-5, 9)])) for k in range(n)]


@pytest.mark.parametrize("parts", [9])
def test_running_values_over_ranges_of_a_hot_key(spark, parts):
    rows = events(2)
    df = spark.createDataFrame(rows, "id long, k long, at timestamp, v long").withColumn("_part", F.lit("own")).repartition(4)
    folds = {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "last": ("last", F.col("v"))}
    for by in ((), ("k",)):
        want, seen = {}, defaultdict(list)
        for r in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0) if by else 0, r[2], r[0])):
            seen[r[1] if by else 0].append(r[3])
            have = [v for v in seen[r[1] if by else 0] if v is not None]
            want[r[0]] = (sum(have), max(have), min(have), have[-1]) if have else (None,) * 4
        got = scans.running(df, [*by, "at", "id"], folds, by, parts).collect()
        assert {r["id"]: (r["s"], r["hi"], r["lo"], r["last"]) for r in got} == want and len(got) == len(rows) and got[0]["_part"] == "own"
    assert scans.running(df.limit(0), ["id"], folds).count() == 0


@pytest.mark.parametrize("parts", [9])
def test_as_of_join(spark, parts):
    left, right = events(3), events(4, 300)
    base = datetime(2024, 1, 1)
    left += [(9000, 1, None, 1), (9001, 1, base - timedelta(days=1), 1), left[0]]
    right += [(7000, 1, None, 5), right[0]]
    a = spark.createDataFrame(left, "id long, k long, at timestamp, v long")
    b = spark.createDataFrame(right, "rid long, k long, seen timestamp, w long")
    want = []
    for i, k, at, v in left:
        near = [(seen, rid, w) for rid, rk, seen, w in right if k is not None and rk == k and at is not None and seen is not None and seen <= at]
        best = max(near, key=lambda x: x[:2]) if near else None
        want.append((i, k, at, v, *(best[1:] if best else (None, None))))
    got = scans.as_of(a, b, ["k"], "at", "seen", ["rid", "w"], parts=parts)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    near = scans.as_of(a, b, ["k"], "at", "seen", ["rid"], F.expr("interval 2 minutes"), parts).filter("rid is not null").count()
    by_id = {r[0]: r[2] for r in right}
    assert near == sum(1 for w in want if w[4] is not None and w[2] - by_id[w[4]] <= timedelta(minutes=2))
    assert scans.as_of(a.limit(0), b, ["k"], "at", "seen", ["rid"]).count() == 0
    assert scans.as_of(a, b.limit(0), ["k"], "at", "seen", ["rid"]).filter("rid is null").count() == len(left)
    with pytest.raises(ValueError):
        scans.as_of(a, b.withColumnRenamed("w", "v"), ["k"], "at", "seen", ["v"])


@pytest.mark.parametrize("parts,minutes", [(12, 10), (12, 200), (3, 0)])
def test_moving_sums_with_halos(spark, parts, minutes):
    rows = events(5) + [(8000, 1, None, 4), (8001, 1, None, 6)]
    df = spark.createDataFrame(rows, "id long, k long, at timestamp, v long")
    span = timedelta(minutes=minutes)
    got = scans.moving(df, ["k"], "at", minutes * 60_000_000, {"n": F.lit(1).cast("long"), "s": F.col("v")}, parts).collect()
    assert len(got) == len(rows)
    for r in got:
        near = [x for x in rows if x[1] == r["k"] and ((x[2] is None and r["at"] is None) or (x[2] is not None and r["at"] is not None and r["at"] - span <= x[2] <= r["at"]))]
        have = [x[3] for x in near if x[3] is not None]
        assert r["n"] == len(near) and r["s"] == (sum(have) if have else None)


@pytest.mark.parametrize("width", [4, 1000])
def test_interval_join_finds_each_pair_once(spark, width):
    random.seed(width)
    def spans(n):
        out = []
        for k in range(n):
            a = random.randint(-500, 500)
            out.append((k, random.choice([1, 1, None, 2]), a, a + random.choice([0, 0, 3, 16, 17, 400, -2])))
        return out + [(n, 1, None, 4), (n + 1, 1, 0, None), out[0]]
    left, right = spans(200), spans(150)
    a = spark.createDataFrame(left, "l long, lk long, la long, lb long")
    b = spark.createDataFrame(right, "r long, rk long, ra long, rb long")
    ok = lambda s: s[2] is not None and s[3] is not None and s[2] <= s[3]
    for by in ([], [("lk", "rk")]):
        joined = intervals.overlaps(a, b, ("la", "lb"), ("ra", "rb"), width, by)
        want = Counter((x[0], y[0]) for x in left for y in right if ok(x) and ok(y) and x[2] <= y[3] and y[2] <= x[3] and (not by or (x[1] is not None and x[1] == y[1])))
        assert Counter((r["l"], r["r"]) for r in joined.collect()) == want
        assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)
    assert intervals.overlaps(a.limit(0), b, ("la", "lb"), ("ra", "rb"), width).count() == 0


def test_sampling_without_replacement(spark):
    rows = [("big", k % 500, k % 3 + 1) for k in range(3000)] + [("few", k, 1) for k in range(4)] + [(None, 5, 1), ("big", None, 1), ("few", 9, 0), ("few", 8, None)]
    df = spark.createDataFrame(rows, "g string, id long, w int").repartition(3)
    drawn = sampling.without_replacement(df, "g", "id", 20)
    got = drawn.collect()
    sizes = Counter(r["g"] for r in got)
    assert sizes == {"big": 20, "few": 6, None: 1} and len({(r["g"], r["id"]) for r in got}) == 27
    assert sorted(r["place"] for r in got if r["g"] == "big") == list(range(1, 21))
    before = plan(drawn)
    assert before.count("WindowGroupLimit") >= 2 and "Partial" in before
    by_weight = sampling.without_replacement(df, "g", "id", 20, weight=F.col("w"))
    assert Counter(r["g"] for r in by_weight.collect()) == {"big": 20, "few": 4, None: 1}
    heavy = spark.range(2000).select(F.lit("g").alias("g"), "id", F.when(F.col("id") < 1000, 9.0).otherwise(1.0).alias("w"))
    share = sampling.without_replacement(heavy, "g", "id", 500, weight=F.col("w")).filter("id < 1000").count()
    assert 420 < share < 490  # about 0.9 by weight, fewer as the heavy ones run out
    slots = spark.range(300).select(sampling.picks(["a", "b", "c", "d"], 3, 1, "s", "id").alias("x")).collect()
    assert all(len(set(r["x"])) == 3 for r in slots) and len({tuple(r["x"]) for r in slots}) == 24


def test_bags(spark):
    random.seed(3)
    pick = lambda n: [(random.choice([1, 2, None]), random.choice(["x", None, ""])) for _ in range(n)]
    a, b = pick(200), pick(120)
    x, y = (spark.createDataFrame(r, "k long, row string") for r in (a, b))
    for got, want in ((bags.difference(x, y), Counter(a) - Counter(b)), (bags.intersection(x, y), Counter(a) & Counter(b))):
        assert Counter(map(tuple, got.collect())) == want
    changed = {tuple(r)[:2]: r["change"] for r in bags.changes(x, y).collect()}
    assert changed == {k: Counter(b)[k] - Counter(a)[k] for k in {*a, *b} if Counter(b)[k] != Counter(a)[k]}
    assert Counter(map(tuple, bags.difference(x, y.select("row", "k").limit(0)).collect())) == Counter(a)
    with pytest.raises(ValueError):
        bags.difference(x, y.select("k"))


def test_keep_first_of_null_keys_and_orders(spark):
    rows = [(None, "b", 1), ("x", "a", 2), ("x", None, 3), ("y", "c", 4), (None, "a", 5), ("", "a", 6), ("z", "q", 7), ("z", "q", 8)]
    df = spark.createDataFrame(rows, "_key string, _first0 string, n int")
    assert sorted(r["n"] for r in dedup.keep_first(df, F.col("_key"), ["_first0"]).collect()) == [3, 4, 5, 6, 7, 8]
    assert sorted(r["n"] for r in dedup.keep_first(df, F.col("_key"), ["_first0", "n"]).collect()) == [3, 4, 5, 6, 7]
    assert dedup.keep_first(df.limit(0), F.col("_key"), ["n"]).count() == 0
    assert unused(df, "_key", "n", "m") == ["__key", "_n", "m"]


def test_rows_without_a_key_are_all_appended(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (None, 1), ("", 2), ("", 2), ("a#1", 3), ("a#2", 3), ("b", 4)], "id string, k int")
    assert sinks.append_new(df, str(tmp_path / "out")) == 2 + 1 + 2 + 1
    assert sinks.append_new(df, str(tmp_path / "out")) == 2
    got = Counter(tuple(r) for r in spark.read.schema("id string, k int").json(str(tmp_path / "out")).collect())
    assert got == {(None, 1): 4, ("", 2): 1, ("a#1", 3): 1, ("a#2", 3): 1, ("b", 4): 1}


def test_documents_are_replaced_in_one_step(spark, tmp_path):
    for text in ("one", "two"):
        sinks.write_document(spark, str(tmp_path / "r.txt"), text)
    assert (tmp_path / "r.txt").read_text() == "two" and [p.name for p in tmp_path.iterdir() if p.suffix == ".tmp"] == []
