"""Exact order statistics by counting: histograms with prefix sums, no sort of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A round splits what is still in question into at most so many halvings, i.e. 2**16 buckets or one more.
ROUND_BITS = 16


def order_statistics(rows: DataFrame, value: str, places: Callable[[int], list[int]]) -> tuple[dict, list[int]]:
    """(facts, values): count, sum, least and largest of a long column, and the values at the places, counted from 0 in ascending order.

    `places` maps the count to the places asked for; nulls don't count, and without rows there are no values. A first
    pass takes the facts. Each further one counts rows by bucket (their high bits) in the intervals that the places
    lie in, combined before the shuffle, and a prefix sum over at most 2**16 + 1 buckets an interval finds each
    place's bucket, which is the next pass's interval. A range of 2**16 values takes one such pass, all longs four.
    """
    v = F.col(value).cast("long")
    given = rows.select(v.alias("v")).filter("v is not null")
    n, total, low, high = given.agg(F.count("v"), F.sum(F.col("v").cast("decimal(38,0)")), F.min("v"), F.max("v")).first()
    facts = {"n": n, "sum": total, "min": low, "max": high}
    wanted = places(n) if n else []
    if any(not 0 <= p < n for p in wanted):
        raise ValueError("a place is from 0 to the count less one")
    state = {p: (low, high, p) for p in wanted}  # place: the interval it lies in, and the place within it
    while any(a < b for a, b, _ in state.values()):
        spans = sorted({(a, b) for a, b, _ in state.values() if a < b})
        shifts = [max(0, (b - a).bit_length() - ROUND_BITS) for a, b in spans]
        span, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, ((a, b), shift) in enumerate(zip(spans, shifts)):
            inside = F.col("v").between(a, b)
            span, bucket = F.when(inside, i).otherwise(span), F.when(inside, F.shiftright("v", shift)).otherwise(bucket)
        counts = given.select(span.alias("i"), bucket.alias("b")).filter("i is not null").groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"))
        sums = counts.withColumn("to", F.sum("n").over(Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
        asked = {p: (spans.index((a, b)), k) for p, (a, b, k) in state.items() if a < b}
        hit = F.lit(False)
        for i, k in asked.values():
            hit |= (F.col("i") == i) & (F.col("to") > k) & (F.col("to") - F.col("n") <= k)
        found = sums.filter(hit).collect()  # one row for each place at most
        for p, (i, k) in asked.items():
            r = next(r for r in found if r["i"] == i and r["to"] - r["n"] <= k < r["to"])
            (a, b), shift = spans[i], shifts[i]
            state[p] = max(a, r["b"] << shift), min(b, ((r["b"] + 1) << shift) - 1), k - (r["to"] - r["n"])
    return facts, [state[p][0] for p in wanted]


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, value): the entries number floor(n * share) counted from 0, the last for 1; no rows give no values."""
    place = lambda n: [min(n - 1, int(n * q)) for q in shares]
    _, found = order_statistics(rows, value, place)
    return rows.sparkSession.createDataFrame(list(zip(map(float, shares), found)), "share double, value long")
