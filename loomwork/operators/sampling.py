"""Ranking, sampling, splitting and batching in deterministic orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import quantiles, scans


def top_per_group(rows: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """The first `cap` rows of each group."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rn") <= cap).drop("_rn")


def balanced(rows: DataFrame, target: int, group: str, turns: str, score: str, key: str, n_groups: int | None = None) -> DataFrame:
    """All rows of several turns; of the rest the best of each group, and overall no more than the target if it can be met."""
    multi, single = rows.filter(F.col(turns) > 1), rows.filter(F.col(turns) == 1)
    n_multi = multi.count()
    cap = max(1, (target - n_multi) // max(1, n_groups or rows.select(group).distinct().count()))
    picked = top_per_group(single, group, [F.desc(score), key], cap)
    return multi.unionByName(picked.orderBy(F.desc(score), key).limit(max(0, target - n_multi)))


def hash_split(rows: DataFrame, key: str, seed: int = 42, val_share: float = 0.1) -> DataFrame:
    return rows.withColumn("split", F.when(T.split_bucket(seed, key) < val_share * 1000, "validation").otherwise("train"))


def ranked(rows: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """`rank` from 1 in a global order, without one task for all rows: ranges are sorted apart and shifted by their predecessors' sizes.

    The ranges are written once, as sizes and places must come from the same ones.
    """
    r = scans.ranges(rows, order, parts)
    local = r.rows.withColumn("_rn", F.col(r.at) - F.shiftleft(F.col(r.part).cast("long"), 33) + 1)
    sizes = local.groupBy(r.part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(r.part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    return local.join(F.broadcast(before.select(r.part, "_before")), r.part).withColumn("rank", (F.col("_rn") + F.col("_before")).cast("long")).drop(r.part, r.at, "_rn", "_before")


def shuffled(key: str, seed: int = 42) -> list:
    """A deterministic random order."""
    return [F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), F.col(key)]


def slice_split(rows: DataFrame, key: str, seed: int = 42, share: float = 0.05) -> DataFrame:
    """Validation, test and train by place in a hashed order: floor(n * share) rows each for the first two."""
    n = int(rows.count() * share)
    return ranked(rows, shuffled(key, seed)).withColumn("split", F.when(F.col("rank") <= n, "validation").when(F.col("rank") <= 2 * n, "test").otherwise("train")).drop("rank")


def length_batches(rows: DataFrame, length: str, key: str, size: int) -> DataFrame:
    """`batch` numbers by length, and `batch_order`, a hashed order of the batches."""
    out = ranked(rows, [F.col(length), F.col(key)]).withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank")
    return out.withColumn("batch_order", F.sha2(F.concat(F.lit("42:"), F.col("batch").cast("string")), 256))


def round_robin(rows: DataFrame, category, order: str, limit: int) -> DataFrame:
    """One row of each category in turn, categories by name, until the limit."""
    w = Window.partitionBy("_cat").orderBy(order)
    return rows.withColumn("_cat", category).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).orderBy("_rn", "_cat").limit(limit).drop("_cat", "_rn")


def shortest(rows: DataFrame, length: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(length, key).limit(k)


def nearest_rank(rows: DataFrame, value: str) -> DataFrame:
    """count, mean (one decimal), the entries number floor(n/2) and floor(n * 0.95) counted from 0, and the largest; an empty input gives no row.

    By counting (`quantiles.order_statistics`): no row is sorted or shuffled.
    """
    facts, at = quantiles.order_statistics(rows, value, lambda n: [n // 2, int(n * 0.95)])
    given = rows.sparkSession.createDataFrame([(facts["n"], facts["sum"], *at, facts["max"])] if at else [], "n long, total decimal(38,0), p50 long, p95 long, max long")
    return given.select("n", F.round(F.col("total").cast("double") / F.col("n"), 1).alias("mean"), "p50", "p95", "max")


def uniform(seed: int, key) -> Column:
    """A number above 0 and below 1 that the seed and the key fix: 52 bits of a SHA-256."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def without_replacement(rows: DataFrame, group: str, key: str, k: int, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """(group, key, place) of k different keys of each group, all of a smaller one, in the order they are drawn.

    A key's number u comes from its hash, the smallest numbers are the sample, and every task keeps only its own k
    smallest of each group before the shuffle (up to 1000; above, keys are first dealt to parts that are cut apart).
    With a weight the number is -ln(u) / weight, which draws by weight; weights of 0 and less, and null ones, are
    never drawn. Keys that repeat are one key, with their largest weight. Null is a group, but not a key.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    given = rows.select(F.col(group), F.col(key), w.alias("_w")).filter(F.col(key).isNotNull() & (F.col("_w") > 0))
    each = given.groupBy(group, key).agg(F.max("_w").alias("_w"))
    u = uniform(seed, F.col(key))
    drawn = each.select(group, key, (u if weight is None else -F.log(u) / F.col("_w")).alias("_u"))
    drawn = drawn.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64)))
    few = drawn.withColumn("place", F.row_number().over(Window.partitionBy(group, "_part").orderBy("_u", key))).filter(F.col("place") <= k)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_u", key))).filter(F.col("place") <= k).select(group, key, "place")


def picks(values: list[str], k: int, seed: int, slot: str, key) -> Column:
    """k different ones of the values for a row, in a hashed order of the seed, the slot and the row's key."""
    item = lambda i, v: F.struct(T.hash32(F.concat(F.lit(f"{seed}:{slot}:{i}:"), T.col(key).cast("string"))).alias("h"), F.lit(i).alias("i"), F.lit(v).alias("v"))
    return F.transform(F.slice(F.array_sort(F.array(*[item(i, v) for i, v in enumerate(values)])), 1, k), lambda x: x["v"])


def within_budget(rows: DataFrame, key: str, budget: int, least: int = 64, seed: int = 42) -> DataFrame:
    """The first rows of a hashed order: as many as a budget allows, but `least` at least."""
    return rows.orderBy(*shuffled(key, seed)).limit(max(budget, least))


def presence(rows: DataFrame, split: str, wanted: list[str]) -> DataFrame:
    """(split, n, present) of each wanted split, also of those without rows."""
    want = rows.sparkSession.createDataFrame([(w,) for w in wanted], f"{split} string")
    got = rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    return want.join(got, split, "left").select(split, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))
