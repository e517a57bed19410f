"""Ordered computations over whole tables: ranges of the order, each worked on apart, and what is carried between them.

A table is dealt to ranges of its order and sorted within them. Each range is summed up in one row; a scan over these
few rows gives what comes before each range, and only then every row gets its own result. A key that fills many
ranges is worked on by many tasks, and no window runs over more than a range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, unused


@dataclass(frozen=True)
class Ranges:
    """Rows with the number of their range and their place in it, by columns of these names."""

    rows: DataFrame
    part: str
    at: str


def ranges(rows: DataFrame, order: list, parts: int | None = None) -> Ranges:
    """Written once, as what is summed up and what is added must come from the same ranges; rows that tie in the whole order share a range."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, at = unused(rows, "_part", "_at")
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return Ranges(cut(dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "ranges"), part, at)


_OVER = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, True)}


def _later(kind: str, before: Column, now: Column) -> Column:
    """A fold's value over two stretches, of which either may have none."""
    if kind == "last":
        return F.coalesce(now, before)
    if kind == "sum":
        return F.coalesce(before + now, before, now)
    return (F.least if kind == "min" else F.greatest)(before, now)


def running(rows: DataFrame, order: list, folds: dict[str, tuple[str, Column]], by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """`rows` with the running value of each fold (name: (kind, column)), from the first row in order up to each row.

    Kinds: sum, min, max and last (the last value that isn't null); nulls don't count, and there is no value before the
    first. With `by`, which the order must begin with, folds start anew at each key; null is a key. `order` should be
    unique, else rows that tie come in any order. Broadcast is one row per range.
    """
    r = ranges(rows, order, parts)
    names = list(folds)
    key = F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0))
    own, carried, own_key, cols = {}, {}, *unused(r.rows, "_edge", "_input")
    with_inputs = r.rows.withColumn(own_key, key).withColumns({f"{cols}{i}": folds[n][1] for i, n in enumerate(names)})
    w = Window.partitionBy(r.part, own_key).orderBy(r.at).rowsBetween(Window.unboundedPreceding, 0)
    for i, n in enumerate(names):
        own[f"{cols}_own{i}"] = _OVER[folds[n][0]](F.col(f"{cols}{i}")).over(w)
    ends = with_inputs.groupBy(r.part).agg(F.min_by(own_key, r.at).alias("first"), F.max_by(own_key, r.at).alias("last"))
    fold = lambda i, n: F.max_by(f"{cols}{i}", F.when(F.col(f"{cols}{i}").isNotNull(), F.col(r.at))) if folds[n][0] == "last" else _OVER[folds[n][0]](F.col(f"{cols}{i}"))
    tails = with_inputs.join(F.broadcast(ends), r.part).filter(F.col(own_key).eqNullSafe(F.col("last"))).groupBy(r.part).agg(F.first("first").alias("first"), F.first("last").alias("last"), *[fold(i, n).alias(f"t{i}") for i, n in enumerate(names)])
    values = [f"t{i}" for i in range(len(names))]
    gives = tails.select(F.col("last").alias("key"), r.part, F.lit(1).alias("gives"), *values)
    asks = tails.select(F.col("first").alias("key"), r.part, F.lit(0).alias("gives"), *[F.when(F.lit(False), F.col(t)).alias(t) for t in values])
    before = Window.partitionBy("key").orderBy(r.part, "gives").rowsBetween(Window.unboundedPreceding, -1)  # two rows per range
    scan = gives.unionByName(asks).withColumns({f"c{i}": _OVER[folds[n][0]](F.col(f"t{i}")).over(before) for i, n in enumerate(names)})
    carry = scan.filter("gives = 0").select(r.part, F.col("key").alias(f"{cols}_key"), *[F.col(f"c{i}").alias(f"{cols}_c{i}") for i in range(len(names))])
    out = with_inputs.withColumns(own).join(F.broadcast(carry), r.part)
    for i, n in enumerate(names):
        here = F.col(f"{cols}_own{i}")
        carried[n] = F.when(F.col(own_key).eqNullSafe(F.col(f"{cols}_key")), _later(folds[n][0], F.col(f"{cols}_c{i}"), here)).otherwise(here)
    return out.select(*[F.col(c) for c in rows.columns if c not in names], *[c.alias(n) for n, c in carried.items()])


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str], within: Column | None = None, parts: int | None = None) -> DataFrame:
    """`left` with the columns `take` of the last row of `right` of the same key at or before its time; null where there is none.

    Both sides are laid in one order (key, time, right before left, then `take`), and the last row of `right` is
    carried along, also from one range to the next: a hot key is no more than many ranges. Of rows of `right` with one
    key and time the largest by `take` counts. `within`: the longest distance in time (an interval). Rows of `right`
    without a key or time count nowhere; rows of `left` without one stay and match nothing, repeated rows stay in
    number. Names of `take` must not be columns of `left`.
    """
    if clash := set(take) & set(left.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    key = [F.col(b).alias(f"k{i}") for i, b in enumerate(by)]
    keys = [f"k{i}" for i in range(len(by))]
    item = F.struct(*[F.col(right_at).alias("at"), F.struct(*take).alias("x")])
    rights = right.dropna(subset=[*by, right_at]).select(*key, F.col(right_at).alias("at"), F.lit(0).alias("side"), item.alias("r"))
    lefts = left.select(*key, F.col(left_at).alias("at"), F.lit(1).alias("side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("l"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    seen = running(both, [*keys, "at", "side", "r"], {"m": ("last", F.col("r"))}, tuple(keys), parts).filter("side = 1")
    near = F.col("m.at") + within >= F.col("at") if within is not None else F.lit(True)
    known = F.col("at").isNotNull() & near
    return seen.select("l.*", *[F.when(known, F.col(f"m.x.{c}")).alias(c) for c in take])


def moving(rows: DataFrame, by: list[str], at: str, micros: int, sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """`rows` with sums over the rows of the same key whose time is at most `micros` before each row's, itself and ties included.

    Each range also gets the rows of earlier ranges that its first times reach back to (its halo), so that ranges of
    one hot key are worked on apart. Times are timestamps; rows without a time see each other only, null is a key.
    """
    key_name, time, halo, to = unused(rows, "_keys", "_micros", "_halo", "_to")
    known = rows.withColumn(key_name, F.struct(*by) if by else F.struct(F.lit(0))).withColumn(time, F.unix_micros(F.col(at).cast("timestamp")))
    inputs = {f"{halo}{i}": c for i, c in enumerate(sums.values())}
    r = ranges(known.withColumns(inputs), [key_name, time], parts)
    first = r.rows.groupBy(r.part).agg(F.min(F.struct(F.col(key_name).alias("k"), F.col(time).alias("t"))).alias("f")).select(F.col(r.part).alias(to), F.col("f.k").alias(f"{to}_key"), F.col("f.t").alias(f"{to}_at"))
    reach = (F.col(key_name) == F.col(f"{to}_key")) & (F.col(r.part) < F.col(to)) & (F.col(time) >= F.col(f"{to}_at") - micros)
    slim = r.rows.select(key_name, time, r.part, *inputs)
    lent = slim.join(F.broadcast(first), reach).select(key_name, time, F.col(to), *inputs, F.lit(True).alias(halo))  # one row per range
    every = r.rows.withColumn(to, F.col(r.part)).withColumn(halo, F.lit(False)).unionByName(lent, allowMissingColumns=True)
    w = Window.partitionBy(to, key_name).orderBy(time).rangeBetween(-micros, 0)
    out = every.withColumns({f"{to}_sum{i}": F.sum(c).over(w) for i, c in enumerate(inputs)}).filter(~F.col(halo))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c not in sums], *[F.col(f"{to}_sum{i}").alias(n) for i, n in enumerate(sums)])
