"""Facts of keys to rows, where one key may have a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one part in so many of all rows, so there are at most so many; skewed-join splitting does for keys below.
HEAVY_PARTS = 64
#: Bits of the broadcast filter of keys, 4 MB whatever the input, and of one of its pages.
FILTER_BITS, PAGE_BITS = 1 << 25, 1 << 15


def attach_by_key(rows: DataFrame, stats: DataFrame, key: list[str], size: str) -> DataFrame:
    """Left join of `rows` with one `stats` row per key, safe against hot keys.

    `size` names the column of `stats` with the number of rows of the key. Keys with more than
    1 / HEAVY_PARTS of all rows are at most HEAVY_PARTS many whatever the input, so they are broadcast;
    all other keys are small enough for a shuffled join. Both inputs should be cheap to read twice.
    """
    total = stats.agg(F.sum(size).alias("_total"))
    marked = stats.crossJoin(F.broadcast(total))  # one row, an ungrouped aggregate
    heavy = marked.filter(F.col(size) * HEAVY_PARTS > F.col("_total")).drop("_total")
    light = marked.filter(F.col(size) * HEAVY_PARTS <= F.col("_total")).drop("_total")
    names = [c for c in stats.columns if c not in key]
    tagged = heavy.select(*key, *[F.col(c).alias(f"_heavy_{c}") for c in names], F.lit(True).alias("_is_heavy"))
    once = rows.join(F.broadcast(tagged), key, "left")
    hot = once.filter(F.col("_is_heavy")).select(*rows.columns, *[F.col(f"_heavy_{c}").alias(c) for c in names])
    rest = once.filter(F.col("_is_heavy").isNull()).select(*rows.columns).join(light, key, "left").select(*rows.columns, *names)
    return hot.unionByName(rest)


def maybe_among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose `column` is among `keys`, a frame of one column, and a few others.

    A bitmap of hashes of the keys tells, which has one size whatever the input. An exact join should follow, which
    then shuffles little else.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    pages = keys.select(spot(keys.columns[0]).alias("_spot")).groupBy(F.expr(f"_spot div {PAGE_BITS}").alias("_page"))
    bits = pages.agg(F.bitmap_construct_agg(F.expr(f"_spot % {PAGE_BITS}")).alias("_bits"))
    met = rows.withColumn("_spot", spot(column)).withColumn("_page", F.expr(f"_spot div {PAGE_BITS}")).join(F.broadcast(bits), "_page")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_spot % {PAGE_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_spot % 8 as int))")) != 0).select(*rows.columns)
