"""Bag difference and intersection of two versions of a table, by signed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signed_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, a, b): each distinct row of either side as a struct and how often each side has it; nulls are equal.

    One aggregate over digests of whole rows, combined before the shuffle, so a row that is repeated without end is one
    row from each task. Both sides must have the same columns; `b`'s are taken by name.
    """
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the two sides differ in their columns")
    cols = [F.col(f"`{c}`") for c in a.columns]
    side = lambda rows, x, y: rows.select(F.struct(*cols).alias("row"), F.lit(x).alias("a"), F.lit(y).alias("b"))
    both = side(a, 1, 0).unionByName(side(b, 0, 1))
    known = both.withColumn("d", F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256))
    return known.groupBy("d").agg(F.first("row").alias("row"), F.sum("a").alias("a"), F.sum("b").alias("b")).drop("d")


def _expanded(counted: DataFrame, n) -> DataFrame:
    """`row` so many times; copies are made by a generator, row by row."""
    return counted.withColumn("n", n).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """EXCEPT ALL: each row as many times as `a` has it more often than `b`."""
    return _expanded(signed_counts(a, b), F.col("a") - F.col("b"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """INTERSECT ALL: each row as many times as both have it."""
    return _expanded(signed_counts(a, b), F.least("a", "b"))


def changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of `a` with `change`: by how many copies the new version `b` has more or fewer of a row; unchanged rows are left out."""
    return signed_counts(a, b).withColumn("change", F.col("b") - F.col("a")).filter("change <> 0").select("row.*", "change")
