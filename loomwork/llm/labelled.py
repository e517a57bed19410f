"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_col, words_col


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable, per_class: int) -> DataFrame:
    """(doc_id, text, y) of up to `per_class` labelled documents of each class, in an order of hashed ids.

    `usable` says which labels may be learnt from. Labels that are null or neither 0 nor 1 don't count; of
    several labels of an id the largest does. Near copies within a class count once: of documents whose
    smallest hash of three words in a row is the same, the one with the smallest id stays. The sample of labels is bounded by `per_class`,
    so it is broadcast and only the sample's texts leave the scan.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(usable)
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y"))
    few = None
    for y in (0, 1):
        part = ids.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        few = part if few is None else few.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).join(F.broadcast(few), "doc_id")
    words = words_col(F.lower("text"))
    triples = F.when(F.size("_w") < 3, F.array(F.xxhash64("_w"))).otherwise(F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2))))
    marked = texts.withColumn("_w", words).withColumn("_mark", F.array_min(triples))
    return marked.groupBy("y", "_mark").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("x.doc_id", "x.text", "y")
