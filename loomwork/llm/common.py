"""Shared helpers of the training-data operators: reading, cutting lineage, text views, keyed attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attach import HEAVY_PARTS, attach_by_key  # noqa: F401  (for the operators)
from ..shipping import ARROW_BATCH_BYTES, tune  # noqa: F401  (for the operators)
from ..tables import PACKED, cut, fresh_dir, shared_dir  # noqa: F401  (for the operators)

#: The words of every operator whose result is fixed by contract: runs free of ASCII white space.
WORD_GAP = r"[ \x09-\x0D]+"

#: Bits of the broadcast filter of ids, 4 MB whatever the input; it only spares work.
FILTER_BITS = 1 << 25
_PAGE = 32768

_CONT = bytes(range(0x80, 0xC0))
_LEAD = bytes(range(0x80)) + b"\x80" * 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark (the path may be of any file system that Spark knows).

    Dealt anew only if its files give fewer tasks than there are cores.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def text_col(name: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_col(text):
    """Array of the runs of anything but ASCII white space."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def one_byte_view(text: str) -> bytes:
    """One byte per code point: ASCII as it is, all else 0x80; offsets in it are code point offsets."""
    if text.isascii():
        return text.encode()
    return text.encode("utf-8", "replace").translate(_LEAD, _CONT)


def _bits(ids: DataFrame) -> DataFrame:
    """A fixed-size bitmap of hashes of the only column of `ids`, in pages; FILTER_BITS / _PAGE rows at most, so it may be broadcast."""
    spot = F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER_BITS))
    return F.broadcast(ids.select(spot.alias("_s")).groupBy(F.expr(f"_s div {_PAGE}").alias("_page")).agg(F.bitmap_construct_agg(F.expr(f"_s % {_PAGE}")).alias("_bits")))


def marked(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """`rows` with `_near`: false only where `column` isn't among `ids`, a frame of one column; most such rows are told by the bitmap.

    Null isn't near. What is near goes on to an exact join, so the bitmap only spares shuffling the rest.
    """
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_s % {_PAGE} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    out = rows.withColumn("_s", F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))).withColumn("_page", F.expr("_s div %d" % _PAGE)).join(_bits(ids), "_page", "left")
    near = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_s % 8 as int))")) != 0, F.lit(False)) & F.col(column).isNotNull()
    return out.withColumn("_near", near).drop("_s", "_page", "_bits")
