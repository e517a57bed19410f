"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at RADIUS or fewer differing bits. A covering family (Pagh, "CoveringLSH")
of 2**(RADIUS + 1) - 1 bit masks makes every such pair agree under at least one mask: bit i gets a vector
m(i) in {0,1}^(RADIUS+1), mask v keeps the bits with <m(i), v> = 1, and for any RADIUS differing bits some
v <> 0 is orthogonal to all of their vectors. So the search has no false negatives.

Only distinct fingerprints take part (copies share one). Buckets of two are checked by an aggregate alone;
buckets up to BUCKET_LIMIT are compared in numpy, and only a spanning forest of their links leaves; larger
buckets go an exact linear way: two fingerprints within 4 bits share a point within 2 bits of both (for an odd
radius one of them is a bit nearer to it), so each joins the smallest fingerprint of each such point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import connected_components
from .common import attach_by_key, cut, marked, table, text_col, tune

RADIUS = 4
#: The family grows as 2**radius, and the points around a fingerprint as 64**(radius / 2).
MOST_RADIUS = 4
SHINGLE = 4
SEED = 42
BUCKET_LIMIT = 8192
_BLOCK = 1 << 15
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LOWER = bytes(32 if 9 <= c <= 13 else v for c, v in enumerate(_LOWER))


def fingerprint(text: str | None) -> int:
    """SimHash over XXH64 (seed 42) of all 4-word shingles, repeats included; 0 without words.

    Lower-cases A-Z only. Fewer than four words make one shingle. Signed 64-bit result.
    """
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - SHINGLE] + 1).tolist()]
        ends = [*gaps[SHINGLE - 1 :].tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts))
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        part = hashes[i : i + _BLOCK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep=None) -> DataFrame:
    """(doc_id, fp long) of every row, with `key` if `keep` is an expression of type long; other columns, whatever their names, are left out."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", "key"][: b.num_columns])

    more = [] if keep is None else [keep.alias("key")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + ", key long" * len(more))


@lru_cache
def covering_masks(radius: int = RADIUS, bits: int = 64) -> tuple[int, ...]:
    """2**(radius+1) - 1 masks: for any `radius` bits at least one mask leaves all of them out."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return tuple(sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, size))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(fps: np.ndarray, reps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within the radius: as many links as merges, in order of search."""
    n, left = len(fps), np.ones(len(fps), dtype=bool)
    out: list[tuple[int, int]] = []
    while left.any():  # breadth first from one root after another; each member is compared once per member it reaches
        root = int(np.flatnonzero(left)[0])
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(left)
            near = near[np.bitwise_count(fps[near] ^ fps[at]) <= radius]
            left[near] = False
            queue += near.tolist()
            out += [(int(reps[at]), int(reps[x])) for x in near]
    assert len(out) < max(n, 1)
    return out


def links(distinct: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between rows (fp, rep) of distinct fingerprints, enough to connect all pairs within the radius, 0 to MOST_RADIUS."""
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"the radius must be 0 to {MOST_RADIUS}")
    tune(distinct.sparkSession)
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("k")) for i, m in enumerate(covering_masks(radius))])
    rows = distinct.select("fp", "rep", F.explode(masks).alias("x")).select(F.xxhash64("x.k", "x.t").alias("key"), "fp", "rep")
    buckets = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("fp", "rep")).alias("lo"), F.max(F.struct("fp", "rep")).alias("hi")).filter("n > 1"), "simhash-buckets")
    pairs = buckets.filter("n = 2 and bit_count(lo.fp ^ hi.fp) <= %d" % radius).select(F.col("lo.rep").alias("a"), F.col("hi.rep").alias("b"))
    more = cut(rows.join(buckets.filter("n > 2").select("key", "n"), "key"), "simhash-more")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple[int, int]] = set()
            for m in b.column(0).to_pylist():
                fps = np.array([x["fp"] for x in m], dtype=np.int64).view(np.uint64)
                out.update(_forest(fps, np.array([x["rep"] for x in m], dtype=np.int64), radius))
            both = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in both], pa.int64()) for i in (0, 1)], ["a", "b"])

    groups = more.filter(F.col("n") <= bucket_limit).groupBy("key").agg(F.collect_list(F.struct("fp", "rep")).alias("m")).select("m")
    found = pairs.unionByName(groups.mapInArrow(within, "a long, b long"))
    if more.filter(F.col("n") > bucket_limit).limit(1).count():
        wide, close = -(-radius // 2), radius // 2  # of two within the radius one has a common point within `close` bits, the other within `wide`
        flips = [0, *(1 << i for i in range(64) if wide > 0), *(1 << i | 1 << j for i in range(64) for j in range(i) if wide > 1)]
        points = F.explode(F.array(*[F.lit(_signed(x)).cast("long") for x in flips]))
        around = more.filter(F.col("n") > bucket_limit).select("fp", "rep").distinct().select("fp", "rep", points.alias("d")).select("rep", F.expr("fp ^ d").alias("point"), (F.bit_count("d") <= close).alias("near"))
        least = around.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("rep"))).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1 and least is not null")
        linked = around.join(least, "point").filter("rep <> least")
        found = found.unionByName(linked.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    return cut(found.distinct(), "simhash-links")


def _components(own: DataFrame, radius: int, bucket_limit: int) -> DataFrame:
    """(fp, part, component_id, n_rows) of the distinct fingerprints of rows (doc_id, fp): its component's smallest fingerprint and smallest doc_id."""
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows")), "simhash-distinct")
    # fingerprints are the nodes, as rows with one doc_id may have several
    parts = connected_components(links(distinct.filter("rep is not null").select("fp", F.col("fp").alias("rep")), radius, bucket_limit))
    named = cut(distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "rep", "n_rows", F.coalesce("component", "fp").alias("part")), "simhash-parts")
    least = cut(named.groupBy("part").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-least")
    return cut(attach_by_key(named, least, ["part"], "n").select("fp", "part", "component_id", "n_rows"), "simhash-named")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable over links.

    Null and empty texts have fingerprint 0 and link like any other. Rows that repeat a doc_id give as many
    rows. Rows with a null doc_id keep their fingerprint and get the component of it. An empty table gives none.
    A long text takes memory in proportion to its words. Other columns, whatever their names, are left out.
    """
    own = cut(fingerprints(docs), "simhash-fp")
    return attach_by_key(own, _components(own, radius, bucket_limit), ["fp"], "n_rows").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, in all columns of `docs`, which may have any names.

    The row with the smallest doc_id stays, of several such (other texts, or repeated rows) one by a hash of its
    text and columns. A row is judged by its own text, also if others have its doc_id. Null and empty texts are
    near duplicates of each other. Rows with a null doc_id can't be told apart and all stay. An empty table gives
    no rows. Only rows that go, and few others, are shuffled with their texts. Fingerprints take memory for a block
    of a long text's shingles and 8 bytes for each.
    """
    key = F.xxhash64(text_col())
    own = cut(fingerprints(docs, keep=key), "simhash-fp")
    named = attach_by_key(own.filter("doc_id is not null"), _components(own, RADIUS, BUCKET_LIMIT), ["fp"], "n_rows")
    named = cut(named.groupBy("doc_id", "key").agg(F.min("part").alias("part"), F.count(F.lit(1)).alias("rows")), "simhash-keys")
    first = named.groupBy("part").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marks = attach_by_key(named, cut(first, "simhash-firsts"), ["part"], "n")
    judged = cut(marks.withColumn("go", F.coalesce(F.struct("doc_id", "key") != F.col("first"), F.lit(False))).filter("go or rows > 1").select("doc_id", "key", "go"), "simhash-judged")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"))
    rows = marked(rows, "doc_id", judged.select("doc_id"))
    met = rows.filter("_near").drop("_near").join(judged.hint("merge"), ["doc_id", "key"], "left")  # the same plan at every size
    once = met.filter("go = false").groupBy("doc_id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return rows.filter("not _near").select("row").unionByName(met.filter("go is null").select("row")).unionByName(once).select("row.*")


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
