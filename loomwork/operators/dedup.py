"""Duplicates: keep-first by key, by smallest shingle, and all pairs of similar shingle sets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U
from ..tables import cut, unused
from .attach import attach_by_key, maybe_among
from .closure import connected_components

#: Above any 32-bit hash; products of a hash and a factor below 2**31 stay within a long.
PRIME = 4294967311
#: Shingles are counted in two to the power of so many buckets.
BUCKET_BITS = 18
#: Sets and shingles of a block, of which pairs are verified two by two; about so many, as sets are dealt by hash.
BLOCK_SETS, BLOCK_SHINGLES = 128, 1 << 16


def keep_first(rows: DataFrame, key, order: list[str]) -> DataFrame:
    """Of the rows with one key the first in order; null is a key of its own, and null comes first in an order.

    The first is found by an aggregate over (key, order) alone, which combines a hot key before the shuffle; ties in
    `order` keep all tied rows. Columns of `rows` may have any names, an empty table gives no rows.
    """
    mark, *firsts = unused(rows, "_key", *[f"_first{i}" for i in range(len(order))])
    marked = rows.withColumn(mark, F.coalesce(F.md5(key), F.lit("")))  # no key's digest is empty
    least = marked.groupBy(mark).agg(F.min(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])).alias("least"))
    first = least.select(F.col(mark).alias(f"{mark}_of"), *[F.col(f"least.o{i}").alias(f) for i, f in enumerate(firsts)])
    same = F.col(mark) == F.col(f"{mark}_of")
    for o, f in zip(order, firsts):
        same &= F.col(o).eqNullSafe(F.col(f))
    return marked.join(first, same, "left_semi").select(*rows.columns)


def exact(convs: DataFrame, order: str = "conv_id") -> DataFrame:
    """Keep-first on the whole list of messages; the domain isn't part of the key."""
    return keep_first(convs, F.to_json("messages"), [order])


def by_prompt_and_answer(rows: DataFrame, user: str, answer: str, fold, order: list[str]) -> DataFrame:
    """Keep-first on the folded prompt and the first 600 characters of the folded answer."""
    return keep_first(rows, F.concat(fold(F.col(user)), F.lit("||"), F.substring(fold(F.col(answer)), 1, 600)), order)


def min_shingle(rows: DataFrame, text: str, order: str, most: int | None = None) -> DataFrame:
    """Rows with `group`: rows with one smallest 32-bit shingle hash are a group and take its first row's number.

    `most`: groups over so many rows count as no group, as in the method that this is compatible with (60 there).
    The groups' numbers come by aggregates over hashes alone, and hot groups (texts without words are one) are
    attached by broadcast, so none lands in one task.
    """
    w, mark, root, n = unused(rows, "_w", "_m", "_root", "_n")
    worded = rows.withColumn(w, T.words(text))  # a column of its own, or each shingle would split the text again
    least = F.array_min(F.transform(T.shingles(F.col(w)), lambda s: T.hash32(s)))
    marked = worded.withColumn(mark, F.coalesce(least, F.lit(-1))).drop(w)  # never null, so that no null check of the whole expression is pushed down
    groups = marked.groupBy(mark).agg(F.min(order).alias(root), F.count(F.lit(1)).alias(n))
    over = F.lit(False) if most is None else F.col(n) > most
    return attach_by_key(marked, cut(groups, "shingle-groups"), [mark], n).withColumn("group", F.when(over, F.col(order)).otherwise(F.col(root))).drop(mark, root, n)


def minhash_signature(shingles, perms: int = 32):
    """The smallest value of each of `perms` affine maps, modulo a prime, over an array of 32-bit hashes; constants follow a fixed recurrence."""
    c, consts = 0x9E3779B9, []
    for _ in range(2 * perms):
        c = (c * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        consts.append(1 + (c >> 34))
    affine = lambda a, b: lambda x: F.pmod(x * F.lit(a) + F.lit(b), F.lit(PRIME))
    return F.array(*[F.array_min(F.transform(T.col(shingles), affine(consts[2 * i], consts[2 * i + 1]))) for i in range(perms)])


def agreement(a, b):
    """The share of places at which two signatures of one length agree, which estimates the Jaccard similarity."""
    same = F.filter(F.zip_with(T.col(a), T.col(b), lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.size(T.col(a))


def lsh_pairs(rows: DataFrame, text: str, key: str, perms: int = 32, width: int = 4, threshold: float = 0.85, most: int = 60) -> DataFrame:
    """(a, b, agreement) of the pairs, a < b, that share a band of their signatures and agree in the threshold's share of places.

    A band is `width` places of the signature; buckets of one band with over `most` rows aren't searched, as in
    the method that this is compatible with, so a bucket gives a bounded number of pairs. For all pairs whatever
    the buckets' sizes see `similar_pairs`.
    """
    worded = rows.withColumn("_w", T.words(text))
    hashed = worded.withColumn("_s", F.transform(T.shingles(F.col("_w")), lambda s: T.hash32(s)))
    signed = cut(hashed.select(F.col(key).alias("k"), minhash_signature("_s", perms).alias("sig")), "lsh-signatures")
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[F.get("sig", F.lit(b * width + i)) for i in range(width)]).alias("h")) for b in range(perms // width)])
    each = signed.select("k", F.explode(bands).alias("x")).select("k", "x.*")
    sizes = each.groupBy("band", "h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n").between(2, most)).select("band", "h")
    met = cut(each.join(sizes, ["band", "h"]), "lsh-buckets")
    pairs = met.withColumnRenamed("k", "a").join(met.withColumnRenamed("k", "b"), ["band", "h"]).filter("a < b").select("a", "b").distinct()
    side = lambda to: signed.select(F.col("k").alias(to), F.col("sig").alias(f"sig_{to}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("agreement", agreement("sig_a", "sig_b"))
    return both.filter(F.col("agreement") >= threshold).select("a", "b", "agreement")


def lsh_groups(rows: DataFrame, text: str, key: str, **options) -> DataFrame:
    """`rows` with `group`: the smallest key that is reached over the pairs of `lsh_pairs`; its row is the survivor."""
    parts = connected_components(lsh_pairs(rows, text, key, **options).select("a", "b"))
    return rows.join(parts.withColumnRenamed("node", "_node"), F.col(key) == F.col("_node"), "left").withColumn("group", F.coalesce("component", F.col(key))).drop("_node", "component")


def shingle_classes(rows: DataFrame, text: str, key: str, keep: list[str] | None = None) -> DataFrame:
    """`rows` (of them the columns `keep`, all by default) with `class`: the smallest key of the rows with the same set of five-word shingles; hot classes are no one task's.

    The sets are found once and go on as digests; as these rows are written, `keep` should leave texts out where they aren't wanted.
    """
    marked = cut(_with_set(rows, text).select(*(keep or rows.columns), F.md5(F.array_join("_s", ",")).alias("_h")), "shingle-digests")
    least = marked.groupBy("_h").agg(F.min(key).alias("class"), F.count(F.lit(1)).alias("_n"))
    return attach_by_key(marked, cut(least, "shingle-classes"), ["_h"], "_n").drop("_h", "_n")


def similar_pairs(rows: DataFrame, text: str, key: str, threshold: float = 0.8) -> DataFrame:
    """(a, b, jaccard) of all pairs of classes (see `shingle_classes`) whose shingle sets reach the threshold; a < b.

    Exact, by prefix filtering: in any common order of shingles, two such sets share one of the first
    n - ceil(threshold * n) + 1 of either, and at the first that they share enough must be left in both. The order is
    by level, then by hash. A level says how full a bucket of shingles is (`_levels`): level 0 holds no shingle of
    many rows, and few sets meet at it. So each row finds its own prefix, only prefixes are shuffled, and whole sets
    move for rows that have a candidate alone. Shingles of level 0 that are in one prefix aren't sent to the join; they
    are counted there, and their level bounds a count, so no task holds all rows of a frequent one. Sets meet within
    classes of sizes only, of which two that are similar have one in common, so a shingle of many sets is searched
    class by class. Where one of the last two shingles is shared too, a pair was met before and isn't met again.
    """
    worded = rows.filter(F.col(text).isNotNull())  # null has no set
    sets = cut(_with_set(worded, text).select(F.col(key).alias("k"), F.md5(F.array_join("_s", ",")).alias("_h"), F.size("_s").alias("n"), "_s"), "shingle-sets")
    own = sets.groupBy("_h").agg(F.min("k").alias("k"))
    sent = rows.sparkSession.sparkContext.broadcast(_levels(sets))  # a byte a bucket, whatever the input
    prefixes = sets.select("_h", "k", "n", U.set_prefix(sent, BUCKET_BITS, threshold)("_s").alias("p")).join(own, ["_h", "k"])
    each = prefixes.select("k", "n", F.col("p.rare").alias("rare"), F.posexplode("p.x").alias("i", "x")).withColumn("i", F.col("i") + 1)
    shared = each.filter("i <= rare").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("x"))).filter("df > 1")
    first = shared.select("k", "n", "i", "x").unionByName(each.filter("i > rare").select("k", "n", "i", "x"))
    before = lambda by: F.lag("x", by).over(Window.partitionBy("k").orderBy("i"))
    first = cut(first.select("k", "n", "i", "x", before(1).alias("p"), before(2).alias("q")), "shingle-prefixes")
    size_class = F.floor(F.log("n") / (1e-9 - math.log(threshold)))  # two sizes within the threshold differ by one class at most
    first = first.withColumn("own", size_class).withColumn("c", F.explode(F.array("own", F.col("own") + 1)))
    side = lambda to: first.select(*[F.col(c).alias(f"{c}{to}") for c in ("n", "i", "own", "p", "q")], F.col("k").alias(to), "x", "c")
    near = (F.col("a") < F.col("b")) & (F.col("c") == F.greatest("owna", "ownb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    enough = 1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-6
    again = F.coalesce(F.expr("pa = pb or pa = qb or qa = pb or qa = qb"), F.lit(False))
    met = side("a").join(side("b"), ["x", "c"]).filter(near & enough & ~again)
    return _verified(_likely(cut(met.select("a", "b").distinct(), "shingle-candidates"), sets, threshold), sets, threshold)


def _likely(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs that may reach the threshold by parities of their shingles' hashes (`udfs.set_parities`): two sets differ by as many shingles at least as parities do.

    A set's parities take a 64th to a 32nd of its bytes, so they may be sent once for each pair.
    """
    known = cut(maybe_among(sets.select("k", "n", "_s"), "k", _ends(pairs)).select("k", "n", U.set_parities("_s").alias("w")).dropDuplicates(["k"]), "shingle-parities")
    side = lambda to: known.select(F.col("k").alias(to), F.col("n").alias(f"n{to}"), F.col("w").alias(f"w{to}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    folded = lambda w, to: F.when(F.size(w) > F.size(to), F.zip_with(F.slice(w, F.lit(1), F.size(to)), F.slice(w, F.size(to) + 1, F.size(to)), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(w))
    both = both.select("a", "b", "na", "nb", folded("wa", "wb").alias("wa"), folded("wb", "wa").alias("wb"))
    differ = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return cut(both.filter(differ <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-6).select("a", "b", "na", "nb"), "shingle-pairs")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs that reach the threshold, by their whole sets.

    A set isn't sent for each of its pairs: sets with one smallest neighbour are dealt to blocks of bounded numbers of
    sets and shingles, and it goes once to each block that it has a pair in. So a group is the sets of two blocks and the
    pairs between them.
    """
    end = lambda k, n, o: F.struct(F.col(k).alias("k"), F.col(n).alias("n"), F.col(o).alias("o"))
    met = pairs.select(F.explode(F.array(end("a", "na", "b"), end("b", "nb", "a"))).alias("e")).select("e.*")
    leaders = cut(met.groupBy("k").agg(F.max("n").alias("n"), F.min("o").alias("o")).select("k", "n", F.least("k", "o").alias("leader")), "shingle-leaders")
    sizes = cut(leaders.groupBy("leader").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_sum")), "shingle-leader-sizes")
    part = F.pmod(F.xxhash64("k"), F.greatest(F.ceil(F.col("_n") / BLOCK_SETS), F.ceil(F.col("_sum") / BLOCK_SHINGLES)))
    blocks = attach_by_key(leaders, sizes, ["leader"], "_n").select("k", F.xxhash64("leader", part).alias("block"))
    side = lambda to: blocks.select(F.col("k").alias(to), F.col("block").alias(f"_{to}"))
    dealt = pairs.join(side("a"), "a").join(side("b"), "b").select(F.xxhash64(F.least("_a", "_b"), F.greatest("_a", "_b")).alias("g"), "a", "b")
    dealt = cut(dealt, "shingle-blocks")
    members = dealt.select("g", F.explode(F.array("a", "b")).alias("k")).distinct()
    texts = maybe_among(sets.select("k", "_s"), "k", _ends(pairs)).dropDuplicates(["k"])
    either = members.join(texts, "k").select("g", F.struct("k", "_s").alias("s")).unionByName(dealt.select("g", F.struct("a", "b").alias("p")), allowMissingColumns=True)
    groups = either.groupBy("g").agg(F.collect_list("s").alias("s"), F.collect_list("p").alias("p")).select("p", F.map_from_entries("s").alias("s"))
    shared = lambda p: F.size(F.array_intersect(F.element_at("s", p["a"]), F.element_at("s", p["b"])))
    total = lambda p: F.size(F.element_at("s", p["a"])) + F.size(F.element_at("s", p["b"]))
    each = groups.select(F.explode(F.transform("p", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), shared(p).alias("m"), total(p).alias("n")))).alias("e")).select("e.*")
    return each.withColumn("jaccard", F.col("m") / (F.col("n") - F.col("m"))).filter(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("k"))


def _levels(sets: DataFrame) -> np.ndarray:
    """One byte for each of 2**BUCKET_BITS buckets of shingles, told by a hash's high bits: 0, or by quarters of a power of two how far the occurrences in it pass a bound.

    The bound is well over what evenly dealt shingles give, so few buckets without a frequent shingle pass it. It only
    orders shingles: any levels give the same pairs, in more or less time. At most one (bucket, level) a bucket comes here.
    """
    bucket = F.expr(f"shiftrightunsigned(x, {64 - BUCKET_BITS})").cast("int").alias("at")
    counts = cut(sets.select(F.explode("_s").alias("x")).select(bucket).groupBy("at").agg(F.count(F.lit(1)).alias("n")), "shingle-buckets")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << BUCKET_BITS)
    bound = mean + 8 * math.sqrt(mean) + 32
    level = F.least(F.lit(255), 1 + F.floor(4 * F.log2(F.col("n") / bound)))
    found = counts.filter(F.col("n") > bound).select("at", level.cast("short").alias("level")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, dtype=np.uint8)
    out[found["at"].to_numpy()] = found["level"].to_numpy()
    return out


def _with_set(rows: DataFrame, text: str) -> DataFrame:
    worded = rows.withColumn("_w", T.words(text))  # a column of its own, or each shingle would split the text again
    hashed = F.when(F.size("_w") < 5, F.array(F.xxhash64(F.array_join("_w", " ")))).otherwise(T.gram_hashes(F.col("_w"), 5))
    return worded.withColumn("_s", F.sort_array(F.array_distinct(hashed))).drop("_w")
