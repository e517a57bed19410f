"""Phrase collocations by position bitmaps.

Every task lays the words of its texts out along positions, a free position between two pieces, and cuts the line
into shards. In a shard each word has a bitmap of its positions, compressed to the 16-bit blocks that aren't empty.
A phrase is extended by shifting its bitmap one place and ANDing it with the words' bitmaps that share a block; the
popcount of what is left is the longer phrase's count in the shard, and a bit can't pass a free position, so no
phrase leaves its piece. A shard is searched depth-first by classes of first words, which bounds what is held.

Popcounts are summed over all shards level by level (words, then pairs, ...). A phrase can be frequent only if both
its parts without the last and without the first word are: bitmaps of hashes of the frequent phrases, of a fixed size
whatever the input, tell most others apart before they leave their shard, and the sums alone decide. Words are
known by 64-bit hashes of language and word; the words' table shows if two share one, and then all is hashed anew.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_by_key, cut, table, text_col, tune

NO_LANG = "und"
#: Bytes of text laid out at a time, positions of a shard (a multiple of 16), bitmap blocks of a class of first words.
CHUNK, SHARD, CLASS = 1 << 20, 1 << 21, 1 << 15
#: Bits of the broadcast filter of frequent phrases of one length: 16 MB whatever the input; it only spares work.
FILTER_BITS = 1 << 27
#: Words of more bytes are hashed one by one: sums of powers are for short ones.
LONG = 64
#: Parts of a language's candidates that are ranked apart before its first ones are.
PARTS = 16
_PAGE = 32768
_WORD, _BLANK, _STOP = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = _STOP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = re.compile(rb"[ \t\n-\r.,;:!?]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def spots(hashes: list[np.ndarray]) -> np.ndarray:
    """The filter's bit of each phrase, given its words' hashes place by place."""
    x = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h.astype(np.uint64))
    return (x & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _number(*parts: str | bytes) -> int:
    data = b"\0".join(p.encode("utf-8", "replace") if isinstance(p, str) else p for p in parts)
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


@dataclass
class Stretch:
    """Words of some texts: hashes, positions, and where they stand in the lowered bytes of which parts' languages."""

    hashes: np.ndarray
    positions: np.ndarray
    low: bytes
    starts: np.ndarray
    ends: np.ndarray
    part: np.ndarray
    langs: list[str]

    def words(self, at: np.ndarray) -> tuple[list[str], list[bytes]]:
        return [self.langs[k] for k in self.part[at].tolist()], [self.low[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]


class Line:
    """Lays texts out: words as hashes, and their positions; one for each run of a task."""

    def __init__(self, seed: int) -> None:
        self.seed, self.langs = seed, {}
        base = _number(f"base {seed}") | 1
        fill = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * CHUNK - 1, x, np.uint64)]))
        self.powers, self.inverse = fill(base), fill(pow(base, -1, 1 << 64))
        self.parts, self.size = [], 0
        self.next, self.gap = 0, False  # the next position, and whether a piece ended since the last word

    def _lang(self, lang: str) -> int:
        if lang not in self.langs:
            if len(self.langs) > 10_000:
                self.langs.clear()
            self.langs[lang] = _number(str(self.seed), lang)
        return self.langs[lang]

    def laid(self) -> Iterator[Stretch]:
        """What was put since the last time, if it has a word."""
        if not self.parts:
            return
        data = b"".join(mark + text for mark, text, _ in self.parts) + b" "
        borders = np.cumsum([0] + [len(t) + 1 for _, t, _ in self.parts])
        low = _LOWER[np.frombuffer(data, np.uint8)]
        kind = _KIND[low]
        full = kind == _WORD
        starts = np.flatnonzero(full[1:] & ~full[:-1]) + 1  # the first byte is a mark
        ends = np.flatnonzero(full[:-1] & ~full[1:]) + 1
        stops = np.zeros(len(low) + 1, np.int64)
        np.cumsum(kind == _STOP, out=stops[1:])
        langs = [x for _, _, x in self.parts]
        self.parts, self.size = [], 0
        if not len(starts):
            self.gap |= bool(stops[-1])
            return
        if len(low) > len(self.powers):  # one word over CHUNK bytes
            n = len(low)
            fill = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
            powers, inverse = fill(self.powers[1]), fill(self.inverse[1])
        else:
            powers, inverse = self.powers, self.inverse
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[: len(low)], out=sums[1:])
        length = ends - starts
        part = np.searchsorted(borders, starts, "right") - 1
        lang = np.array([self._lang(x) for x in langs], np.uint64)[part]
        hashes = mixed(mixed((sums[ends] - sums[starts]) * inverse[starts] + length.astype(np.uint64)) ^ lang)
        lowered = low.tobytes()
        for i in np.flatnonzero(length > LONG):
            hashes[i] = _number(str(int(lang[i])), lowered[starts[i] : ends[i]])
        ended = stops[starts] > np.concatenate([[0], stops[ends[:-1]]])
        ended[0] |= self.gap
        positions = self.next + np.arange(len(starts)) + np.cumsum(ended)
        self.next, self.gap = int(positions[-1]) + 1, bool(stops[-1] > stops[ends[-1]])
        yield Stretch(hashes, positions, lowered, starts, ends, part, langs)

    def put(self, lang: str, text: bytes) -> Iterator[Stretch]:
        """A text, in parts that end between words."""
        at, mark = 0, b"\n"
        while at < len(text) or mark == b"\n":
            stop = at + CHUNK
            found = _GAP.search(text, stop) if stop < len(text) else None
            stop = found.end() if found else len(text)
            self.parts.append((mark, text[at:stop], lang))
            self.size += stop - at + 1
            at, mark = stop, b" "
            if self.size >= CHUNK:
                yield from self.laid()


class Shard:
    """The words' bitmaps of one stretch of positions."""

    def __init__(self, hashes: np.ndarray, positions: np.ndarray) -> None:
        self.hashes, word = np.unique(hashes, return_inverse=True)
        self.n = max(1, len(self.hashes))
        self.seen = np.zeros(len(self.hashes), np.int64)  # one place of each word
        self.seen[word] = np.arange(len(word))
        block = positions >> 4
        key = block * self.n + word
        order = np.argsort(key, kind="stable")
        key, bit = key[order], (np.uint16(1) << (positions[order] & 15).astype(np.uint16))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        self.block, self.word = np.divmod(key[first], self.n)
        blocks = int(self.block[-1]) + 3 if len(first) else 2
        self.first = np.searchsorted(self.block, np.arange(blocks + 1))
        self.by_word = np.argsort(self.word, kind="stable")

    def counts(self) -> np.ndarray:
        """Each word's popcount."""
        return np.bincount(self.word, np.bitwise_count(self.bits), self.n)[: len(self.hashes)].astype(np.int64)

    def _extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple:
        """(parent, word, count) of each longer phrase, and its blocks: every phrase's bitmap by one place on, AND every word's."""
        up, carry = bits << np.uint16(1), np.flatnonzero(bits >> np.uint16(15))
        stay = np.flatnonzero(up)
        phrase = np.concatenate([phrase[stay], phrase[carry]])
        block = np.concatenate([block[stay], block[carry] + 1])
        bits = np.concatenate([up[stay], np.ones(len(carry), np.uint16)])
        n = self.first[block + 1] - self.first[block]
        row = np.repeat(np.arange(len(block)), n)
        other = np.arange(len(row)) + np.repeat(self.first[block] - (np.cumsum(n) - n), n)
        both = bits[row] & self.bits[other]
        hit = np.flatnonzero(both)
        row, other, both = row[hit], other[hit], both[hit]
        key = phrase[row] * self.n + self.word[other]
        order = np.argsort(key, kind="stable")
        key, both = key[order], both[order]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        count = np.add.reduceat(np.bitwise_count(both).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        parent, word = np.divmod(key[at], self.n)
        return parent, word, count, (np.cumsum(new) - 1, block[row][order], both)

    def phrases(self, depth: int, frequent: list[np.ndarray], owned: int) -> Iterator[tuple]:
        """(hashes by place, counts) of the phrases of `depth` words that begin before `owned`, class by class."""
        mine = self.by_word[self.block[self.by_word] < owned >> 4]
        word = self.word[mine]
        at = 0
        while at < len(mine):
            end = len(mine)
            if end - at > CLASS:  # whole words only, one at least
                end = int(np.searchsorted(word, word[at + CLASS]))
                if end <= at:
                    end = int(np.searchsorted(word, word[at], "right"))
            part = mine[at:end]
            low = int(word[at])
            yield from self._deeper([self.hashes[low : int(word[end - 1]) + 1]], (word[at:end] - low, self.block[part], self.bits[part]), depth, frequent)
            at = end

    def _deeper(self, hashes: list[np.ndarray], entries: tuple, depth: int, frequent: list[np.ndarray]) -> Iterator[tuple]:
        parent, word, count, (phrase, block, bits) = self._extended(*entries)
        longer = [*[h[parent] for h in hashes], self.hashes[word]]
        n = len(longer)
        keep = _among(longer[1:], frequent[n - 1]) if n > 2 else np.ones(len(count), bool)
        if n == depth:
            yield [h[keep] for h in longer], count[keep]
            return
        keep &= _among(longer, frequent[n])
        number = np.cumsum(keep) - 1
        left = keep[phrase]
        if left.any():
            yield from self._deeper([h[keep] for h in longer], (number[phrase[left]], block[left], bits[left]), depth, frequent)


def _among(hashes: list[np.ndarray], bitmap: np.ndarray) -> np.ndarray:
    s = spots(hashes)
    return (bitmap[s >> 3] >> (s & 7).astype(np.uint8)) & 1 != 0


def _filter(frequent: DataFrame, n: int) -> np.ndarray:
    """The frequent phrases' bits, at most FILTER_BITS / _PAGE rows for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(spots([c.to_numpy(zero_copy_only=False) for c in b.columns]))], ["s"])

    at = frequent.select(*[f"h{i + 1}" for i in range(n)]).mapInArrow(run, "s long")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in at.groupBy(F.expr(f"s div {_PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.expr(f"s % {_PAGE}")).alias("bits")).collect():
        out[r["page"] * _PAGE // 8 :][: _PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _stretches(batches: Iterator[pa.RecordBatch], line: Line) -> Iterator[Stretch]:
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            yield from line.put(lang, text.as_py())
    yield from line.laid()


def _shards(batches: Iterator[pa.RecordBatch], seed: int, depth: int, frequent: np.ndarray) -> Iterator[tuple[Shard, int]]:
    """The partition's shards of frequent words, each with the positions that its last phrases reach, and the end of its own ones."""
    line, held, begin = Line(seed), [], 0

    def cut_off(owned: int) -> tuple[Shard, int]:
        nonlocal held, begin
        h, p = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        now, left = p - begin < owned + depth, p - begin >= owned
        shard = Shard(h[now], p[now] - begin)
        held, begin = [(h[left], p[left])], begin + owned
        return shard, owned

    for s in _stretches(batches, line):
        keep = _among([s.hashes], frequent)
        held.append((s.hashes[keep], s.positions[keep]))
        while line.next - begin >= SHARD + depth:
            yield cut_off(SHARD)
    if held:
        yield cut_off((line.next - begin + 31) & ~15)


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) if isinstance(c, np.ndarray) else c for c in columns], names)


def _counted_words(rows: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h1, a) of all words."""

    def shard_words(held: list[Stretch]) -> pa.RecordBatch:
        shard = Shard(np.concatenate([s.hashes for s in held]), np.concatenate([s.positions for s in held]) - held[0].positions[0])
        ends = np.cumsum([len(s.hashes) for s in held])
        of = np.searchsorted(ends, shard.seen, "right")
        order = np.argsort(of, kind="stable")
        langs, words = [], []
        for k, s in enumerate(held):
            at = shard.seen[order[np.searchsorted(of[order], k) : np.searchsorted(of[order], k, "right")]]
            x, y = s.words(at - (ends[k] - len(s.hashes)))
            langs += x
            words += y
        return _batch([pa.array(langs, pa.string()), pa.array(words, pa.binary()), shard.hashes[order], shard.counts()[order]], ["lang", "word", "h1", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for s in _stretches(batches, Line(seed)):
            held.append(s)
            if s.positions[-1] - held[0].positions[0] >= SHARD:
                yield shard_words(held)
                held = []
        if held:
            yield shard_words(held)

    got = rows.mapInArrow(run, "lang string, word binary, h1 long, a long")
    return got.groupBy("lang", "word", "h1").agg(F.sum("a").alias("a"))


def _counted_phrases(rows: DataFrame, seed: int, depth: int, frequent) -> DataFrame:
    """(h1, ..., a) of all phrases of `depth` words whose two parts may be frequent."""
    names = [f"h{i + 1}" for i in range(depth)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, owned in _shards(batches, seed, depth, frequent.value[1]):
            for hashes, count in shard.phrases(depth, frequent.value, owned):
                yield _batch([*hashes, count], [*names, "a"])

    got = rows.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "a"]))
    return got.groupBy(*names).agg(F.sum("a").alias("a"))


def _attached(rows: DataFrame, facts: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """`rows` with the columns of `facts`, one row per key; safe where one key has many of `rows`."""
    stats = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(facts.hint("merge"), keys), tag)
    return attach_by_key(rows, stats, keys, "_n").drop("_n")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and by length 1 to `longest` the phrases with at least `least` occurrences.

    Those are rows (lang, phrase, h1, ..., a, pre, suf): the counts of the phrase's first 1, 2, ... words and of its
    last ones. Texts are lower-cased in A-Z and cut into pieces at `[.,;:!?\\x0A-\\x0D]`, words are parted by blanks
    and tabs. Null texts count as empty, a null language as "und"; repeated rows count as often, ids don't matter.
    An empty table has no phrases. Long texts are laid out in parts. Other columns are left out.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), text_col(text).cast("binary").alias("text"))
    for seed in range(100):
        words = cut(_counted_words(rows, seed), "phrase-words")
        if words.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    levels = [words.filter(F.col("a") >= least).select("lang", F.col("word").cast("string").alias("phrase"), "h1", "a", F.array("a").alias("pre"), F.array("a").alias("suf"))]
    frequent = [None]
    for m in range(2, longest + 1):
        frequent.append(_filter(levels[-1], m - 1))
        sent = spark.sparkContext.broadcast(frequent)  # FILTER_BITS for each shorter length
        own, head, tail = ([f"h{i + 1}" for i in x] for x in (range(m), range(m - 1), range(1, m)))
        counted = cut(_counted_phrases(rows, seed, m, sent).filter(F.col("a") >= least), f"phrases-{m}")
        first = levels[-1].select("lang", F.col("phrase").alias("_head"), *head, "pre")
        last = levels[-1].select(F.substring_index("phrase", " ", -1).alias("_last"), *[F.col(a).alias(b) for a, b in zip(head, tail)], "suf")
        both = _attached(_attached(counted, first, head, f"phrase-heads-{m}"), last, tail, f"phrase-tails-{m}")
        grown = both.select("lang", F.concat_ws(" ", "_head", "_last").alias("phrase"), *own, "a", F.concat("pre", F.array("a")).alias("pre"), F.concat("suf", F.array("a")).alias("suf"))
        levels.append(cut(grown, f"phrase-level-{m}"))
    return totals, levels


def _worst_cut(m: int):
    """The cut of a phrase of m words with the lowest score, as a struct (score, k, l, r)."""
    big = lambda c: c.cast("decimal(15,0)")

    def one(k: int):
        left, right = F.get("pre", F.lit(k - 1)), F.get("suf", F.lit(m - k - 1))
        top, down = (big(F.col("a")) * big(F.col("a"))).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right)
        score = ((top - top % down) / down).cast("decimal(20,0)").cast("long")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    cuts = [one(k) for k in range(1, m)]
    return cuts[0] if m == 2 else F.least(*cuts)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, inside: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases of two to `longest` words.

    A phrase inside a longer frequent one with `inside` hundredths of its occurrences or more is left out. Ties in
    the score go to the more frequent, then to the smaller phrase. Counts are exact up to 10^15. Odd input is as in
    `phrase_counts`; a language without frequent phrases has no row.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    totals, levels = phrase_counts(docs, longest, least, text, lang)
    kept = []
    for m in range(2, longest + 1):
        own = [f"h{i + 1}" for i in range(m)]
        rows = levels[m - 1].select("lang", "phrase", *own, "a", _worst_cut(m).alias("c"))
        for longer in range(m + 1, longest + 1):
            parts = F.array(*[F.struct(*[F.col(f"h{i + j + 1}").alias(f"h{i + 1}") for i in range(m)]) for j in range(longer - m + 1)])
            over = levels[longer - 1].select(F.explode(parts).alias("x"), "a").groupBy(*[F.col(f"x.{h}").alias(h) for h in own]).agg(F.max("a").alias("_over"))
            rows = rows.join(over.hint("merge"), own, "left").filter(f"coalesce(100 * _over < {inside} * a, true)").drop("_over")
        kept.append(rows.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score")))
    every = kept[0]
    for k in kept[1:]:
        every = every.unionByName(k)
    best = [F.desc("score"), F.desc("a"), "phrase"]
    part = every.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).filter(F.col("rank") <= top).drop("rank", "_part")
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)  # PARTS * top rows of a language
    out = first.join(totals.hint("merge"), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two and three words with ten occurrences or more."""
    return collocations(table(spark, sf_dir, "documents"))
