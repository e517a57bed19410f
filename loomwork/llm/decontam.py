"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND.

Every passage of every document is a query. Impacts are BM25 contributions over the item's own score (its
BM25 with itself as the query), so a score is the weighted share of the item that the passage has, and one
threshold holds for all items. Items are laid out in blocks; the index keeps each term's largest impact
overall (WAND's bound) and per block (block-max). Passages go through in batches: whole passages whose summed
term bounds stay below the threshold are skipped, then blocks whose summed block maxima do, and only the
postings of the blocks left are scored. These are block-max WAND's two tests, for all blocks of many passages at
once by numpy instead of one pivot after another; arrays are no longer than a few times the postings met. Bounds never underestimate,
so all items at or over the threshold are retrieved. A retrieved pair counts as a leak if the whole item has at least OVERLAP of its five-word shingles
in the passage and both its question part and its answer part have at least FLOOR of their words in shared
shingles, or if each part alone has at least OVERLAP of its own shingles there (parts that stand apart). Items
under SHINGLE words can't be told from common phrases: they are no leak anywhere and aren't indexed.

Items are indexed by classes of length, each with passages of its own: two steps long, at every step, a step being
the class's bound (SHORTEST doubled some times). So a long item doesn't make the passages of short ones long, in
which bounds would rule nothing out, and passages don't depend on what else the benchmark holds.

The index is broadcast, so the benchmark must be small: its bytes are checked against INDEX_BYTES and a
larger one is searched in several rounds, one part of it at a time, with the statistics of the whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_col, tune

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
#: Words of either part in shared shingles. Fails only where shingles repeat within the item: without repeats, at most
#: 0.2 * (words - 4) words, under 0.4 of a part, can be outside shared shingles when the whole item reaches OVERLAP.
FLOOR = 0.5
SHINGLE = 5
BLOCK = 8
INDEX_BYTES = 16 << 20
#: Words of the longest items of the first length class; each further class reaches twice as far.
SHORTEST = 32
#: Entries of block maxima that passages searched together meet.
MET = 1 << 20
#: Items whose shingles a task keeps at a time.
KEPT_ITEMS = 4096
#: ASCII punctuation and white space separate words; digits, letters and all beyond ASCII belong to them.
_CLEAN = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_CLEAN).split()


def _shingles(words: list) -> set[tuple]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def question_and_answer(words: list) -> tuple[list, list]:
    """An item's two parts. Items carry no mark of their own, so the first half of the words is the question."""
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


class Statistics(NamedTuple):
    """Of all items with a word: their number, words in all, and items with each term (of those asked for)."""

    n: int
    words: int
    df: dict[bytes, int]


class LengthClass:
    """Postings of the items of one length class with BM25 impacts, their maxima per term and per block of items.

    All in flat arrays, as large as the items' words: postings by term and item, and block maxima by term and block
    (only of blocks that have the term). Terms are numbered within the class, `local` translates.
    """

    def __init__(self, words: np.ndarray, lens: np.ndarray, idf: np.ndarray, mean: float, step: int, first_item: int) -> None:
        self.step, self.first_item, n = step, first_item, len(lens)
        own, at = np.unique(words, return_inverse=True)
        self.n_terms, self.n_items = len(own), n
        self.local = np.full(len(idf) + 1, len(own), dtype=np.int32)  # the last number stands for words that no item of the class has
        self.local[own] = np.arange(len(own))
        self.n_blocks = -(-n // BLOCK)
        pairs, tf = np.unique(at.astype(np.int64) * n + np.repeat(np.arange(n), lens), return_counts=True)
        term, item = np.divmod(pairs, n)
        raw = idf[own[term]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[item] / mean))
        whole = np.bincount(item, weights=raw, minlength=n)
        self.post_item, self.post_impact = item.astype(np.int32), (raw / whole[item]).astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(own))), [len(pairs)]])
        first = np.flatnonzero(np.diff(term * (self.n_blocks + 1) + item // BLOCK, prepend=-1))
        self.max_block = (item[first] // BLOCK).astype(np.int32)
        self.max_impact = np.maximum.reduceat(self.post_impact, first)
        self.max_starts = np.searchsorted(term[first], np.arange(len(own) + 2))
        self.term_max = np.append(np.maximum.reduceat(self.post_impact, self.starts[:-2]), np.float32(0))

    @staticmethod
    def _of(starts: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Places of all entries of the terms q."""
        lens = starts[q + 1] - starts[q]
        return np.repeat(starts[q] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())

    @staticmethod
    def _sums(keys: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys (below `size`) and the sums of their weights, by arrays as long as the shorter of the keys met and all of them."""
        if size <= 8 * len(keys):
            return np.arange(size), np.bincount(keys, weights=weights, minlength=size)
        own, place = np.unique(keys, return_inverse=True)
        return own, np.bincount(place, weights=weights, minlength=len(own))

    def search_many(self, owner: np.ndarray, term: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item by position in the class, score) of what scores at least the threshold, by passage and item.

        `owner`, in ascending order, and `term` give the words of passages as the class numbers them. Passages are
        searched many at a time, as many as meet MET entries of block maxima, one at least.
        """
        known = term < self.n_terms
        own, q = np.divmod(np.unique(owner[known] * np.int64(self.n_terms) + term[known]), self.n_terms)
        enough = np.bincount(own, self.term_max[q])[own] >= threshold - 1e-5 if len(own) else np.zeros(0, bool)  # WAND's bound again, repeats apart
        own, q = own[enough], q[enough]
        met = np.cumsum(self.max_starts[q + 1] - self.max_starts[q])
        out, at = [], 0
        while at < len(own):
            end = int(np.searchsorted(met, (met[at - 1] if at else 0) + MET, "right"))
            if end < len(own):  # whole passages
                end = int(np.searchsorted(own, own[max(end, at)]))
                end = end if end > at else int(np.searchsorted(own, own[at], "right"))
            out.append(self._searched(own[at:end], q[at:end], threshold))
            at = end
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else empty

    def _searched(self, own: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for distinct (passage, term): block maxima first, then the postings of the blocks that are left."""
        passages, place = np.unique(own, return_inverse=True)
        n = self.max_starts[q + 1] - self.max_starts[q]
        keys, sums = self._sums(np.repeat(place, n) * self.n_blocks + self.max_block[self._of(self.max_starts, q)], self.max_impact[self._of(self.max_starts, q)], len(passages) * self.n_blocks)
        live = keys[sums >= threshold - 1e-5]
        left = np.isin(place, live // self.n_blocks)
        if not left.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        place, q = place[left], q[left]
        at, place = self._of(self.starts, q), np.repeat(place, self.starts[q + 1] - self.starts[q])
        key = place * self.n_blocks + self.post_item[at] // BLOCK
        hit = live[np.minimum(np.searchsorted(live, key), len(live) - 1)] == key
        keys, scores = self._sums(place[hit] * self.n_items + self.post_item[at[hit]], self.post_impact[at[hit]], len(passages) * self.n_items)
        best = scores >= threshold - 1e-5
        place, item = np.divmod(keys[best], self.n_items)
        return passages[place], item, scores[best]

    def search(self, query: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Items (by position in the class) of one passage's terms, as the class numbers them, that score at least the threshold."""
        q = np.array(query, dtype=np.int64)
        _, items, scores = self.search_many(np.zeros(len(q), np.int64), q, threshold)
        return list(zip(items.tolist(), scores.tolist()))


class ItemIndex:
    """An index of test items by length classes, and the items' words as term numbers.

    Of an id that several items share all count. An index of a part of the benchmark is given the statistics of the whole.
    """

    def __init__(self, items: list[tuple[int, str | None]], whole: Statistics | None = None) -> None:
        kept = [(i, w) for i, t in items if i is not None and len(w := terms(t or "")) >= SHINGLE]
        kept.sort(key=lambda x: (len(x[1]), x[0]))
        self.ids = [i for i, _ in kept]
        n = len(kept)
        self.vocab = {t: k for k, t in enumerate(sorted({t for _, w in kept for t in w}))}
        self.words = np.array([self.vocab[t] for _, w in kept for t in w], dtype=np.int32)
        lens = np.array([len(w) for _, w in kept], dtype=np.int64)
        self.ends = np.cumsum(lens)
        all_n, all_words = (whole.n, whole.words) if whole else (n, int(lens.sum()))
        if whole:
            df = np.array([whole.df[t] for t in self.vocab], dtype=np.int64)
        else:
            df = np.bincount(np.unique(self.words.astype(np.int64) * n + np.repeat(np.arange(n), lens)) // max(1, n), minlength=len(self.vocab))
        idf = np.log(1 + (all_n - df + 0.5) / (df + 0.5))
        self.classes: list[LengthClass] = []
        lo, step = 0, SHORTEST
        while lo < n:
            while step < lens[lo]:
                step *= 2
            hi = int(np.searchsorted(lens, step, "right"))
            begin = int(self.ends[lo] - lens[lo])
            self.classes.append(LengthClass(self.words[begin : self.ends[hi - 1]], lens[lo:hi], idf, all_words / all_n, step, lo))
            lo = hi
        self.parts: dict[int, tuple[list[int], set, list[tuple[set, int]]]] = {}

    def shingles_of(self, item: int) -> tuple[list[int], set, list[tuple[set, int]]]:
        """An item's words, its shingles, and (shingles, words) of its question and answer; kept for a while, as few items are ever retrieved."""
        if item not in self.parts:
            if len(self.parts) >= KEPT_ITEMS:
                self.parts.clear()
            words = self.words[self.ends[item - 1] if item else 0 : self.ends[item]].tolist()
            self.parts[item] = words, _shingles(words), [(_shingles(p), len(p)) for p in question_and_answer(words) if p]
        return self.parts[item]

    def verified(self, item: int, passage: list[int], grams: dict[int, set] | None = None) -> tuple[float, float] | None:
        """Shares of the question's and the answer's shingles in the passage (term numbers), if the pair is a leak.

        `grams` holds the passage's shingles by their size, from one item to the next.
        """
        words, whole, parts = self.shingles_of(item)
        grams = {} if grams is None else grams
        for size in {SHINGLE, min(SHINGLE, len(words)), *(min(SHINGLE, size) for _, size in parts)} - grams.keys():
            grams[size] = _shingles(passage) if size == SHINGLE else {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
        shares = [len(want & grams[min(SHINGLE, size)]) / len(want) for want, size in parts]
        if min(shares) < OVERLAP:
            shared = whole & grams[min(SHINGLE, len(words))]
            if len(shared) < OVERLAP * len(whole):
                return None
            covered = np.zeros(len(words), dtype=bool)
            for i in range(len(words) - SHINGLE + 1):
                if tuple(words[i : i + SHINGLE]) in shared:
                    covered[i : i + SHINGLE] = True
            if any(p.mean() < FLOOR for p in question_and_answer(covered) if len(p)):
                return None
        return shares[0], shares[-1]

    def leaks(self, texts: list[str], threshold: float = THRESHOLD) -> list[tuple[int, int, int, float, float, float]]:
        """(text's position, item id, first word of the passage, score, question share, answer share), one row per
        text and item: the passage with the best score, the first of equal ones.

        A class's passages are two steps long and start at every step, and no item of the class is longer than a
        step, so any place of any item lies within one passage.
        """
        words = [terms(t) for t in texts]
        get, unknown = self.vocab.get, len(self.vocab)
        flat = np.array([get(w, unknown) for ws in words for w in ws], dtype=np.int64)
        lens = np.array([len(ws) for ws in words], dtype=np.int64)
        found: dict[tuple[int, int], tuple] = {}
        if len(flat):
            for c in self.classes:
                self._class_leaks(c, flat, lens, threshold, found)
        best: dict[tuple[int, int], tuple] = {}
        for (d, k), hit in sorted(found.items(), key=lambda x: (x[0][0], -x[1][0], x[0][1])):
            best.setdefault((d, self.ids[k]), hit)  # of items that share an id the best
        return [(d, i, s, score, q, a) for (d, i), (score, s, q, a) in sorted(best.items())]

    def _class_leaks(self, c: LengthClass, flat: np.ndarray, lens: np.ndarray, threshold: float, found: dict) -> None:
        """Adds the leaks of one class's items."""
        steps = -(-lens // c.step)
        own = np.repeat(np.arange(len(lens)), steps)
        start = (np.arange(len(own)) - np.repeat(np.cumsum(steps) - steps, steps)) * c.step
        cuts = start + np.repeat(np.cumsum(lens) - lens, steps)
        follows = np.append(own[1:] == own[:-1], False)
        local = c.local[flat]
        # bounds of each step; repeats within it count again, which only loosens them
        wand = np.add.reduceat(c.term_max[local].astype(np.float64), cuts)
        passage = wand + np.where(follows, np.append(wand[1:], 0), 0)
        ends = np.append(cuts[1:], len(flat))
        live = np.flatnonzero(passage >= threshold - 1e-5)
        until = np.where(follows, ends[np.minimum(np.arange(len(own)) + 1, len(own) - 1)], ends)
        n = until[live] - cuts[live]
        words = local[np.repeat(cuts[live] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        near, item, score = c.search_many(np.repeat(live, n), words, threshold)
        before, said, grams = -1, [], {}
        for p, k, x in zip(near.tolist(), (item + c.first_item).tolist(), score.tolist()):
            key = (int(own[p]), k)
            if key in found and found[key][0] >= x:
                continue
            if p != before:
                before, said, grams = p, flat[cuts[p] : until[p]].tolist(), {}
            if shares := self.verified(k, said, grams):
                found[key] = (x, int(start[p]), *shares)


def _item_terms(items: DataFrame) -> DataFrame:
    """(part, term, words) of each item with a word: its terms once each; `words`, the item's length, stands on its first row only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, found, sizes = [], [], []
            for part, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = terms(t)
                own = own if len(own) >= SHINGLE else []
                once = set(own)
                parts += [part] * len(once)
                found += once
                sizes += [len(own), *[None] * (len(once) - 1)] if own else []
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(found, pa.binary()), pa.array(sizes, pa.int64())], ["part", "term", "words"])

    return items.filter("id is not null").select("part", "text").mapInArrow(run, "part long, term binary, words long")


def _rounds(benchmark: DataFrame, item_id: str, text: str) -> Iterator[ItemIndex]:
    """Indexes of the items in parts of at most INDEX_BYTES of text each, by a stable hash of the id; the driver holds one part.

    Scores and passages don't depend on the parts: with more than one, document frequencies, lengths and the
    number of items are counted over the whole benchmark, and each part fetches those of its own terms.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), text_col(text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // INDEX_BYTES) or 1
    if parts == 1:
        yield ItemIndex([(r["id"], r["text"]) for r in items.collect()])
        return
    items = items.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    each = cut(_item_terms(items), "item-terms")
    n, words = each.agg(F.count("words"), F.sum("words")).first()
    df = cut(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item-df")
    for k in range(parts):
        own = df.join(each.filter(F.col("part") == k).select("term").distinct(), "term")
        whole = Statistics(n or 0, words or 0, {bytes(r["term"]): r["df"] for r in own.collect()})
        yield ItemIndex([(r["id"], r["text"]) for r in items.filter(F.col("part") == k).collect()], whole)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, first_word, score, question_share, answer_share) of each leak.

    Null and empty texts and items have none; items with a null id are left out; repeated rows of a document
    give repeated rows, repeated items one per document. An empty benchmark or table gives no rows. Long texts take
    memory in proportion to their words. Other columns, whatever their names, aren't read.
    """
    tune(docs.sparkSession)
    schema = "doc_id long, item_id long, first_word long, score double, question_share double, answer_share double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text"))
    out = None
    for index in _rounds(benchmark, item_id, "text"):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for lo in range(0, len(texts), 256):
                    got = index.leaks(texts[lo : lo + 256], threshold)
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    cols = [[ids[lo + g[0]] for g in got], *[[g[i] for g in got] for i in range(1, 6)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "first_word", "score", "question_share", "answer_share"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents without a leak, in all columns of `docs`: decided row by row, so nothing is shuffled.

    Null and empty texts have no leak and stay. Repeated rows fare alike. An empty benchmark keeps all, an empty
    table gives no rows. Other columns may have any names and keep their values. Long texts take memory in
    proportion to their words, a batch of texts at a time.
    """
    tune(docs.sparkSession)
    for index in _rounds(benchmark, item_id, "text"):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def judge(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                leaky = {lo + g[0] for lo in range(0, len(texts), 256) for g in sent.value.leaks(texts[lo : lo + 256], threshold)}
                yield b.filter(pa.array([i not in leaky for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(judge, docs.schema)
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    got = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", "first_word", F.round("score", 4).alias("score"), F.round("question_share", 4).alias("question_share"), F.round("answer_share", 4).alias("answer_share"))
