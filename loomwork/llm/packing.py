"""Packing of token sequences by the dot-product heuristic of vector bin packing.

An example is a vector of tokens, one segment and loss-bearing tokens; a sequence has a limit on each. Every task
packs the examples of its own partition, so no row is shuffled for it: it holds a bounded pool of examples, opens
one sequence after another and adds, of the pool's examples that fit, the one whose vector has the largest dot
product with the room that is left (limits are units, and dimensions count by the pool's mean demand). What then
stays open is filled by the head of an example that is cut; its rest goes back to the pool. What a task cannot
fill at its end, and what is short because its segments ran out, is dealt to sequences of powers of two, which
need no padding. Without cutting, short sequences are padded.

A sequence's number is its task's and a count within the task; a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .batch_bpe import batch_encoder
from .common import table, text_col, tune

#: Examples that a task chooses among: at most so many times the sequence's tokens in memory.
POOL = 512
END_ID = 1
PIECE = "doc_id long, start long, length long, doc_tokens long, loss long, sequence_id long, offset long, ids binary"
_NAMES = [f.split(" ")[0] for f in PIECE.split(", ")]
_KINDS = [pa.int64()] * 7 + [pa.binary()]


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most: tokens, segments and loss-bearing tokens."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Example:
    """What is left of an example: from `start` on; its first `prompt` tokens bear no loss."""

    key: int | None
    ids: bytes
    size: int
    prompt: int
    start: int = 0

    @property
    def left(self) -> int:
        return self.size - self.start

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.prompt))

    def head(self, tokens: int, loss: int) -> int:
        """How many of the next tokens fit both."""
        return min(self.left, tokens, max(0, self.prompt - self.start) + loss)

    def taken(self, length: int) -> tuple:
        """The next piece: (key, start, length, size, loss, ids); what is left begins after it."""
        piece = (self.key, self.start, length, self.size, self.loss(length), self.ids[4 * self.start : 4 * (self.start + length)])
        self.start += length
        return piece


def padded_length(total: int | Column, limit: int) -> int | Column:
    """A sequence's length with padding: none at a power of two."""
    if isinstance(total, Column):
        return F.when(F.bit_count(total) == 1, total).otherwise(F.lit(limit).cast("long"))
    return total if total.bit_count() == 1 else limit


class Packer:
    """One task's pool and numbering; `add` and `finish` give rows of PIECE."""

    def __init__(self, limits: Limits, cut: bool, first: int) -> None:
        self.limits, self.cut, self.next = limits, cut, first
        self.unit = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pool: list[Example] = []
        self.need = np.zeros((3, 2 * POOL))  # the pool's vectors, by dimension

    def _put(self, e: Example) -> None:
        self.need[:, len(self.pool)] = e.left, 1, e.loss(e.left)
        self.pool.append(e)

    def _out(self, k: int) -> Example:
        """Takes example k out of the pool; the last one takes its place."""
        e, last = self.pool[k], self.pool.pop()
        if last is not e:
            self.pool[k], self.need[:, k] = last, self.need[:, len(self.pool)]
        return e

    def _closed(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for key, start, length, size, loss, ids in pieces:
            yield key, start, length, size, loss, self.next, at, ids
            at += length
        self.next += 1

    def _shared_out(self, pieces: list[tuple]) -> Iterator[tuple]:
        """A short sequence's pieces as sequences of powers of two, longest first."""
        total = sum(p[2] for p in pieces)
        whole = [Example(key, ids, length, length - loss) for key, _, length, _, loss, ids in pieces]  # a piece's loss-bearing tokens are its last
        k = 0
        while total:
            room, part = 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                base, e = pieces[k], whole[k]
                key, start, length, _, loss, ids = e.taken(min(e.left, room))
                part.append((key, base[1] + start, length, base[3], loss, ids))
                room -= length
                k += not e.left
            yield from self._closed(part)

    def _filled(self) -> Iterator[tuple]:
        """Opens, fills and closes one sequence of what the pool holds."""
        room, pieces = self.unit.copy(), []
        weights = self.need[:, : len(self.pool)].mean(axis=1) / self.unit**3
        while self.pool and room[0] and room[1]:
            tokens, segments, loss = self.need[:, : len(self.pool)]
            if self.cut and room[1] == 1:  # the last segment is for what fills the sequence
                fits = (tokens == room[0]) & (loss <= room[2])
            else:
                fits = (tokens <= room[0]) & (loss <= room[2])
            a, b, c = weights * room
            k = int(np.where(fits, tokens * a + segments * b + loss * c, -1.0).argmax())
            if not fits[k]:
                break
            e = self._out(k)
            pieces.append(e.taken(e.left))
            room -= pieces[-1][2], 1, pieces[-1][4]
        if self.cut and self.pool and room[0] and room[1]:
            tokens, _, loss = self.need[:, : len(self.pool)]
            heads = np.minimum(np.minimum(tokens, room[0]), tokens - loss + room[2])
            e = self._out(int((heads * 2.0**32 + tokens).argmax()))  # of the longest heads the one that leaves most
            if length := e.head(int(room[0]), int(room[2])):
                pieces.append(e.taken(length))
                room[0] -= length
            if e.left:
                self._put(e)
        yield from self._shared_out(pieces) if self.cut and room[0] else self._closed(pieces)

    def add(self, e: Example) -> Iterator[tuple]:
        """An example over a limit is cut at once, by whole sequences, also where examples are else left whole."""
        while e.left > self.limits.tokens or e.loss(e.left) > self.limits.loss:
            length = e.head(self.limits.tokens, self.limits.loss)
            yield from self._shared_out([e.taken(length)]) if self.cut else self._closed([e.taken(length)])
        if e.left:
            self._put(e)
        while len(self.pool) >= POOL:
            yield from self._filled()

    def finish(self) -> Iterator[tuple]:
        while self.pool:
            yield from self._filled()


def _packed(rows: DataFrame, examples, limits: Limits, cut: bool) -> DataFrame:
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("every limit is 1 at least")
    tune(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut, TaskContext.get().partitionId() << 33)
        told = lambda got: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), _KINDS)], _NAMES)
        got = []
        for b in batches:
            for e in examples(b):
                got += packer.add(e)
                if len(got) >= 4096:
                    yield told(got)
                    got = []
        got += packer.finish()
        if got:
            yield told(got)

    return rows.mapInArrow(run, PIECE)


def pack(encoded: DataFrame, limits: Limits = Limits(), cut: bool = True) -> DataFrame:
    """Pieces (PIECE) of encoded examples (doc_id, ids array<int>, n_prompt): every token in exactly one piece.

    `n_prompt` tokens at an example's head bear no loss; null counts as 0. Null and empty lists have no piece. Rows
    that repeat an id, and rows with a null id, are examples of their own; an empty table gives no rows. An example
    over a limit is cut by whole sequences first, however long it is. Other columns are left out. `ids` are
    little-endian unsigned 32-bit numbers; pieces of one sequence follow each other.
    """

    def examples(b: pa.RecordBatch) -> Iterator[Example]:
        for key, ids, prompt in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            if ids.is_valid and len(ids):
                numbers = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
                yield Example(key, numbers.tobytes(), len(numbers), max(0, prompt or 0))

    return _packed(encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"), F.col("n_prompt").cast("int")), examples, limits, cut)


def pack_texts(docs: DataFrame, limits: Limits = Limits(), cut: bool = True, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`pack` of texts that are encoded on the way, each followed by `end_id`.

    A text's first token has nothing before it to be predicted from, so it bears no loss. Null texts count as empty:
    they are the end alone. Repeats, null ids, empty tables and other columns as in `pack`; a long text takes memory
    in proportion to its tokens.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bpe.spec_of(path or bpe.tokenizer_path()))  # a vocabulary: a few MB, whatever the input
    end = end_id.to_bytes(4, "little")

    def examples(b: pa.RecordBatch) -> Iterator[Example]:
        for key, ids in zip(b.column(0).to_pylist(), batch_encoder(sent.value).encode(b.column(1).to_pylist())):
            yield Example(key, ids + end, len(ids) // 4 + 1, 1)

    return _packed(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text")), examples, limits, cut)


def sequences(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(sequence_id, n_tokens, padded, ids, lengths): each sequence's ids, its segments' lengths and its length with padding.

    A group is one sequence, so it is bounded by the limits.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("_p"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate(F.transform("_p", lambda p: p["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return rows.select("sequence_id", "n_tokens", padded_length(F.col("n_tokens"), limits.tokens).alias("padded"), ids.alias("ids"), F.transform("_p", lambda p: p["length"]).alias("lengths"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens and 256 segments at most; documents bear loss nearly everywhere, so its limit is that of tokens."""
    got = pack_texts(table(spark, sf_dir, "documents"), Limits())
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
