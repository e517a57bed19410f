"""The ids of many texts at once, over one byte array.

Texts within Latin-1 are laid one after another; tables give each byte's lower case and class, comparing neighbours
gives the pre-tokens' borders, and prefix sums of a polynomial give every pre-token's 64-bit hash. Pre-tokens are
then told apart by hash and length, and a bounded table holds what each gives, so that only new ones reach the
library's BPE model. Texts beyond Latin-1 or with special tokens, and pre-tokens over LONG letters, go one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from .bpe import ForcedBPE, load

#: Letters laid out at a time (one text may be longer) and pre-tokens remembered: some 40 bytes each.
CHUNK, REMEMBERED, LONG = 1 << 21, 1_500_000, 64
_BASE = 0x9E3779B97F4A7C15
_WHITE, _LETTER, _NUMBER, _OTHER = range(4)


def _kind(c: str) -> int:
    if c in "\t\n\x0b\x0c\r \x85\xa0":
        return _WHITE
    return _LETTER if c.isalpha() else _NUMBER if c.isnumeric() else _OTHER


_LOWER = np.array([ord(chr(i).lower()) for i in range(256)], np.uint8)
_KIND = np.array([_kind(chr(i)) for i in range(256)], np.uint8)


class BatchEncoder:
    """Encodes lists of texts with one tokenizer's model; remembers pre-tokens between calls."""

    def __init__(self, bpe: ForcedBPE) -> None:
        self.bpe = bpe
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, CHUNK)
            fill = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
            self.powers, self.inverse = fill(_BASE), fill(pow(_BASE, -1, 1 << 64))

    def _word(self, word: bytes) -> list[int]:
        letters = "".join([self.bpe.letters[b] for b in word.decode("latin-1").encode()])
        return [t.id for t in self.bpe.at_end.tokenize(letters)]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        got = [self._word(w) for w in words]
        count = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, np.fromiter((i for g in got for i in g), np.uint32, int(count.sum()))])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.count = (np.insert(a, place, b) for a, b in ((self.keys, keys), (self.at, at), (self.count, count)))

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, place) of sorted keys in the table."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return (self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)), place

    @staticmethod
    def _borders(low: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens; the array ends in three blanks."""
        full = kind != _WHITE
        start = full.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        q = np.flatnonzero(low[:-3] == 39)  # an apostrophe that begins a pre-token takes some endings with it
        q = q[(q == 0) | (kind[q - 1] != _OTHER)]
        if len(q):
            one, two = low[q + 1], low[q + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
            start[q[short | long] + 1] = False
            for hit, n in ((short, 2), (long, 3)):
                start[q[hit] + n] = full[q[hit] + n]
        ends = np.flatnonzero(full[:-1] & (start[1:] | ~full[1:])) + 1
        return np.flatnonzero(start), ends

    def _laid(self, texts: list[bytes]) -> Iterator[bytes]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1  # a line end after each
        low = _LOWER[np.frombuffer(b"\n".join([*texts, b"\n\n"]), np.uint8)]
        kind = _KIND[low]
        starts, ends = self._borders(low, kind)
        self._reach(len(low))
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.powers[: len(low)], out=sums[1:])
        length = ends - starts
        keys = (sums[ends] - sums[starts]) * self.inverse[starts] + length.astype(np.uint64)
        is_long = length > LONG
        keys[is_long] = 0  # looked up apart
        distinct, first, each = np.unique(keys, return_index=True, return_inverse=True)
        data = low.tobytes()
        known, _ = self._found(distinct)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > REMEMBERED:
                known[:] = False
            new = ~known
            self._learn(distinct[new], [data[starts[i] : ends[i]] if length[i] <= LONG else b"" for i in first[new]])
        _, place = self._found(distinct)
        at, count, pool = self.at[place][each], self.count[place][each], self.pool
        if is_long.any():
            more = [np.array(self._word(data[starts[i] : ends[i]]), np.uint32) for i in np.flatnonzero(is_long)]
            count[is_long] = [len(m) for m in more]
            at[is_long] = len(pool) + np.cumsum(count[is_long]) - count[is_long]
            pool = np.concatenate([pool, *more])
        before = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        ids = pool[np.repeat(at - before[:-1], count) + np.arange(before[-1])].astype("<u4").tobytes()
        borders = before[np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))]
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            yield ids[4 * a : 4 * b]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Per text, in order, its ids as little-endian unsigned 32-bit numbers."""
        laid, size = [], 0
        for t in texts:
            try:
                if self.bpe.stops and self.bpe.stops.search(t):
                    raise ValueError
                plain = t.encode("latin-1")
            except ValueError:  # a UnicodeEncodeError is one
                yield from self._laid(laid)
                yield np.array(self.bpe.encode(t), "<u4").tobytes()
                laid, size = [], 0
                continue
            laid.append(plain)
            size += len(plain)
            if size >= CHUNK:
                yield from self._laid(laid)
                laid, size = [], 0
        yield from self._laid(laid)


@lru_cache(maxsize=2)
def batch_encoder(spec: str) -> BatchEncoder:
    return BatchEncoder(load(spec))
