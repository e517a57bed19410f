"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be inside a merged symbol, so the text may be
cut between its two bytes: the fragments are encoded independently and their ids concatenated, which gives
the ids of the whole. Pairs at a word's end (whose second byte carries the end-of-word suffix) are judged
apart, as they have fewer tokens. Whole words repeat, so most come from a bounded cache.

The tokenizer file (a public one of the JSON kind) is a parameter; executors read it by the same path, else
from the text that the driver sends along.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_col, tune

DEFAULT_FILE = "word_bpe_49k.json"
CACHE_WORDS = 150_000
# Letters and numbers below U+0100; texts above that are split by the library's own pre-tokenizer.
_LETTER, _NUMBER = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9²³¹¼-¾"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t-\r \x85\xa0{_LETTER}{_NUMBER}]+")
#: The pattern that the fast splitter is for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


class _Words(dict):
    """What each pre-token gives, worked out when first met; cleared between texts once it is full."""

    def __init__(self, bpe: "ForcedBPE") -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> str:
        got = self.bpe.word(word)
        if len(word) <= 64:
            self[word] = got
        return got


class ForcedBPE:
    """Encoder and decoder of one tokenizer file with a whole-word BPE model over bytes."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.lib.no_truncation()
        self.lib.no_padding()
        j = json.loads(spec)
        model = j["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        if any(t.get(k) for t in j.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens with stripping or normalizing aren't supported")
        split = j["pre_tokenizer"]["pretokenizers"][0]
        if j["decoder"] is not None or split["pattern"].get("Regex") != _PATTERN or [n["type"] for n in j["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a tokenizer file of another kind")
        loose = json.loads(spec)
        loose["model"]["end_of_word_suffix"] = None
        self.at_end, self.inside = self.lib.model, Tokenizer.from_str(json.dumps(loose)).model
        self.by_id = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.letters = _byte_letters()
        self.inner: set[str] = set()  # byte pairs inside tokens, the second byte not at a word's end
        self.final: set[str] = set()  # the same, the second byte at a word's end
        for t in self.vocab:
            ends = bool(self.suffix) and t.endswith(self.suffix)
            s = t[: -len(self.suffix)] if ends else t
            pairs = [s[i : i + 2] for i in range(len(s) - 1)]
            if ends and pairs:
                self.final.add(pairs.pop())
            self.inner.update(pairs)
        if missing := [c for c in self.letters if c not in self.vocab or c + self.suffix not in self.vocab]:
            raise ValueError(f"no token for the bytes {missing}")
        self.words = _Words(self)
        self.stops = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def pieces(self, letters: str) -> list[str]:
        """A word's fragments between its forced cuts."""
        out, last, n = [], 0, len(letters)
        for i in range(1, n):
            if letters[i - 1 : i + 1] not in (self.final if i == n - 1 and self.suffix else self.inner):
                out.append(letters[last:i])
                last = i
        out.append(letters[last:])
        return out

    def word(self, word: str) -> str:
        """Ids of one pre-token, joined by one space: its fragments' one after another."""
        letters = "".join([self.letters[b] for b in word.encode("utf-8", "replace")])
        cuts = self.pieces(letters)
        tokens = [t for piece in cuts[:-1] for t in self.inside.tokenize(piece)] + self.at_end.tokenize(cuts[-1])
        return " ".join([str(t.id) for t in tokens])

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            low = self.lib.normalizer.normalize_str(text)
            back = {c: b for b, c in enumerate(self.letters)}
            return [bytes(back[c] for c in w).decode("utf-8", "replace") for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(low)]
        return _FAST.findall(text.lower())

    def rows(self, text: str) -> list[str]:
        """Ids of each pre-token and special token of a text."""
        words = self.words
        if len(words) > CACHE_WORDS:
            words.clear()
        marks = list(self.stops.finditer(text)) if self.stops else []
        if not marks:
            return [words[w] for w in self.split(text)]
        out, at = [], 0
        for m in marks:
            out += [words[w] for w in self.split(text[at : m.start()])]
            out.append(str(self.special[m[0]]))
            at = m.end()
        return out + [words[w] for w in self.split(text[at:])]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids in self.rows(text or "") for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: tokens joined by one space, special ones included."""
        return " ".join([self.by_id[i] for i in ids])

    def count(self, text: str | None) -> int:
        return sum([ids.count(" ") + 1 for ids in self.rows(text or "")])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens and digests of the ids and of what they decode to."""
        ids = " ".join(self.rows(text or ""))
        decoded = self.decode([int(i) for i in ids.split(" ")]) if ids else ""
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return ids.count(" ") + bool(ids), sha(ids), sha(decoded)


@lru_cache(maxsize=4)
def load(spec: str) -> ForcedBPE:
    return ForcedBPE(spec)


def spec_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(docs: DataFrame, path: str, make, fields: list[tuple[str, pa.DataType]], schema: str, id_col: str, text: str) -> DataFrame:
    """Row by row over (id, text); the file's text is sent once per executor (a vocabulary: a few MB, whatever the input)."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(spec_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(sent.value)
        for b in batches:
            got = [make(bpe, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[i] for g in got], kind) for i, (_, kind) in enumerate(fields)]], ["doc_id", *[n for n, _ in fields]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text")).mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, repeated ones and ones with a null id too; null and empty texts give an empty list.

    An empty table gives no rows. Long texts take memory in proportion to their tokens. Other columns, whatever
    their names, are left out.
    """
    return _mapped(docs, path or tokenizer_path(), lambda bpe, t: (bpe.encode(t),), [("ids", pa.list_(pa.int32()))], "ids array<int>", id_col, text)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded) of every row (doc_id, ids), special tokens kept; null and empty lists give the empty string.

    An id that isn't in the vocabulary is an error. Repeated rows and null ids give as many rows, an empty table none.
    Long lists take memory in proportion to their ids. Other columns, whatever their names, are left out.
    """
    tune(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(spec_of(path or tokenizer_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i or []) for i in b.column(1).to_pylist()])], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, decoded string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of tokens and digests of the ids and of the decoded text, one row for each row of `docs`.

    Null and empty texts: no tokens, the digests of the empty string. Repeated rows and null ids give as many rows,
    an empty table none. Long texts take memory in proportion to their tokens. Other columns, whatever their names,
    are left out.
    """
    return _mapped(docs, path or tokenizer_path(), lambda bpe, t: bpe.digest(t), [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text)


def counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row; nulls, repeats, long texts, empty tables and other columns as in `digests`."""
    return _mapped(docs, path or tokenizer_path(), lambda bpe, t: (bpe.count(t),), [("n_tokens", pa.int64())], "n_tokens long", id_col, text)


def op3_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
