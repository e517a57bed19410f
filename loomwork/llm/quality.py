"""Quality: a linear-chain CRF labels every line good or bad; length-weighted marginals make the document's score.

Features of a line come from the line itself and from its neighbours (the line before and after), so that a
stretch of junk pulls in its edges. Training has document labels only: lines start with their document's
label and are relabelled once by the first model, so that intact lines of bad documents count as good.
Forward-backward runs over all documents of a batch at once, line by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_col, tune
from .labelled import fold, sample
from .logistic import Logistic

#: Labelled documents per class that are learnt from, at most, and their lines: documents enter in the order of hashed
#: ids, whole, as long as they fit.
SAMPLE_PER_CLASS = 1500
SAMPLE_LINES = 300_000
CUTOFF = 0.3
_KINDS = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _KINDS[_c] = 1 if _ch.isascii() and _ch.isupper() else 2 if _ch.isascii() and _ch.islower() else 3 if _ch.isascii() and _ch.isdigit() else 4 if _ch in "#*$%&|<>{}[]\\~^=_" else 5 if _ch in "!?" else 6 if _ch in ".,;:'\"()-/" else 7 if _ch in " \t\r\x0b\x0c" else 8 if 0x80 <= _c < 0xC0 else 0
OWN = 11
WIDTH = 3 * OWN + 1


def line_features(lines: list[str]) -> np.ndarray:
    """Own features of each line: shares of character classes, word lengths, repetition, earlier lines that are equal."""
    data = np.frombuffer("\n".join(lines).encode("utf-8", "replace") + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kinds = _KINDS[data]
    at = np.minimum(starts, len(data) - 1)
    count = lambda k: np.add.reduceat((kinds == k).astype(np.int32), at)
    chars = np.maximum(1, ends - starts - count(8))
    words, distinct, again, seen = [], [], [], set()
    for line in lines:
        w = line.split()
        words.append(len(w))
        distinct.append(len(set(w)))
        again.append(bool(w) and line in seen)
        seen.add(line)
    words, distinct = np.array(words), np.array(distinct)
    n = np.maximum(1, words)
    repeated = 1 - distinct / n
    return np.stack([
        count(1) / chars, count(3) / chars, np.minimum(1, 3 * count(4) / chars), np.minimum(1, 8 * count(5) / chars), count(6) / chars,
        np.minimum(1, np.maximum(0, repeated - 0.25) * 2) * (words > 12), np.minimum(1, chars / n / 20), np.log1p(words) / 6, (words < 3).astype(float), np.array(again, dtype=float), (repeated > 0.6) * (words > 5) * 1.0,
    ], axis=1)


def own_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of the lines with a word, each by itself; weights are lengths."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return (line_features(lines) if lines else np.zeros((0, OWN))), np.array([len(v) for v in lines], dtype=float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Each line's own, previous and next line's features, and a bias."""
    none = np.zeros((1, OWN))
    return np.hstack([own, np.vstack([none, own])[:-1], np.vstack([own, none])[1:], np.ones((len(own), 1))])


def document(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of the lines with a word."""
    own, weights = own_features(text)
    return with_neighbours(own), weights


def marginals(emit: list[np.ndarray], trans: np.ndarray, pairs: np.ndarray | None = None) -> list[np.ndarray]:
    """P(good) of each line of each document by forward-backward, from emissions (lines by 2), all documents at once.

    Adds the expected counts of neighbouring labels to `pairs` (2 by 2), if given.
    """
    order = sorted(range(len(emit)), key=lambda i: -len(emit[i]))
    lens = np.array([len(emit[i]) for i in order])
    out = [np.zeros(0)] * len(emit)
    if not len(lens) or not lens[0]:
        return out
    flat = np.concatenate([emit[i] for i in order])
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    alpha, beta = np.zeros_like(flat), np.zeros_like(flat)
    active = [int(np.searchsorted(-lens, -t, side="left")) for t in range(lens[0])]  # documents with more than t lines
    n = active[0]
    alpha[first[:n]] = flat[first[:n]]
    for t in range(1, lens[0]):
        at = first[: active[t]] + t
        alpha[at] = np.logaddexp(alpha[at - 1, 0, None] + trans[0], alpha[at - 1, 1, None] + trans[1]) + flat[at]
    for t in range(lens[0] - 2, -1, -1):
        at = first[: active[t + 1]] + t
        nxt = flat[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(trans[:, 0] + nxt[:, 0, None], trans[:, 1] + nxt[:, 1, None])
    good = 1 / (1 + np.exp(np.clip((alpha + beta)[:, 0] - (alpha + beta)[:, 1], -500, 500)))
    if pairs is not None:
        whole = np.logaddexp(*(alpha + beta).T)
        to = np.concatenate([np.arange(f + 1, f + n) for f, n in zip(first, lens)])
        pairs += np.exp(alpha[to - 1, :, None] + trans + (flat + beta)[to, None, :] - whole[to, None, None]).sum(axis=0)
    for j, i in enumerate(order):
        out[i] = good[first[j] : first[j] + lens[j]]
    return out


class LineCRF:
    """Two labels (0 bad, 1 good): emission weights per feature, transition weights, fitted to line labels."""

    def __init__(self, emit: np.ndarray, trans: np.ndarray) -> None:
        self.emit, self.trans = emit, trans

    @classmethod
    def fit(cls, docs: list[np.ndarray], labels: list[np.ndarray], rounds: int = 60, l2: float = 1e-3, rate: float = 0.3) -> "LineCRF":
        """Adam on the penalized log-likelihood."""
        w, tr = np.zeros((WIDTH, 2)), np.zeros((2, 2))
        state = [np.zeros_like(v) for v in (w, w, tr, tr)]
        x, y = np.concatenate(docs), np.concatenate(labels).astype(int)
        lens = np.array([len(d) for d in docs])
        inner = np.ones(len(x), dtype=bool)
        inner[np.cumsum(lens)[:-1]] = False
        inner[0] = False
        to = np.flatnonzero(inner)  # lines that have one before them in their document
        gold = np.zeros((2, 2))
        np.add.at(gold, (y[to - 1], y[to]), 1)
        hot = np.eye(2)[y]
        cuts = np.cumsum(lens)[:-1]
        for step in range(1, rounds + 1):
            e = x @ w
            pairs = np.zeros((2, 2))
            good = np.concatenate(marginals(np.split(e, cuts), tr, pairs))
            p = np.stack([1 - good, good], axis=1)
            g = x.T @ (hot - p) / len(x) - l2 * w
            gt = (gold - pairs) / len(x) - l2 * tr
            for v, d, a, b in ((w, g, *state[:2]), (tr, gt, *state[2:])):
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                v += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return cls(w, tr)

    def lines(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        return marginals([x @ self.emit for x in xs], self.trans)


def summary(good: np.ndarray, weights: np.ndarray) -> list[float]:
    """Of a document: length-weighted mean of P(good), share of length in surely bad lines, smallest P(good), no line at all."""
    if not len(good):
        return [0.0, 1.0, 0.0, 1.0]
    total = weights.sum()
    return [float((good * weights).sum() / total), float(weights[good < 0.5].sum() / total), float(good.min()), 0.0]


class QualityModel:
    """The line model and the document's logistic model over its summary."""

    def __init__(self, crf: LineCRF, final: Logistic) -> None:
        self.crf, self.final = crf, final

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray) -> "QualityModel":
        return cls.learn([document(t) for t in texts], y)

    @classmethod
    def learn(cls, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> "QualityModel":
        some = [i for i, (x, _) in enumerate(docs) if len(x)]
        xs = [docs[i][0] for i in some]
        crf = LineCRF(np.zeros((WIDTH, 2)), np.zeros((2, 2)))
        if some and y.min() != y.max():
            crf = LineCRF.fit(xs, [np.full(len(x), y[i]) for i, x in zip(some, xs)])
            again = [np.where(g > 0.5, 1, 0) if y[i] == 0 else np.ones(len(g)) for i, g in zip(some, crf.lines(xs))]
            crf = LineCRF.fit(xs, [a if y[i] == 1 or not a.all() else np.zeros(len(a)) for i, a in zip(some, again)])
        sums = np.array([summary(g, w) for g, (_, w) in zip(crf.lines([x for x, _ in docs]), docs)]).reshape(-1, 4)
        return cls(crf, Logistic.fit(sums, y))

    def score(self, texts: list[str]) -> np.ndarray:
        docs = [document(t) for t in texts]
        sums = np.array([summary(g, w) for g, (_, w) in zip(self.crf.lines([x for x, _ in docs]), docs)]).reshape(-1, 4)
        return self.final.predict(sums)


def _lines_of(rows: DataFrame) -> DataFrame:
    """(doc_id, y, n, own, weights) of rows (doc_id, text, y): the lines' features in a row; texts stay on the executors."""
    names = ["doc_id", "y", "n", "own", "weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [own_features(t) for t in b.column(2).to_pylist()]
            lists = [pa.array([v.astype(np.float32).ravel() for v in part], pa.list_(pa.float32())) for part in zip(*got)] if got else [pa.array([], pa.list_(pa.float32()))] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(w) for _, w in got], pa.int64()), *lists], names)

    return rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, n long, own array<float>, weights array<float>")


def train(docs: DataFrame, labels: DataFrame, usable, per_class: int = SAMPLE_PER_CLASS, most_lines: int = SAMPLE_LINES) -> QualityModel:
    """A model from a bounded sample of labelled documents; without usable labels the score is the base rate.

    The driver fetches 48 bytes for each of `most_lines` lines at most, and no texts. Labels that are null or neither
    0 nor 1, and such of a null doc_id, don't count; of several labels of a document the largest does; repeated
    rows count once.
    """
    tune(docs.sparkSession)
    rows = cut(_lines_of(sample(docs, labels, "quality", usable, per_class)), "quality-lines")
    sizes = rows.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # 2 * per_class rows at most
    taken, left = [], most_lines
    for r in sizes:
        if r["n"] <= left:
            taken.append(r["doc_id"])
            left -= r["n"]
    chosen = rows if len(taken) == len(sizes) else rows.filter(F.col("doc_id").isin(taken))
    got = chosen.orderBy("doc_id").collect()
    if not got:
        return QualityModel(LineCRF(np.zeros((WIDTH, 2)), np.zeros((2, 2))), Logistic.fit(np.zeros((0, 4)), np.zeros(0)))
    lines = [(with_neighbours(np.array(r["own"], dtype=float).reshape(-1, OWN)), np.array(r["weights"], dtype=float)) for r in got]
    return QualityModel.learn(lines, np.array([r["y"] for r in got], dtype=float))


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row, repeated ones and ones with a null doc_id too.

    Texts without a word, null and empty ones count as one bad line. A long text takes some hundred bytes per line.
    An empty table gives no rows. Other columns, whatever their names, are left out.
    """
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [sent.value.score(texts[i : i + 256]) for i in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(got) if got else [], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).mapInArrow(run, "doc_id long, score double")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = scored(docs, train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0))
    return got.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
