"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

The lexicon (whole words and stems) is learnt from labelled documents: terms that lean to the toxic class beyond
chance, and that fill far more of toxic texts than of others. The intersection of the trie with the Levenshtein
automata of all its terms is one deterministic automaton, built lazily: a state is the set of (trie node,
automaton row) that are still within the allowed distance, and its transitions are kept once found. A word is
read until it dies, mostly within two or three letters. How many edits a term allows depends on its length, and on
how often words that near occur in clean documents: edits that ordinary words reach are not allowed.

Each hit weighs its term's weight, less by a factor per edit, times the chance that it is meant as abuse. That
chance comes from a window of words around the hit and from quotation marks, by a model trained on a small labelled
table of contexts (`context_table`), so quotation and report weigh little. Hits of one term that are more likely
quotation or report than abuse count once, by the largest: a word that is talked about isn't worse for being named
often. A document's score is a logistic model over sums of these weights, whose coefficients can't be negative: one
more hit never lowers a score but for its part in the text's length.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_col, tune
from .labelled import fold, sample
from .logistic import Logistic

#: Labelled documents per class that the lexicon and the weights are learnt from, at most.
SAMPLE_PER_CLASS = 4000
STEMS = range(4, 8)
EVIDENCE = 18.0
#: A term fills at least so many times as much of toxic texts as of others.
LEAN = 15.0
#: A misspelling weighs so much of its term's weight, per edit; a term allows as many edits as clean texts reach in at most one of so many words.
PER_EDIT = 0.8
STRAY = 20_000
#: The largest weight of a term.
MOST = 6.0
CUTOFF = 0.3
WINDOW = 6
SEED = 11
STATES = 200_000
_CLEAN = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Quotation marks as bytes that no text has otherwise once it is cleaned: both ways, opening, closing, and low opening.
_MARKS = {'"': b"\x01", "«": b"\x02", "»": b"\x03", "“": b"\x04", "”": b"\x03", "„": b"\x05", "\n": b"\x06"}
_MARKED = bytes(c if c < 7 else v for c, v in enumerate(_CLEAN))
_PIECE = re.compile(rb"[\x01-\x06]|[^ \x01-\x06]+")


def plain(text: str) -> str:
    """Lower case, with curly and angle quotation marks as blanks."""
    low = text.lower()
    if not low.isascii():
        for q in "«»“”„":
            low = low.replace(q, " ")
    return low


def tokens(text: str) -> list[bytes]:
    return plain(text).encode("utf-8", "replace").translate(_CLEAN).split()


def quoted(text: str) -> list[bool] | None:
    """For each of a text's tokens whether it stands within a pair of quotation marks on one line; None without marks. One pass."""
    if not any(q in text for q in "\"«“„"):
        return None
    low = re.sub("[\x00-\x06]", " ", text.lower())
    for q, mark in _MARKS.items():
        low = low.replace(q, mark.decode())
    straight, depth, out, waiting = False, 0, [], []
    for m in _PIECE.finditer(low.encode("utf-8", "replace").translate(_MARKED)):
        c = m[0][0]
        if c > 6:
            if straight or depth:
                waiting.append(len(out))
            out.append(False)
            continue
        if c == 6:  # a mark that its line doesn't close quotes nothing
            straight, depth, waiting = False, 0, []
        elif c == 1:
            straight = not straight
        elif c in (2, 5) or c == 4 and not depth:
            depth = c
        else:  # closing, also the German way
            depth = 0
        if not straight and not depth:
            for i in waiting:
                out[i] = True
            waiting = []
    return out


def allowed(term: str) -> int:
    """Edits that a term may have at most: none below five letters, one below nine, else two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


# --- contexts -------------------------------------------------------------------------------------------

def context_table(n: int = 3000, seed: int = SEED) -> list[tuple[list[bytes], list[bytes], bool, int]]:
    """Labelled contexts: (words before, words after, quoted?, 1 for abuse), in the four languages of the corpus."""
    r = random.Random(seed)
    abuse = [x.split("_") for x in (
        "you are a _", "you _", "what a _", "such a _", "_ go away", "shut up _", "you are all _ and", "they are _ people", "your _ face", "be quiet you _", "you're nothing but a _", "_", "", "tu es un _", "espèce de _", "quel _", "vous êtes des _", "ta gueule _",
        "du bist ein _", "so ein _", "ihr seid _", "halt den mund du _", "eres un _", "qué _", "sois unos _", "tú _ cállate",
    )]
    report = [x.split("_") for x in (
        "he said the word _", "she said _ was", "the term _ is considered rude", "the word _ means", "was called a _ by", "he called him a _ and apologized", "the slur _ was used", "quoted as saying _", "they wrote _ on the wall", "calling someone a _ is", "the insult _ in the text", "a report of the word _",
        "he called me an _", "she called me a _ yesterday", "they called us _ at", "called him an _ in", "called her a _ and", "someone called them _ on", "i was called an _", "he was called a _", "accused of being a _", "told her she was an _", "said that he was a _", "referred to them as _",
        "il m a traité de _", "on l a traitée de _ hier", "elle m a appelé _", "er nannte mich einen _", "sie hat mich _ genannt", "wurde als _ bezeichnet", "me llamó _ ayer", "lo trató de _", "dijo que era un _",
        "le mot _ est", "il a dit _ dans", "l article cite _", "elle a écrit _", "das wort _ bedeutet", "er sagte _ und", "sie schrieb _ in", "nannte ihn einen _", "ein zitat _", "la palabra _ significa", "dijo _ en", "escribió _ en", "lo llamó _ y",
    )]
    fill = "the of and to in is was a for on with that it as de la le les et des du en un une est die der und das zu den mit ist ein el los que y por se con para su".split()
    words = lambda k: [r.choice(fill) if r.random() < 0.5 else "".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(k)]
    out = []
    for i in range(n):
        y = i % 2
        kind = abuse if y else report
        t = r.choice(kind) if y == 0 or r.random() < 0.5 else [""]
        before, after = [*words(r.randint(0, 8)), *t[0].split()], [*(t[1].split() if len(t) > 1 else []), *words(r.randint(0, 8))]
        marks = r.random() < (0.01 if y else 0.75)
        if y == 0 and marks:
            kind = r.random()
            if kind < 0.3:  # quotation without any word of report
                before, after = words(r.randint(0, 8)), words(r.randint(0, 8))
            elif kind < 0.8:  # what is quoted addresses somebody
                said = r.choice(abuse)
                before, after = [*before, *said[0].split()], [*(said[1].split() if len(said) > 1 else []), *after]
        out.append(([w.encode() for w in before], [w.encode() for w in after], marks, y))
    return out


class ContextModel:
    """The chance that a hit is meant as abuse: a linear model over the words of its window and quotation marks, trained on `context_table`."""

    def __init__(self, seed: int = SEED, rounds: int = 400, l2: float = 0.1) -> None:
        rows = context_table(seed=seed)
        self.index: dict[bytes, int] = {}
        seen = Counter(w for b, a, _, _ in rows for w in {*b[-WINDOW:], *a[:WINDOW]})
        for w in sorted(seen):
            if seen[w] >= 5:
                self.index[w] = len(self.index) + 2
        x = np.zeros((len(rows), 2 * len(self.index) + 2))
        for k, (b, a, q, _) in enumerate(rows):
            x[k, self.at(b, a, q)] = 1
        y = np.array([r[3] for r in rows], dtype=float)
        w, step = np.zeros(x.shape[1]), 4.0 / len(rows)
        keep = np.full(len(w), l2)
        keep[0] = 0.0
        for _ in range(rounds):
            w += step * (x.T @ (y - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))) - keep * w)
        self.weights = w

    def at(self, before: list[bytes], after: list[bytes], marks: bool) -> list[int]:
        """Places of the features: bias, quotation, known words of the window (others within quotation marks than outside)."""
        get, far = self.index.get, len(self.index) if marks else 0
        return sorted({0, *([1] if marks else []), *[i + far for w in (*before[-WINDOW:], *after[:WINDOW]) if (i := get(w))]})

    def chance(self, words: list[bytes], place: int, marks: bool) -> float:
        z = self.weights[self.at(words[max(0, place - WINDOW) : place], words[place + 1 : place + 1 + WINDOW], marks)].sum()
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


@lru_cache(maxsize=2)
def contexts(seed: int = SEED) -> ContextModel:
    return ContextModel(seed)


# --- hits -----------------------------------------------------------------------------------------------

class FuzzyTrie:
    """The lexicon's trie and its lazily determinized intersection with the terms' Levenshtein automata.

    A state maps trie nodes to the smallest number of edits with which the letters read so far lead to the
    node. Reading a letter inserts, matches or substitutes; deletions of lexicon letters are closed over.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], edits: dict[str, int] | None = None) -> None:
        self.edits = {t: allowed(t) if edits is None else min(allowed(t), edits.get(t, 0)) for t in (*words, *stems)}
        self.next: list[dict[str, int]] = [{}]
        self.term: list[tuple[str, bool] | None] = [None]
        self.room = [0]  # the most edits that any term below the node allows
        for t, stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            at, k = 0, self.edits[t]
            self.room[0] = max(self.room[0], k)
            for c in t:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.room.append(0)
                at = self.next[at][c]
                self.room[at] = max(self.room[at], k)
            if self.term[at] is None or stem:
                self.term[at] = (t, stem)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.hits: list[tuple | None] = []  # whole-word hit of the state: (term, edits, 0)
        self.stem_hits: list[tuple | None] = []  # hit of a stem that has just been read: (term, edits)
        self.start = self._id(self._close({0: 0}))
        self.prefixes: dict[bytes, bool] = {}

    def _close(self, state: dict[int, int]) -> dict[int, int]:
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            for child in self.next[node].values():
                if e + 1 <= self.room[child] and e + 1 < state.get(child, 99):
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return state

    def _id(self, state: dict[int, int]) -> int:
        key = tuple(sorted(state.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            whole = [(e, self.term[n][0]) for n, e in state.items() if self.term[n] and not self.term[n][1] and e <= self.edits[self.term[n][0]]]
            stem = [(e, self.term[n][0]) for n, e in state.items() if self.term[n] and self.term[n][1] and e <= self.edits[self.term[n][0]]]
            self.hits.append(min(whole)[::-1] if whole else None)
            self.stem_hits.append(min(stem)[::-1] if stem else None)
        return self.ids[key]

    def step(self, at: int, c: str) -> int:
        """The state after one more letter; -1 if none of the lexicon can be reached."""
        to = self.moves[at].get(c)
        if to is None:
            new: dict[int, int] = {}
            for node, e in self.states[at].items():
                if e + 1 <= self.room[node]:
                    new[node] = min(new.get(node, 99), e + 1)
                for d, child in self.next[node].items():
                    cost = e + (d != c)
                    if cost <= self.room[child]:
                        new[child] = min(new.get(child, 99), cost)
            to = self.moves[at][c] = self._id(self._close(new)) if new else -1
        return to

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """(term, edits, stem?) of the best hit of a word: a stem that it starts with, else the nearest term, at equal edits a whole one."""
        at, near = self.start, None
        for c in word:
            at = self.step(at, c)
            if at < 0:
                break
            hit = self.stem_hits[at]
            if hit and (near is None or hit[1] < near[1]):
                near = hit
                if not hit[1]:
                    return hit[0], 0, True
        whole = self.hits[at] if at >= 0 else None
        if whole and (near is None or whole[1] <= near[1]):
            return (*whole, False)
        return (*near, True) if near else None

    def alive(self, word: bytes) -> bool:
        """Whether the first three bytes leave a chance; kept by prefix."""
        at = self.start
        for c in word[:3].decode("utf-8", "ignore"):
            at = self.step(at, c)
            if at < 0:
                return False
            if self.stem_hits[at]:
                return True
        return True


class _Alive(dict):
    def __init__(self, trie: FuzzyTrie) -> None:
        super().__init__()
        self.trie = trie

    def __missing__(self, prefix: bytes) -> bool:
        self[prefix] = got = self.trie.alive(prefix)
        return got


class Lexicon:
    """Words and stems with their weights, and the edits that each term allows (None: by length)."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], edits: dict[str, int] | None = None) -> None:
        self.words, self.stems, self.edits = words, stems, edits


class Scanner:
    """A text's hits and their sums."""

    NAMES = ["sum", "density"]

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.trie = FuzzyTrie(lexicon.words, lexicon.stems, lexicon.edits)
        self.live = _Alive(self.trie)
        self.contexts = contexts()

    def hits(self, text: str) -> tuple[list[tuple[int, str, int, bool, float, float]], int]:
        """(word number, term, edits, stem?, weight in its context, chance of abuse) of each hit, and the number of words."""
        if len(self.trie.states) > STATES or len(self.live) > STATES:
            self.trie.reset()
            self.live.clear()
        ws, live = tokens(text), self.live
        found = []
        for i in [i for i, w in enumerate(ws) if live[w[:3]]]:
            m = self.trie.match(ws[i].decode("utf-8", "ignore"))
            if m:
                found.append((i, *m))
        if not found:
            return [], len(ws)
        marks, out = quoted(text), []
        for i, t, e, stem in found:
            chance = self.contexts.chance(ws, i, bool(marks and marks[i]))
            weight = self.lexicon.words.get(t) or self.lexicon.stems[t]
            out.append((i, t, e, stem, weight * PER_EDIT**e * chance, chance))
        return out, len(ws)

    def features(self, text: str) -> list[float]:
        """Sum of the hits' weights and their sum per 100 words, as logarithms; of a term's hits that are likelier meant otherwise only the largest counts."""
        got, n = self.hits(text)
        said: dict[str, float] = {}
        total = 0.0
        for _, t, _, _, w, chance in got:
            if chance < 0.5:
                said[t] = max(said.get(t, 0.0), w)
            else:
                total += w
        total += sum(said.values())
        return [math.log1p(total), math.log1p(100 * total / max(n, 20))]


# --- learning -------------------------------------------------------------------------------------------

def lexicon(counts: DataFrame, totals: dict[int, int]) -> Lexicon:
    """Words and stems with their weights from rows (term, stem, y0, y1, d0, d1).

    y0, y1 are the documents of either class with the term, d0, d1 the sums of the shares of their words that it is.
    The evidence is the log-likelihood ratio of the term against the classes' sizes; the weight grows with the
    ratio of the mean shares. Of terms that begin alike the one with more evidence stays, of equal ones the longer.
    The terms that pass are bounded by the sample, as each is in several of its toxic documents.
    """
    n0, n1 = max(1, totals.get(0, 0)), max(1, totals.get(1, 0))
    p = n1 / (n0 + n1)
    a, b = F.col("y1").cast("double"), F.col("y0").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g2 = 2 * (part(a, (a + b) * p) + part(b, (a + b) * (1 - p)))
    lean = (F.col("d1") / n1) / ((F.col("d0") + 0.002) / n0)
    rows = counts.withColumn("g2", g2).withColumn("lean", lean).filter((F.col("g2") > EVIDENCE) & (F.col("lean") > LEAN) & (a * n0 > b * n1))
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    for r in rows.orderBy(F.desc("g2"), F.desc(F.length("term")), "term", "stem").collect():
        t = r["term"]
        if any(t[:k] in stems for k in STEMS) or any(x.startswith(t) for x in (*words, *stems)):
            continue
        (stems if r["stem"] else words)[t] = min(MOST, math.log10(r["lean"]) ** 2 / 2)
    return Lexicon({w: x for w, x in words.items() if not any(w[:k] in stems for k in STEMS)}, stems)


def _term_counts(train: DataFrame) -> DataFrame:
    """(term, stem, y0, y1, d0, d1) of the sampled documents; stems need two or more letters to follow."""
    names = ["term", "stem", "y0", "y1", "d0", "d1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = Counter(tokens(text))
                n, own = words.total(), Counter()
                for w, k in words.items():
                    w = w.decode("utf-8", "ignore")
                    if len(w) >= 3:
                        own[w, False] += k
                        for size in STEMS:
                            if len(w) > size:
                                own[w[:size], True] += k
                for key, k in own.items():
                    got = total.setdefault(key, [0, 0, 0.0, 0.0])
                    got[y] += 1
                    got[2 + y] += k / n
                if len(total) > 500_000:
                    yield _as_batch(total)
                    total.clear()
        yield _as_batch(total)

    def _as_batch(total: dict) -> pa.RecordBatch:
        keys, v = list(total), list(total.values())
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *[pa.array([x[i] for x in v], kind) for i, kind in enumerate(kinds)]], names)

    rows = train.select("text", "y").mapInArrow(run, "term string, stem boolean, y0 long, y1 long, d0 double, d1 double")
    return rows.groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in names[2:]])


def _edits(rows: DataFrame, lex: Lexicon) -> dict[str, int]:
    """The edits that each term allows: those that words of clean documents reach in at most one of STRAY words."""
    sent = rows.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, total = Scanner(sent.value), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                got, n = scan.hits(text)
                total["", 0] += n
                total.update((t, e) for _, t, e, *_ in got if e)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["term", "edits", "n"])

    clean = rows.filter("y = 0").select("text").mapInArrow(run, "term string, edits int, n long")
    stray = {(r["term"], r["edits"]): r["n"] for r in clean.groupBy("term", "edits").agg(F.sum("n").alias("n")).collect()}  # terms by edits, whatever the input
    most = stray.get(("", 0), 0) / STRAY
    out = {}
    for t in (*lex.words, *lex.stems):
        k = 0
        while k < allowed(t) and stray.get((t, k + 1), 0) <= most:
            k += 1
        out[t] = k
    return out


def _featured(docs: DataFrame, sent, names: list[str]) -> DataFrame:
    """The named columns and an array of features, from rows with these columns and `text`."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(sent.value)
        for b in batches:
            feats = [scan.features(t) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(feats, pa.list_(pa.float64()))], [*names, "x"])

    return docs.select(*names, "text").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, usable, per_class: int = SAMPLE_PER_CLASS) -> tuple[Lexicon, Logistic]:
    """Lexicon and model, learnt from a bounded sample of the labelled documents that `usable` allows.

    Labels that are null or neither 0 nor 1, and such of a null doc_id, don't count; of several labels of a document
    the largest does; repeated rows count once. Without usable labels, or with one class only, the lexicon is
    empty and the score the base rate.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = cut(sample(docs, labels, "toxic", usable, per_class), "toxic-sample")
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    lex = Lexicon({}, {})
    if len(totals) == 2:
        lex = lexicon(_term_counts(rows), totals)
        lex.edits = _edits(rows, lex)
    got = _featured(rows, spark.sparkContext.broadcast(lex), ["y"]).collect()  # the bounded sample's few features
    x = np.array([r["x"] for r in got]).reshape(-1, len(Scanner.NAMES))
    y = np.array([r["y"] for r in got], dtype=float)
    return lex, Logistic.fit(x, y, signed=False)


def scored(docs: DataFrame, lex: Lexicon, model: Logistic) -> DataFrame:
    """(doc_id, score) of every row, repeated ones and ones with a null doc_id too.

    Null and empty texts get the score of a text without hits. Texts are read once, in time linear in their
    length. Other columns, whatever their names, are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((lex, model))  # bounded by the sample of labels
    tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = sent.value
        scan = Scanner(lex)
        for b in batches:
            x = np.array([scan.features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(Scanner.NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.predict(x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The documents whose score stays below the cutoff, in all columns of `docs`; learns from all labels but the held-out fold.

    Decided row by row, so nothing is shuffled, repeated rows fare alike, and null texts stay as they are (they
    have no hits). An empty table gives no rows. A long text takes memory in proportion to its words. Other columns
    may have any names and keep their values.
    """
    model = train(docs, labels, fold("doc_id", 4) != 2)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        lex, logistic = sent.value
        scan = Scanner(lex)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            x = np.array([scan.features(t or "") for t in texts]).reshape(-1, len(Scanner.NAMES))
            yield b.filter(pa.array(logistic.predict(x) < cutoff))

    return docs.mapInArrow(judge, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = scored(docs, *train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2))
    return got.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
