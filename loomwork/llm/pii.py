"""Personal data: exact base patterns, and a linear-chain CRF over word shapes that adds spans.

The base (e-mail, IP, card, phone) is fixed by contract. The CRF is trained by gradient ascent from a small
labelled table that `labelled_table` builds from a seed, and decoded by Viterbi in numpy batches. It finds
what the patterns leave: spelled-out addresses, numbers with odd separators, keys and tokens. Its spans keep
clear of base spans, which always stay. What it takes for a card number must pass Luhn, which shapes can't show.

Words whose best label is "outside" whatever their neighbours' labels cut the chain exactly: only the
stretches between such words are decoded.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_byte_view, table, text_col, tune

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["outside", *KINDS]
SEED = 7
CACHE_SHAPES = 50_000
#: Words, padding included, that one round of Viterbi takes; a longer stretch is a round of its own.
CELLS = 1 << 16
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(rb"[^ \t-\r]+")
_SHAPE = bytes(ord("d") if 48 <= c <= 57 else ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else c for c in range(256))
_DIGIT = re.compile(rb"[0-9]")
_NO_DIGITS = bytes(c for c in range(256) if not 48 <= c <= 57)


def emails(view: bytes) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: each '@' looks back over its local part."""
    out, last = [], 0
    at = view.find(b"@")
    while at >= 0:
        start = at
        while start > last and view[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(view, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = view.find(b"@", max(at + 1, last))
    return out


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = d - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(view: bytes) -> list[list[tuple[int, int]]]:
    """Spans of each base kind, in order of KINDS; offsets in code points."""
    mails = emails(view) if b"@" in view else []
    if not _DIGIT.search(view):
        return [mails, [], [], []]
    ips = [m.span() for m in _IP.finditer(view) if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b"."))] if b"." in view else []
    cards = []
    for m in _CARD.finditer(view):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].translate(None, b" -")) <= 19 and _luhn(d):
            cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(view) if 9 <= sum(48 <= c <= 57 for c in m[0]) <= 15] if b"+" in view else []
    return [mails, ips, cards, phones]


# --- the labelled table -------------------------------------------------------------------------------

def labelled_table(n: int = 400, seed: int = SEED) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label): fillers with personal data of each kind, and look-alikes labelled outside."""
    r = random.Random(seed)
    letters, hexes, caps = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    num = lambda k: pick("0123456789", k)

    def word() -> str:
        w = pick(letters, r.randint(1, 12))
        kind = r.random()
        w = w.capitalize() if kind < 0.12 else w.upper() if kind < 0.17 else w
        return w + r.choice(["", "", "", "", ",", ".", "!!", "!", "?", ":", ".\"", "***", "$$$", "%%%", "###", "&&&"])

    def harmless() -> list[str]:
        return r.choice([
            lambda: [num(r.randint(1, 4)) + r.choice(["", ".", ",", "%"])], lambda: ["Version", f"{num(1)}.{num(1)}."], lambda: [f"{num(1)}.{num(1)}.{num(1)}"], lambda: [f"${num(2)}.{num(2)}"], lambda: [f"{num(4)}-{num(2)}-{num(2)}"], lambda: [f"{num(2)}:{num(2)}"],
            lambda: ["|", word(), "|"], lambda: ["CC", "BY-NC", "4.0."], lambda: [f"({word()})"], lambda: [f"{pick(letters, 4)}-{pick(letters, 5)}"], lambda: [f"{num(1)},{num(3)}"], lambda: ["=", "-", "--"], lambda: [f"@{pick(letters, 6)}"], lambda: [f"{pick(letters, 3)}{num(1)}"], lambda: ["U.S.", "e.g."], lambda: [f"\"{word()}\""],
        ])()

    def data() -> tuple[str, list[str]]:
        name, host = pick(letters, r.randint(3, 8)), f"{pick(letters, r.randint(3, 7))}"
        return r.choice([
            lambda: ("email", [f"{name}.{num(2)}@{host}{num(1)}.example.com"]), lambda: ("email", [f"{name}@{host}.com"]), lambda: ("email", [f"{name}[at]{host}[dot]com"]), lambda: ("email", [f"{name}(at){host}.com"]), lambda: ("email", [f"{name}@{host},com"]),
            lambda: ("ip", [".".join(str(r.randint(10, 255)) for _ in range(4))]), lambda: ("ip", [".".join(str(r.randint(10, 255)) for _ in range(4)) + f":{num(4)}"]), lambda: ("ip", [":".join(pick(hexes, 4) for _ in range(8))]), lambda: ("ip", ["-".join(str(r.randint(100, 255)) for _ in range(4))]),
            lambda: ("card", [num(16)]), lambda: ("card", [num(4) for _ in range(4)]), lambda: ("card", ["-".join(num(4) for _ in range(4))]), lambda: ("card", [".".join(num(4) for _ in range(4))]), lambda: ("card", [num(4), num(6), num(5)]),
            lambda: ("phone", ["+1", f"({num(3)})", f"{num(3)}-{num(4)}"]), lambda: ("phone", [f"({num(3)})", f"{num(3)}-{num(4)}"]), lambda: ("phone", [f"{num(3)}-{num(3)}-{num(4)}"]), lambda: ("phone", [f"+{num(2)}", num(3), num(4), num(4)]), lambda: ("phone", [f"{num(3)}.{num(3)}.{num(4)}"]),
            lambda: ("secret", ["AKIA" + pick(caps, 16)]), lambda: ("secret", [f"\"{pick(hexes, 40)}\""]), lambda: ("secret", [pick(hexes, 32)]), lambda: ("secret", ["sk-" + pick(letters + caps, 32)]), lambda: ("secret", ["ghp_" + pick(letters + caps, 36)]),
        ])()

    out = []
    for _ in range(n):
        s: list[tuple[str, str]] = []
        for _ in range(r.randint(2, 5)):
            s += [(word(), "outside") for _ in range(r.randint(1, 6))]
            if r.random() < 0.45:
                kind, words = data()
                words = [*words[:-1], words[-1] + r.choice(["", "", "", ".", ","])]
                s += [(w, kind) for w in words]
            elif r.random() < 0.6:
                s += [(w, "outside") for w in harmless()]
        out.append(s + [(word(), "outside")])
    return out


# --- the model ------------------------------------------------------------------------------------------

def features(shape: bytes) -> list[str]:
    """Features of one word's shape (X capital, x small, d digit, else the character itself)."""
    s = shape.decode("latin-1")
    core = s.strip(".,;:!?\"'()*#$%&|")
    runs = re.sub(r"(.)\1+", r"\1+", core)
    digits, marks = s.count("d"), "".join(sorted(set(re.sub(r"[Xxd]", "", core))))
    mixed = "".join(sorted(set(re.findall(r"[Xxd]", core))))
    n = len(core)
    groups = len(re.findall(r"d+", core))
    return ["bias", f"runs={runs}" if len(runs) <= 12 else "runs=long", f"marks={marks}", f"mixed={mixed}", f"digits={min(digits, 20)}", f"len={'0' if n == 0 else '1-3' if n < 4 else '4-15' if n < 16 else '16-24' if n < 25 else '25+'}|{mixed}", f"first={core[:1]}", f"plus={s.startswith('+')}", f"paren={s.startswith('(') and 'd' in s}", f"groups={groups}|{marks}", f"switch={min(len(re.findall('[Xx]d|d[Xx]', core)), 3)}"]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class ShapeCRF:
    """Weights of a linear-chain CRF: emissions by feature, transitions between neighbouring labels."""

    def __init__(self, emit: np.ndarray, trans: np.ndarray, index: dict[str, int]) -> None:
        self.emit, self.trans, self.index = emit, trans, index
        self.cache: dict[bytes, np.ndarray] = {}

    @classmethod
    def fit(cls, sentences: list[list[tuple[str, str]]], rounds: int = 120, l2: float = 0.02, rate: float = 0.15) -> "ShapeCRF":
        """Adam on the penalized log-likelihood over all sentences at once, padded to one length."""
        index: dict[str, int] = {}
        k, label = len(LABELS), {x: i for i, x in enumerate(LABELS)}
        feats = [[[index.setdefault(f, len(index)) for f in features(shape_of(w))] for w, _ in s] for s in sentences]
        n, t = len(sentences), max(map(len, sentences))
        width = len(feats[0][0])
        ids = np.full((n, t, width), len(index))
        gold, mask = np.zeros((n, t), dtype=int), np.zeros((n, t), dtype=bool)
        for i, s in enumerate(sentences):
            ids[i, : len(s)], gold[i, : len(s)], mask[i, : len(s)] = feats[i], [label[x] for _, x in s], True
        w, tr = np.zeros((len(index) + 1, k)), np.zeros((k, k))
        m1, m2, a1, a2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)
        hot = np.eye(k)[gold] * mask[..., None]
        pair = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
        for step in range(1, rounds + 1):
            e = w[ids].sum(axis=2) * mask[..., None]
            alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
            alpha[:, 0] = e[:, 0]
            for i in range(1, t):
                new = _logsum(alpha[:, i - 1, :, None] + tr, 1) + e[:, i]
                alpha[:, i] = np.where(mask[:, i, None], new, alpha[:, i - 1])
            for i in range(t - 2, -1, -1):
                new = _logsum(tr + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
                beta[:, i] = np.where(mask[:, i + 1, None], new, 0)
            z = _logsum(alpha[:, -1], 1)
            gamma = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            xi = np.exp(alpha[:, :-1, :, None] + tr + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            g = np.zeros_like(w)
            np.add.at(g, ids.reshape(-1, width), ((hot - gamma).reshape(-1, k))[:, None, :])
            g = g / n - l2 * w / 10
            g[-1] = 0
            gt = (pair - xi.sum(axis=(0, 1))) / n - l2 * tr / 10
            for x, d, u, v in ((w, g, m1, m2), (tr, gt, a1, a2)):
                u += 0.1 * (d - u)
                v += 0.01 * (d * d - v)
                x += rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(w, tr, index)

    def emission(self, shape: bytes) -> np.ndarray:
        got = self.cache.get(shape)
        if got is None:
            if len(self.cache) >= CACHE_SHAPES:
                self.cache.clear()
            got = self.cache[shape] = self.emit[[self.index.get(f, len(self.index)) for f in features(shape)]].sum(axis=0)
        return got

    def surely_outside(self, e: np.ndarray) -> bool:
        """True if label 0 is on every best path, whatever the neighbours' labels (or no neighbour at all)."""
        into, out = np.vstack([self.trans, np.zeros(len(e))]), np.hstack([self.trans, np.zeros((len(e), 1))])
        loss = (into - into[:, :1]).max(axis=0) + (out - out[:1]).max(axis=1)
        return bool((e[0] > (e + loss)[1:]).all())

    def viterbi(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of stretches (emissions, words by labels), batched by length; label 0 stands on either side.

        Memory is bounded by CELLS words, or by the longest stretch.
        """
        out: list[np.ndarray] = [np.zeros(0, dtype=int)] * len(stretches)
        order = sorted((i for i in range(len(stretches)) if len(stretches[i])), key=lambda i: len(stretches[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * len(stretches[order[hi]]) <= CELLS:
                hi += 1
            part, lo = order[lo:hi], hi
            n, t = len(part), len(stretches[part[-1]])
            k = len(self.trans)
            e, lens = np.zeros((n, t, k)), np.array([len(stretches[i]) for i in part])
            for j, i in enumerate(part):
                e[j, : lens[j]] = stretches[i]
            score, back = e[:, 0] + self.trans[0], np.zeros((n, t, k), dtype=np.int8)
            for i in range(1, t):
                way = score[:, :, None] + self.trans
                back[:, i] = way.argmax(axis=1)
                score = np.where((i < lens)[:, None], way.max(axis=1) + e[:, i], score)
            best = (score + self.trans[:, 0]).argmax(axis=1)
            path = np.zeros((n, t), dtype=np.int8)
            for i in range(t - 1, -1, -1):
                path[:, i] = np.where(i < lens, best, 0)
                if i:
                    best = np.where(i < lens, back[np.arange(n), i, best], best)
            for j, i in enumerate(part):
                out[i] = path[j, : lens[j]]
        return out


def shape_of(word: str) -> bytes:
    return one_byte_view(word).translate(_SHAPE)


@lru_cache(maxsize=2)
def default_model(seed: int = SEED) -> ShapeCRF:
    return ShapeCRF.fit(labelled_table(seed=seed))


#: Marks that are no part of a span at its ends; of brackets only such without their other half.
_EDGE = b".,;:!?\"'*#$%&|"


def trimmed(view: bytes, start: int, end: int) -> tuple[int, int]:
    """A span without the marks at its ends."""
    while start < end:
        if view[start] in _EDGE or view[start] == 41 or view[start] == 40 and view.find(b")", start, end) < 0:
            start += 1
        elif view[end - 1] in _EDGE or view[end - 1] == 40 or view[end - 1] == 41 and view.find(b"(", start, end) < 0:
            end -= 1
        else:
            break
    return start, end


def card_spans(view: bytes, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Card numbers among neighbouring words that the CRF takes for cards: from the left, the fewest words with 13 to 19 digits that pass Luhn.

    Shapes don't show a check digit, and numbers in a row make one run; so each number is read by itself.
    """
    digits = [view[a:b].translate(None, _NO_DIGITS) for a, b in places]
    out, i = [], 0
    while i < len(places):
        got, j = b"", i
        while j < len(places) and digits[j] and len(got) + len(digits[j]) <= 19:
            got += digits[j]
            j += 1
            if len(got) >= 13 and _luhn(got):
                out.append((places[i][0], places[j - 1][1]))
                i = j - 1
                break
        i += 1
    return out


def _reaches(base: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all base spans in order, and the farthest end up to each."""
    every = np.array(sorted(x for spans in base for x in spans), dtype=np.int64)
    return every[:, 0], np.maximum.accumulate(every[:, 1])


def _touched(starts: np.ndarray, reach: np.ndarray, places: list[tuple[int, int]]) -> np.ndarray:
    """Which places share a character with a span: of the spans that begin before its end one ends after its start."""
    at = np.array(places, dtype=np.int64)
    before = np.searchsorted(starts, at[:, 1])
    return (before > 0) & (reach[before - 1] > at[:, 0])


class Finder:
    """Base and CRF spans of texts, many at a time."""

    def __init__(self, model: ShapeCRF) -> None:
        self.model = model
        self.sure: dict[bytes, bool] = {}

    def doubtful(self, shapes: list[bytes]) -> list[int]:
        sure, out = self.sure, []
        if len(sure) > CACHE_SHAPES:
            sure.clear()
        for s in set(shapes) - sure.keys():
            sure[s] = self.model.surely_outside(self.model.emission(s))
        flags = [sure[s] for s in shapes]
        if not all(flags):
            out = [i for i, f in enumerate(flags) if not f]
        return out

    def find(self, texts: list[str]) -> list[tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]]:
        """For each text its base spans by kind and the CRF's (kind, start, end)."""
        done, jobs, stretches, taken = [], [], [], {}
        for t in texts:
            view = one_byte_view(t)
            base = base_spans(view)
            done.append((base, []))
            shapes = view.translate(_SHAPE)
            words = shapes.split()
            at = self.doubtful(words)
            if not at:
                continue
            places = [m.span() for m in _WORD.finditer(view)]
            if any(base):
                taken[len(done) - 1] = _reaches(base)
            runs = np.split(np.array(at), np.flatnonzero(np.diff(at) != 1) + 1)
            for run in runs:
                stretches.append(np.array([self.model.emission(words[i]) for i in run]))
                jobs.append((len(done) - 1, view, [places[i] for i in run]))
        for (doc, view, places), labels in zip(jobs, self.model.viterbi(stretches)):
            # words that a base span touches are outside, so they cut a run and its other words stay
            labels = np.where(_touched(*taken[doc], places), 0, labels) if doc in taken else labels
            i = 0
            while i < len(labels):
                j = i
                while j < len(labels) and labels[j] == labels[i]:
                    j += 1
                if labels[i]:
                    kind = int(labels[i]) - 1
                    whole = card_spans(view, places[i:j]) if KINDS[kind] == "card" else [(places[i][0], places[j - 1][1])]
                    for start, end in (trimmed(view, *span) for span in whole):
                        if start < end:
                            done[doc][1].append((kind, start, end))
                i = j
        return done


def spans(docs: DataFrame, model: ShapeCRF | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, base and added as arrays of (kind, start, end), counts of the base by kind.

    Null and empty texts have none. Offsets are code points, ends exclusive. Repeated rows and ones with a null id
    give as many rows; an empty table gives none. Other columns, whatever their names, are left out. A long text
    takes some hundred bytes for each word that may be personal data, and two for each character.
    """
    tune(docs.sparkSession)
    own = model or default_model()
    own.cache.clear()
    sent = docs.sparkSession.sparkContext.broadcast(own)  # some ten thousand weights, whatever the input
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                found = finder.find(texts[lo : lo + 256])
                base = [[{"kind": KINDS[k], "start": s, "end": e} for k, spans in enumerate(f[0]) for s, e in spans] for f in found]
                more = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(f[1])] for f in found]
                n = [pa.array([len(f[0][k]) for f in found], pa.int64()) for k in range(4)]
                both = [sorted([(k, s, e) for k, spans in enumerate(f[0]) for s, e in spans] + f[1]) for f in found]
                text_of = lambda xs: ",".join([f"{KINDS[k]}:{s}:{e}" for k, s, e in xs])
                sha = [hashlib.sha256(text_of([(k, s, e) for k, spans in enumerate(f[0]) for s, e in spans]).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), *n, pa.array(sha), pa.array([text_of(x) for x in both]), pa.array(base, span), pa.array(more, span)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "base", "added"])

    kind = "array<struct<kind: string, start: int, end: int>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text")).mapInArrow(run, f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, base {kind}, added {kind}")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", F.size("added").cast("long").alias("n_added"))
