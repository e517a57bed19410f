"""Fill-in-middle, packing and collocations against brute force and odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import batch_bpe, bpe, collocations, fim, packing

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, n long, output string, length int, h1 int, word string, phrase string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-middle


def cut_by_hand(text, key, unit=r"[^\n]*\n|[^\n]+"):
    units = re.findall(unit, text)
    n = len(units)
    d = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 50 else "psm", len(p), len(m), out


def test_fill_in_middle(spark):
    texts = ["", None, "one", "one\n", "\n", "\n\n\n", "a\nb\nc", "é\n日本\U0001f600\n\nend", "has <P> mark\nx", "a<\nS>\nP>", "<", "\r\n\x0b\n", "x\n" * 5000, "z" * 100_000]
    rows = [(k, t, "en", 1, "o", 2, 3, "w", "p") for k, t in enumerate(texts * 3)] + [(None, "a\nb", None, None, None, None, None, None, None), (5, "\n\n\n", "en", 1, "o", 2, 3, "w", "p")]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    got = fim.transform(docs).withColumn("back", fim.restored()).collect()
    assert len(got) == len(rows)
    want = Counter((k, *cut_by_hand(t or "", k), t or "") if k is not None else (None, 2, "plain", None, None, t, t) for k, t, *_ in rows)
    assert Counter(tuple(r) for r in got) == want
    assert {"psm", "spm", "plain"} == {r["form"] for r in got}
    assert fim.transform(docs.limit(0)).count() == 0


def test_fill_in_middle_rules(spark):
    docs = spark.createDataFrame([(k, f"w{k} b  c\td\n e ") for k in range(200)], "doc_id long, text string")
    for unit, pattern in (("word", r"\S+\s*|\s+"), ("char", r"(?s).")):
        rule = fim.Rule(prefix="[p]", suffix="[s]", middle="[m]", unit=unit, seed=3, fim_share=60, spm_share=0)
        got = fim.transform(docs, rule).withColumn("back", fim.restored(rule=rule)).collect()
        assert all(r["back"] == f"w{r['doc_id']} b  c\td\n e " and r["n"] == len(re.findall(pattern, r["back"])) for r in got)
        share = Counter(r["form"] for r in got)
        assert share["spm"] == 0 and 90 < share["psm"] < 150
    assert fim.ends(fim.code_points("ab  cd"), "word").tolist() == [4, 6]
    with pytest.raises(ValueError):
        fim.transform(docs, fim.Rule(unit="page"))


# packing


@pytest.fixture(scope="module")
def coder():
    return bpe.load(bpe.spec_of(bpe.tokenizer_path()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbé ÀstmdreVl''!?12½\t\n\x1c\x85\xa0日<|>́ſ"), max_size=40), max_size=12), st.integers(4, 60))
def test_batch_encoder(texts, chunk):
    coder = bpe.load(bpe.spec_of(bpe.tokenizer_path()))
    before = batch_bpe.CHUNK, batch_bpe.REMEMBERED, batch_bpe.LONG
    batch_bpe.CHUNK, batch_bpe.REMEMBERED, batch_bpe.LONG = chunk, 5, 6
    try:
        encoder = batch_bpe.BatchEncoder(coder)
        for _ in range(2):
            got = [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts)]
            assert got == [coder.lib.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        batch_bpe.CHUNK, batch_bpe.REMEMBERED, batch_bpe.LONG = before


def held(pieces, limits, cut):
    """What every packing keeps; the number of padding tokens."""
    by = defaultdict(list)
    for p in pieces:
        by[p[5]].append(p)
    for parts in by.values():
        at = 0
        for key, start, length, size, loss, _, offset, ids in sorted(parts, key=lambda p: p[6]):
            assert offset == at and length > 0 and 4 * length == len(ids) and start + length <= size
            at += length
        assert at <= limits.tokens and len(parts) <= limits.segments and sum(p[4] for p in parts) <= limits.loss
    return sum(packing.padded_length(t, limits.tokens) - t for t in (sum(p[2] for p in parts) for parts in by.values()))


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 4, 40), packing.Limits(100, 3, 100), packing.Limits(16, 1, 16), packing.Limits(50, 50, 7)])
def test_packer(limits, cut):
    random.seed(len(str(limits)) + cut)
    packer, pieces, want = packing.Packer(limits, cut, 1000), [], {}
    for k in range(1500):
        n = random.choice([1, 2, random.randint(1, limits.tokens), random.randint(1, 3 * limits.tokens)])
        prompt = random.choice([0, 1, n // 2, n])
        ids = np.random.default_rng(k).integers(0, 49408, n).astype("<u4").tobytes()
        want[k] = ids
        pieces += packer.add(packing.Example(k, ids, n, prompt))
        assert len(packer.pool) < packing.POOL
        assert sum(p[4] for p in pieces if p[0] == k) <= n - prompt
    pieces += packer.finish()
    padding = held(pieces, limits, cut)
    back = defaultdict(list)
    for p in pieces:
        back[p[0]].append((p[1], p[7]))
    assert {k: b"".join(i for _, i in sorted(v)) for k, v in back.items()} == want
    if cut:
        assert padding == 0
    else:
        assert all(len(back[k]) == 1 for k, v in want.items() if len(v) // 4 <= min(limits.tokens, limits.loss))
    if not cut and limits == packing.Limits():
        assert padding < 0.05 * sum(p[2] for p in pieces)


def test_dot_product_prefers_what_fits_the_room_that_is_left():
    """With much room for loss left and little for tokens, loss-bearing examples go first, and the other way round."""
    limits = packing.Limits(100, 10, 50)
    packer = packing.Packer(limits, False, 0)
    for key, n, prompt in ((0, 60, 10), (1, 40, 40), (2, 40, 0)):
        assert not list(packer.add(packing.Example(key, bytes(4 * n), n, prompt)))
    first = [p[0] for p in packer.finish() if p[5] == 0]
    assert first == [0, 1]  # the full loss of example 0 leaves room for tokens without loss only


def test_pack_rows(spark, coder):
    texts = ["", None, "Hello, world! " * 3, "don't 'sab", "日本語 text", "<|endoftext|>", "word " * 20_000, "same", "same", "É" * 3000] + [f"text number {k} " * (k % 60) for k in range(400)]
    rows = [(None if k == 3 else k, t, "en", 1, "o", 2, 3, "w", "p") for k, t in enumerate(texts)] + [(7, "same", "en", 1, "o", 2, 3, "w", "p")]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    pieces = [tuple(r) for r in packing.pack_texts(docs, packing.Limits(256, 8, 256)).collect()]
    assert held(pieces, packing.Limits(256, 8, 256), True) == 0
    want = Counter((k, i) for k, t, *_ in rows for i in [*coder.lib.encode(t or "", add_special_tokens=False).ids, 1])
    assert Counter((p[0], i) for p in pieces for i in np.frombuffer(p[7], "<u4").tolist()) == want
    assert packing.pack_texts(docs.limit(0)).count() == 0

    chats = spark.createDataFrame([(1, [5, 6, 7, 8], 2), (2, [], 0), (3, None, None), (None, [9], None), (1, [5, 6, 7, 8], 9), (4, list(range(3000)), 100)], "doc_id long, ids array<int>, n_prompt int")
    limits = packing.Limits(1024, 8, 500)
    pieces = packing.pack(chats, limits, cut=False)
    got = [tuple(r) for r in pieces.collect()]
    held(got, limits, False)
    assert sorted(p[0] or 0 for p in got) == [0, 1, 1, *[4] * 6] and sum(p[4] for p in got if p[0] == 1) == 2
    rows = packing.sequences(pieces, limits).collect()
    assert sum(r["n_tokens"] for r in rows) == 3009 and all(sum(r["lengths"]) == r["n_tokens"] == len(r["ids"]) // 4 and r["padded"] in (r["n_tokens"], 1024) for r in rows)
    assert packing.pack(chats.limit(0)).count() == 0


def test_op12(spark, coder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by, whole = defaultdict(list), defaultdict(list)
    for r in packing.op12_packing(spark, SF).collect():
        by[r["sequence_id"]].append(r)
        whole[r["doc_id"]].append(r)
    for parts in by.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts])[:-1].tolist() and sum(r["length"] for r in parts) <= 2048
    assert sum(packing.padded_length(t, 2048) - t for t in (sum(r["length"] for r in p) for p in by.values())) == 0
    for k, t in docs.items():
        ids, at = np.array([*coder.lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(whole[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


# collocations


def counted_by_hand(rows, longest):
    f, n = [Counter() for _ in range(longest + 1)], Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang if lang is not None else "und"] += len(w)
            for m in range(1, longest + 1):
                f[m].update((lang if lang is not None else "und", *w[i : i + m]) for i in range(len(w) - m + 1))
    return f, n


def by_hand(rows, longest=3, least=10, top=2000, inside=50):
    f, n = counted_by_hand(rows, longest)
    out = defaultdict(list)
    for m in range(2, longest + 1):
        for p, a in f[m].items():
            if a < least:
                continue
            over = [b for q in range(m + 1, longest + 1) for x, b in f[q].items() if b >= least and x[0] == p[0] and any(x[i : i + m] == p[1:] for i in range(1, q - m + 2))]
            if any(100 * b >= inside * a for b in over):
                continue
            cuts = [(1_000_000 * a * a // (f[k][p[: k + 1]] * f[m - k][(p[0], *p[k + 1 :])]), k) for k in range(1, m)]
            score, k = min(cuts)
            out[p[0]].append((-score, -a, " ".join(p[1:]), f[k][p[: k + 1]], f[m - k][(p[0], *p[k + 1 :])]))
    return {(lang, i + 1, p, -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v, key=lambda x: (x[0], x[1], x[2].encode()))[:top])}


WORDS = ["New", "york", "é", "A", "b", "日本", "the", "the", "x" * 70, "don't", "\xa0", "\x1c"]


def random_texts(n, seed):
    random.seed(seed)
    gap = lambda: random.choice([" "] * 8 + ["  ", "\t", ", ", ".", "\n", "! ", "\r\n"])
    return ["".join(random.choice(WORDS) + gap() for _ in range(random.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk,shard,cls", [(1 << 21, 1 << 21, 1 << 17), (64, 64, 16), (7, 16, 1), (300, 32, 5)])
def test_shards_count_as_by_hand(monkeypatch, chunk, shard, cls):
    """The same popcounts however the texts are laid out, the positions cut and the words classed."""
    for name, v in (("CHUNK", chunk), ("SHARD", shard), ("CLASS", cls)):
        monkeypatch.setattr(collocations, name, v)
    rows = [(random.choice(["en", "de"]), t) for t in random_texts(60, chunk)] + [("en", ""), ("de", " . ,"), ("en", "a b" * 40)]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([t.encode() for _, t in rows])], ["lang", "text"])
    f, _ = counted_by_hand(rows, 4)
    name = {}
    for s in collocations._stretches(iter([batch]), collocations.Line(0)):
        name |= {h: (x, w.decode()) for h, x, w in zip(s.hashes.tolist(), *s.words(np.arange(len(s.hashes))))}
    all_bits = np.full(collocations.FILTER_BITS // 8, 255, np.uint8)
    for depth in (2, 3, 4):
        got = Counter()
        for part, owned in collocations._shards(iter([batch]), 0, depth, all_bits):
            for hashes, count in part.phrases(depth, [None, all_bits, all_bits, all_bits], owned):
                for *h, c in zip(*[x.tolist() for x in hashes], count.tolist()):
                    assert len({name[x][0] for x in h}) == 1
                    got[(name[h[0]][0], *[name[x][1] for x in h])] += c
        assert got == f[depth]


def test_collocations(spark):
    texts = random_texts(400, 1)
    rows = [(k, t, random.choice(["en", "fr", None, ""]), 1, "o", 2, 3, "w", "p") for k, t in enumerate(texts)]
    rows += [(1, None, "en", 1, "o", 2, 3, "w", "p"), (None, "new york city " * 30, "en", 1, "o", 2, 3, "w", "p"), (None, "x", "rare", 1, "o", 2, 3, "w", "p"), (2, "ping " * 3000, "en", 1, "o", 2, 3, "w", "p")]
    rows += rows[-3:]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    pairs = [(r[2], r[1]) for r in rows]
    assert {tuple(r) for r in collocations.collocations(docs).collect()} == by_hand(pairs)
    got = collocations.collocations(docs, longest=4, least=3, top=5, inside=80).collect()
    assert {tuple(r) for r in got} == by_hand(pairs, 4, 3, 5, 80) and len(got) == len({(r["lang"], r["rank"]) for r in got})
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_score_passes_64_bits(spark):
    big = 9 * 10**12
    got = spark.createDataFrame([(big, [2 * big, big], [big + 7, big])], "a long, pre array<long>, suf array<long>").select(collocations._worst_cut(2).alias("c")).first()["c"]
    assert (got["score"], got["l"], got["r"]) == (10**6 * big * big // (2 * big * (big + 7)), 2 * big, big + 7)


def test_words_that_share_a_hash_are_hashed_anew(spark, monkeypatch):
    """Under the first seed the stand-in gives all words one hash, so a second seed is taken."""
    seeds = []
    real = collocations._counted_words

    def stand_in(rows, seed):
        seeds.append(seed)
        got = real(rows, seed)
        return got.withColumn("h1", F.lit(1).cast("long")) if seed == 0 else got

    monkeypatch.setattr(collocations, "_counted_words", stand_in)
    docs = spark.createDataFrame([("en", "a b c " * 12)], "lang string, text string")
    assert {r["phrase"] for r in collocations.collocations(docs).collect()} == {"a b c", "b c a", "c a b"} and seeds == [0, 1]
