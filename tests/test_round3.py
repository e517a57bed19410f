"""Findings of the third round: results at thresholds, and work that must not be done over again."""

import random
import re
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T
from __spark_entry__ import FLAGSHIP
from loomwork.operators import dedup, intervals, sampling
from loomwork.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_language_thresholds_are_exact(spark):
    texts = {"a" * 63 + "1" * 27: "mixed", "a" * 64 + "1" * 26: "en", "a" * 7 + "1" * 3: "mixed", "a" * 27 + "1" * 63: "other", "a" * 28 + "1" * 62: "mixed"}
    rows = spark.createDataFrame([(k,) for k in texts], "t string")
    talk = F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content")))
    got = rows.select("t", T.substring_language("t").alias("x"), T.conversation_language(talk).alias("y")).collect()
    assert {r["t"]: r["x"] for r in got} == texts
    assert {r["t"]: r["y"] for r in got} == {k: "en" if v == "en" else "mixed" for k, v in texts.items()}


def test_white_space_is_python_s(spark):
    blanks = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    assert sorted(T.BLANKS) == sorted(blanks)
    texts = ["", " ", *[f"{b}a{b}{b}​᠎b é{b}c{b}" for b in blanks], "".join(blanks)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.words("t").alias("w"), T.strip("t").alias("s"), T.rstrip("t").alias("r"))
    assert [(r["w"], r["s"], r["r"]) for r in rows.collect()] == [(t.split(), t.strip(), t.rstrip()) for t in texts]


def test_languages_search_a_text_once(spark):
    rows = spark.createDataFrame([("x",)], "t string")
    for fn, pattern in ((T.token_language, r"\[A-Za-z\]"), (T.substring_language, r"\[A-Za-z\]"), (T.token_language, "https"), (T.response_language, "https")):
        assert len(re.findall(pattern, plan(rows.select(fn("t").alias("x"))))) <= 1
    assert rows.select(T.response_language("t", T.token_language("t")).alias("x")).first()["x"] == T_response(spark, "x")


def T_response(spark, text):  # noqa: N802
    return spark.createDataFrame([(text,)], "t string").select(T.response_language("t").alias("x")).first()["x"]


def test_response_language_of_a_known_text(spark):
    for text in ("", " \n", "```py\nx\n```", "```py\nx\n``` what is this", "what is `x` this", "این یک پرسش است", "```"):
        rows = spark.createDataFrame([(text,)], "t string").withColumn("k", T.token_language("t"))
        assert rows.select(T.response_language("t", F.col("k")).alias("x")).first()["x"] == T_response(spark, text)


@pytest.mark.parametrize("fn", [T.malformed, T.without_thinking])
def test_responses_are_trimmed_and_matched_without_patterns_over_blanks(spark, fn):
    rows = spark.createDataFrame([("x",)], "t string")
    assert "u3000]+$" not in plan(rows.select(fn("t").alias("x")))  # trimming took a pattern over the whole text
    marks = {"a {{ name }} b": "placeholder", "TODO": "placeholder", "xTODO": None, "{{ a b }}": None, "[نام]": "placeholder", "```": "unclosed_fence"}
    got = spark.createDataFrame([(k,) for k in marks], "t string").select("t", T.malformed("t").alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == marks


def test_repeats_hash_a_text_once(spark):
    rows = spark.createDataFrame([("a b c " * 9,), ("a b",), (None,)], "t string").withColumn("_w", T.words("t"))
    assert plan(rows.select(T.max_gram_repeat(F.col("_w")).alias("x"))).count("sequence(") == 0  # n-grams were hashed for each use, word by word
    words = ("a b c " * 9).split()
    grams = [tuple(words[i : i + 12]) for i in range(len(words) - 11)]
    got = rows.select(T.max_gram_repeat(F.col("_w")).alias("m"), T.repetition(F.col("_w"), 3, 5).alias("r"), T.repeats_at_least(F.col("_w"), 12, 6).alias("six"), T.repeats_at_least(F.col("_w"), 12, 7).alias("seven")).first()
    assert got["m"] == max(map(grams.count, grams)) == 6 and got["r"] == 22 / 25 and got["six"] and not got["seven"]


def test_shingle_classes_make_the_sets_once(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b"), (4, "a  b"), (5, ""), (6, " "), (7, "a b c d e")], "k long, t string")
    got = dedup.shingle_classes(rows, "t", "k", ["k"])
    assert "split(" not in plan(got) and got.columns == ["k", "class"]  # texts were cut again for each reader of the classes
    assert {r["k"]: r["class"] for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    assert dedup.shingle_classes(rows, "t", "k").columns == ["k", "t", "class"]


def test_intervals_are_counted_without_pairs(spark):
    random.seed(7)
    rows = [(k * 3 + 1, a, a + random.choice([0, 1, 5, 60, -1])) for k, a in enumerate(random.choices([*range(90), 7, 7, 7], k=400))] + [(5000, None, 4), (None, 1, 2)]
    spans = spark.createDataFrame(random.sample(rows, len(rows)), "id long, a long, b long").repartition(3)
    ok = [r for r in rows if None not in r and r[1] <= r[2]]
    want = {}
    for k, a, b in ok:
        met = [x for x, c, d in ok if x > k and a <= d and c <= b]
        if met:
            want[k] = (len(met), sum(met))
    got = intervals.later_overlaps(spans, "id", ("a", "b"))
    assert {r["id"]: (r["n"], r["total"]) for r in got.collect()} == want
    assert intervals.later_overlaps(spans.limit(0), "id", ("a", "b")).count() == 0
    assert intervals.later_overlaps(spark.createDataFrame([(1, 2, 3)], "id long, a long, b long"), "id", ("a", "b")).count() == 0


def test_points_of_one_time_are_summed_before_windows_meet_them(spark):
    random.seed(8)
    windows = [(random.randint(0, 2), a, a + random.choice([0, 3, 40])) for a in random.choices(range(60), k=80)]
    points = [(random.randint(0, 2), random.randint(0, 80), random.randint(-5, 50)) for _ in range(300)]
    got = intervals.points_within(spark.createDataFrame(windows, "p long, a long, b long"), spark.createDataFrame(points, "q long, at long, v long"), ("a", "b"), "at", "v", 4, [("p", "q")])
    want = {}
    for p, a, b in windows:
        met = [(t, v) for q, t, v in points if q == p and a <= t <= b]
        if met:
            want[p, a, b] = (len(met), sum(v for _, v in met), min(met)[0], max(met)[0])
    rows = got.collect()
    assert {(r["p"], r["a"], r["b"]): (r["n"], r["total"], r["first"], r["last"]) for r in rows} == want and len(rows) == len(want)


def test_python_takes_texts_by_bytes(spark):
    QUERIES["normalized_texts"](spark, FLAGSHIP)
    size = F.pandas_udf(lambda t: pd.Series([len(t)] * len(t)), "long")
    long = spark.range(0, 96, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    assert long.select(size("t").alias("n")).agg(F.max("n")).first()[0] <= 17


def test_label_masks_deal_batches_without_the_ids(spark):
    seen = []
    own = sampling.length_batches
    try:
        sampling.length_batches = lambda rows, *a: seen.append(rows.columns) or own(rows, *a)
        QUERIES["label_masks"](spark, FLAGSHIP)
    finally:
        sampling.length_batches = own
    assert seen and all("ids" not in c for c in seen)


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_similar_pairs_shuffle_prefixes_instead_of_all_shingles(spark):
    random.seed(11)
    texts = [" ".join(f"w{random.randrange(10**6)}" for _ in range(500)) for _ in range(400)]
    texts += [t + " more words" for t in texts[:20]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    before = shuffled(spark)
    assert {(r["a"], r["b"]) for r in dedup.similar_pairs(rows, "t", "id").collect()} == {(i, 400 + i) for i in range(20)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < 3 * 8 * 500 * len(texts)  # all shingles went round five times, with their sets and counts


@pytest.mark.parametrize("bits, most", [(20, 128), (12, 3)])
def test_similar_pairs_of_frequent_shingles_and_dense_groups(spark, monkeypatch, bits, most):
    monkeypatch.setattr(dedup, "BUCKET_BITS", bits)
    monkeypatch.setattr(dedup, "BLOCK_SETS", most)
    random.seed(5)
    base = [[f"{g}.{i}" for i in range(random.choice([12, 40, 90, 200]))] for g in range(8)]
    stamp = [f"stamp{i}" for i in range(30)]  # in half of all texts
    texts = ["", " ", "a", "a b", "a b c d e", "stamp0 stamp1"]
    for _ in range(240):
        t = list(random.choice(base))
        for _ in range(random.choice([0, 1, 1, 2, 3])):
            at = random.randrange(len(t))
            t[at : at + random.choice([0, 1])] = [f"new{random.randrange(9)}"]
        texts.append(" ".join(t + (stamp if random.random() < 0.5 else [])))
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    sets = {}
    for k, t in enumerate(texts):
        sets.setdefault(frozenset(grams(t.split())), k)
    want = {(a, b): len(x & y) / len(x | y) for x, a in sets.items() for y, b in sets.items() if a < b and 5 * len(x & y) >= 4 * len(x | y)}
    rows = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (900, None)], "id long, t string").repartition(5)
    got = [(r["a"], r["b"], r["jaccard"]) for r in dedup.similar_pairs(rows, "t", "id").collect()]
    assert len(want) > 200 and len(got) == len(want) and {(a, b): j for a, b, j in got} == pytest.approx(want)
