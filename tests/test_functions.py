"""Branches that the tables don't reach, on hand-written rows."""

import re
import shutil
import time
from itertools import product

import pytest
from pyspark.sql import functions as F

from loomwork.functions import constants as C
from loomwork.functions import text as T
from loomwork.functions import udfs as U
from loomwork.operators import conversations as V
from loomwork.operators import dedup, materialize, metrics, sampling

CONVS = "conv_id long, turns int, messages array<struct<role: string, content: string>>"
LONG = " ".join(f"word{i} matters here" for i in range(20))
FA = "این یک پرسش درباره‌ی تاریخ است که برای من خیلی مهم بود"


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").withColumn("_w", T.words("t")).select(fn.alias("x")).first()["x"]


def conv(user, asst, *more):
    return [("user", user), ("assistant", asst), *more]


@pytest.mark.parametrize("reason, messages", [
    ("ok", conv("What is this about?", LONG)),
    ("bad_role_structure", [("system", "s"), *conv("What is this about?", LONG)]),
    ("bad_role_structure", [("user", "a"), ("user", "b"), ("assistant", LONG)]),
    ("bad_role_structure", [("user", "only a question here")]),
    ("malformed", conv(None, LONG)),
    ("empty_content", conv(" \n ", LONG)),
    ("corrupted_unicode", conv("What is � this about?", LONG)),
    ("arabic_language", conv("هذا من على في إلى", LONG)),
    ("answer_too_short", conv("What is this about?", "short")),
    ("prompt_too_short", conv("What?", LONG)),
    ("too_long", conv("What is this about?", "a b " * 1100)),
    ("repetitive", conv("What is this about?", "one two three four " * 15)),
    ("repetitive", conv("What is this about?", ("a b c d e f g h i j k l " + " ".join(f"w{i}" for i in range(60)) + " ") + ("a b c d e f g h i j k l " + " ".join(f"v{i}" for i in range(60)) + " a b c d e f g h i j k l"))),
    ("placeholder_artifact", conv("What is this about?", LONG + " {{ name }} x")),
    ("unfinished", conv("What is this about?", LONG + ", ")),
    ("unfinished_code_fence", conv("What is this about?", LONG + "\n```js\nx = 1")),
    ("secret_like", conv("What is this about?", LONG + " AKIA" + "A1" * 8)),
])
def test_reasons(spark, reason, messages):
    got = V.with_reason(spark.createDataFrame([(1, len(messages), messages)], CONVS)).first()
    assert got["reason"] == reason


def test_small_corpus_reasons(spark):
    rows = {"ok": conv("What is this?", LONG), "bad_messages": [("user", "x")], "foreign_system": [("system", "Other"), *conv("What is this?", LONG)], "missing_roles": [("user", "aaaaaa"), ("user", "bbbbbb")], "empty_content": conv("hi", LONG), "answer_too_short": conv("What is this?", "short one"), "repetitive": conv("What is this?", "one two three four " * 15), "too_long": conv("x" * 4001, LONG), "secret_like": conv("What is this?", LONG + " sk-" + "a" * 24)}
    df = spark.createDataFrame([(i, len(m), m) for i, m in enumerate(rows.values())], CONVS)
    assert [r["reason"] for r in V.with_small_reason(df, "You are").orderBy("conv_id").collect()] == list(rows)


def test_languages(spark):
    assert one(spark, FA, T.substring_language("t")) == "fa"
    assert one(spark, "هذا من على في إلى", T.substring_language("t")) == "ar"
    assert one(spark, "plain English words", T.substring_language("t")) == "en"
    assert one(spark, None, T.substring_language("t")) == "other"
    assert one(spark, FA, T.token_language("t")["lang"]) == "fa"
    assert one(spark, "هذا من على إلى هناك", T.token_language("t")["lang"]) == "ar"
    assert one(spark, "```js\nlet x\n```", T.response_language("t")) == "code"
    assert one(spark, "  ", T.token_language("t")["conf"]) == 0.0


def test_normalization(spark):
    raw = "كتابـي ٣٤ می‌شود‏  \t x \r\n\r\n\r\n\r\nend"
    want = "کتابی ۳۴ می‌شود x\n\nend"
    assert one(spark, raw, T.normalize_segment("t")) == want == U.normalized(raw)
    kept = "`ي` https://a.b/ي ```\nي\n``` me@mail.com /usr/ك.x"
    assert U.normalized("ي " + kept + " ي") == "ی " + kept.replace("/usr/ك.x", "/usr/ک.x") + " ی"
    assert U.normalized("abcd <fa> https://x.y") == "abcd <fa> https://x.y"  # spans by position: nothing twice
    assert one(spark, "Ａ  b C", U.fold_text("t")) == "a b c"
    assert one(spark, None, U.normalize_text("t")) is None


def test_text_functions(spark):
    assert one(spark, "a b c a b c", T.repetition(F.col("_w"), 3, 5)) == pytest.approx(0.25)
    assert one(spark, "a b c a b c a b c", T.max_gram_repeat(F.col("_w"), 3)) == 3
    assert [one(spark, "a b c a b c", T.repeats_at_least(F.col("_w"), 3, k)) for k in (2, 3)] == [True, False]
    assert one(spark, "<think>x</think> y", T.without_thinking("t")) == "y"
    assert one(spark, "<think>x", T.without_thinking("t")) == "" == one(spark, "<think>x</think>", T.without_thinking("t"))
    assert one(spark, "TODO and fixme", F.size(T.bad_markers("t"))) == 2
    assert [tuple(b) for b in one(spark, "```html\n<p>\n```\n```\na{b:c}\n```\n```py\nx\n```", T.blocks("t"))] == [("html", "<p>\n"), ("css", "a{b:c}\n"), ("other", "x\n")]
    assert one(spark, "17", T.split_bucket(42, "t")) == 52
    assert one(spark, "abc", T.hash32(F.col("t"))) == 2416005272
    assert U.html_fault("<p><b></p>") is None and U.html_fault("</p>") == "stray </p>" and U.html_fault("<p></b>") == "unmatched </b>" and U.html_fault("<i><b><p>").startswith("unclosed")
    assert U.json_objects('noise ```json\n[{"a": "}{"}, {"b": [1, {"c": 2}]}, {"d": ') == ['{"a": "}{"}', '{"b": [1, {"c": 2}]}']
    assert U.json_objects('[{"a": 1}]') == ['{"a": 1}'] and U.json_objects(None) == []
    assert U.json_objects('[{"a": {"b": 1}, "c') == [] and U.json_objects('[{"a": "x\\') == [] and U.json_objects('{"a": 1}, {"b": 2}') == []


def test_json_objects_is_linear_and_survives_nesting():
    for noise in ("{" * 200_000, '"\\' * 200_000, "[" * 200_000, "[" + '{"a":' * 100_000 + "1" + "}" * 100_000 + "]"):
        began = time.time()
        assert U.json_objects('[{"a": 1}, ' + noise) == (['{"a": 1}'])
        assert time.time() - began < 5
    rows = [("".join(c), None) for c in product('{}"\\[a', repeat=6)]
    for s, _ in rows[:: 7]:  # against a scan letter by letter
        depth, quoted, escaped, start, want = 0, False, False, -1, []
        for i, c in enumerate(s):
            if quoted:
                quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            elif c == '"':
                quoted, escaped = True, False
            elif c == "{":
                start, depth = (i if depth == 0 else start), depth + 1
            elif c == "}":
                depth -= 1
                if depth == 0 and start >= 0:
                    want.append(s[start : i + 1])
        assert [x for x in U.complete_objects(s)] == want or depth < 0 or "}" in s[: (s + "{").find("{")], s


def test_files_and_truncated_answers(spark):
    text = "**a/b.html**\n```html\n <p> \n```\n**x.css** then **y.css**\n```text\nnotes **z.css**\n```\n```css\nq{}\n```\n```JS\n1\n```\n```\nplain\n```\n```sql\nSELECT 1\n```"
    assert [tuple(f) for f in one(spark, text, T.files("t"))] == [("a/b.html", "<p>"), ("z.css", "q{}"), ("app.js", "1"), ("file4.txt", "plain"), ("file5.sql", "SELECT 1")]
    assert one(spark, None, T.files("t")) == [] == one(spark, "no block", T.files("t"))
    rows = spark.createDataFrame([(1, "aa\n```js\nbb\ncc", 60), (2, "a", 10), (3, "x" * 500 + "\n" + "y" * 20, 100), (4, "a\n\n" + "b" * 100, 60), (5, "short \n" + "z" * 30 + "\n", 60)], "id long, t string, b int")
    got = {r["id"]: r["kept"] for r in materialize.truncated_answers(rows, "id", "t", "b", lambda x: F.when(F.col("id") == 1, 20).otherwise(F.length(x) + 1)).collect()}
    assert got == {1: "aa\n```js\nbb\n```", 2: None, 3: None, 4: None, 5: "short \n" + "z" * 30}


def test_dedup_and_sampling(spark):
    df = spark.createDataFrame([(i, f"same start of the text {'x' if i < 61 else i}") for i in range(65)], "id long, t string")
    assert dedup.min_shingle(df.filter("id < 60"), "t", "id").select("group").distinct().count() == 1
    assert dedup.min_shingle(df.filter("id < 61"), "t", "id", 60).filter("group = id").count() == 61 and dedup.min_shingle(df.filter("id < 61"), "t", "id").filter("group = 0").count() == 61
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(reversed(words)), " ".join(words)]
    table = spark.createDataFrame(list(enumerate([*texts, "", "  "])), "id long, t string")
    got = dedup.similar_pairs(table, "t", "id").collect()
    assert [(r["a"], r["b"], round(r["jaccard"], 4)) for r in got] == [(0, 1, round(55 / 57, 4))]
    assert {r["id"]: r["class"] for r in dedup.shingle_classes(table, "t", "id").collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4, 5: 4}
    both = spark.createDataFrame([([1, 2, 3, 4], [1, 5, 3, 4])], "a array<long>, b array<long>").select(dedup.agreement("a", "b").alias("f"), dedup.minhash_signature("a", 8).alias("m"))
    assert both.first()["f"] == 0.75 and len(both.first()["m"]) == 8
    assert dedup.similar_pairs(table.limit(0), "t", "id").count() == 0
    rows = spark.createDataFrame([(i, c, i) for i, c in enumerate(["a-1", "a-2", "b-1", "c-1"])], "seq long, id string, n long")
    assert [r["id"] for r in sampling.round_robin(rows, F.regexp_replace("id", "-?[0-9]+$", ""), "seq", 4).collect()] == ["a-1", "b-1", "c-1", "a-2"]
    four = sampling.nearest_rank(spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "n long"), "n").first()
    assert (four["p50"], four["p95"], four["max"], four["mean"]) == (3, 4, 4, 2.5)
    assert sampling.nearest_rank(spark.createDataFrame([], "n long"), "n").count() == 0
    ranks = sampling.ranked(spark.range(1000), [F.desc("id")], 7).collect()
    assert {r["rank"] + r["id"] for r in ranks} == {1000}


def test_metrics_and_material(spark):
    resp = spark.createDataFrame([("x", FA), ("y", "<think>no"), ("z", "plain English words here")], "id string, response string")
    bench = spark.createDataFrame([("z", "en", "c")], "id string, expect_lang string, category string")
    judged = metrics.judged_responses(resp, bench)
    assert {r["id"]: (r["expect"], r["category"], r["got"]) for r in judged.collect()} == {"x": ("fa", "unknown", "fa"), "y": ("fa", "unknown", "empty"), "z": ("en", "c", "en")}
    m = metrics.benchmark_metrics(judged).first()
    assert (m["persian_response_rate"], m["language_compliance"], m["empty_response_rate"], m["misclassified_total"]) == (1.0, 1.0, 0.3333, 1)
    a = spark.createDataFrame([("An answer that is long enough to count", "build a page", "en"), ("```css\na{b:c}\n``` and some more text to fill", "why", "fa")], "answer string, prompt string, expect string")
    s = metrics.answer_summary(metrics.answer_measures(a, "answer", "prompt", "expect")).first()
    assert (s["n"], s["empty_rate"], s["empty_share"], s["code_production_rate"], s["syntax_checked"], s["syntax_valid_rate"], s["language_correct"]) == (2, 1.0, 0.0, 0.5, 1, 1.0, 0.5)
    ids = spark.createDataFrame([(0, [1, 2, 3], [1]), (0, [4, 5], [4]), (1, [6], [6])], "batch long, ids array<int>, prompt array<int>").withColumn("mask", materialize.label_mask("prompt", "ids"))
    assert [r["mask"] for r in ids.collect()] == [[-100, 2, 3], [-100, 5], None]
    got = materialize.collate(ids.filter("mask is not null"), "batch", "ids", "mask", 0).select("input_ids", "labels", "attention_mask").collect()
    assert sorted(map(list, got)) == [[[1, 2, 3], [-100, 2, 3], [1, 1, 1]], [[4, 5, 0], [-100, 5, -100], [1, 1, 0]]]
    wants = spark.createDataFrame([("a", 400), ("b", 10)], "category string, want long")
    have = spark.createDataFrame([("a",)] * 395 + [("b",)] * 20, "category string")
    assert [(r["category"], r["need"], r["batch"]) for r in materialize.plan_batches(wants, have, 2400).collect()] == [("a", 5.0, 0), ("a", 5.0, 1)]
    rate = spark.createDataFrame([(0,), (9,), (10,), (110,)], "s long").select(T.learning_rate("s", 10, 110, 1.0).alias("x")).collect()
    assert [round(r["x"], 6) for r in rate] == [0.1, 1.0, 1.0, 0.0]


def test_html_balance_of_all_pages(spark):
    """Against a stack over tags found by a pattern, comments and scripts apart."""
    page = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][^\s/>]*)[^>]*?>", re.S)
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", U.html_error("html").alias("fault")).collect()
    for r in rows:
        path, fault = [], None
        for m in page.finditer(r["html"] or ""):
            tag = (m[3] or "").lower()
            if not tag or tag in C.VOID_TAGS:
                continue
            if not m[2]:
                path.append(tag)
            elif tag in path:
                del path[len(path) - 1 - path[::-1].index(tag) :]
            else:
                fault = f"unmatched </{tag}>" if path else f"stray </{tag}>"
        assert r["fault"] == (fault or (f"unclosed: {path}" if len(path) > 1 else None))
    assert rows


def test_validated_files_and_verdict(spark):
    files = [("a.html", "<html><p>x</p></html>"), ("b", "<!DOCTYPE html><i><b>"), ("c.CSS", "a{"), ("d.css", "a{}"), ("e.txt", "{"), ("f.js", "let x = 1")]
    df = spark.createDataFrame(files, "path string, code string")
    got = metrics.validated_files(df, U.html_error, lambda c: F.lit("unchecked"))
    assert {r["path"]: r["valid"] for r in got.collect()} == {"a.html": True, "b": False, "c.CSS": False, "d.css": True, "f.js": None}
    assert tuple(metrics.verdict(got).first()) == (4, 2, "FAIL") and metrics.verdict(got.filter("path in ('a.html', 'd.css')")).first()["verdict"] == "PASS" and metrics.verdict(got.limit(0)).first()["verdict"] == "FAIL"


def test_language_with_model_and_conversations_without_messages(spark):
    rows = [(FA, "__label__ar", 0.5, "fa"), (FA, "ara", 0.9, "ar"), ("plain English words", "EN", 0.2, "en"), (FA, None, None, "fa"), (FA, "de", 0.74, "fa"), ("plain words", "de", 0.5, "other")]
    df = spark.createDataFrame(rows, "t string, label string, conf double, want string").withColumn("g", F.when(F.col("label").isNotNull(), F.struct("label", "conf")))
    assert [r["x"]["lang"] for r in df.select(T.with_model("t", "g").alias("x")).collect()] == [r[3] for r in rows]
    convs = spark.createDataFrame([(1, 2, [("user", "ي"), ("assistant", None)]), (2, 0, []), (3, 0, None)], CONVS)
    got = {r["conv_id"]: r["messages"] for r in V.normalize(convs, T.normalize_segment).collect()}
    assert [tuple(m) for m in got[1]] == [("user", "ی"), ("assistant", "")] and got[2] == [] and got[3] is None


def test_lsh_groups_and_preparation(spark):
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words)), " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert {r["id"]: r["group"] for r in dedup.lsh_groups(df, "t", "id").collect()} == {0: 0, 1: 0, 2: 2, 3: 0}
    many = spark.createDataFrame([(i, " ".join(words)) for i in range(61)], "id long, t string")
    assert dedup.lsh_groups(many, "t", "id").filter("group = id").count() == 61 and dedup.lsh_groups(many.limit(0), "t", "id").count() == 0
    convs = [(i, 2, conv(f"What is question number {i} about?", f"answer {i} " + " ".join(f"{x}{i}" for x in words[:30])), "d") for i in range(6)]
    convs += [(10, 2, convs[0][2], "d"), (11, 2, conv("What?", LONG), "d"), (12, 4, [*conv("What is that one about?", LONG), *conv("And what else is there?", " ".join(f"{x}z" for x in words[:30]))], "e")]
    picked, stats = V.preparation(spark.createDataFrame(convs, CONVS + ", domain string"), 4)
    s = stats.first()
    assert (s["n_raw"], s["n_rejected"], s["n_exact"], s["n_near"], s["n_kept"], s["n_multi"]) == (9, 1, 1, 0, 7, 1) and s["n_picked"] == picked.count() == s["n_train"] + s["n_validation"] == 2


def test_generators(spark):
    tasks = materialize.task_matrix(spark, [("page", "fa", 3), ("fix", "en", 0), ("css", "en", 2)], ["easy", "hard"]).orderBy("id").collect()
    assert [(r["id"], r["difficulty"]) for r in tasks] == [("css-en-000", "easy"), ("css-en-001", "hard"), ("page-fa-000", "easy"), ("page-fa-001", "hard"), ("page-fa-002", "easy")]
    got = materialize.prompt_cycle(spark, ["a", "b", "c", "d"], ["x", "y"], 16).collect()
    assert len({(r["subject"], r["mode"]) for r in got}) == 8
    texts = [r["text"] for r in materialize.filled_templates(spark.range(50), "a {c} page for {n}", "id", {"c": ["red", "blue"], "n": ["x", "y", "z"]}).collect()]
    assert len(set(texts)) == 6 and not any("{" in t for t in texts)
    runs = spark.createDataFrame([(1024, 10.0, None), (4096, 15.0, None), (3072, 14.0, None), (8192, 1.0, "oom")], "seq_len int, memory_gb double, error string")
    assert materialize.fitting_config(runs).first()["seq_len"] == 3072 and materialize.fitting_config(runs.limit(0)).first()["seq_len"] == 2048


@pytest.mark.skipif(shutil.which("node") is None, reason="no node")
def test_scripts_are_checked_a_batch_at_a_time(spark, monkeypatch):
    codes = ["let a = 1;", "function (", None, "return 1", "throw new Error('not run')", "const x = {;", "a => a * 2", "\u2028 let é = '日本'"]
    want = [True, False, True, True, True, False, True, True]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string").repartition(2)
    got = {r["i"]: r["e"] for r in df.select("i", U.js_error("c").alias("e")).collect()}
    assert [got[i] is None for i in range(len(codes))] == want and got[1].startswith("SyntaxError")
    rows = df.select(F.concat(F.col("i").cast("string"), F.lit(".js")).alias("path"), F.col("c").alias("code"))
    assert metrics.verdict(metrics.validated_files(rows, U.html_error, U.js_error)).first()["valid"] == sum(want)
    started = []
    real = U.subprocess.run
    monkeypatch.setattr(U.subprocess, "run", lambda *a, **k: started.append(1) or real(*a, **k))
    assert U.script_faults(shutil.which("node"), ["1"] * 500) == [None] * 500 and len(started) == 1
