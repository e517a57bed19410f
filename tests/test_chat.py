"""The chat template with tools, letter by letter; large-corpus preparation and files read in part."""

from pyspark.sql import functions as F

from loomwork.functions import chat
from loomwork.functions import text as T
from loomwork.operators import conversations as V
from loomwork.operators import dedup
from loomwork.sources import readers

CALL = "<tool_call>\n{{\"name\": \"{}\", \"arguments\": {}}}\n</tool_call>"


def said(spark, messages, **options):
    rows = spark.createDataFrame([(1, [(m[0], m[1], m[2] if len(m) > 2 else None) for m in messages] if messages is not None else None, "own")], f"id long, c array<{chat.MESSAGE}>, _n string")
    got = chat.with_chat(rows, "c", "text", **options)
    assert got.columns == ["id", "c", "_n", "text"]
    return got.first()["text"]


def test_chat_with_tools(spark):
    turns = [("system", "S"), ("user", "Q"), ("assistant", "<think>\nplan\n</think>\n\nLook.", [("find", '{"q": 1}'), ("time", "{}")]), ("tool", "r1"), ("tool", "r2"), ("assistant", "Done.")]
    head = "<|im_start|>system\nS\n\n" + chat.TOOLS_HEAD + '\n{"name": "find"}' + chat.TOOLS_TAIL + "<|im_end|>\n"
    first = "<|im_start|>assistant\n<think>\nplan\n</think>\n\nLook.\n" + CALL.format("find", '{"q": 1}') + "\n" + CALL.format("time", "{}") + "<|im_end|>\n"
    tools = "<|im_start|>user\n<tool_response>\nr1\n</tool_response>\n<tool_response>\nr2\n</tool_response><|im_end|>\n"
    assert said(spark, turns, tools=['{"name": "find"}'], generation_prompt=True) == head + "<|im_start|>user\nQ<|im_end|>\n" + first + tools + "<|im_start|>assistant\n<think>\n\n</think>\n\nDone.<|im_end|>\n<|im_start|>assistant\n"
    # thoughts before the last question go; a response in a user's turn is no question; later systems are turns
    turns = [("user", "A"), ("assistant", "<think>x</think>B", [("f", "{}")]), ("user", "<tool_response>r</tool_response>"), ("assistant", "", [("g", "{}")]), ("system", "later"), ("user", "C"), ("assistant", "D</think>E")]
    want = "<|im_start|>user\nA<|im_end|>\n<|im_start|>assistant\nB\n" + CALL.format("f", "{}") + "<|im_end|>\n<|im_start|>user\n<tool_response>r</tool_response><|im_end|>\n<|im_start|>assistant\n" + CALL.format("g", "{}") + "<|im_end|>\n<|im_start|>system\nlater<|im_end|>\n<|im_start|>user\nC<|im_end|>\n"
    assert said(spark, turns) == want + "<|im_start|>assistant\n<think>\nD\n</think>\n\nE<|im_end|>\n"
    assert said(spark, [], generation_prompt=True, thinking=False) == said(spark, None, generation_prompt=True, thinking=False) == "<|im_start|>assistant\n<think>\n\n</think>\n\n"
    assert said(spark, [("tool", None), ("user", None)]) == "<|im_start|>user\n<tool_response>\n\n</tool_response><|im_end|>\n<|im_start|>user\n<|im_end|>\n"


def test_runner_answers_and_build_keys(spark):
    texts = [" a ", "<think>x</think> b ", "<think>x</think> ", "x</think>y</think>z", None, "<think>open"]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.runner_answer("t").alias("x")).collect()]
    assert got == ["a", "b", "<think>x</think>", "y</think>z", "", "<think>open"]
    keys = spark.createDataFrame([("  A\n b\t" + "c" * 400,), ("كي",)], "t string").select(T.prompt_key("t", 300, False).alias("x")).collect()
    assert keys[0]["x"] == "a b " + "c" * 296 and keys[1]["x"] == "كي"


def test_hot_groups_are_attached_without_one_task(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" with some words"))).alias("t"), F.lit("x").alias("_m"))
    groups = dedup.min_shingle(df, "t", "id")
    assert groups.filter("t = '' and group = 0").count() == 2000 and groups.filter("t <> '' and group = id").count() == 2000 and groups.columns == ["id", "t", "_m", "group"]
    assert dedup.min_shingle(df, "t", "id", 60).filter("group = id").count() == 4000
    classes = dedup.shingle_classes(df.drop("_m"), "t", "id")
    assert classes.filter("t = '' and class = 0").count() == 2000
    for got in (groups, classes):
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    sizes = groups.select(F.spark_partition_id().alias("p"), "t").filter("t = ''").groupBy("p").count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 1000  # the empty texts stay where they are


def test_preparation_normalizes_but_for_code_and_counts_pairs(spark):
    words, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    third, fourth = words.replace("w", "x"), words.replace("w", "y")
    turn = lambda q, a: [("user", f"What about {q} and the rest?"), ("assistant", a)]
    convs = [(1, turn("one", f"كتاب `كي` {words} one."), "a"), (2, [*turn("two", f"{other} two."), *turn("more", f"{third} more.")], "b"), (3, turn("three", f"{fourth} three."), "b"), (4, [("user", "alone")], "z"), (5, None, "z"), (6, turn("three", f"{fourth} three."), "b")]
    picked, stats = V.preparation(spark.createDataFrame(convs, "conv_id long, messages array<struct<role: string, content: string>>, domain string"), 10)
    got = {r["conv_id"]: r for r in picked.collect()}
    s = stats.first()
    assert s["n_raw"] == 6 and s["n_rejected"] + s["n_exact"] + s["n_near"] + s["n_kept"] == 6 and s["n_exact"] == 1 and s["n_rejected"] == 2
    assert all(r["turns"] == (2 if k == 2 else 1) for k, r in got.items())
    assert 1 not in got or got[1]["messages"][1]["content"].startswith("کتاب `كي`")


def test_first_rows_of_files_without_a_sort(spark, tmp_path):
    for k in range(5):
        rows = spark.createDataFrame([([("user", f"{k}-{i}")],) for i in range(10)], f"messages {readers.MESSAGES}")
        rows.coalesce(1).write.parquet(f"{tmp_path}/raw/d {k}")
        next((tmp_path / f"raw/d {k}").glob("part-*.parquet")).rename(tmp_path / f"raw/d {k}/train-0.parquet")
    few = readers.domain_parquet(spark, str(tmp_path / "raw"), subset=13)
    assert "Sort" not in few._jdf.queryExecution().executedPlan().toString() and len(few.inputFiles()) == 2
    assert sorted(r["messages"][0]["content"] for r in few.collect()) == sorted([f"0-{i}" for i in range(10)] + [f"1-{i}" for i in range(3)])
    assert readers.domain_parquet(spark, str(tmp_path / "raw"), subset=500).count() == 50
