import json

from loomwork.sources import readers, sinks
from loomwork.streaming import prep


def test_json_lines_and_sinks(spark, tmp_path):
    good = {"id": "a#1", "category": "c", "messages": [{"role": "user", "content": "سلام"}]}
    (tmp_path / "one.jsonl").write_text(json.dumps(good, ensure_ascii=False) + "\n\n{broken\n", encoding="utf-8")
    rows = readers.json_lines(spark, str(tmp_path / "*.jsonl"))
    assert rows.count() == 2 and readers.malformed_counts(rows).first()["malformed"] == 1
    assert readers.line_count(spark, str(tmp_path / "one.jsonl")).first()["rows"] == 2
    assert readers.first_lines(spark, str(tmp_path / "one.jsonl"), 1).count() == 1
    assert readers.optional_json_lines(spark, f"{tmp_path}/one.jsonl, {tmp_path}/none.jsonl").count() == 2
    assert readers.optional_json_lines(spark, f"{tmp_path}/none.jsonl").count() == 0
    ok = rows.filter("_bad is null")
    sinks.write_json_lines(ok, str(tmp_path / "out"))
    assert "سلام" in next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8")
    assert sinks.append_new(ok, str(tmp_path / "log")) == 1 and sinks.append_new(ok, str(tmp_path / "log")) == 0
    assert "| c |" in sinks.markdown(ok.select("category"), "T")
    assert len(readers.manifest(spark, str(tmp_path / "one.jsonl")).first()["sha256"]) == 64


def test_parquet_by_domain_and_prompt_sets(spark, tmp_path):
    rows = spark.createDataFrame([([("user", "x")], "history", "s"), ([("user", "y")], "science", "s")], "messages array<struct<role: string, content: string>>, domain string, other string")
    for d in ("history", "science"):
        rows.filter(f"domain = '{d}'").select("messages", "other").coalesce(1).write.parquet(f"{tmp_path}/raw/{d}")
        for p in (tmp_path / "raw" / d).glob("part-*.parquet"):
            p.rename(p.parent / "train-0.parquet")
    got = readers.domain_parquet(spark, str(tmp_path / "raw"))
    assert sorted(r["domain"] for r in got.collect()) == ["history", "science"]
    assert readers.domain_parquet(spark, str(tmp_path / "raw"), subset=1).count() == 1
    (tmp_path / "a.json").write_text(json.dumps({"name": "n", "count": 1, "prompts": [{"id": "p1", "prompt": "q"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "p2", "prompt": "q", "expect": "fa"}]))
    assert [readers.prompt_set(spark, str(tmp_path / f)).first()["id"] for f in ("a.json", "b.json")] == ["p1", "p2"]
    assert readers.json_or_null(spark, str(tmp_path / "none.json"), "name string") is None
    assert readers.json_or_null(spark, str(tmp_path / "a.json"), "name string") == {"name": "n"}


def test_small_files(spark, tmp_path):
    rows = spark.createDataFrame([("a#1", 1), ("a#2", 2), ("a#1", 1), ("b#1", 3)], "id string, n int")
    assert sinks.append_new(rows, str(tmp_path / "log")) == 3 and sinks.append_new(rows, str(tmp_path / "log")) == 0
    wide = spark.range(300).selectExpr("id", "'x|y' as t")
    assert sinks.markdown(wide, "All").count("\n") == 304 and "x\\|y" in sinks.markdown(wide, "All")
    report = str(tmp_path / "r.md")
    runs = spark.createDataFrame([(k, k in (1, 3, 4)) for k in range(6)], "k long, failed boolean")
    assert sinks.write_unless_died(runs.filter("k < 4"), report, ["k"], "failed", lambda r: "one") and not sinks.write_unless_died(runs, report, ["k"], "failed", lambda r: "two")
    assert (tmp_path / "r.md").read_text() == "one" and [p.name for p in tmp_path.glob("*.tmp")] == []
    files = spark.createDataFrame([("/x/a.js", "1"), ("x/../../b", "2"), ("x\\c.css", "3")], "path string, code string")
    assert sinks.write_files(files, str(tmp_path / "out")) == 2 and (tmp_path / "out/x/a.js").read_text() == "1\n" and (tmp_path / "out/x/c.css").exists()


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").write.parquet(str(tmp_path / "in"))
    stream = prep.prepared(prep.turns(spark, str(tmp_path / "in")))
    for _ in range(2):  # the second run finds nothing new
        prep.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(tmp_path / "in")).count()
