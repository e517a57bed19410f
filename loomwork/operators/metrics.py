"""Metrics of benchmark responses and of answers, as one conditional aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def count_if(c: Column) -> Column:
    return F.sum(F.coalesce(c.cast("long"), F.lit(0)))


def judged_responses(responses: DataFrame, bench: DataFrame) -> DataFrame:
    """Responses (id, response) with the benchmark's expectation and what was got; unknown ids expect fa in category unknown."""
    facts = bench.select("id", F.col("expect_lang").alias("_e"), F.col("category").alias("_c"))
    rows = responses.join(facts, "id", "left").withColumns({"expect": F.coalesce("_e", F.lit("fa")), "category": F.coalesce("_c", F.lit("unknown")), "answer": T.without_thinking("response")}).drop("_e", "_c")
    rows = rows.withColumns({"empty": F.col("answer") == "", "_w": T.words("answer")})
    full = lambda c: F.when(~F.col("empty"), c)
    return rows.withColumns({"malformed": full(T.malformed("answer")), "repetitive": full(T.repetition(F.col("_w")) > 0.45), "got": F.when(F.col("empty"), "empty").otherwise(T.token_language("answer")["lang"])}).drop("_w")


def benchmark_metrics(judged: DataFrame) -> DataFrame:
    """Rates with four decimals, null where the denominator is 0."""
    e, g, full = F.col("expect"), F.col("got"), ~F.col("empty")
    n, n_full = F.count(F.lit(1)), count_if(full)
    fa, ok = count_if(full & (e == "fa")), count_if(full & (e == g) & e.isin("fa", "ar", "en"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 4)
    mean = F.sum(F.when(full, F.length("answer")).otherwise(0)) / F.greatest(F.lit(1), n_full)
    return judged.agg(
        n.alias("n_prompts"), rate(count_if((e == "fa") & (g == "fa")), fa).alias("persian_response_rate"), rate(ok, count_if(full & e.isin("fa", "ar", "en"))).alias("language_compliance"),
        rate(count_if((e == "fa") & (g == "ar")), fa).alias("arabic_leakage_rate_on_fa"), rate(count_if(F.col("empty")), n).alias("empty_response_rate"), rate(count_if(F.col("repetitive")), n).alias("repetition_rate"),
        rate(count_if(F.col("malformed").isNotNull()), n).alias("malformed_response_rate"), F.round(mean, 1).alias("average_response_length_chars"), F.round(mean / 2.2, 1).alias("average_response_length_tokens_est"),
        count_if(F.col("empty") | (e.isin("fa", "ar", "en") & (e != g))).alias("misclassified_total"),
    )


def by_category(judged: DataFrame) -> DataFrame:
    e, g, full = F.col("expect"), F.col("got"), ~F.col("empty")
    each = [a for x in ("fa", "ar", "en") for a in (count_if(full & (e == x)).alias(f"{x}_expect"), count_if((e == x) & (g == x)).alias(f"{x}_ok"))]
    return judged.groupBy("category").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("empty")).alias("empty"), count_if(F.col("malformed").isNotNull()).alias("malformed"), count_if(F.col("repetitive")).alias("repetitive"), *each)


def misclassified(judged: DataFrame, order: str, limit: int = 40) -> DataFrame:
    """The first wrong rows: a report's feature."""
    wrong = F.col("empty") | (F.col("expect").isin("fa", "ar", "en") & (F.col("expect") != F.col("got")))
    return judged.filter(wrong).orderBy(order).limit(limit).select("id", "expect", "got", F.substring("answer", 1, 200).alias("response"))


def projected(rows: DataFrame, cuts: dict[str, int]) -> DataFrame:
    """`rows` with texts cut to so many characters, as reports show them."""
    return rows.withColumns({c: F.substring(F.coalesce(c, F.lit("")), 1, n) for c, n in cuts.items()})


def validated_files(files: DataFrame, html_error, js_error) -> DataFrame:
    """(path, kind, valid, error) of rows (path, code): by extension, or as a page by what the code begins with; other files are left out."""
    ext = F.lower(F.when(F.contains("path", F.lit(".")), F.element_at(F.split("path", r"\."), -1)).otherwise(""))
    page = (ext == "html") | F.contains(F.substring("code", 1, 200), F.lit("<html")) | F.contains(F.substring("code", 1, 100), F.lit("<!DOCTYPE"))
    rows = files.withColumn("kind", F.when(page, "html").when(ext == "css", "css").when(ext == "js", "js")).filter("kind is not null")
    check = lambda kind, udf: rows.filter(F.col("kind") == kind).withColumn("error", udf)
    css = F.when(~T.css_balanced("code"), "brace mismatch")
    out = check("html", html_error("code")).unionByName(check("css", css)).unionByName(check("js", js_error("code")))
    return out.withColumn("valid", F.when(F.coalesce(F.col("error") != "unchecked", F.lit(True)), F.col("error").isNull()))


def verdict(validated: DataFrame) -> DataFrame:
    """One row: files checked, valid ones, and PASS if all are; FAIL without any."""
    n, ok = count_if(F.col("valid").isNotNull()), count_if(F.col("valid"))
    return validated.agg(n.alias("checked"), ok.alias("valid")).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("checked", "valid")}).withColumn("verdict", F.when((F.col("checked") > 0) & (F.col("checked") == F.col("valid")), "PASS").otherwise("FAIL"))


def answer_measures(rows: DataFrame, answer: str, prompt: str, expect: str) -> DataFrame:
    """`rows` with the measures of each answer; syntax by brace balance of CSS blocks (HTML by the UDF in functions)."""
    a = F.col(answer)
    out = rows.withColumns({"_b": T.blocks(a), "_w": T.words(a)})
    kinds = lambda k: F.filter("_b", lambda b: b["kind"] == k)
    ratio = T.arabic_block_ratio(a)
    has_code = F.exists("_b", lambda b: b["kind"].isin("html", "css", "js"))
    wants_page = T.any_of(F.contains(F.lower(F.col(prompt)), F.lit(w)) for w in C.BUILD_WORDS)
    return out.withColumns({
        "answer_chars": F.length(a), "has_code": has_code, "is_empty": F.length(T.strip(a)) < 30, "repetition": F.round(T.repetition(F.col("_w")), 3), "bad_markers": T.bad_markers(a),
        "css_valid": F.when(F.size(kinds("css")) > 0, F.forall(F.slice(kinds("css"), 1, 3), lambda b: T.css_balanced(b["code"]))), "lang_ok": F.when(F.col(expect) == "fa", ratio >= 0.10).when(F.col(expect) == "en", ratio <= 0.15),
        "persian_ratio": F.round(ratio, 3), "relevance_hits": T.relevance_hits(a), "followed": F.when(wants_page, F.size(kinds("html")) > 0).otherwise(has_code | (F.length(a) > 120)),
    }).withColumn("relevant", F.col("relevance_hits") >= 2).drop("_b", "_w")


def answer_summary(measured: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Shares over all answers. `empty_rate` and `bad_marker_rate` are one minus the share, as published; the shares stand beside them."""
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    share = lambda c: F.round(count_if(c) / n, 3)
    bad, checked = F.size("bad_markers") > 0, F.col("css_valid").isNotNull()
    aggs = [
        F.count(F.lit(1)).alias("n"), F.round(1 - count_if(F.col("is_empty")) / n, 3).alias("empty_rate"), share(F.col("is_empty")).alias("empty_share"), share(F.col("has_code")).alias("code_production_rate"),
        share(F.col("followed")).alias("instruction_following"), share(F.col("lang_ok")).alias("language_correct"), share(F.col("relevant")).alias("relevance_rate"), count_if(checked).alias("syntax_checked"),
        F.round(count_if(F.col("css_valid")) / F.greatest(F.lit(1), count_if(checked)), 3).alias("syntax_valid_rate"), F.round(1 - count_if(bad) / n, 3).alias("bad_marker_rate"), share(bad).alias("bad_marker_share"), F.round(F.avg("repetition"), 3).alias("mean_repetition"),
    ]
    return measured.groupBy(*by).agg(*aggs) if by else measured.agg(*aggs)


def side_by_side(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """(metric, a, b) of two one-row frames."""
    long = lambda df, to: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names])).alias("x")).select("x.metric", F.col("x.v").alias(to))
    return long(a, "a").join(long(b, "b"), "metric", "full")


def log_means(log: DataFrame, step: str, loss: str, tokens: str) -> DataFrame:
    """(step, n, tokens, mean_loss) of a training log's accumulated entries; entries without a loss count no loss."""
    return log.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(tokens, F.lit(0))).alias("tokens"), F.round(F.avg(loss), 6).alias("mean_loss"))
