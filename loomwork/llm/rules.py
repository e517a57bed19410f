"""Quality rules with risk-controlled thresholds, in DataFrame and SQL functions only.

Base counts are fixed by contract. On top of them each rule rejects documents whose statistic exceeds a
cutoff, and each cutoff is selected per stratum (language) on labelled holdouts: of the cutoffs fixed
beforehand, the tightest for which the exact binomial (Clopper-Pearson) upper bound on the share of good
documents that it rejects is at most RISK over the number of rules. Tests go from the loosest cutoff to the
tightest and stop at the first that fails (fixed-sequence testing), at level DELTA over the number of strata
and rules (Bonferroni). So with probability 1 - DELTA no stratum loses more than RISK of its good documents to
the rules. A rule without a passing cutoff is off in its stratum, as in strata without labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_col, words_col

RISK = 0.08
DELTA = 0.05
#: Strata whose cutoffs are broadcast; those of more are joined otherwise, with the same result.
FEW_STRATA = 10_000
#: Each rule's statistic and its cutoffs, loosest first; a document above the cutoff is rejected.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12]),
    "shouting": ("n_marks / greatest(n_words, 1)", [1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2]),
}
_GAPS = " \t\n\x0b\x0c\r"


def counts(docs: DataFrame, id_col: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """Base counts of every row, all from expressions over the row itself: no shuffle.

    Repeated windows of three words are found by their 64-bit hashes within one document: sorted hashes tell
    whether there are any; only then are the windows sorted with their positions and the covered words counted.
    Null texts have no words. Repeated rows give as many rows, null ids and strata stay null, an empty table gives
    none. A long text takes a few arrays as long as its words. Other columns, whatever their names, are left out.
    """
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), text_col().alias("_t"))
    t = t.withColumn("_w", words_col(F.col("_t"))).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.trim(F.translate(x, _GAPS, "      ")) != ""))
    t = t.select(
        "doc_id", "stratum", F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", _GAPS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", "!?", ""))).cast("long").alias("n_marks"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    t = t.withColumn("_k", F.when(F.col("n_words") >= 3, F.expr("transform(sequence(0, size(_h) - 3), i -> xxhash64(get(_h, i), get(_h, i + 1), get(_h, i + 2)))")).otherwise(F.expr("cast(array() as array<bigint>)"))).drop("_h")
    t = t.withColumn("_dup", F.expr("size(array_distinct(_k)) < size(_k)"))
    t = t.withColumn("_s", F.when(F.col("_dup"), F.expr("sort_array(transform(_k, (k, i) -> struct(k, i)))")))
    t = t.withColumn("_p", F.when(F.col("_dup"), F.expr("transform(filter(_s, (x, j) -> x.k <=> get(_s, j - 1).k or x.k <=> get(_s, j + 1).k), x -> x.i)")))
    covered = F.when(F.col("_dup"), F.expr("size(array_distinct(flatten(transform(_p, p -> array(p, p + 1, p + 2)))))")).otherwise(0).cast("long")
    t = t.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))
    # a table of its own, or filters on the counts would be pushed into the lambdas
    return cut(t.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "rule-counts")


def _log_gamma(x):
    """Logarithm of the gamma function for x >= 1, by Stirling's series from x + 10 down; to some 12 digits."""
    y = x + 10.0
    high = (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    steps = F.log(x)
    for k in range(1, 10):
        steps = steps + F.log(x + k)
    return high - steps


def _passes(k, n, risk: float, level):
    """Whether the exact binomial upper bound at the level is at most the risk: P(X <= k) <= level for X ~ Bin(n, risk).

    Below n * risk the tail's terms fall from k down, as those of a normal law of the same spread do at least; so they
    are summed from k over ten spreads, beyond which they are below the sum's last digit at any size.
    """
    odds, k, n = (1 - risk) / risk, k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(risk)) + (n - k) * F.log(F.lit(1 - risk))
    reach = F.least(k, F.ceil(F.sqrt(n * (risk * (1 - risk))) * 10 + 40))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc, i):
        t = acc["t"] * (k - i + 1) / (n - k + i) * odds
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    below = (n > 0) & (k < n * risk)
    steps = F.when(below & (k > 0), F.sequence(F.lit(1), reach.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    tail = top + F.log(F.aggregate(steps, start, add, lambda acc: acc["s"]))
    return F.when(~below, False).otherwise(tail <= F.log(level))


def cutoffs(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) of the rules that are on, of every stratum with labels.

    A label that is null counts for nothing; of several labels of a document the best does. A document that several
    rows repeat counts once in a stratum, as rejected where any of its rows is.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = features.filter("not base_failed").join(good, "doc_id")
    held = held.groupBy("stratum", "doc_id").agg(*[F.max(F.expr(expr)).alias(f"_{rule}") for rule, (expr, _) in RULES.items()])
    tests = [F.sum((F.col(f"_{rule}") > c).cast("long")).alias(f"{rule}@{i}") for rule, (_, grid) in RULES.items() for i, c in enumerate(grid)]
    sums = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *tests)
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{rule}@{i}").alias("k")) for rule, (_, grid) in RULES.items() for i, c in enumerate(grid)])
    strata = sums.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    rows = sums.select("stratum", "n", F.explode(each).alias("x")).crossJoin(F.broadcast(strata)).select("stratum", "n", "x.*", "strata")  # one row, an ungrouped aggregate
    tried = rows.withColumn("ok", _passes(F.col("k"), F.col("n"), risk / len(RULES), F.lit(delta) / len(RULES) / F.col("strata")))
    # loosest first, up to the first failure
    failed = tried.filter("not ok").groupBy("stratum", "rule").agg(F.max("cutoff").alias("stop"))
    kept = tried.join(failed, ["stratum", "rule"], "left").filter("ok and (stop is null or cutoff > stop)")
    return kept.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(features: DataFrame, chosen: DataFrame) -> DataFrame:
    """`features` with `kept`: not failed by the base and above no cutoff of its stratum.

    Null strata and strata without labels have no rules, so the base alone decides there. Rows that repeat a document
    are judged each by itself, also with a null doc_id; an empty table gives no rows. Texts aren't read any more, so
    their length doesn't matter; columns of `features` keep their values.
    """
    wide = cut(chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES]), "rule-cutoffs")
    few = wide.count() <= FEW_STRATA
    rows = features.join(F.broadcast(wide) if few else wide, "stratum", "left")
    over = [F.coalesce(F.expr(expr) > F.col(f"_{r}"), F.lit(False)) for r, (expr, _) in RULES.items()]
    bad = F.col("base_failed")
    for o in over:
        bad = bad | o
    return rows.withColumn("kept", ~bad).drop(*[f"_{r}" for r in RULES])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    features = counts(table(spark, sf_dir, "documents"))
    got = judged(features, cutoffs(features, table(spark, sf_dir, "labels")))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
