"""Training material: token lists, label masks, padding, planners of generation tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import sampling

IGNORED = -100


def label_mask(prompt_ids, full_ids) -> Column:
    """Labels: ignored over the prompt, the ids over the rest; null if nothing is left to learn."""
    p, f = F.size(T.col(prompt_ids)), F.size(T.col(full_ids))
    n = F.least(p, f)
    return F.when(p < f, F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(T.col(full_ids), n + 1, f)))


def padded(ids, size, value) -> Column:
    return F.concat(T.col(ids), F.array_repeat(F.lit(value), F.greatest(F.lit(0), T.col(size) - F.size(T.col(ids)))))


def collate(rows: DataFrame, batch: str, ids: str, labels: str, pad: int) -> DataFrame:
    """Rows padded to their batch's longest, with a mask of what is real."""
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("_n"))
    out = rows.join(longest, batch)
    real = F.transform(F.col(ids), lambda _: F.lit(1))
    return out.select(*[c for c in rows.columns if c not in (ids, labels)], padded(ids, "_n", pad).alias("input_ids"), padded(labels, "_n", IGNORED).alias("labels"), padded(real, "_n", 0).alias("attention_mask"))


def budgeted_lines(rows: DataFrame, key: str | list[str], text: str, budget, cost) -> DataFrame:
    """(key, kept): leading whole lines of a text whose summed cost stays within the budget; `key` may be several columns.

    The fold keeps the number of lines only, so it is linear in their number.
    """
    keys = [key] if isinstance(key, str) else key
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"), F.lit(0).alias("n"))

    def add(acc, line):
        used = acc["used"] + cost(line).cast("long")
        fits = acc["open"] & (used <= budget)
        return F.struct(used.alias("used"), fits.alias("open"), (acc["n"] + fits.cast("int")).alias("n"))

    counted = rows.withColumn("_lines", F.split(T.col(text), "\n")).withColumn("_n", F.aggregate("_lines", start, add, lambda acc: acc["n"]))
    return counted.select(*keys, F.array_join(F.slice("_lines", F.lit(1), F.col("_n")), "\n").alias("kept"))


def truncated_answers(rows: DataFrame, key: str, text: str, budget, cost, least_share: float = 0.1, least_budget: int = 48) -> DataFrame:
    """(key, kept): `budgeted_lines` without blanks at the end and with an open code block closed.

    Null if the budget is under `least_budget`, or if what is left is empty or under `least_share` of the answer.
    `budget` may be a column: what a row's prompt leaves.
    """
    whole = F.length(T.rstrip(text))
    cuts = budgeted_lines(rows.withColumns({"_budget": T.col(budget) if isinstance(budget, (str, Column)) else F.lit(budget), "_whole": whole}), [key, "_budget", "_whole"], text, F.col("_budget"), cost)
    left = cuts.withColumn("kept", T.rstrip("kept"))
    usable = (F.col("_budget") >= least_budget) & (F.length("kept") > 0) & (F.length("kept") >= least_share * F.col("_whole"))
    return left.select(key, F.when(usable, F.when(T.odd_fences("kept"), F.concat("kept", F.lit("\n```"))).otherwise(F.col("kept"))).alias("kept"))


def plan_batches(wants: DataFrame, have: DataFrame, target: int, base: int = 2400, size: int = 4) -> DataFrame:
    """(category, batch): tasks that are missing to each category's share of the target."""
    rows = wants.join(have.groupBy("category").agg(F.count(F.lit(1)).alias("_have")), "category", "left")
    need = F.greatest(F.lit(0.0), F.least(F.col("want").cast("double"), target * F.col("want") / base) - F.coalesce("_have", F.lit(0)))
    rows = rows.withColumn("need", need).withColumn("batches", F.ceil(F.col("need") / size).cast("int")).filter("batches > 0")
    return rows.select("category", "need", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"))


def template_product(spark, domains: list[str], questions: list[str], styles: list[str], prefix: str = "bench") -> DataFrame:
    """Every domain, question and style, numbered in that order: parameters of a bounded product."""
    d, q = len(questions) * len(styles), len(styles)
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), i + 1)
    n = F.col("id").cast("int")
    rows = spark.range(len(domains) * d).select(F.format_string(f"{prefix}-%04d", n + 1).alias("id"), pick(domains, (n / d).cast("int")).alias("domain"), pick(questions, ((n % d) / q).cast("int")).alias("question"), pick(styles, n % q).alias("style"))
    return rows.withColumn("prompt", F.concat_ws(" ", "style", F.format_string("%s: %s", F.col("domain"), F.col("question"))))


def task_matrix(spark, kinds: list[tuple[str, str, int]], difficulties: list[str]) -> DataFrame:
    """(id, kind, lang, difficulty): `n` tasks for each (kind, lang, n), difficulties in turn; a bounded product of parameters."""
    rows = spark.createDataFrame([(k, x, n) for k, x, n in kinds], "kind string, lang string, n int").filter("n > 0")
    each = rows.select("kind", "lang", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    turn = F.element_at(F.array(*[F.lit(x) for x in difficulties]), F.col("i") % len(difficulties) + 1)
    return each.select(F.format_string("%s-%s-%03d", "kind", "lang", "i").alias("id"), "kind", "lang", turn.alias("difficulty"))


def prompt_cycle(spark, subjects: list[str], modes: list[str], n: int, prefix: str = "prompt") -> DataFrame:
    """(id, subject, mode) of n prompts by index: subjects in turn, and a mode that moves on with each round of subjects, so that all pairs meet."""
    i = F.col("id").cast("int")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), k + 1)
    return spark.range(n).select(F.format_string(f"{prefix}-%05d", i).alias("id"), pick(subjects, i % len(subjects)).alias("subject"), pick(modes, (F.floor(i / len(subjects)).cast("int") + i) % len(modes)).alias("mode"))


def filled_templates(rows: DataFrame, template: str, key: str, choices: dict[str, list[str]], seed: int = 4217) -> DataFrame:
    """`rows` with `text`: the template's {name} slots filled by choices picked by a hash of the seed, the slot and the key."""
    text = F.lit(template)
    for name, values in choices.items():
        at = (T.hash32(F.concat(F.lit(f"{seed}:{name}:"), F.col(key).cast("string"))) % len(values)).cast("int")
        text = F.replace(text, F.lit("{" + name + "}"), F.element_at(F.array(*[F.lit(v) for v in values]), at + 1))
    return rows.withColumn("text", text)


def derived_config(machines: DataFrame, ram: str = "ram_gb", cores: str = "cores", gpu: str = "gpu") -> DataFrame:
    """`machines` with the training settings that fit them; nulls count as 4 GB, 2 cores and no GPU."""
    memory, has_gpu = F.coalesce(F.col(ram).cast("double"), F.lit(4.0)), F.coalesce(F.col(gpu), F.lit(False))
    roomy = has_gpu | (memory >= 8)
    either = lambda a, b: F.when(roomy, a).otherwise(b)
    return machines.withColumns({
        "device": F.when(has_gpu, "cuda").otherwise("cpu"), "threads": F.greatest(F.lit(1), F.coalesce(F.col(cores).cast("int"), F.lit(2))), "max_seq_len": F.when(has_gpu | (memory >= 12), 768).when(memory >= 8, 384).otherwise(256),
        "batch_size": either(2, 1), "accumulation": either(4, 8), "lora_r": either(16, 12), "lora_alpha": either(32, 24), "learning_rate": either(1.5e-4, 1.2e-4),
    })


def fitting_config(configs: DataFrame, memory_limit: float = 14.5, fallback: int = 2048) -> DataFrame:
    """(seq_len): the longest measured length without an error and within the memory limit, else the fallback."""
    fits = F.max(F.when(F.col("error").isNull() & (F.col("memory_gb") < memory_limit), F.col("seq_len")))
    return configs.agg(F.coalesce(fits, F.lit(fallback)).alias("seq_len"))


def in_turn(rows: DataFrame, order: list, items: DataFrame, item_order: list) -> DataFrame:
    """`rows` beside `items` by place: row k gets item k modulo their number, in the given orders.

    Both sides are numbered without a task for all rows; a place that more rows share than others don't is not
    possible, as places take turns. Names of the two sides must differ. No items: no rows.
    """
    n = items.count()
    if not n:
        return rows.join(items, F.lit(False))
    own = sampling.ranked(rows, order).withColumn("_place", (F.col("rank") - 1) % n).drop("rank")
    return own.join(sampling.ranked(items, item_order).withColumn("_place", F.col("rank") - 1).drop("rank"), "_place").drop("_place")


def zipped(a: DataFrame, a_order: list, b: DataFrame, b_order: list) -> DataFrame:
    """Two tables side by side by place; the longer one's rest is left out."""
    return sampling.ranked(a, a_order).join(sampling.ranked(b, b_order), "rank").drop("rank")


def config_hash(names: list[str]) -> Column:
    """SHA-256 of a row's columns as JSON with sorted keys; null columns are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)
