"""Conversations: assembly, structure, filters with the first failing reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions import udfs as U
from ..tables import cut
from . import dedup, sampling


def assemble(turns: DataFrame) -> DataFrame:
    """(conv_id, messages, turns) from one row per message, in the order of turns."""
    item = F.struct(F.col("turn"), F.col("role"), F.col("text").alias("content"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("_m"))
    return rows.select("conv_id", F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"), F.size("_m").alias("turns"))


def joined(messages, role: str) -> Column:
    """A role's contents, joined by one blank."""
    return F.array_join(F.transform(F.filter(T.col(messages), lambda m: m["role"] == role), lambda m: F.coalesce(m["content"], F.lit(""))), " ")


def first_of(messages, role: str) -> Column:
    return F.get(F.filter(T.col(messages), lambda m: m["role"] == role), F.lit(0))["content"]


def roles_alternate(messages) -> Column:
    """From user to assistant without two equal roles in a row."""
    roles = F.transform(T.col(messages), lambda m: m["role"])
    adjacent = F.exists(F.zip_with(roles, F.slice(roles, 2, F.greatest(F.size(roles), F.lit(1))), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))
    return F.coalesce((F.element_at(roles, 1) == "user") & (F.element_at(roles, -1) == "assistant") & ~adjacent, F.lit(False))


def message_fault(messages) -> Column:
    """The first fault of the first faulty message: malformed, empty_content, corrupted_unicode; else null."""
    fault = lambda m: F.when(m["content"].isNull(), "malformed").when(T.strip(m["content"]) == "", "empty_content").when(F.contains(m["content"], F.lit("�")) | (T.corruption(m["content"]) > 0.02), "corrupted_unicode")
    return F.get(F.filter(F.transform(T.col(messages), fault), lambda x: x.isNotNull()), F.lit(0))


def with_reason(convs: DataFrame, limits: dict | None = None) -> DataFrame:
    """`convs` with `reason`: ok, or the first rule of large-corpus preparation that fails. Fewer than one message: bad_role_structure."""
    cfg = C.LIMITS | (limits or {})
    rows = convs.withColumns({"_asst": joined("messages", "assistant"), "_user": joined("messages", "user"), "_fault": message_fault("messages")})
    rows = rows.withColumn("_w", T.words("_asst"))
    a, u, n = F.length("_asst"), F.length("_user"), F.size("_w")
    reason = (
        F.when(~roles_alternate("messages"), "bad_role_structure").when(F.col("_fault").isNotNull(), F.col("_fault")).when(T.conversation_language("messages") == "ar", "arabic_language")
        .when(a < cfg["min_answer_chars"], "answer_too_short").when(u < cfg["min_prompt_chars"], "prompt_too_short").when(a > cfg["max_answer_chars"], "too_long").when((a + u) / 2.0 > cfg["max_seq_len"] * 0.9, "too_long")
        .when(T.repetition(F.col("_w"), 3, 5) > 0.45, "repetitive").when(T.repeats_at_least(F.col("_w"), 12, 3), "repetitive").when((n > 40) & (T.unique_ratio(F.col("_w")) < 0.12), "low_lexical_diversity")
        .when(F.col("_asst").rlike(C.PREP_PLACEHOLDER), "placeholder_artifact").when(T.unfinished("_asst"), "unfinished").when(T.odd_fences("_asst"), "unfinished_code_fence").when(T.secret("_asst") | T.secret("_user"), "secret_like").otherwise("ok")
    )
    return rows.withColumn("reason", reason).drop("_asst", "_user", "_fault", "_w")


def with_small_reason(convs: DataFrame, system_prefix: str) -> DataFrame:
    """`convs` with `reason` by the small corpus's rules, over the first user and the first assistant message."""
    rows = convs.withColumns({"_u": first_of("messages", "user"), "_a": first_of("messages", "assistant")}).withColumn("_w", T.words(F.coalesce("_a", F.lit(""))))
    first = F.get("messages", F.lit(0))
    empty = F.exists("messages", lambda m: m["content"].isNull() | (F.length(T.strip(m["content"])) < 5))
    patterns = C.SECRETS[:-1]
    reason = (
        F.when(F.col("messages").isNull() | (F.size("messages") < 2), "bad_messages").when((first["role"] == "system") & ~F.coalesce(first["content"].startswith(system_prefix), F.lit(False)), "foreign_system")
        .when(~F.exists("messages", lambda m: m["role"] == "user") | ~F.exists("messages", lambda m: m["role"] == "assistant"), "missing_roles").when(empty, "empty_content").when(F.length("_a") < 40, "answer_too_short")
        .when((F.length("_u") > 4000) | (F.length("_a") > 24000), "too_long").when(T.repetition(F.col("_w")) > 0.45, "repetitive").when(T.secret("_a", patterns) | T.secret("_u", patterns), "secret_like").otherwise("ok")
    )
    return rows.withColumn("reason", reason).drop("_u", "_a", "_w")


def language_fits(lang, prompt) -> Column:
    ratio = T.arabic_block_ratio(prompt)
    return F.when(T.col(lang) == "fa", ratio >= 0.12).when(F.coalesce(T.col(lang), F.lit("en")) == "en", ratio <= 0.45).otherwise(True)


def strict_conversation(messages) -> Column:
    """User and assistant by turns, with at least 4 and 40 characters."""
    want = lambda m, i: F.coalesce((m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")) & (F.length(T.strip(m["content"])) >= F.when(i % 2 == 0, 4).otherwise(40)), F.lit(False))
    m = T.col(messages)
    return (F.size(m) >= 2) & (F.size(m) % 2 == 0) & F.forall(F.transform(m, want), lambda x: x)


def valid_schema(messages) -> Column:
    m = T.col(messages)
    return F.coalesce((F.size(m) > 0) & F.forall(m, lambda x: x["role"].isin("system", "user", "assistant") & (T.strip(x["content"]) != "")), F.lit(False))


def last_messages(messages, n: int) -> Column:
    m = T.col(messages)
    return F.slice(m, F.greatest(F.lit(1), F.size(m) - n + 1), F.lit(n))


def normalize(convs: DataFrame, fn, key: str = "conv_id") -> DataFrame:
    """Applies a text UDF or expression to each content, by message rows, and assembles again; missing contents become empty.

    Rows are told apart by `key`, and the other columns stay beside it. Conversations without messages stay as they are.
    """
    rows = convs.filter(F.size("messages") > 0).select(key, F.posexplode("messages").alias("turn", "m")).select(key, "turn", F.col("m.role").alias("role"), fn(F.coalesce("m.content", F.lit(""))).alias("content"))
    again = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("_m"))
    new = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    out = convs.join(again.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    return out.withColumn("messages", F.coalesce(new, "messages")).drop("_m")


def preparation(convs: DataFrame, target: int, domain: str = "domain", seed: int = 42, val_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The large-corpus job: (picked conversations with score and split, one row of stats) of conversations (conv_id, messages, domain).

    Conversations of fewer than two messages are malformed and of no domain. The others are normalized but for code,
    links and the like, filtered by the first failing reason, freed of exact and near duplicates; those of several
    turns (pairs of messages, `turns`) are kept, and the best others of each domain up to the target; all are dealt to
    the splits. Every number of the stats is counted by itself, so they check each other: n_raw = n_rejected + n_exact
    + n_near + n_kept, and n_picked = n_train + n_validation.
    """
    whole = F.coalesce(F.size("messages") >= 2, F.lit(False))
    usable = convs.filter(whole).withColumn("turns", F.floor(F.size("messages") / 2).cast("int"))
    judged = cut(with_reason(normalize(usable, U.normalize_text)), "prep-judged")
    ok = judged.filter("reason = 'ok'")
    unique = cut(dedup.exact(ok), "prep-exact")
    copies = ok.groupBy(F.md5(F.to_json("messages"))).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_exact"))
    said = F.concat_ws(" ", F.transform("messages", lambda m: m["content"]))
    groups = cut(dedup.min_shingle(unique.withColumn("_t", said), "_t", "conv_id", 60).drop("_t"), "prep-near")
    kept = groups.filter("conv_id = group").drop("group").withColumns({"_a": joined("messages", "assistant"), "_u": joined("messages", "user")}).withColumn("_w", T.words("_a"))
    scored = cut(kept.withColumn("score", T.quality_rank("_a", "_u", "turns", F.col("_w"))).drop("_a", "_u", "_w"), "prep-scored")
    domains = usable.select(domain).distinct().count()
    picked = cut(sampling.hash_split(sampling.balanced(scored, target, domain, "turns", "score", "conv_id", domains), "conv_id", seed, val_share), "prep-picked")
    n = lambda c, to: F.coalesce(F.sum(F.coalesce(c.cast("long"), F.lit(0))), F.lit(0)).alias(to)
    one = F.lit(1)
    parts = [
        convs.agg(n(one, "n_raw"), n(~whole, "_malformed")), judged.agg(n(F.col("reason") != "ok", "_failed")), copies, groups.agg(n(F.col("conv_id") != F.col("group"), "n_near")), scored.agg(n(one, "n_kept")),
        picked.agg(n(one, "n_picked"), n(F.col("split") == "train", "n_train"), n(F.col("split") == "validation", "n_validation"), n(F.col("turns") > 1, "n_multi")),
    ]
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.crossJoin(F.broadcast(p))  # one row each, ungrouped aggregates
    return picked, stats.withColumn("n_rejected", F.col("_malformed") + F.col("_failed")).drop("_malformed", "_failed")
