"""The library's operators applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions import udfs as U
from ..operators import conversations as V
from ..operators import dedup, materialize, metrics, sampling
from ..shipping import tune
from ..sources import readers, sinks
from ..sources.readers import spread
from ..streaming import prep
from ..tables import cut, fresh_dir

SYSTEM_PREFIX = "You are"
Q: dict = {}


def query(f):
    """Registers a query; integers come out as longs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        df = f(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes])

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    Q[f.__name__] = run
    return run


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d):
    return spread(t(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))))


def convs(spark, d):
    return V.assemble(t(spark, d, "conversations"))


def pairs(spark, d):
    """A user's message and the assistant's that follows it at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return rows.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"), F.coalesce("answer", F.lit("")).alias("answer"))


@query
def reason_counts(s, d):
    """P1, A1"""
    return V.with_reason(convs(s, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def conversation_reasons(s, d):
    """P1, P4, W6"""
    return V.with_reason(convs(s, d)).select("conv_id", "turns", "reason")


@query
def small_corpus_reasons(s, d):
    """P2, P3"""
    return V.with_small_reason(convs(s, d), SYSTEM_PREFIX).select("conv_id", "reason", V.language_fits(F.lit("en"), F.coalesce(V.first_of("messages", "user"), F.lit(""))).alias("language_fits"))


@query
def conversation_structure(s, d):
    """P10, P12, W8"""
    return convs(s, d).select("conv_id", V.strict_conversation("messages").alias("strict"), V.valid_schema("messages").alias("valid"), F.md5(F.array_join(F.transform(V.last_messages("messages", 6), lambda m: m["content"]), "|")).alias("history_md5"))


@query
def exact_dedup_conversations(s, d):
    """W1"""
    return dedup.exact(convs(s, d)).select("conv_id", "turns")


@query
def exact_dedup_documents(s, d):
    """W1 over texts"""
    return dedup.keep_first(docs(s, d), F.col("text"), ["doc_id"]).select("doc_id", "source")


@query
def prompt_key_dedup(s, d):
    """W3"""
    rows = pairs(s, d)
    return dedup.keep_first(rows, T.prompt_key("prompt"), ["conv_id", "turn"]).select("conv_id", "turn")


@query
def prompt_answer_dedup(s, d):
    """W2, F6"""
    fold = lambda c: F.lower(T.strip(F.regexp_replace(c, T.SPACE, " ")))
    return dedup.by_prompt_and_answer(pairs(s, d), "prompt", "answer", fold, ["conv_id", "turn"]).select("conv_id", "turn")


@query
def near_dedup_min_shingle(s, d):
    """J4, J5, A14, F19, F20, W4 in the compatible mode"""
    return dedup.min_shingle(docs(s, d), "text", "doc_id", 60).select("doc_id", F.col("group").alias("group_id"))


@query
def minhash_signatures(s, d):
    """A14 over many permutations"""
    rows = docs(s, d).withColumn("_w", T.words("text")).withColumn("_s", F.transform(T.shingles(F.col("_w")), lambda x: T.hash32(x)))
    return rows.select("doc_id", F.md5(F.array_join(dedup.minhash_signature("_s"), ",")).alias("md5"))


@query
def similar_shingle_pairs(s, d):
    """J4, U4 in full: pairs of different shingle sets, by the smallest documents with them"""
    return dedup.similar_pairs(docs(s, d), "text", "doc_id").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query
def shingle_classes(s, d):
    """The class of each document, for the pairs of classes"""
    return dedup.shingle_classes(docs(s, d), "text", "doc_id", ["doc_id"]).select("doc_id", F.col("class").alias("class_id"))


@query
def document_text_measures(s, d):
    """F7, F8, F9, A10, A15, W9"""
    rows = docs(s, d).withColumn("_w", T.words("text")).withColumn("_rep", T.repetition(F.col("_w"), 3, 5))
    return rows.select("doc_id", F.round("_rep", 6).alias("rep5"), F.round(F.when(F.size("_w") < 12, 0.0).otherwise(F.col("_rep")), 6).alias("rep12"), T.max_gram_repeat(F.col("_w")).alias("max_gram"), F.round(T.unique_ratio(F.col("_w")), 6).alias("uniq"))


@query
def document_script_measures(s, d):
    """F4, F10, F16, F31"""
    return docs(s, d).select("doc_id", F.round(T.arabic_block_ratio("text"), 6).alias("arabic"), F.round(T.latin_ratio("text"), 6).alias("latin"), F.round(T.corruption("text"), 6).alias("corruption"), T.arabic_only_letters("text").alias("arabic_only"), F.round(F.length("text") / 2.0, 1).alias("est_tokens"))


@query
def document_languages(s, d):
    """F11, F13, F15"""
    rows = docs(s, d).withColumn("_t", T.token_language("text"))
    return rows.select("doc_id", T.substring_language("text").alias("by_substrings"), F.col("_t.lang").alias("by_tokens"), F.col("_t.conf").alias("conf"), T.response_language("text", F.col("_t")).alias("response"))


@query
def conversation_languages(s, d):
    """F12"""
    return convs(s, d).select("conv_id", T.conversation_language("messages").alias("lang"))


@query
def document_flags(s, d):
    """P5-P9"""
    return docs(s, d).select("doc_id", T.secret("text").alias("secret"), F.col("text").rlike(C.PREP_PLACEHOLDER).alias("placeholder"), T.unfinished("text").alias("unfinished"), T.odd_fences("text").alias("odd_fences"), T.malformed("text").alias("malformed"))


@query
def normalized_segments(s, d):
    """F2"""
    return docs(s, d).select("doc_id", F.md5(T.normalize_segment("text")).alias("md5"))


@query
def normalized_texts(s, d):
    """each text with a line of Arabic letters, some within inline code"""
    text = F.concat("text", F.lit("\nكتاب ي "), F.col("doc_id").cast("string"), F.lit(" `ي ك`"))
    return docs(s, d).select("doc_id", F.md5(U.normalize_text(text)).alias("md5"))


@query
def normalized_conversations(s, d):
    """F5"""
    arabic = convs(s, d).withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit(" ي")).alias("content"))))
    return V.normalize(arabic, U.normalize_text).select("conv_id", "turns", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("md5"))


@query
def folded_texts(s, d):
    """F6 with NFKC"""
    return docs(s, d).select("doc_id", F.md5(U.fold_text("text")).alias("md5"))


@query
def split_conversations(s, d):
    """O3"""
    return sampling.hash_split(convs(s, d), "conv_id").select("conv_id", T.split_bucket(42, "conv_id").alias("bucket"), "split")


@query
def sliced_split(s, d):
    """O5, O4"""
    return sampling.slice_split(docs(s, d), "doc_id").select("doc_id", "split")


def scored_docs(s, d):
    rows = docs(s, d).withColumns({"_user": F.element_at(F.split("text", "\n"), 1), "_w": T.words("text"), "turns": F.when(F.col("doc_id") % 10 == 0, 3).otherwise(1)})
    return rows.withColumn("score", F.round(T.quality_rank("text", "_user", "turns", F.col("_w")), 6)).select("doc_id", "source", "turns", "score")


@query
def quality_ranks(s, d):
    """F17"""
    return scored_docs(s, d)


@query
def best_per_source(s, d):
    """W5, O1"""
    return sampling.top_per_group(scored_docs(s, d), "source", [F.desc("score"), "doc_id"], 20)


@query
def balanced_sample(s, d):
    """A target of 400 rows"""
    return sampling.balanced(scored_docs(s, d), 400, "source", "turns", "score", "doc_id")


@query
def length_statistics(s, d):
    """A4"""
    return sampling.nearest_rank(docs(s, d).select(F.length("text").alias("n")), "n")


@query
def distributions(s, d):
    """A2, A3, A5: one pass for languages, sources and both"""
    rows = docs(s, d)
    return rows.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def length_batches(s, d):
    """O6"""
    return sampling.length_batches(docs(s, d).select("doc_id", F.length("text").alias("n")), "n", "doc_id", 16).select("doc_id", "batch", "batch_order")


@query
def shortest_documents(s, d):
    """O11"""
    return sampling.shortest(docs(s, d).select("doc_id", F.length("text").alias("n")), "n", "doc_id", 24)


@query
def round_robin_pick(s, d):
    """W7"""
    return sampling.round_robin(docs(s, d), F.regexp_replace("source", "-?[0-9]+$", ""), "doc_id", 50).select("doc_id", "source")


def responses(s, d):
    bench = t(s, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.element_at(F.array(F.lit("fa"), F.lit("ar"), F.lit("en")), (F.col("item_id") % 3 + 1).cast("int")).alias("expect_lang"), F.concat(F.lit("c"), (F.col("item_id") % 4).cast("string")).alias("category"))
    return metrics.judged_responses(docs(s, d).select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), F.col("text").alias("response")), bench)


@query
def benchmark_metrics(s, d):
    """J1, P14, A6, F36"""
    return metrics.benchmark_metrics(responses(s, d))


@query
def benchmark_by_category(s, d):
    """A7"""
    return metrics.by_category(responses(s, d))


@query
def misclassified_examples(s, d):
    """O8, P20"""
    return metrics.misclassified(responses(s, d), "seq")


def measured(s, d):
    return metrics.answer_measures(pairs(s, d).withColumn("expect", F.lit("en")), "answer", "prompt", "expect")


@query
def answer_measures(s, d):
    """P15-P19, F22, F25"""
    return measured(s, d).select("conv_id", "turn", "answer_chars", "has_code", "is_empty", "repetition", F.size("bad_markers").alias("n_bad_markers"), "lang_ok", "relevance_hits", "relevant", "followed")


@query
def answer_summary(s, d):
    """A8, A13"""
    return metrics.answer_summary(measured(s, d))


@query
def running_answer_counts(s, d):
    """Running counts in the order of turns within each conversation"""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return measured(s, d).select("conv_id", "turn", F.count(F.lit(1)).over(w).alias("n"), F.sum(F.col("relevant").cast("long")).over(w).alias("relevant"))


@query
def side_by_side(s, d):
    """Answers against prompts"""
    a = metrics.answer_summary(measured(s, d))
    b = metrics.answer_summary(metrics.answer_measures(pairs(s, d).withColumn("expect", F.lit("en")), "prompt", "prompt", "expect"))
    return metrics.side_by_side(a, b, ["n", "empty_share", "relevance_rate", "mean_repetition"])


@query
def html_balance(s, d):
    """F24, F27, V1"""
    return t(s, d, "pages").select("page_id", U.html_error("html").alias("fault"))


@query
def chat_templates(s, d):
    """F32"""
    return convs(s, d).select("conv_id", F.md5(T.chat_prompt("messages")).alias("md5"), F.length(T.chat_prompt(F.slice("messages", 1, F.greatest(F.lit(1), F.col("turns") - 1)), True)).alias("prompt_chars"))


@query
def label_masks(s, d):
    """F34, F35 over word lengths as ids, in batches of 16 by length"""
    rows = docs(s, d).select("doc_id", F.length("text").alias("n"), F.transform(T.words("text"), lambda w: F.length(w)).alias("ids"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "label-ids")
    # batches are dealt without the ids: the range of the longest texts would hold most of them
    batches = sampling.length_batches(rows.select("row", "doc_id", "n"), "n", "doc_id", 16).select("row", "batch")
    rows = rows.join(batches, "row").withColumn("mask", materialize.label_mask(F.slice("ids", 1, 5), "ids")).filter("mask is not null")
    out = materialize.collate(rows.select("doc_id", "batch", "ids", "mask"), "batch", "ids", "mask", 0)
    return out.select("doc_id", "batch", F.size("input_ids").alias("width"), F.size(F.filter("labels", lambda x: x == materialize.IGNORED)).alias("ignored"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("real"))


@query
def budgeted_answers(s, d):
    """W10, F33"""
    return materialize.budgeted_lines(docs(s, d), "doc_id", "text", 500, lambda line: F.length(line) + 1).select("doc_id", F.length("kept").alias("kept_chars"))


@query
def planned_batches(s, d):
    """G1, A11"""
    rows = docs(s, d).select(F.col("source").alias("category"))
    wants = rows.distinct().withColumn("want", F.lit(600))
    return materialize.plan_batches(wants, rows, 2400)


@query
def template_product(s, d):
    """G5, J6, F40"""
    return materialize.template_product(s, ["history", "science", "poetry"], ["what", "why", "how"], ["Briefly,", "In detail,"])


@query
def unlabelled_documents(s, d):
    """J3, S13"""
    return docs(s, d).select("doc_id", "source").join(t(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query
def corpus_union(s, d):
    """Documents and conversations as one bag, by origin"""
    a = docs(s, d).select(F.lit("document").alias("origin"), "text")
    b = t(s, d, "conversations").select(F.lit("conversation").alias("origin"), "text")
    return a.unionByName(b).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def task_matrix(s, d):
    """Tasks by kind and language, difficulties in turn"""
    return materialize.task_matrix(s, [("page", "fa", 110), ("page", "en", 130), ("style", "fa", 90), ("script", "en", 40)], ["easy", "medium", "hard"])


@query
def prompt_cycle(s, d):
    """G6, J7 over parameters"""
    return materialize.prompt_cycle(s, ["table", "form", "menu", "card", "chart"], ["write", "fix", "explain", "extend"], 110)


@query
def filled_templates(s, d):
    """A text for each document, filled by hashed choices"""
    choices = {"colour": ["red", "green", "blue"], "part": ["header", "footer"], "kind": ["page", "form", "table", "menu", "card"]}
    return materialize.filled_templates(docs(s, d).select("doc_id"), "A {colour} {kind} with a {part}.", "doc_id", choices)


@query
def prompts_in_turn(s, d):
    """Benchmark items go round over the documents"""
    items = t(s, d, "benchmark").select("item_id")
    return materialize.in_turn(docs(s, d).select("doc_id"), [F.col("doc_id")], items, [F.col("item_id")]).select("doc_id", "item_id")


@query
def prompts_zipped(s, d):
    """Benchmark items and documents side by side by place"""
    items = t(s, d, "benchmark").select("item_id")
    return materialize.zipped(items, [F.col("item_id")], docs(s, d).select("doc_id"), [F.col("doc_id")]).select("item_id", "doc_id")


def answers_with_files(s, d):
    """Answers that hold each document's text as a page, a style sheet and a block that isn't a file."""
    page = F.translate("text", "`*", "")
    return docs(s, d).select("doc_id", F.concat(F.lit("Files: **pages/"), "source", F.lit(".html**\n```html\n"), page, F.lit("\n```\nand\n```css\nbody { margin: 0 }\n```\n```text\nnotes\n```\n```sql\nSELECT 1\n```\n")).alias("answer"))


@query
def extracted_files(s, d):
    """F23"""
    return answers_with_files(s, d).select("doc_id", F.explode(T.files("answer")).alias("f")).select("doc_id", "f.path", F.md5(T.strip("f.code")).alias("md5"))


def noisy_json(s, d):
    """Two objects in a fence with words around it; every third array is cut off inside a third object."""
    one = F.format_string('{"id": %d, "lang": "%s", "mark": "} ] {"}', "doc_id", "lang")
    two = F.format_string('{"source": "%s", "more": {"n": [1, 2]}}', "source")
    end = F.when(F.col("doc_id") % 3 == 0, F.lit(', {"id": 7, "text": "cut')).otherwise(F.lit("]\n```\nDone."))
    return docs(s, d).select("doc_id", F.concat(F.lit("Here it is:\n```json\n["), one, F.lit(", "), two, end).alias("answer"))


@query
def salvaged_json(s, d):
    """F28, F29, F30"""
    return noisy_json(s, d).select("doc_id", F.posexplode(U.salvage_json("answer")).alias("place", "object"))


@query
def learning_rates(s, d):
    """warm-up and cosine over the batches of the documents"""
    n = -(-t(s, d, "documents").count() // 16)
    return s.range(n).select(F.col("id").alias("step"), F.round(1e6 * T.learning_rate("id", 4, n, 2e-4), 6).alias("micro_rate"))


@query
def long_enough_pairs(s, d):
    """P11"""
    return pairs(s, d).filter((F.length("prompt") >= 10) & (F.length("answer") >= 40)).select("conv_id", "turn")


@query
def training_log(s, d):
    """A12 over events as log entries"""
    log = t(s, d, "events").select(F.floor(F.col("event_id") / 64).alias("step"), F.col("value").alias("loss"), F.length("props").cast("long").alias("tokens"))
    return metrics.log_means(log, "step", "loss", "tokens")


@query
def split_presence(s, d):
    """P13"""
    return sampling.presence(sampling.hash_split(convs(s, d), "conv_id"), "split", ["train", "validation", "test"])


@query
def budgeted_sample(s, d):
    """O9, O7"""
    return sampling.within_budget(docs(s, d).select("doc_id", "source"), "doc_id", 120)


@query
def config_hashes(s, d):
    """V4 over the figures of each source"""
    rows = docs(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("last"))
    return rows.select("source", materialize.config_hash(["source", "rows", "last"]).alias("sha256"))


@query
def fitting_configs(s, d):
    """Measured lengths that fit, from the sizes of nations"""
    k = F.col("n_nationkey")
    runs = t(s, d, "nation").select((512 * (k + 1)).cast("int").alias("seq_len"), (k * 0.75 + 3).cast("double").alias("memory_gb"), F.when(k % 5 == 0, "out of memory").alias("error"))
    return materialize.fitting_config(runs)


@query
def labelled_documents(s, d):
    """Ids in both tables"""
    return t(s, d, "documents").select("doc_id").intersect(t(s, d, "labels").select("doc_id"))


@query
def streamed_turns(s, d):
    """T1, F2, F8, P5, O3 on a file stream, run to its end"""
    base, path = stream_paths(s, f"{d}/conversations.parquet")
    schema = ", ".join(f"{n} {k}" for n, k in t(s, d, "conversations").dtypes)
    rows = prep.prepared(prep.turns(s, path, schema)).select("conv_id", "turn", F.md5("content").alias("md5"), F.round("repetition", 6).alias("repetition"), "secret", "split")
    prep.run_to_end(rows, f"{base}/out", f"{base}/state")
    return s.read.parquet(f"{base}/out")


@query
def lsh_near_duplicates(s, d):
    """Signatures, bands, verified pairs and their closure"""
    return dedup.lsh_groups(docs(s, d).select("doc_id", "text"), "text", "doc_id").select("doc_id", F.col("group").alias("group_id"))


@query
def truncated_answers(s, d):
    """whole lines within 500 characters, a tenth of the text at least"""
    return materialize.truncated_answers(docs(s, d), "doc_id", "text", 500, lambda line: F.length(line) + 1).select("doc_id", F.md5("kept").alias("md5"))


def domain_convs(s, d):
    return convs(s, d).withColumn("domain", F.concat(F.lit("d"), (F.col("conv_id") % 5).cast("string")))


@query
def preparation_stats(s, d):
    """A5, 3.1: the large-corpus job's totals, each counted by itself, and whether they add up"""
    stats = V.preparation(domain_convs(s, d), 40)[1]
    gap, split_gap = F.expr("n_raw - n_rejected - n_exact - n_near - n_kept"), F.expr("n_picked - n_train - n_validation")
    return stats.select("n_raw", "n_rejected", "n_exact", "n_near", "n_kept", "n_picked", "n_multi", "n_validation", gap.alias("gap"), split_gap.alias("split_gap"))


@query
def preparation_picked(s, d):
    """3.1: the conversations that the large-corpus job picks, with what they are ranked by and their split"""
    return V.preparation(domain_convs(s, d), 40)[0].select("conv_id", "turns", "domain", F.round("score", 6).alias("score"), "split")


@query
def split_distributions(s, d):
    """A2, A3: turns, domains and languages of the train split"""
    rows = sampling.hash_split(domain_convs(s, d), "conv_id").filter("split = 'train'").withColumn("lang", T.conversation_language("messages"))
    return rows.groupingSets([["turns"], ["domain"], ["lang"]], "turns", "domain", "lang").agg(F.count(F.lit(1)).alias("n"))


@query
def cut_answers(s, d):
    """P20: prompts and answers as reports show them"""
    rows = metrics.projected(pairs(s, d), {"prompt": 120, "answer": 1200})
    return rows.select("conv_id", "turn", "prompt", "answer")


@query
def languages_with_model(s, d):
    """a model's guess by source, decided with the words below a confidence of 0.75"""
    guess = F.when(F.col("doc_id") % 4 > 0, F.struct(F.element_at(F.array(F.lit("__label__en"), F.lit("fa"), F.lit("de")), (F.col("doc_id") % 3 + 1).cast("int")).alias("label"), (F.col("doc_id") % 10 / 10).alias("conf")))
    rows = docs(s, d).withColumn("_g", guess).withColumn("_x", T.with_model("text", "_g"))
    return rows.select("doc_id", F.col("_x.lang").alias("lang"), F.round("_x.conf", 6).alias("conf"))


@query
def derived_configs(s, d):
    """F39 over machines made of nations"""
    k = F.col("n_nationkey")
    rows = t(s, d, "nation").select("n_nationkey", (k * 0.75).alias("ram_gb"), (k % 9).cast("int").alias("cores"), (k % 7 == 0).alias("gpu"))
    return materialize.derived_config(rows).select("n_nationkey", "device", "threads", "max_seq_len", "batch_size", "accumulation", "lora_r", "lora_alpha", "learning_rate")


@query
def validated_files(s, d):
    """Pages, style sheets and other files of each source, by extension"""
    css = docs(s, d).select(F.format_string("%d.css", "doc_id").alias("path"), F.when(F.col("doc_id") % 3 == 0, "a{b:c").otherwise("a{b:c}").alias("code"))
    page = docs(s, d).select(F.format_string("%d", "doc_id").alias("path"), F.when(F.col("doc_id") % 5 == 0, "<html><p><b></html></i>").otherwise("<html><p>x</p></html>").alias("code"))
    other = docs(s, d).select(F.format_string("%d.txt", "doc_id").alias("path"), F.lit("text").alias("code"))
    return metrics.validated_files(css.unionByName(page).unionByName(other), U.html_error, U.js_error).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("valid").cast("long")).alias("valid"))


def written(s, d):
    """(folder, conversations with a split) after the sink has written them."""
    where = fresh_dir(s, "written")
    rows = sampling.hash_split(domain_convs(s, d), "conv_id").select(F.format_string("c%d#0", "conv_id").alias("id"), "messages", "domain", F.lit("raw").alias("source"), "split", F.lit("x").alias("_lineage"))
    return where, rows


def digest(rows):
    return rows.select("domain", "source", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("md5"))


@query
def json_lines_round_trip(s, d):
    """Written as JSON lines, read again"""
    where, rows = written(s, d)
    sinks.write_json_lines(rows, where)
    return digest(readers.json_lines(s, f"{where}/*.json"))


@query
def malformed_lines(s, d):
    """Lines of which every seventh is broken and some are blank; a path that doesn't exist is skipped"""
    where = fresh_dir(s, "lines")
    line = F.when(F.col("doc_id") % 7 == 0, "{broken").when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "source")))
    docs(s, d).select(line.alias("value")).write.text(where)
    rows = readers.optional_json_lines(s, f"{where}/, {where}-none/")
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("_bad").alias("malformed"), F.countDistinct("id").alias("ids"))
    lines = readers.line_count(s, where).agg(F.sum("rows").alias("lines"))
    bad = readers.malformed_counts(rows).agg(F.coalesce(F.sum("malformed"), F.lit(0)).alias("by_file"))
    return counts.crossJoin(lines).crossJoin(bad)  # one row each


@query
def split_files(s, d):
    """One folder per split, without lineage columns"""
    where, rows = written(s, d)
    sinks.write_splits(rows, where)
    got = s.read.json(where)
    return got.groupBy("split", F.lit("_lineage" in got.columns).alias("lineage")).agg(F.count(F.lit(1)).alias("n"))


@query
def resumed_append(s, d):
    """Half of the rows, then all of them with repeats, then all again"""
    where, rows = written(s, d)
    half = rows.filter("substr(domain, 2) < '3'")
    added = [sinks.append_new(half, where), sinks.append_new(rows.unionByName(rows), where), sinks.append_new(rows, where)]
    sinks.append_log(s.range(3).select(F.lit("log").alias("id")), f"{where}-log")
    return s.createDataFrame([(*added, s.read.json(where).count(), s.read.json(f"{where}-log").count())], "first long, second long, third long, rows long, logged long")


@query
def domain_parquet_round_trip(s, d):
    """Parquet files by folders of domains; a subset is the same at each run"""
    where, rows = written(s, d)
    rows.select("messages", F.concat(F.lit("train-"), "domain").alias("file"), "domain").write.partitionBy("domain", "file").parquet(where)
    read = lambda n=None: readers.domain_parquet(s, where, "domain=*/file=train-*/*.parquet", n)
    few = [sorted(map(str, read(10).select("messages").collect())) for _ in range(2)]
    return read().groupBy(F.regexp_extract(F.col("domain"), "file=train-(.*)", 1).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.lit(few[0] == few[1] and len(few[0]) == 10).alias("stable"))


@query
def documents_and_reports(s, d):
    """Small files written, replaced, listed and read again"""
    where = fresh_dir(s, "reports")
    items = t(s, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("prompt"))
    sinks.write_stats(items.agg(F.lit("set").alias("name"), F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(F.struct("id", "prompt"))).alias("prompts")).select("name", "count", F.to_json("prompts").alias("prompts")), f"{where}/stats.json")
    sinks.write_document(s, f"{where}/set.json", "[" + ", ".join(r["value"] for r in sinks.as_json(items).collect()) + "]")
    for k in range(8):
        sinks.write_document(s, f"{where}/old/eval-{k}.md", sinks.markdown(items.filter(f"id % 8 = {k}").select("id"), f"Part {k}"))
    sinks.write_progress(s, f"{where}/progress.json", 3, 8)
    sinks.write_progress(s, f"{where}/progress.json", 8, 8)
    went = sinks.keep_newest(s, f"{where}/old", 5)
    fine = sinks.write_unless_died(items, f"{where}/report.md", [F.col("id").cast("long")], F.col("id") % 2 == 0, lambda r: sinks.markdown(r.select("id"), "All"))
    died = sinks.write_unless_died(items, f"{where}/report.md", [F.col("id").cast("long")], F.col("id").isin("4", "5"), lambda r: "lost")
    files = sinks.write_files(s.createDataFrame([("/a/b.html", "<p>"), ("../c.txt", "no"), ("d\\e.css", "q{}")], "path string, code string"), f"{where}/files")
    lines = readers.line_count(s, f"{where}/report.md").first()["rows"]
    first = [r["value"] for r in readers.first_lines(s, f"{where}/report.md", 1).collect()]
    seen = readers.manifest(s, f"{where}/files/*/*").select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")
    state = readers.json_or_null(s, f"{where}/progress.json", "running boolean, done long, total long")
    none = readers.json_or_null(s, f"{where}/none.json", "done long")
    facts = [("prompts", readers.prompt_set(s, f"{where}/set.json").count()), ("stats", readers.json_or_null(s, f"{where}/stats.json", "name string, count long")["count"]), ("removed", len(went)), ("fine", int(fine)), ("died", int(died)), ("files", files), ("lines", lines), ("title", int(first == ["# All"])), ("done", state["done"] * (not state["running"])), ("none", int(none is None))]
    small = s.createDataFrame(facts, "file string, bytes long").withColumn("sha256", F.lit(None).cast("string"))
    return seen.unionByName(small)


@query
def pricing_summary(s, d):
    """Generic relational coverage: aggregation"""
    return t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 2).alias("avg_price"))


def stream_paths(s, path):
    """(folder for state and output, what a stream reads); streams read folders or globs, not single files."""
    return fresh_dir(s, "stream"), f"{path[:-1]}[{path[-1]}]" if _is_file(s, path) else path


@query
def streamed_event_windows(s, d):
    """Tumbling windows over a file stream, run to its end"""
    base, path = stream_paths(s, f"{d}/events.parquet")
    events = s.readStream.schema(t(s, d, "events").schema).parquet(path)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = prep.windowed_counts(events, size="1 day").select(F.col("window.start").cast("string").alias("day"), "event_type", "n")
    write = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    write.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return s.read.parquet(f"{base}/out")


def _is_file(s, path):
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(at).isFile()

