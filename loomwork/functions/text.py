"""Text functions as Column expressions; nothing here leaves the JVM.

Functions over words take a Column of words and use it within lambdas: pass a column that exists (withColumn
first), as an expression would be evaluated again for each element.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: White space as Python's str.split sees it. What is under 256 is listed one by one, which is one look-up, and the rest is asked for within its range only.
SPACE = r"[ \t\n\x0B\f\r\x1c\x1d\x1e\x1f\x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]+"
#: The same characters one by one.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

SCRIPT = r"[\u0600-\u06FF]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def let(value: Column, then) -> Column:
    """`then` of a value that is evaluated once, however often `then` uses it; conditional branches would evaluate it again each."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(t) -> Column:
    return F.btrim(col(t), F.lit(BLANKS))


def rstrip(t) -> Column:
    return F.rtrim(col(t), F.lit(BLANKS))


def words(t) -> Column:
    return F.when(strip(t) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(strip(t), SPACE))


def grams(w: Column, n: int) -> Column:
    """Array of the n-grams of an array of words, joined by one space; empty if there are fewer than n words."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))


def gram_hashes(w: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of an array of words; within one text they stand for the n-grams. Empty below n words."""

    def wider(h: Column, have: int) -> Column:
        """From hashes of `have` words to those of n: two that overlap or touch make one of up to twice as many words."""
        if have == n:
            return h
        to = min(n, 2 * have)
        left = F.size(h) - (to - have)
        return let(F.zip_with(F.slice(h, F.lit(1), left), F.slice(h, F.lit(to - have + 1), left), lambda a, b: F.xxhash64(a, b)), lambda x: wider(x, to))

    hashed = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: wider(h, 1))
    return F.when(F.size(w) >= n, hashed).otherwise(F.expr("cast(array() as array<bigint>)"))


def repetition(w: Column, n: int = 3, min_words: int = 12) -> Column:
    """Share of n-grams that repeat an earlier one; 0 below `min_words`."""
    total = F.size(w) - (n - 1)
    return F.when(F.size(w) < min_words, 0.0).otherwise((total - F.size(F.array_distinct(gram_hashes(w, n)))) / total)


def max_gram_repeat(w: Column, n: int = 12) -> Column:
    """How often the most frequent n-gram occurs; 1 below n words. Sorted hashes bring equal n-grams side by side."""
    run = lambda acc, x: F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
    step = lambda acc, x: F.struct(x.alias("last"), run(acc, x).alias("run"), F.greatest(acc["best"], run(acc, x)).alias("best"))
    longest = lambda h: F.aggregate(F.sort_array(h), F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(1).alias("best")), step, lambda acc: acc["best"])
    return F.when(F.size(w) < n, 1).otherwise(let(gram_hashes(w, n), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 1).otherwise(longest(h))))


def repeats_at_least(w: Column, n: int, times: int) -> Column:
    """Whether some n-gram occurs at least `times` times: after sorting, an entry equals the one `times` - 1 further."""
    total = F.size(w) - (n - 1)
    some = lambda h: F.size(F.array_distinct(h)) <= total - (times - 1)  # noqa: E731  (as many repeats at least; the sort is for the rest)
    same = lambda h: F.exists(F.zip_with(h, F.slice(h, times, F.greatest(F.size(h), F.lit(1))), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))
    far = lambda h: F.when(some(h), let(F.sort_array(h), same)).otherwise(False)
    return F.when(total >= times, let(gram_hashes(w, n), far)).otherwise(False)


def unique_ratio(w: Column) -> Column:
    return F.size(F.array_distinct(w)) / F.greatest(F.lit(1), F.size(w))


def char_count(t, chars: str) -> Column:
    """Characters of `t` in a regex class; whole runs of them are one match."""
    return F.length(col(t)) - F.length(F.regexp_replace(col(t), f"{chars}+", ""))


def occurrences(t, piece: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(col(t)) - F.length(F.replace(col(t), F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def share(t, chars: str) -> Column:
    return char_count(t, chars) / F.greatest(F.lit(1), F.length(col(t)))


def arabic_block_ratio(t) -> Column:
    return share(t, r"[\u0600-\u06FF]")


def latin_ratio(t) -> Column:
    return share(t, "[A-Za-z]")


def arabic_only_letters(t) -> Column:
    return char_count(t, "[ضطظعغفقحخثصشسجرذدز]")


def corruption(t) -> Column:
    """Share of characters that tell of broken encodings; 0 for empty text."""
    return share(t, r"[\uFFF0-\uFFFF\u0700-\u074F]")


def normalize_segment(t) -> Column:
    """Maps Arabic letters and digits to Persian ones, drops marks and controls, and folds blanks and blank lines."""
    x = F.translate(col(t), C.MAP_FROM, C.MAP_TO)
    for pattern, to in ((C.BIDI, ""), (C.CONTROLS, ""), (r"\r\n|\r", "\n"), (r"[ \t]+\n", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, to)
    return x


def substring_language(t) -> Column:
    """fa, ar, en, mixed or other, from counted substrings and letters."""
    t = col(t)
    total = lambda pieces: reduce(lambda a, b: a + b, [occurrences(t, p) for p in pieces])
    size = F.greatest(F.lit(1), F.length(t)).cast("long")
    over = lambda n, tenths: n * 10 > size * tenths  # noqa: E731  (whole numbers: 0.7 * 90 as doubles is under 63)
    # all markers are of the Arabic script: texts without it have none, and skip the counting
    counted = F.struct(total(C.ARABIC_MARKERS).alias("ar"), total(C.PERSIAN_MARKERS).alias("fa"), char_count(t, f"[{C.PERSIAN_LETTERS}]").alias("letters"))
    none = F.struct(F.lit(0).alias("ar"), F.lit(0).alias("fa"), F.lit(0).alias("letters"))
    arabic = F.when(t.rlike(r"[\u0600-\u06FF\u0750-\u077F]"), char_count(t, r"[\u0600-\u06FF\u0750-\u077F]")).otherwise(0)

    def told(x: Column, ascii_n: Column) -> Column:
        ar, fa, letters = x["ar"], x["fa"], x["letters"]
        return (
            F.when((letters >= 1) & (fa >= ar), "fa").when((ar >= 3) & (fa == 0) & (letters == 0), "ar")
            .when(over(arabic, 3), F.when((fa > 0) | (letters > 0), "fa").otherwise("mixed")).when(over(ascii_n, 3), "mixed").otherwise("other")
        )

    others = lambda ascii_n: let(F.when(t.rlike(SCRIPT), counted).otherwise(none), lambda x: told(x, ascii_n))
    return F.when(t.isNull() | (t == ""), "other").otherwise(let(char_count(t, "[A-Za-z]").cast("long"), lambda n: F.when(over(n, 7), "en").otherwise(others(n))))


def conversation_language(messages) -> Column:
    """Of the user's turns: ar, fa_en, fa, en or mixed."""
    langs = F.transform(F.filter(col(messages), lambda m: m["role"] == "user"), lambda m: substring_language(m["content"]))

    def told(langs: Column) -> Column:
        n = lambda x: F.size(F.filter(langs, lambda y: y == x))
        return F.when((n("ar") > 0) & (n("ar") >= n("fa")), "ar").when((n("fa") > 0) & (n("en") > 0), "fa_en").when(n("fa") > 0, "fa").when(n("en") > 0, "en").otherwise("mixed")

    return let(langs, told)


def without(t: Column, mark: str, pattern: str) -> Column:
    """A blank for each match of a pattern that has `mark` in it; texts without the mark aren't searched."""
    return let(t, lambda x: F.when(F.contains(x, F.lit(mark)), F.regexp_replace(x, pattern, " ")).otherwise(x))


def prose(t) -> Column:
    """The text without its code blocks."""
    return without(col(t), "```", r"```[\s\S]*?```")


def token_language(t) -> Column:
    """struct(lang, conf) from whole words and letters, code and links left out."""
    raw = col(t)
    word = r"[\p{L}\p{N}_\u0600-\u06FF\u0750-\u077F]"
    out = lambda lang, conf: F.struct(F.lit(lang).alias("lang"), (conf if isinstance(conf, Column) else F.lit(float(conf))).alias("conf"))

    def arabic_script(x: Column, arabic: Column) -> Column:
        hits = lambda w, lexicon: F.size(F.filter(w, lambda y: y.isin(lexicon)))
        counted = let(F.regexp_extract_all(x, F.lit(f"({word}+)"), 1), lambda w: F.struct(hits(w, C.PERSIAN_WORDS).alias("fa"), hits(w, C.ARABIC_WORDS).alias("ar"), char_count(x, f"[{C.PERSIAN_LETTERS}]").alias("letters")))
        return let(counted, lambda n: told(n["fa"], n["ar"], n["letters"], arabic))

    def told(fa: Column, ar: Column, letters: Column, arabic: Column) -> Column:
        return (
            F.when((letters >= 2) & (fa >= ar), out("fa", F.least(F.lit(1.0), 0.55 + 0.08 * letters + 0.05 * fa))).when((ar >= 2) & (fa == 0) & (letters == 0), out("ar", F.least(F.lit(1.0), 0.5 + 0.1 * ar)))
            .when(arabic >= 5, F.when((fa == 0) & (ar >= 1), out("ar", 0.6)).otherwise(out("fa", 0.55))).when(fa >= 1, out("fa", 0.5)).otherwise(out("other", 0.3))
        )

    def counted(x: Column) -> Column:
        letters = F.struct(char_count(x, "[A-Za-z]").alias("en"), F.when(x.rlike(SCRIPT), char_count(x, SCRIPT)).otherwise(0).alias("arabic"))
        # the lexicons and the letters are of the Arabic script: a text without it has none of them
        rest = lambda n: F.when(n["arabic"] > 0, arabic_script(x, n["arabic"])).otherwise(out("other", 0.3))
        return let(letters, lambda n: F.when((n["en"] > 5) & (n["en"] > n["arabic"] * 2), out("en", 0.8)).otherwise(rest(n)))

    x = without(without(prose(raw), "`", r"`[^`\n]+`"), "://", r"https?://\S+")
    return let(x, lambda x: F.when(x.isNull() | ~x.rlike(word), out("other", 0.0)).otherwise(counted(x)))


def with_model(t, predicted) -> Column:
    """struct(lang, conf) of an optional language model's guess, struct(label, conf) or null, and of `token_language`.

    The model's label counts; below a confidence of 0.75 the words decide between fa and ar if they are surer.
    """
    label = F.regexp_replace(F.lower(col(predicted)["label"]), "^__label__", "")
    lang = F.when(label.isin("fa", "persian"), "fa").when(label.isin("ar", "ara", "arb"), "ar").when(label == "en", "en").otherwise("other")
    conf = col(predicted)["conf"].cast("double")
    doubt = lambda own: (conf < 0.75) & own["lang"].isin("fa", "ar") & (own["lang"] != lang) & (own["conf"] > conf)
    return let(token_language(t), lambda own: F.when(col(predicted).isNull() | label.isNull() | doubt(own), own).otherwise(F.struct(lang.alias("lang"), conf.alias("conf"))))


def response_language(t, known: Column | None = None) -> Column:
    """`code` for an answer of code blocks only, else the language of the rest. `known`: the text's `token_language`, if at hand; without code blocks it is the answer's."""
    own = let(prose(t), lambda x: F.when(strip(x) == "", "code").otherwise(token_language(x)["lang"]))
    return own if known is None else F.when(F.contains(col(t), F.lit("```")), own).when(strip(t) == "", "code").otherwise(known["lang"])


def secret(t, patterns=C.SECRETS) -> Column:
    return any_of(col(t).rlike(p) for p in patterns)


def odd_fences(t) -> Column:
    return occurrences(t, "```") % 2 == 1


def unfinished(t) -> Column:
    x = rstrip(t)
    return any_of(x.endswith(e) for e in C.UNFINISHED)


def malformed(t) -> Column:
    """unclosed_fence, placeholder or null."""
    marked = any_of(F.contains(col(t), F.lit(m)) for m in C.METRIC_MARKS)  # most texts have none, and skip the pattern
    return F.when(odd_fences(t), "unclosed_fence").when(marked & col(t).rlike(C.METRIC_PLACEHOLDER), "placeholder")


def without_thinking(t) -> Column:
    """The trimmed answer after its first end of thinking; empty if thinking never ends."""
    after = lambda x: strip(F.substring(x, F.instr(x, "</think>") + F.lit(8), F.length(x)))
    return let(strip(F.coalesce(col(t), F.lit(""))), lambda x: F.when(F.contains(x, F.lit("</think>")), after(x)).when(x.startswith("<think>"), "").otherwise(x))


def runner_answer(t) -> Column:
    """The trimmed answer after its first end of thinking, if anything follows there; else all of it, trimmed."""
    x = strip(F.coalesce(col(t), F.lit("")))
    tail = strip(F.substring(x, F.instr(x, "</think>") + F.lit(8), F.length(x)))
    return F.when((F.instr(x, "</think>") > 0) & (tail != ""), tail).otherwise(x)


def bad_markers(t) -> Column:
    return F.filter(F.array(*[F.lit(m) for m in C.BAD_MARKERS]), lambda m: F.contains(F.lower(col(t)), F.lower(m)))


def relevance_hits(t) -> Column:
    low = F.lower(col(t))
    return F.size(F.filter(F.array(*[F.lit(v) for v in C.RELEVANCE]), lambda v: F.contains(low, v)))


def blocks(t) -> Column:
    """array<struct(kind, code)> of fenced blocks; blocks of an unknown language are told by their content."""
    x = col(t)
    pairs = F.arrays_zip(F.regexp_extract_all(x, F.lit(C.BLOCK), 1).alias("lang"), F.regexp_extract_all(x, F.lit(C.BLOCK), 2).alias("code"))
    named = F.create_map(*[F.lit(v) for kv in C.BLOCK_KIND.items() for v in kv])
    has = lambda code, *any_: any_of(F.contains(code, F.lit(a)) for a in any_)
    guess = lambda code: F.when(has(code, "<html", "<div", "<!DOCTYPE"), "html").when(has(code, "{") & has(code, ":") & ~has(code, "<"), "css").otherwise("other")
    return F.transform(pairs, lambda p: F.struct(F.coalesce(named[F.lower(p["lang"])], guess(p["code"])).alias("kind"), p["code"].alias("code")))


def files(t) -> Column:
    """array<struct(path, code)> of the fenced blocks of an answer.

    One scan reads bold paths and blocks as events; folding over them, a path waits for the next block that is a
    file. Blocks without a path are named by their language, or by their number among all blocks. Blocks of the
    language `text` are no files; a bold path within one waits on.
    """
    pattern = F.lit(f"(?U){C.BOLD_PATH}|{C.BLOCK}")
    event = F.arrays_zip(*[F.regexp_extract_all(F.coalesce(col(t), F.lit("")), pattern, i).alias(n) for i, n in enumerate(("all", "path", "lang", "code"))])
    named = F.create_map(*[F.lit(v) for kv in C.FILE_NAMES.items() for v in kv])
    last = lambda code: F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(code, F.lit(f"(?U){C.BOLD_PATH}"), 1)), -1)
    none = F.expr("cast(array() as array<struct<path: string, code: string>>)")

    def step(acc, e):
        lang, block = F.lower(e["lang"]), e["path"] == ""
        file = block & (lang != "text")
        name = F.coalesce(F.nullif(acc["path"], F.lit("")), named[lang], F.concat(F.lit("file"), acc["n"].cast("string"), F.lit("."), F.coalesce(F.nullif(lang, F.lit("")), F.lit("txt"))))
        inner = F.coalesce(F.nullif(last(e["code"]), F.lit("")), acc["path"])
        path = F.when(file, "").when(block, inner).otherwise(e["path"])
        more = F.when(file, F.array(F.struct(name.alias("path"), strip(e["code"]).alias("code")))).otherwise(none)
        return F.struct(path.alias("path"), (acc["n"] + block.cast("int")).alias("n"), F.concat(acc["out"], more).alias("out"))

    return F.aggregate(event, F.struct(F.lit("").alias("path"), F.lit(0).alias("n"), none.alias("out")), step, lambda acc: acc["out"])


def css_balanced(code) -> Column:
    return occurrences(code, "{") == occurrences(code, "}")


def quality_rank(asst, user, turns, asst_words: Column) -> Column:
    """Higher is better: length, joined letters, no repetition, rich vocabulary, several turns, a full prompt."""
    one = F.lit(1.0)
    return (
        2.0 * F.least(one, F.length(col(asst)) / 900) + 1.5 * F.least(one, char_count(asst, "\u200c") / 8) + 1.5 * (1.0 - repetition(asst_words, 3, 5))
        + 1.5 * F.least(one, unique_ratio(asst_words)) + F.when(col(turns) > 2, 2.0).otherwise(0.0) + 0.8 * F.least(one, F.length(col(user)) / 120)
    )


def shingles(w: Column, n: int = 5) -> Column:
    """n-word shingles; all words as one if there are fewer, one empty shingle without words."""
    return F.when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(grams(w, n))


def hash32(t: Column) -> Column:
    """First 32 bits of MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")


def split_bucket(seed: int, key) -> Column:
    """Bucket of 1000 from the first eight bytes, little-endian, of SHA-256 over "seed:key"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(key).cast("string")), 256)
    turned = F.concat(*[F.substring(digest, 2 * i - 1, 2) for i in range(8, 0, -1)])
    return (F.conv(turned, 16, 10).cast("decimal(20,0)") % 1000).cast("int")


def prompt_key(t, size: int = 180, fold_letters: bool = True) -> Column:
    """Folded prefix that tells prompts apart."""
    x = F.regexp_replace(F.translate(col(t), "يك", "یک"), "\u200c", "") if fold_letters else col(t)
    return F.substring(F.lower(strip(F.regexp_replace(x, SPACE, " "))), 1, size)


def chat_prompt(messages, generation_prompt: bool = False) -> Column:
    """The chat template for system, user and assistant turns; an assistant's thinking is dropped but for the last answer."""
    body = lambda m: F.when(m["role"] == "assistant", F.regexp_replace(F.element_at(F.split(F.coalesce(m["content"], F.lit("")), "</think>"), -1), "^\n+", "")).otherwise(F.coalesce(m["content"], F.lit("")))
    turn = F.transform(col(messages), lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), body(m), F.lit("<|im_end|>\n")))
    text = F.array_join(turn, "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generation_prompt else text


def learning_rate(step, warmup: int, total: int, peak: float) -> Column:
    """Linear warm-up, then a cosine to zero."""
    s = col(step).cast("double")
    return F.when(s < warmup, peak * (s + 1) / max(1, warmup)).otherwise(peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (s - warmup) / max(1, total - warmup))))
