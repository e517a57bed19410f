"""Line dedup over overlapping windows of three lines.

Lines that hold a word are numbered within their document; each three in a row make a window, known by two
independent 64-bit hashes of its trimmed lines. Of windows that are equal anywhere in the corpus the first
(smallest doc_id, then position) stays; every later one has its three lines removed. Covered positions merge
in a set per document, so overlapping windows remove a line once.

Documents with fewer than three such lines have no window and stay as they are. Lines without a word are never
removed, and don't separate the lines around them. Null texts count as empty; rows with a null doc_id stay as
they are, and rows that repeat a doc_id are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, cut, marked, table, text_col

WINDOW = 3
_GAPS = " \t\n\x0b\x0c\r"


def _lines(text):
    """Array of (position among all lines, hash, second hash) of the lines with a word."""
    trimmed = lambda x: F.trim(F.translate(x, _GAPS, "      "))
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), trimmed(x).alias("x")))
    return F.transform(F.filter(every, lambda s: s["x"] != ""), lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"), F.xxhash64(F.lit("second"), s["x"]).alias("g")))


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, p, a, b): hashes a, b of each window and the number p of its first line among those with a word.

    `copy` is a hash of the text, which tells rows of one doc_id apart; repeated rows give their windows again. Null
    texts, texts of fewer than three such lines and rows with a null doc_id have none, so an empty table has none. A
    long text takes some arrays as long as its lines. Other columns, whatever their names, are left out.
    """
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("_t")).filter("doc_id is not null")
    t = t.withColumn("copy", F.xxhash64("_t")).withColumn("_l", _lines(F.col("_t"))).filter(F.size("_l") >= WINDOW)
    each = f"transform(sequence(0, size(_l) - {WINDOW}), p -> struct(p, xxhash64({', '.join(f'_l[p + {k}].h' for k in range(WINDOW))}) as a, xxhash64({', '.join(f'_l[p + {k}].g' for k in range(WINDOW))}) as b))"
    return t.select("doc_id", "copy", F.explode(F.expr(each)).alias("x")).select("doc_id", "copy", "x.*")


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, gone array<int>): numbers, among a document's lines with a word, of the lines to remove; documents that lose none have no row.

    Of equal windows that with the smallest (doc_id, p, copy) stays. Repeated rows of a document are one here. Nulls,
    long texts, empty tables and other columns as in `windows`.
    """
    rows = cut(windows(docs), "line-windows")
    first = rows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "p", "copy")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = attach_by_key(rows, cut(first, "line-firsts"), ["a", "b"], "n").filter("first is not null and not (doc_id = first.doc_id and p = first.p and copy = first.copy)")
    covered = later.select("doc_id", "copy", F.explode(F.array(*[F.col("p") + k for k in range(WINDOW)])).alias("p"))
    return covered.groupBy("doc_id", "copy").agg(F.collect_set("p").alias("gone"))


def _applied(docs: DataFrame) -> DataFrame:
    """(row, text, n): each row of `docs` as a struct, its text without the removed lines, and how many these are.

    Only rows whose doc_id is, or by a bitmap may be, one that loses lines are shuffled; all others stay where they are.
    """
    gone = cut(removed(docs), "line-gone")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("doc_id", F.col("row.doc_id").cast("long"))
    rows = marked(rows, "doc_id", gone.select("doc_id"))
    same = rows.filter("not _near").select("row", F.col("row.text").alias("text"), F.lit(0).cast("long").alias("n"))
    near = rows.filter("_near").select("row", "doc_id", F.xxhash64(text).alias("copy")).join(gone.hint("merge"), ["doc_id", "copy"], "left")  # the same plan at every size
    has_word = lambda x: F.trim(F.translate(x, _GAPS, "      ")) != ""
    every = F.split(text, "\n")
    worded = F.transform(F.filter(F.transform(every, lambda x, i: F.struct(i.alias("i"), has_word(x).alias("w"))), lambda s: s["w"]), lambda s: s["i"])
    near = near.withColumns({"every": F.when(F.col("gone").isNotNull(), every), "worded": F.when(F.col("gone").isNotNull(), worded)})
    near = near.withColumn("out", F.expr("transform(gone, p -> get(worded, p))"))
    left = F.expr("array_join(transform(array_except(sequence(0, size(every) - 1), out), i -> get(every, i)), '\n')")
    kept = F.when(F.size("gone") >= F.size("worded"), F.lit("")).otherwise(left)
    return same.unionByName(near.select("row", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n")))


def dedup_lines(docs: DataFrame, count: str = "_n_removed") -> DataFrame:
    """All columns of `docs`, `text` without the removed lines, and `count`; a column of that name in `docs` is replaced.

    A text that loses all its lines becomes empty. Null texts stay null. Rows with a null doc_id, and repeated rows
    of one document, stay in number; a repeat of a document's own text loses nothing to it. An empty table gives
    no rows. Long texts take a few arrays as long as their lines. Other columns may have any names.
    """
    return _applied(docs).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != count], F.col("n").alias(count))


def stage(docs: DataFrame) -> DataFrame:
    """`dedup_lines` in the columns of `docs`, which keep their values and may have any names; `n_chars`, if there is one, follows the text.

    Nulls, repeated rows, long texts and empty tables: as `dedup_lines` says.
    """
    kinds, n = dict(docs.dtypes), F.col("n")
    new = {"text": F.col("text")}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(n > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(kinds["n_chars"]).alias("n_chars")
    return _applied(docs).select(*[new.get(c, F.col("row")[c].alias(c)) for c in docs.columns])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines removed, lines with a word left, and the digest of the text that stays."""
    got = dedup_lines(table(spark, sf_dir, "documents"))
    left = F.size(F.filter(F.split(text_col(), "\n"), lambda x: F.trim(F.translate(x, _GAPS, "      ")) != ""))
    return got.select("doc_id", F.col("_n_removed").alias("n_removed"), left.cast("long").alias("n_left"), F.sha2(text_col(), 256).alias("kept_sha256"))
