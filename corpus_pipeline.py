"""The training-data pipeline: five stages of `loomwork.llm`, each reading what the one before has written.

In every stage null and empty texts count as texts without words, an empty table gives no rows, and columns beyond
those of `documents` may have any names and keep their values (the last stage returns its own columns only). Texts
are worked on whole; what a long one takes is said at each operator.
"""

from __future__ import annotations

from loomwork.llm import bpe, decontam, line_dedup, simhash, toxicity
from loomwork.llm.common import cut, table


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score reaches the cutoff go; learnt from the labels outside the held-out fold.

    Null texts stay, as they have no hits. Repeated rows, and rows with a null doc_id, are judged by their own texts
    and stay in number. Null labels don't count.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark, docs, sf_dir):
    """Lines of windows that occurred before go from the texts; `n_chars` follows.

    No row goes; null texts stay null. Of equal windows the one with the smallest doc_id, then place, stays. Rows
    that repeat a document with its text lose nothing to each other; rows with a null doc_id stay as they are.
    """
    return line_dedup.stage(docs)


def dedup_near(spark, docs, sf_dir):
    """One document of each group of near duplicates stays.

    It is the one with the smallest doc_id, of such by a hash of its text and columns, so repeated rows leave one.
    Null and empty texts are near duplicates of each other. Rows with a null doc_id stay.
    """
    return simhash.dedup(docs)


def drop_leaks(spark, docs, sf_dir):
    """Documents with a benchmark item go.

    Null texts stay. Repeated rows, and rows with a null doc_id, are judged by their own texts. Items that are null,
    have a null id or under five words are a leak nowhere; without items all documents stay.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """Token counts and digests of ids and decoded texts of what is left, one row for each row.

    Null texts have no tokens and the digests of the empty string; repeated rows and null ids give as many rows.
    """
    return bpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", drop_leaks), ("bpe", encode)]

#: SQL has neither the toxicity model nor XXH64 and BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the table `documents`, cut after each by a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
