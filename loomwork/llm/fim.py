"""Fill-in-middle transformation over code point arrays.

A text becomes one numpy array of its code points. Each code point has a class, and a unit ends between two
neighbours whose classes differ in the way the unit asks for; `flatnonzero` of that comparison gives all ends at
once. Hashes of the seed and the row's id choose two ranks among them, and the three slices are encoded again and
written around the marks. Nothing is drawn at random, so a lost task gives the same rows when it runs again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_col, tune

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Class of each ASCII code point for the units: 1 ends a line, 2 is a blank, 0 all else.
_CLASSES = np.zeros(128, np.uint8)
_CLASSES[[9, 11, 12, 13, 32]] = 2
_CLASSES[10] = 1


@dataclass(frozen=True)
class Rule:
    """How texts are cut and which of them: marks, unit, seed, and shares in hundredths.

    `unit`: "line" (with its line end), "word" (with the blanks after it) or "char".
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "line"
    seed: int = 7
    fim_share: int = 100
    spm_share: int = 50

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def ends(codes: np.ndarray, unit: str = "line") -> np.ndarray:
    """Where the units end, in code points; the last end is the length, an empty text has none."""
    n = len(codes)
    if not n or unit == "char":
        return np.arange(1, n + 1)
    kinds = _CLASSES[np.where(codes < 128, codes, 0)]
    left, right = kinds[:-1], kinds[1:]
    between = left == 1 if unit == "line" else (left > 0) & (right == 0)
    return np.append(np.flatnonzero(between) + 1, n)


def draws(seed: int, key: int) -> list[int]:
    """Four numbers below 2**32 that the seed and the id fix."""
    d = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]


def rearranged(text: str, key: int | None, rule: Rule) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix's length, middle's length, output) of one text."""
    codes = code_points(text)
    at = ends(codes, rule.unit)
    n = len(at)
    if not n or key is None or any(m in text for m in rule.marks):
        return n, PLAIN, None, None, text
    h1, h2, h3, h4 = draws(rule.seed, key)
    if h3 % 100 >= rule.fim_share:
        return n, PLAIN, None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(at[k - 1]) if k else 0 for k in (first, last))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le", "surrogatepass") for p in (codes[:a], codes[a:b], codes[b:]))
    if h4 % 100 < rule.spm_share:
        return n, SPM, a, b - a, f"{rule.suffix}{suffix}{rule.prefix}{prefix}{rule.middle}{middle}"
    return n, PSM, a, b - a, f"{rule.prefix}{prefix}{rule.suffix}{suffix}{rule.middle}{middle}"


def transform(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row for each row of `docs`.

    Null texts count as empty; empty texts, texts with one of the marks and rows with a null id stay plain, with null
    lengths. Repeated rows give equal rows, as cuts depend on the id and the text alone; an empty table gives none.
    A long text takes some ten bytes for each code point, batches are bounded by bytes. Other columns, whatever their
    names, are left out.
    """
    tune(docs.sparkSession)
    if rule.unit not in ("line", "word", "char") or len({*rule.marks}) < 3 or "" in rule.marks:
        raise ValueError("the unit is line, word or char, and the three marks differ and aren't empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            got = [rearranged(t.as_py(), k, rule) for k, t in zip(b.column(0).to_pylist(), b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str | Column = "output", form: str | Column = "form", rule: Rule = Rule()) -> Column:
    """The text that an output was made of: exact, as a text with a mark in it is never rearranged.

    The marks must not be able to overlap each other, as those that begin by a sign they hold nowhere else.
    """
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(out, "|".join(re.escape(m) for m in rule.marks), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == PSM, F.concat(part(1), part(3), part(2))).when(form == SPM, F.concat(part(2), part(3), part(1))).otherwise(out)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Per document how it is cut, and digests of what comes out and of what is rebuilt from that."""
    got = transform(table(spark, sf_dir, "documents")).withColumn("_back", restored())
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("_back", 256).alias("restored_sha256"))
