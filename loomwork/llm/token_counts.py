"""Token counts as delta-maintained rollups.

A batch of signed changes (insert, delete, revise) becomes one small table of additive deltas by source,
language and tokenizer version. A batch is committed by creating its marker file, which only one writer can
do; a batch that has its marker is skipped, so a replay or a retry after a lost driver changes nothing, and
the files of an attempt without marker are never read. Totals are the sum of the last snapshot and of the
deltas committed since; compaction folds those into a new snapshot.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import cut, fresh_dir, table, text_col, words_col

KEYS = ["source", "lang", "tokenizer_version"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"


class _Files:
    """The few file system calls that commits need, by the file system of the path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def claim(self, name: str, content: str) -> bool:
        """Creates a file with this content, unless there is one: False then. The content becomes visible at once, by a rename of a written file.

        It takes a file system whose rename is atomic and refuses an existing target, as HDFS and local folders; a bare object store gives neither.
        """
        if self.fs.exists(self.path(name)):
            return False
        own = self.path(f"_tmp/{uuid.uuid4().hex}")
        out = self.fs.create(own, False)
        out.write(bytearray(content.encode()))
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        done = self.fs.rename(own, self.path(name))
        return bool(done)

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self.path(name)))

    def read(self, folder: str, but=()) -> dict[str, dict]:
        """Contents by name; files named in `but` aren't opened and give an empty one."""
        at = self.path(folder)
        found = self.fs.listStatus(at) if self.fs.exists(at) else []
        named = [(s.getPath().getName(), s) for s in found]
        return {name: {} if name in but else self._content(s) for name, s in named}

    def last(self, folder: str) -> dict | None:
        """The content of the file with the greatest name; only that one is opened."""
        at = self.path(folder)
        found = self.fs.listStatus(at) if self.fs.exists(at) else []
        return self._content(max(found, key=lambda s: s.getPath().getName())) if len(found) else None

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if there isn't one."""
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def content(self, name: str) -> dict:
        return self._content(self.fs.getFileStatus(self.path(name)))

    def _content(self, status) -> dict:
        stream = self.fs.open(status.getPath())
        try:
            return json.loads(bytes(stream.readNBytes(status.getLen())).decode())
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        """Removes a file or folder, if it is there."""
        self.fs.delete(self.path(name), True)


def signed(changes: DataFrame) -> DataFrame:
    """Deltas by key of rows (op, source, lang, tokenizer_version, n_tokens, n_chars, old_tokens, old_chars).

    insert: +1 document and its counts; delete: -1 and minus its counts; revise: no document, counts new less
    old. Null counts are 0; null keys are a key of their own; any other op is an error. Repeated rows count as
    often as they stand there. No rows give no deltas. Other columns, whatever their names, aren't read.
    """
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    delta = lambda new, old: F.when(F.col("_s") == 0, n(new) - n(old)).otherwise(F.col("_s") * n(new))
    rows = changes.withColumn("_s", sign.cast("long")).select(*KEYS, F.col("_s").alias("n_docs"), delta("n_tokens", "old_tokens").alias("n_tokens"), delta("n_chars", "old_chars").alias("n_chars"))
    return rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


class TokenLedger:
    """Totals of token counts under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark, root.rstrip("/"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False, and nothing changes, if a batch of this name is committed already. Names are file names."""
        if self.files.exists(f"commits/{batch}"):
            return False
        attempt = f"deltas/{uuid.uuid4().hex}"
        signed(changes).write.parquet(f"{self.root}/{attempt}")
        return self.files.claim(f"commits/{batch}", json.dumps({"at": attempt}))

    def _parts(self) -> tuple[list[str], list[str], int]:
        """Folders whose sum is the totals, the batches in them, and the number of snapshots; from one listing."""
        last = self.files.last("snapshots") or {"folded": [], "n": 0}
        folded = set(last["folded"])
        commits = self.files.read("commits", folded)
        return [x for x in [last.get("at")] if x] + [c["at"] for b, c in sorted(commits.items()) if b not in folded], sorted({*commits, *folded}), last["n"]

    def _sum(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).filter(" or ".join(f"{m} <> 0" for m in MEASURES))

    def totals(self) -> DataFrame:
        """One row per key whose documents or counts aren't all zero; no rows before the first commit."""
        return self._sum(self._parts()[0])

    def compact(self) -> bool:
        """Folds what is committed now into a snapshot; batches committed meanwhile stay deltas. False if another snapshot came first.

        The folded batches stay known by name, so replays stay harmless: a snapshot lists a name for each batch.
        """
        paths, batches, n = self._parts()
        if not paths:
            return False
        attempt = f"snapshots-data/{uuid.uuid4().hex}"
        self._sum(paths).write.parquet(f"{self.root}/{attempt}")
        return self.files.claim(f"snapshots/{n + 1:09d}", json.dumps({"at": attempt, "folded": batches, "n": n + 1}))


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, n_chars, n_words, n_tokens) of every row, repeated ones and ones with nulls too.

    Null texts count as empty. Long texts take memory in proportion to their tokens. An empty table gives no rows.
    Other columns, whatever their names, are left out.
    """
    text = text_col()
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(bpe.spec_of(path or bpe.tokenizer_path()))
    bpe.tune(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        coder = bpe.load(sent.value)
        for b in batches:
            n = pa.array([coder.count(t) for t in b.column(5).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], n], ["doc_id", "source", "lang", "n_chars", "n_words", "n_tokens"])

    ready = packed.select("doc_id", "source", "lang", F.length("text").cast("long").alias("n_chars"), F.size(words_col(F.col("text"))).cast("long").alias("n_words"), "text")
    return ready.mapInArrow(run, "doc_id long, source string, lang string, n_chars long, n_words long, n_tokens long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals of all documents after four batches, one of them sent twice: inserts with estimated counts (a quarter
    of the characters) and with word counts, revision of the estimates by real counts, deletion of empty documents."""
    docs = cut(counted(table(spark, sf_dir, "documents")), "token-counts")
    ledger = TokenLedger(spark, fresh_dir(spark, "ledger"))
    estimate = F.ceil(F.col("n_chars") / 4).cast("long")
    none = F.lit(None).cast("long")
    rows = lambda op, version, tokens, old=none, old_chars=none: docs.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), tokens.alias("n_tokens"), "n_chars", old.alias("old_tokens"), old_chars.alias("old_chars"), F.col("n_words").alias("_words"))
    ledger.commit("insert-estimates", rows("insert", "word_bpe_49k", estimate))
    ledger.commit("insert-words", rows("insert", "words", F.col("n_words")))
    revised = rows("revise", "word_bpe_49k", F.col("n_tokens"), estimate, F.col("n_chars"))
    ledger.commit("revise", revised)
    ledger.compact()
    ledger.commit("revise", revised)
    empty = "_words = 0"
    ledger.commit("delete-empty", rows("delete", "word_bpe_49k", F.col("n_tokens")).filter(empty).unionByName(rows("delete", "words", F.col("n_words")).filter(empty)))
    return ledger.totals()
