"""Substring dedup by a log-structured fingerprint index.

Windows are 13 words in a row. Each window has a fingerprint: the smallest hash of the seven-word runs inside it
(winnowing), so equal windows have equal fingerprints and a document needs only the fingerprints that change
from window to window, about a quarter as many as words.

The index keeps immutable runs, bucketed and sorted by their keys. Runs of postings say which documents have a
fingerprint. Runs of windows say which document owns a window (the smallest doc_id that has it), for all windows
whose fingerprint was ever shared; a window is known by 96 bits of two hashes of all its words. A batch of
documents becomes new runs, which are merge-joined bucket by bucket with the runs of history without shuffling these:

* a fingerprint that two documents of history share has all its windows among the owned ones already;
* a fingerprint that one document of history has alone is verified now: that document's text is read again
  from the index, and its windows become owned ones;
* all windows of the batch with a shared fingerprint are compared with each other and with the owned ones.

A batch is committed by a manifest that names what is live, with the batch's decisions: a batch that was committed
before gives the same result again and changes nothing. What a batch costs beyond the merge with history's runs
doesn't grow with the number of batches: runs come in tiers, over MAX_RUNS of one tier are compacted into one of the
next and removed. A compacted run of postings keeps two documents of each fingerprint, the smallest and the
largest, as no more is ever asked; one of texts is dealt to parts by document, of which only those with a wanted
text are read. Lists of boilerplate are one list again after each compaction.

Documents with equal word sequences are copies: all but the smallest doc_id lose all their words at once (if
there are 13), and take no part in the comparison. Fingerprints of boilerplate, which over one in HOT_SHARE of
a sample of documents has, would crowd one bucket: they count as shared without a join, so their postings stay
where the documents are.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PACKED, attach_by_key, cut, fresh_dir, marked, table, text_col, tune, words_col
from .token_counts import _Files

WINDOW = 13
GRAM = 7
BATCHES = 2
MAX_RUNS = 4
#: Documents in the sample that finds boilerplate, about; and the share of them that makes a fingerprint hot. So at
#: most HOT_SHARE times a document's mean number of fingerprints are hot, whatever the input.
HOT_SAMPLE = 4096
HOT_SHARE = 64
#: Documents in a part of a compacted run of texts, about, and its parts at most.
PART_DOCS, TEXT_PARTS = 4096, 1024
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _rolled(h: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """Polynomial hash, mixed, of each n in a row."""
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * factor + h[k : len(h) - n + 1 + k]
    return _mix(out)


def fingerprints(h: np.ndarray) -> np.ndarray:
    """Of each window of a document's word hashes (uint64; at least 13): the smallest seven-word hash in it."""
    grams, width = _rolled(h, GRAM, _M3), WINDOW - GRAM + 1
    low, have = grams, 1
    while have < width:  # minima over doubling spans
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def _hashes(words) -> "F.Column":
    return F.transform(words, lambda w: F.xxhash64(w))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield flat[a:b]


def _digested(docs: DataFrame) -> DataFrame:
    """(doc_id, key, mark, n_words, whole, text, fps) of each row, in one pass over the texts.

    `whole` is the digest of the words, (key, mark) are 96 bits of hashes of them, `fps` the document's distinct
    fingerprints (none below 13 words and for rows with a null doc_id).
    """
    names = ["doc_id", "key", "mark", "n_words", "whole", "text", "fps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, ends = [], [0]
            for known, h in zip(b.column(0).is_valid().to_pylist(), _lists(b.column(6))):
                own = np.unique(fingerprints(h.view(np.uint64))) if known and len(h) >= WINDOW else h[:0]
                fps.append(own.view(np.int64))
                ends.append(ends[-1] + len(own))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(fps) if fps else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(6)], lists], names)

    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).withColumn("_w", words_col(F.col("text"))).withColumn("_t", F.array_join("_w", " "))
    rows = rows.select("doc_id", F.xxhash64("_t").alias("key"), F.hash("_t").alias("mark"), F.size("_w").cast("long").alias("n_words"), F.sha2("_t", 256).alias("whole"), "text", _hashes(F.col("_w")).alias("h"))
    return rows.mapInArrow(run, "doc_id long, key long, mark int, n_words long, whole string, text string, fps array<long>")


def _picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`docs` joined with `wanted` on doc_id; the bitmap spares shuffling the texts of most others."""
    return marked(docs, "doc_id", wanted.select("doc_id")).filter("_near").drop("_near").join(wanted, "doc_id")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows (doc_id, key, fps) whose (doc_id, key) isn't in `gone`: most need no join."""
    rows = marked(docs, "doc_id", gone.select("doc_id"))
    return rows.filter("not _near").drop("_near").unionByName(rows.filter("_near").drop("_near").join(gone, ["doc_id", "key"], "left_anti"))


def windows(rows: DataFrame) -> DataFrame:
    """(doc_id, key, start, a, b, old) of rows (doc_id, key, text, fps, old): the windows with one of the fingerprints `fps`."""
    names = ["doc_id", "key", "start", "a", "b", "old"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, key, old, h, fps in zip(*[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], _lists(batch.column(3)), _lists(batch.column(4))):
                if len(h) < WINDOW:
                    continue
                h = h.view(np.uint64)
                at = np.flatnonzero(np.isin(fingerprints(h), fps.view(np.uint64)))
                if len(at):
                    one, two = _rolled(h, WINDOW, _M1)[at], _rolled(_mix(h), WINDOW, _M2)[at]
                    out.append((np.full(len(at), d), np.full(len(at), key), at.astype(np.int32), one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(at), bool(old))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    hashed = rows.select("doc_id", "key", "old", _hashes(words_col(F.col("text"))).alias("h"), "fps")
    return hashed.mapInArrow(run, "doc_id long, key long, start int, a long, b int, old boolean")


class FingerprintIndex:
    """The index under a folder that all executors share; the last manifest names what is live.

    One writer at a time: a second one's commit is refused. Compaction removes the runs that it replaces, so a
    reader that holds an older manifest opens the index anew. What a failed attempt left is removed by the commit
    that takes its place. The decisions on each batch stay, for replays; nothing else reads them.
    """

    _KINDS = {"postings": ("fp BIGINT, doc_id BIGINT", ["fp"]), "windows": ("a BIGINT, b INT, owner BIGINT, n BIGINT", ["a", "b"])}
    _TAGS = ("texts", "hot", "facts", "starts")

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark, root.rstrip("/"))
        self.buckets = self.manifest()["buckets"] or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def manifest(self) -> dict:
        """Live runs of postings and windows, of texts ([name, parts, tier]) and boilerplate, and the last batch's decisions."""
        last = self.files.last("manifests")
        return last or {"postings": [], "windows": [], "texts": [], "hot": [], "decided": {}, "buckets": None, "n": 0}

    @staticmethod
    def _decisions(batch: str) -> str:
        return f"decided/{hashlib.sha256(batch.encode()).hexdigest()}"

    def decided(self, batch: str) -> dict | None:
        """Where the decisions on a batch are; None if it isn't in the index."""
        now, name = self.manifest(), self._decisions(batch)
        return now["decided"].get(batch) or (self.files.content(name) if self.files.exists(name) else None)

    def _commit(self, now: dict, **changed) -> None:
        for batch, own in now["decided"].items():  # the manifest holds one batch's, however many there are
            self.files.claim(self._decisions(batch), json.dumps(own))
        new = now | {"decided": {}} | changed | {"buckets": self.buckets, "n": now["n"] + 1}
        if not self.files.claim(f"manifests/{new['n']:09d}", json.dumps(new)):
            raise RuntimeError("another writer has committed to the index meanwhile")
        own = json.dumps(new)
        for tag in self._TAGS:  # of this number's attempts only what was committed stays
            for name in self.files.names(f"{tag}/{new['n']:09d}"):
                if name not in own:
                    self.files.delete(f"{tag}/{new['n']:09d}/{name}")
        self._remove([name for name in self.files.names("") if f"_{new['n']:09d}_" in name and name not in own])
        self.files.delete("work")

    def _save(self, rows: DataFrame, tag: str, now: dict, by: str | None = None) -> str:
        """Writes a table within the index; it counts once a manifest names it."""
        name = f"{tag}/{now['n'] + 1:09d}/{uuid.uuid4().hex}"
        out = rows.write.options(**PACKED)
        (out.partitionBy(by) if by else out).parquet(f"{self.root}/{name}")
        return name

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _cut(self, rows: DataFrame, tag: str) -> DataFrame:
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{self._save(rows, f'work/{tag}', {'n': 0})}")

    def _write(self, rows: DataFrame, kind: str, now: dict, tier: int = 0) -> str:
        name, keys = f"{kind}_{tier}_{now['n'] + 1:09d}_{uuid.uuid4().hex}", self._KINDS[kind][1]
        rows.write.options(**PACKED).bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            schema, keys = self._KINDS[name.split("_")[0]]
            by = ", ".join(keys)
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")
        return self.spark.table(name)

    def _remove(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.files.delete(name)

    def drop(self) -> None:
        """Removes the whole index but the facts and decisions of its batches."""
        now = self.manifest()
        self._remove(now["postings"] + now["windows"])
        for name in [*now["hot"], *[t[0] for t in now["texts"]]]:
            self.files.delete(name)

    def _boilerplate(self, now: dict) -> DataFrame:
        """(fp) of all that was boilerplate in some batch."""
        rows = self.spark.createDataFrame([], "fp long")
        for name in now["hot"]:
            rows = rows.unionByName(self._read(name, "fp long"))
        return rows.distinct()

    def text_paths(self, now: dict, wanted: DataFrame) -> list[str]:
        """Where the texts of the documents in `wanted` (doc_id) are: runs of single batches, and of compacted ones the parts with a wanted text."""
        out = []
        for name, parts, _ in now["texts"]:
            if not parts:
                out.append(f"{self.root}/{name}")
                continue
            have = set(self.files.names(name))
            own = wanted.select(_part(parts).alias("p")).distinct().collect()  # TEXT_PARTS at most
            out += [f"{self.root}/{name}/part={r['p']}" for r in own if f"part={r['p']}" in have]
        return out

    def _owned(self, rows: DataFrame, now: dict) -> DataFrame:
        """(a, b, owner, n): the smallest doc_id of each pair of hashes among rows (doc_id, a, b) and in history, and how many have it, runs of history counting once."""
        got = rows.groupBy("a", "b").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n"))
        for name in now["windows"]:
            before = self._run(name).groupBy("a", "b").agg(F.min("owner").alias("_before"))
            got = got.join(before, ["a", "b"], "left").withColumns({"owner": F.least("owner", "_before"), "n": F.col("n") + F.col("_before").isNotNull().cast("long")}).drop("_before")
        return got.select("a", "b", "owner", "n")

    def _hot(self, docs: DataFrame, n: int) -> DataFrame:
        """(fp) of the fingerprints of boilerplate; a bounded number."""
        some = docs if n <= HOT_SAMPLE else docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(n)) < HOT_SAMPLE)
        return some.select(F.explode("fps").alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * HOT_SHARE > min(n, HOT_SAMPLE)).filter("_n > 8").select("fp")

    def add(self, batch: str, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Adds a batch of documents, unless one of this name is there already, and gives what was decided on it.

        (doc_id, key, n_words, whole, copy) of each row of the batch; (doc_id, key, starts) of the documents
        that lose windows; (doc_id, key, ..., text) of the batch's rows.
        """
        own, texts = self.decided(batch), None
        if own is None:
            self.compact()
            own = self._judge(self.manifest(), batch, docs)
            texts = self._read(own["texts"], _TEXTS)
        return self._read(own["facts"], _FACTS), self._read(own["starts"], _STARTS), _digested(docs) if texts is None else texts

    def _judge(self, now: dict, batch: str, docs: DataFrame) -> dict:
        stored = self._save(_digested(docs), "texts", now)
        rows = self._read(stored, _TEXTS)
        # copies: rows whose words a smaller doc_id has, all of them
        known = rows.select("doc_id", F.col("key").alias("a"), F.col("mark").alias("b"), "key", "n_words", "whole")
        wholes = self._write(self._owned(known.filter("doc_id is not null"), now), "windows", now)
        owners = self._run(wholes).filter("n > 1")
        facts = self._save(attach_by_key(known, owners, ["a", "b"], "n").select("doc_id", "key", "n_words", "whole", F.coalesce(F.col("owner") < F.col("doc_id"), F.lit(False)).alias("copy")), "facts", now)
        first = self._read(facts, _FACTS)
        n = first.count()
        single = self._cut(_without(rows.select("doc_id", "key", "fps"), first.filter("copy").select("doc_id", "key")).filter("size(fps) > 0").select("doc_id", "fps"), "single")
        hot = self._save(self._hot(single, n), "hot", now)
        boiler = F.broadcast(self._read(hot, "fp long"))
        each = single.select(F.explode("fps").alias("fp"), "doc_id")
        postings = self._write(each.join(boiler, "fp", "left_anti").repartition(self.buckets, "fp"), "postings", now)

        new = self._run(postings)
        shared = new.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).withColumns({"_held": F.lit(0), "_old": F.lit(None).cast("long")})
        for name in now["postings"]:
            before = self._run(name).groupBy("fp").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"))
            shared = shared.join(before, "fp", "left").withColumns({"_held": F.col("_held") + F.when(F.col("_lo").isNull(), 0).when(F.col("_lo") < F.col("_hi"), 2).otherwise(1), "_old": F.coalesce("_old", "_lo")}).drop("_lo", "_hi")
        alone = F.when(F.col("_held") == 1, F.col("_old"))  # a document of history that had the fingerprint alone
        if now["hot"]:
            shared = shared.join(self._boilerplate(now).withColumn("_hot", F.lit(True)), "fp", "left").withColumn("_held", F.col("_held") + F.when(F.col("_hot"), 2).otherwise(0)).drop("_hot")
        shared = shared.filter("lo < hi or _held > 0").select("fp", alone.alias("old"))
        hits = new.join(shared, "fp").select("doc_id", "fp", "old")
        boilers = each.join(boiler, "fp").select("doc_id", "fp", F.lit(None).cast("long").alias("old"))
        hits = self._cut(hits.unionByName(boilers), "hits")
        met = hits.filter("old is not null").select(F.col("old").alias("doc_id"), "fp")
        if now["postings"]:  # of what is boilerplate now, too: who of history had it alone
            held = None
            for name in now["postings"]:
                part = self._run(name).join(boiler, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                held = part if held is None else held.unionByName(part)
            held = held.groupBy("fp").agg(F.min("lo").alias("doc_id"), F.max("hi").alias("hi")).filter("doc_id = hi")
            if now["hot"]:
                held = held.join(self._boilerplate(now), "fp", "left_anti")
            met = met.unionByName(held.select("doc_id", "fp"))

        wanted = hits.groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
        texts = _picked(rows.select("doc_id", "key", "text"), self._cut(wanted, "wanted")).withColumn("old", F.lit(False))
        if now["texts"]:
            wanted = self._cut(met.groupBy("doc_id").agg(F.collect_set("fp").alias("fps")), "wanted-old")
            if paths := self.text_paths(now, wanted):
                before = self.spark.read.schema("doc_id long, key long, text string").parquet(*paths)
                texts = texts.unionByName(_picked(before, wanted).withColumn("old", F.lit(True)))
        found = self._cut(windows(texts), "found")
        owned = self._write(self._owned(found, now), "windows", now)
        several = self._run(owned).filter("n > 1")
        later = attach_by_key(found.filter("not old").drop("old"), several, ["a", "b"], "n").filter("owner < doc_id")
        starts = self._save(later.groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts")), "starts", now)
        own = {"facts": facts, "starts": starts, "texts": stored}
        self._commit(now, postings=[*now["postings"], postings], windows=[*now["windows"], wholes, owned], texts=[*now["texts"], [stored, 0, 0]], hot=[*now["hot"], hot], decided={batch: own})
        return own

    def compact(self) -> None:
        """Merges the runs of each tier that has over MAX_RUNS of them (twice as many of windows, two for each batch) into one of the next, and removes them."""
        while True:
            now = self.manifest()
            merged, old = {}, []
            for kind in self._KINDS:
                tier, runs = _fullest(now[kind], lambda name: int(name.split("_")[1]), MAX_RUNS * (2 if kind == "windows" else 1))
                if runs:
                    rows = self._run(runs[0])
                    for r in runs[1:]:
                        rows = rows.unionByName(self._run(r))
                    if kind == "postings":
                        ends = rows.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                        rows = ends.select("fp", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("doc_id"))
                    else:
                        rows = rows.groupBy("a", "b").agg(F.min("owner").alias("owner"), F.sum("n").alias("n"))
                    merged[kind] = [*[r for r in now[kind] if r not in runs], self._write(rows.repartition(self.buckets, *self._KINDS[kind][1]), kind, now, tier + 1)]
                    old += runs
            gone = []
            tier, runs = _fullest(now["texts"], lambda t: t[2], MAX_RUNS)
            if runs:
                rows = self._read(runs[0][0], _PICKED)
                for r in runs[1:]:
                    rows = rows.unionByName(self._read(r[0], _PICKED))
                parts = max(1, min(TEXT_PARTS, rows.count() // PART_DOCS))
                dealt = rows.withColumn("part", _part(parts)).repartition("part")
                merged["texts"] = [*[t for t in now["texts"] if t not in runs], [self._save(dealt, "texts", now, "part"), parts, tier + 1]]
                gone += [t[0] for t in runs]
            if len(now["hot"]) > MAX_RUNS:
                merged["hot"] = [self._save(self._boilerplate(now), "hot", now)]
                gone += now["hot"]
            if not merged:
                return
            self._commit(now, **merged)
            self._remove(old)
            for name in gone:
                self.files.delete(name)


def _part(parts: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")


def _fullest(runs: list, tier_of, most: int) -> tuple[int, list]:
    """The lowest tier with more than `most` runs, and these; none: no runs."""
    for tier in sorted({tier_of(r) for r in runs}):
        own = [r for r in runs if tier_of(r) == tier]
        if len(own) > most:
            return tier, own
    return 0, []


_PICKED = "doc_id long, key long, text string"
_FACTS = "doc_id long, key long, n_words long, whole string, copy boolean"
_STARTS = "doc_id long, key long, starts array<int>"
_TEXTS = "doc_id long, key long, mark int, n_words long, whole string, text string, fps array<long>"


def _kept(rows: DataFrame) -> DataFrame:
    """(doc_id, key, n_removed, kept) of rows (doc_id, key, text, starts): words of covered positions go."""
    t = rows.withColumn("_w", words_col(F.col("text")))
    t = t.withColumn("_gone", F.expr(f"array_distinct(flatten(transform(starts, s -> sequence(s, s + {WINDOW - 1}))))"))
    t = t.withColumn("_left", F.expr("transform(array_except(sequence(0, size(_w) - 1), _gone), i -> get(_w, i))"))
    return t.select("doc_id", "key", F.size("_gone").cast("long").alias("n_removed"), F.array_join("_left", " ").alias("kept"))


def _name(docs: DataFrame) -> str:
    """A name of a batch by its contents: the same rows in any order have the same."""
    h = F.xxhash64(F.col("doc_id").cast("long"), text_col()).cast("decimal(20,0)")
    n, a, b = docs.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.xxhash64(F.col("doc_id").cast("long"), text_col(), F.lit(1)).cast("decimal(20,0)"))).first()
    return f"{n}.{a}.{b}"


def dedup_substrings(docs: DataFrame, index: FingerprintIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """Per row (doc_id, n_words, n_removed, kept_sha256): words covered by a window that a smaller doc_id has go.

    The documents enter the index in `batches` ranges of doc_id, and are compared with all that it holds: with the
    documents of earlier calls on the same index too. What was decided on those stays as it was. A call with rows
    that are in the index already (as the same batches) gives the same result again. Without an index one of its own is used.

    Windows are judged on the input. Null texts have no words. Rows with a null doc_id lose nothing. Rows that
    repeat a doc_id, be it with other texts, are one document to each other: none of them loses words to another,
    each loses what its own text shares with a smaller doc_id, and each gives a row. Empty tables give no rows.
    Columns other than doc_id and text, whatever their names, are not read. A text's words are hashed at once, so
    a task needs some tens of bytes per word of its longest text.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or FingerprintIndex(spark, fresh_dir(spark, "substring-index"))
    d = F.col("doc_id").cast("long")
    lo, hi = docs.agg(F.min(d), F.max(d)).first()
    edges = [None] if lo is None else [lo + (hi - lo + 1) * k // batches for k in range(batches)] + [hi + 1]
    ranges = [docs.filter(d.isNull())] if lo is None else [docs.filter((d >= a) & (d < b) | (d.isNull() if a == lo else F.lit(False))) for a, b in zip(edges, edges[1:]) if a < b]
    out = None
    for k, part in enumerate(ranges):
        facts, starts, texts = index.add(f"part-{k}" if own else _name(part), part)
        kept = _kept(_picked(texts.select("doc_id", "key", "text"), starts.withColumnRenamed("key", "_key")).filter("key = _key").drop("_key"))
        kept = cut(kept.select("doc_id", "key", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).distinct(), "substring-kept")
        gone = F.col("copy") & (F.col("n_words") >= WINDOW)
        rows = facts.join(kept, ["doc_id", "key"], "left").select(
            "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))
        out = rows if out is None else out.unionByName(rows)
    if own:
        index.drop()
    return out


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
