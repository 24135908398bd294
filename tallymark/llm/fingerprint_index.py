"""Substring dedup with a log-structured fingerprint index.

The index is a folder of sorted immutable runs: fingerprints (anchor and content hash) of the window segments of
earlier documents, each with its first document.  A new batch of larger doc_ids is fingerprinted and
merge-joined with all runs; wherever the batch meets the history or itself under an anchor, the words themselves are
compared, and only what is equal word for word counts.  The batch's new fingerprints become a run of
their own.  When FANOUT runs have come together they are compacted into one and the old ones deleted.

`FingerprintIndex` keeps its list of runs in the folder: a later application opens it and adds the next batch (`add_batch`).

A word is removed if a window of WINDOW words over it also starts in a document with a smaller doc_id.

Defined results for odd input: a null text has no words; a null doc_id is neither compared nor changed; rows that repeat a
doc_id with its text are one document, rows that share a doc_id with other texts are documents of their own, in the order of a hash (`add_batch` refuses such a batch); texts under WINDOW words lose nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut, new_path, own_ids, parts, ready, remove, with_doc_ids
from .textkit import Prefix, word_hashes, words
from .windows import CHECK, FULL, NO_ID, ROW, RUN, Unit, all_marks, compact, finish, merge, removed_mask, same_bytes, scan_segments

WINDOW, ANCHOR = 13, 5
UNIT = Unit("word", WINDOW, ANCHOR, by_document=True)
FANOUT = 2
BATCHES = 3
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class FingerprintIndex:
    """Sorted runs in a folder that all executors share; batches must come in ascending ranges of doc_id.

    The folder holds runs and states; a state (the number of partitions, the largest doc_id, the live runs) is written after its runs and the one with
    the highest number counts, so a job that dies in between leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, n_parts: int | None = None, unit: Unit = UNIT, fanout: int = FANOUT):
        self.spark, self.path, self.unit, self.fanout = spark, path.rstrip("/"), unit, fanout
        self.version, self.names, self.last, self.n_parts = 0, [], None, n_parts
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(folder):
            state = spark.read.parquet(f"{self.path}/state/*").orderBy(F.desc("version")).first()
            self.version, self.names, self.last, self.n_parts = state.version, list(state.runs), state.last, state.n_parts
        if not self.n_parts:
            raise ValueError("a new index needs a number of partitions")

    def runs(self) -> list[DataFrame]:
        return [self.spark.read.schema(ROW).parquet(f"{self.path}/{name}") for name in self.names]

    def _save(self) -> None:
        self.version += 1
        row = [(self.version, self.n_parts, self.last, self.names)]
        self.spark.createDataFrame(row, "version int, n_parts int, last long, runs array<string>").coalesce(1).write.parquet(f"{self.path}/state/{self.version:08d}")

    def add(self, batch: DataFrame, store: bool = True) -> DataFrame:
        """What in the batch is repeated inside a task, and what must be compared; then its run joins the index."""
        low, high = batch.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is not None and self.last is not None and low <= self.last:
            raise ValueError(f"the index holds documents up to {self.last}; the batch begins at {low}")
        rows = scan_segments(batch, self.unit, self.n_parts)
        for run in self.runs():
            rows = rows.unionByName(run)
        base, name = f"{self.path}/batch-{uuid.uuid4().hex}", f"run-{uuid.uuid4().hex}"
        merge(rows, self.unit, self.n_parts, keep_runs=store).withColumn("of", F.when(F.col("kind") == RUN, "run").otherwise("marks")).write.option("compression", "zstd").partitionBy("of").parquet(base)
        if store:
            has_run = self._move(f"{base}/of=run", f"{self.path}/{name}")
            self.names += [name] * has_run
            self.last = high if self.last is None or (high is not None and high > self.last) else self.last
            if len(self.names) >= self.fanout:
                self.compact()
            else:
                self._save()
        return self.spark.read.schema(ROW).parquet(base).where(F.col("kind").isin(FULL, CHECK)).select("p", "kind", "weight", "blob")

    def _move(self, source: str, target: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = path(source).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return bool(system.exists(path(source)) and system.rename(path(source), path(target)))

    def compact(self) -> None:
        old, name = self.names, f"run-{uuid.uuid4().hex}"
        every = self.runs()[0]
        for run in self.runs()[1:]:
            every = every.unionByName(run)
        cut(compact(every), "run", f"{self.path}/{name}")
        self.names = [name]
        self._save()
        for run in old:
            remove(self.spark, f"{self.path}/{run}")


def repeated_windows(unit: Unit, doc: np.ndarray, size: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece and word in it of windows whose word sequence also starts in a smaller document; pieces are in the order of (doc, start)."""
    starts, ends, first = words(body, np.concatenate([[0], np.cumsum(size)]))
    piece = np.repeat(np.arange(len(size)), np.diff(first))
    at = np.flatnonzero(first[piece + 1] - np.arange(len(starts)) >= unit.window)
    if not len(at):
        return at, at
    h = Prefix(word_hashes(body, starts, ends)).range(at, at + unit.window)
    order = np.argsort(h, kind="stable")  # at is in the order of documents, so each group begins with its smallest
    at, h = at[order], h[order]
    begin, length = starts[at], ends[at + unit.window - 1] - starts[at]
    same = np.zeros(len(at), bool)
    near = np.flatnonzero((h[1:] == h[:-1]) & (length[1:] == length[:-1])) + 1
    same[near] = same_bytes(body, begin[near], begin[near - 1], length[near])  # verification: the words are equal byte for byte
    head = at[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]
    gone = at[doc[piece[at]] > doc[piece[head]]]
    return piece[gone], gone - first[piece[gone]]


def _result(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, marks) -> pa.Table:
    body, cum, first = UNIT.body(data, offsets)
    gone = removed_mask(UNIT, ids, first, marks)
    upto = np.concatenate([[0], np.cumsum(gone)])
    size = np.diff(cum)
    kept = body[np.repeat(~gone, size)].tobytes()  # one space after each word
    at = np.concatenate([[0], np.cumsum(size[~gone])])[first - upto[first]].tolist()
    sha = [hashlib.sha256(kept[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table({
        "doc_id": pa.array(ids, mask=ids == NO_ID),
        "n_words": np.diff(first), "n_removed": np.diff(upto[first]), "kept_sha256": pa.array(sha, pa.string()),
    })


def add_batch(batch: DataFrame, history: DataFrame, path: str, n_parts: int | None = None) -> DataFrame:
    """The digest of a batch against the index at path, which then holds the batch too.

    history has the documents of earlier batches (doc_id, text), whose words the verification reads.
    """
    batch, back = own_ids(ready(batch).select("doc_id", "text"))
    if back is not None:
        raise ValueError("rows of the batch share a doc_id with different texts; the index needs one text for each")
    index = FingerprintIndex(batch.sparkSession, path, n_parts or parts(batch, mb=4))
    marks = index.add(batch)
    return finish(batch, all_marks(batch.unionByName(history.select("doc_id", "text")), UNIT, marks, index.n_parts, repeated_windows), index.n_parts, _result, SCHEMA)


def digest(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; the index is filled in batches of ascending doc_id."""
    n_parts = parts(docs, mb=4)
    docs, back = own_ids(ready(docs).select("doc_id", "text"))
    index = FingerprintIndex(docs.sparkSession, new_path(docs.sparkSession, "index"), n_parts)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    bounds = sorted(set(cuts or []))
    marks = None
    for i in range(len(bounds) + 1):
        batch = docs
        if i > 0:
            batch = batch.where(F.col("doc_id") > bounds[i - 1])
        if i < len(bounds):
            batch = batch.where(F.col("doc_id") <= bounds[i])
        found = index.add(batch, store=i < len(bounds))  # nothing comes after the last batch
        marks = found if marks is None else marks.unionByName(found)
    for run in index.names:
        remove(docs.sparkSession, f"{index.path}/{run}")
    return with_doc_ids(finish(docs, all_marks(docs, UNIT, marks, n_parts, repeated_windows), n_parts, _result, SCHEMA), back)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)
), firsts AS (SELECT g, min(doc_id) AS d FROM wins GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM wins JOIN firsts USING (g), range(0, 13) r(k) WHERE doc_id > d
), each AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w
), kept AS (
  SELECT e.doc_id, string_agg(e.w[e.i], ' ' ORDER BY e.i) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
