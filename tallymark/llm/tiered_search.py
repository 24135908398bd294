"""Ranked lexical search over a tiered index.

`build` writes the index: a row per shard (the texts of a batch, about SHARD_BYTES) with its documents, its terms, and its postings in tiers.  A term's
postings in a shard are ordered by impact, the part of the score that depends on the document alone; the first tier holds as many as TIERS[0] of
the shard's documents, the next as many as TIERS[1], the last the rest.  Each tier keeps a residual bound per term: the highest impact
behind it (0 if nothing is left).  Tiers are columns, so a search that needs the first one reads only that.

`search` takes items in blocks of BLOCK_BYTES.  Round t scores an item by the tiers up to t: a document's score so far is a lower bound, and adding the
residual bounds of the terms that it was not seen with gives an upper one.  Tasks keep the best k of each item and the highest upper bound of all
others.  An item is proven when that bound, over all tasks, is under the k-th score; its k documents are then completed from the rest of
their shards.  Items without proof fall through to the next tier, where shards whose bound is under the k-th score known are passed over.  The last tier has no residual, so every
result is exact.

Ties go by ascending doc_id, null last.  Terms are compared as bytes.

Defined results for odd input: null texts and texts without terms are in no result, nor counted in N; an item without terms, or with none that
scores, has no rows; rows that repeat a doc_id are documents of their own, rows that repeat an item_id items of their own; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import new_path, ready
from .textkit import chunks, column, distinct, fold_ascii, pack, tidy, unpack, word_hashes

SHARD_BYTES = 8 << 20
#: Shares of a shard's documents up to which a term's postings fill each tier.
TIERS = (1 / 4, 1 / 2, 1.0)
#: Bytes of items searched at a time, items scored at a time in a shard, and results of an item.
BLOCK_BYTES, ROWS, K = 1 << 20, 256, 10
_TERM = np.ones(256, bool)
_TERM[:128] = [chr(c).isalnum() for c in range(128)]
_ITEM_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

ORACLE = r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts FROM documents),
e AS (SELECT row_number() OVER () AS r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM e),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM e) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * nn + 2.0) / (2.0 * df + 1.0))) AS BIGINT) AS w FROM f, s),
i AS (SELECT item, item_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS term FROM (SELECT row_number() OVER () AS item, * FROM benchmark)),
x AS (SELECT item, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // l))))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN p USING (term), s GROUP BY item, item_id, r, doc_id),
y AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 10
"""


def term_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all terms, and for each document where its terms begin."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]  # terms do not run on into the next text
    start[edge] = inside[1:-1][edge]
    end[edge - 1] = inside[1:-1][edge - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        data, offsets = column(batch.column(0))
        for a, b in chunks(offsets, SHARD_BYTES):
            n = np.diff(term_places(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[2])
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], names=["docs", "terms"])


def _postings(texts: pa.Array, n_all: int, l_all: int) -> tuple[bytes, list[bytes]]:
    """A shard's terms and its tiers; texts in the order of their ids."""
    data, offsets = column(texts)
    data, n_docs = fold_ascii(data), len(texts)
    starts, ends, edge = term_places(data, offsets)
    first, which = distinct(data, starts, ends)
    n = np.diff(edge)
    lengths, at = np.unique(n, return_inverse=True)
    m = np.array([10 + 90 * x * n_all // max(1, l_all) for x in lengths.tolist()], np.int64)[at]  # Python's integers cannot overflow
    key, tf = np.unique(which * n_docs + np.repeat(np.arange(n_docs), n), return_counts=True)
    term, doc = key // max(1, n_docs), key % max(1, n_docs)
    q = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    order = np.lexsort((-q, term))
    term, doc, q = term[order], doc[order], q[order]
    df = np.bincount(term, minlength=len(first))
    begin = np.cumsum(df) - df
    rank = np.arange(len(term)) - begin[term]
    size = ends[first] - starts[first]
    raw = data.tobytes()
    words = pack(np.array([len(first)], np.int64), size.astype(np.int32), df.astype(np.int32), np.frombuffer(b"".join([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]), np.uint8))
    tiers, lo = [], 0
    for share in TIERS:
        hi = n_docs if share == TIERS[-1] else max(lo, math.ceil(n_docs * share))
        mine = (rank >= lo) & (rank < hi)
        rest = np.zeros(len(first), np.int32)
        rest[df > hi] = q[(begin + hi)[df > hi]]
        tiers.append(pack(np.bincount(term[mine], minlength=len(first)).astype(np.int32), rest, doc[mine].astype(np.int32), q[mine].astype(np.int32)))
        lo = hi
    return words, tiers


def _shards(n_all: int, l_all: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(np.concatenate([[0], np.cumsum(size)]), SHARD_BYTES):
                part = batch.slice(a, b - a)
                part = part.take(pc.sort_indices(part.column(0), null_placement="at_end"))
                words, tiers = _postings(part.column(1), n_all, l_all)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in (words, *tiers)]], names=["shard", "ids", "words", *TIER_NAMES])
                k += 1

    return run


TIER_NAMES = [f"tier{t}" for t in range(len(TIERS))]
SHARDS = "shard long, ids array<long>, words binary, " + ", ".join(f"{t} binary" for t in TIER_NAMES)


class Index:
    """An index in a folder of the shared store; any session can open it by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
        self.docs, self.terms = spark.read.schema("docs long, terms long").parquet(f"{path}/stats").first()

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None) -> Index:
        spark = docs.sparkSession
        path = path or new_path(spark, "index")
        texts = ready(docs).select(F.col("doc_id").cast("long"), "text")
        counted = texts.select("text").mapInArrow(tidy(_count), "docs long, terms long")
        counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "terms")]).write.parquet(f"{path}/stats")
        n, total = spark.read.parquet(f"{path}/stats").first()
        texts.mapInArrow(tidy(_shards(n, total)), SHARDS).write.option("compression", "none").parquet(f"{path}/shards")  # the columns are compressed
        return cls(spark, path)


class Query:
    """A block of items: their terms, and once df is known the weights."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        own = [sorted({t.lower() for t in _ITEM_TERM.findall((text or "").encode())}) for _, text in items]
        self.terms = sorted({t for x in own for t in x})
        number = {t: i for i, t in enumerate(self.terms)}
        holders: list[list[int]] = [[] for _ in self.terms]
        for i, x in enumerate(own):
            for t in x:
                holders[number[t]].append(i)
        self.items = [np.array(x, np.int64) for x in holders]
        data = np.frombuffer(b"".join(self.terms), np.uint8)
        end = np.cumsum([len(t) for t in self.terms]).astype(np.int64)
        self.hash = word_hashes(data, end - [len(t) for t in self.terms], end) if self.terms else np.zeros(0, np.uint64)
        self.order = np.argsort(self.hash)
        self.weight = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: dict[int, int], n_all: int) -> None:
        for t, n in df.items():
            self.weight[t] = math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1)))

    def find(self, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term here, term of the shard, df in the shard) for the terms that a shard has."""
        raw = unpack(words)
        n = int(np.frombuffer(raw[:8], np.int64)[0])
        size, df = np.frombuffer(raw[8 : 8 + 8 * n], np.int32).reshape(2, n).astype(np.int64) if n else np.zeros((2, 0), np.int64)
        data = np.frombuffer(raw[8 + 8 * n :], np.uint8)
        end = np.cumsum(size)
        h, mine = word_hashes(data, end - size, end), self.hash[self.order]
        lo, hi = np.searchsorted(mine, h, side="left"), np.searchsorted(mine, h, side="right")
        found = [(int(self.order[x]), s) for s in np.flatnonzero(hi > lo).tolist() for x in range(lo[s], hi[s])]
        found = [(t, s) for t, s in found if data[end[s] - size[s] : end[s]].tobytes() == self.terms[t]]  # bytes decide
        t, s = np.array(found, np.int64).reshape(-1, 2).T
        return t, s, df[s]


class Tier:
    """A tier of a shard for the terms found."""

    def __init__(self, blob: bytes, n_terms: int, s: np.ndarray):
        raw = np.frombuffer(unpack(blob), np.int32)
        count, self.rest = raw[:n_terms].astype(np.int64), raw[n_terms : 2 * n_terms][s].astype(np.int64)
        n = int(count.sum())
        doc, q = raw[2 * n_terms : 2 * n_terms + n], raw[2 * n_terms + n :]
        end = np.cumsum(count)
        self.lists = [(doc[a:b], q[a:b].astype(np.int64)) for a, b in zip((end - count)[s].tolist(), end[s].tolist(), strict=True)]


def _score(query: Query, row: dict, rounds: int, active: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(items, scores, what may come on top) of a shard by its first tiers, for ROWS of the active items at a time.

    Items whose upper bounds are all under the k-th score known go no further than the tier that shows it.
    """
    t, s, _ = query.find(row["words"])
    keep = query.weight[t] > 0
    t, s = t[keep], s[keep]
    n_terms, n_docs = int(np.frombuffer(unpack(row["words"])[:8], np.int64)[0]), len(row["ids"])
    tiers: list[Tier] = []
    place = np.full(len(query.ids), -1, np.int64)
    for a in range(0, len(active), ROWS):
        items = active[a : a + ROWS]
        scores = np.zeros((len(items), n_docs), np.int64)
        for r in range(rounds):
            if r == len(tiers):
                tiers.append(Tier(row[TIER_NAMES[r]], n_terms, s))
            place[:] = -1
            place[items] = np.arange(len(items))
            own = [(p := place[query.items[x]])[p >= 0] for x in t.tolist()]
            for x, rows, (doc, q) in zip(t.tolist(), own, tiers[r].lists, strict=True):
                if len(rows) and len(doc):
                    scores[rows[:, None], doc] += query.weight[x] * q
            more = np.zeros_like(scores)
            for i, (x, rows) in enumerate(zip(t.tolist(), own, strict=True)):
                rest = int(query.weight[x] * tiers[r].rest[i])
                if rest and len(rows):
                    more[rows] += rest
                    for tier in tiers[: r + 1]:
                        more[rows[:, None], tier.lists[i][0]] -= rest
            open_ = (scores + more).max(axis=1, initial=0) >= known[items]
            if r + 1 < rounds and not open_.all():
                items, scores = items[open_], scores[open_]
            if not len(items):
                break
        else:
            yield items, scores, more


def _best(query: Query, rounds: int, active: np.ndarray, known: np.ndarray, k: int) -> Callable:
    """Map over shards: the k best documents of each item in the task, and a row without a shard with the highest bound of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((0, 7), np.int64)  # item, -score, null, doc_id, upper, shard, place
        bound = np.zeros(len(query.ids), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
                null = np.array([i is None for i in row["ids"]], np.int64)
                for items, scores, more in _score(query, row, rounds, active, known):
                    upper = scores + more
                    for x, score, up in zip(items.tolist(), scores, upper, strict=True):
                        some = np.argsort(-score, kind="stable")[:k]  # places are in the order of ids
                        some = some[score[some] > 0]
                        top = np.concatenate([top, np.stack([np.full(len(some), x), -score[some], null[some], ids[some], up[some], np.full(len(some), row["shard"]), some], axis=1)])
                        up[some] = 0
                        bound[x] = max(bound[x], up.max(initial=0))
                top = top[np.lexsort((top[:, 6], top[:, 5], top[:, 3], top[:, 2], top[:, 1], top[:, 0]))]
                rank = np.arange(len(top)) - np.searchsorted(top[:, 0], top[:, 0])
                np.maximum.at(bound, top[rank >= k, 0], top[rank >= k, 4])
                top = top[rank < k]
        others = np.flatnonzero(bound)
        none = pa.array([None] * len(others), pa.int64())
        column_of = lambda i, sign=1, mask=None: pa.array(sign * top[:, i], mask=mask)
        yield pa.RecordBatch.from_arrays([column_of(0), column_of(1, -1), column_of(3, 1, top[:, 2] > 0), column_of(4), column_of(5), column_of(6)], names=FOUND_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(others), none, none, pa.array(bound[others]), none, none], names=FOUND_NAMES)

    return run


FOUND = "item long, score long, doc_id long, upper long, shard long, place long"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _complete(query: Query, wanted: dict[int, list[tuple[int, int]]]) -> Callable:
    """Map over shards: the whole scores of documents (item, place) of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mine = wanted.get(row["shard"], [])
                items = np.array(sorted({i for i, _ in mine}), np.int64)
                out = []
                for group, scores, _ in _score(query, row, len(TIERS), items, np.zeros(len(query.ids), np.int64)):
                    at = {x: j for j, x in enumerate(group.tolist())}
                    out += [(i, row["shard"], p, int(scores[at[i], p])) for i, p in mine if i in at]
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "shard", "place", "score"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        block.append(tuple(row))
        size += len(row[1] or "") + 8
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search_block(index: Index, block: list[tuple], k: int = K, log: list | None = None) -> list[tuple]:
    """(item_id, rank, doc_id, score) of a block of items; log gets (round, items looked at, items proven)."""
    query = Query(block)
    if not query.terms or not index.docs:
        return []

    def count(batches):
        for batch in batches:
            total = np.zeros(len(query.terms), np.int64)
            for words in batch.column(0):
                t, _, df = query.find(words.as_py())
                np.add.at(total, t, df)
            t = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(total[t])], names=["t", "n"])

    df = index.shards.select("words").mapInArrow(tidy(count), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    query.weigh({r.t: r.n for r in df}, index.docs)
    active, known, out = np.arange(len(block)), np.zeros(len(block), np.int64), []
    for rounds in range(1, len(TIERS) + 1):
        shards = index.shards.select("shard", "ids", "words", *TIER_NAMES[:rounds])
        found = shards.mapInArrow(tidy(_best(query, rounds, active, known, k)), FOUND)
        # the k best of each item over all tasks, the others only as a bound: k structs and a number for each item
        order = Window.partitionBy("item").orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("doc_id"), "shard", "place")
        ranked = found.withColumn("in_top", F.col("shard").isNotNull() & (F.row_number().over(order) <= k))
        hit = F.struct("score", "doc_id", "upper", "shard", "place")
        rows = ranked.groupBy("item").agg(F.collect_list(F.when(F.col("in_top"), hit)).alias("best"), F.coalesce(F.max(F.when(~F.col("in_top"), F.col("upper"))), F.lit(0)).alias("bound")).collect()
        best = {r.item: r.best for r in rows}
        bound = {r.item: r.bound for r in rows}
        last = rounds == len(TIERS)
        proven = [x for x in active.tolist() if last or (len(best.get(x, [])) == k and min(r.score for r in best[x]) > bound.get(x, 0)) or not bound.get(x, 0)]
        if log is not None:
            log.append((rounds, len(active), len(proven)))
        wanted: dict[int, list[tuple[int, int]]] = {}
        for x in proven:
            for r in best.get(x, []):
                if r.upper > r.score:
                    wanted.setdefault(r.shard, []).append((x, r.place))
        whole = {}
        if wanted:
            some = index.shards.where(F.col("shard").isin(*wanted)) if len(wanted) <= 1000 else index.shards
            done = some.mapInArrow(tidy(_complete(query, wanted)), "item long, shard long, place long, score long")
            whole = {(r.item, r.shard, r.place): r.score for r in done.collect()}
        for x in proven:
            hits = [(-whole.get((x, r.shard, r.place), r.score), r.doc_id is None, r.doc_id or 0, r.doc_id) for r in best.get(x, [])]
            out += [(block[x][0], i + 1, h[3], -h[0]) for i, h in enumerate(sorted(hits, key=lambda h: h[:3]))]
        for x in active.tolist():
            if len(best.get(x, [])) == k:
                known[x] = min(r.score for r in best[x])
        active = np.array(sorted(set(active.tolist()) - set(proven)), np.int64)
        if not len(active):
            break
    return out


def search(index: Index, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item.  Blocks of results are written as they come."""
    spark, path = index.spark, new_path(index.spark, "found")
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _blocks(items):
        spark.createDataFrame(search_block(index, block, k), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def rank_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Build an index of all documents and search it for all items."""
    return search(Index.build(docs), items)
