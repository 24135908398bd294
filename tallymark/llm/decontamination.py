"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as UTF-8 bytes of their lower case with white-space runs as one space.  A benchmark item is
one unit, or overlapping pieces of UNIT bytes if longer than UNIT + STRIDE, so that a long item's parts are found
too.  A unit of m bytes occurs in a document if a region of it is within e = m * EDITS edits (rounded down).  By
the q-gram lemma such a region shares at least m + 1 - q (e + 1) q-grams with the unit, on diagonals
that differ by at most e; q is the largest up to Q for which that is 1 or more, so the filter loses nothing at any length.  Shared q-grams
are counted in diagonal bands that overlap by half, regions under that count are dropped, and those that remain are verified
by a banded alignment of the whole unit.

What is found: every item of Q to UNIT + STRIDE bytes that stands whole within its edits, and of a longer item any UNIT + STRIDE bytes.
A shorter part of an item is not a match.

The benchmark is read in blocks of at most BLOCK_BYTES (its size is measured first); the documents pass one map per block, row by row
and without a shuffle, and rest in the shared folder after every CHAIN blocks.  Documents of any length are processed whole: one whose q-grams
are equal to many of the benchmark's is counted in parts that overlap by more than a region.

Defined results for odd input: a null or empty document or item matches nothing; an item shorter than Q bytes matches only a
document that is nothing else; repeated rows, ids and null ids are rows of their own, with any number of blocks; an empty benchmark leaves every document clean;
an empty document table gives no rows; other columns pass `keep_clean` as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, ready
from .textkit import _IS_SEP, chunks, column, tidy

Q = 8
EDITS = 0.10
UNIT, STRIDE = 160, 80
BLOCK_BYTES = 4 << 20
CHAIN = 2
#: Pairs of equal q-grams that are counted at a time.
MOST_HITS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with single spaces, and the documents' new offsets."""
    sep = _IS_SEP[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(sep[1:] & sep[:-1])
    inner = offsets[:-1][offsets[:-1] < len(data)]
    keep[inner] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return np.where(sep, np.uint8(32), data)[keep], upto[offsets]


def qgrams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """Every q bytes (8 at most) as one number."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.ascontiguousarray(data) if q == 8 else np.concatenate([data, np.zeros(8 - q, np.uint8)])
    grams = np.ndarray((n,), "<u8", padded.data, 0, (1,))
    return grams if q == 8 else grams & np.uint64((1 << 8 * q) - 1)


def units(texts: list[str | None], ids: list[int]) -> list[tuple[int, bytes]]:
    """(item, bytes) of all units."""
    out = []
    for item, text in zip(ids, texts, strict=True):
        raw = np.frombuffer((pc.utf8_lower(text or "").as_py()).encode("utf-8"), np.uint8)
        body = normal(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" ")
        if len(body) <= UNIT + STRIDE:
            starts, size = [0], len(body)
        else:
            starts, size = sorted({*range(0, len(body) - UNIT, STRIDE), len(body) - UNIT}), UNIT
        out += [(item, body[s : s + size]) for s in starts if size]
    return out


def align(units: np.ndarray, sizes: np.ndarray, budget: np.ndarray, text: np.ndarray, left: np.ndarray, n: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Banded alignments of many (unit, region) pairs at once.

    For each pair: the fewest edits that turn the whole unit (a row of units, sizes bytes) into some part of
    the region text[left : left + n], on the diagonals low ... low + width - 1 (region - unit); budget + 1 if
    more than the budget.  Pairs leave the working set when they end or can't come back under the budget.
    """
    out = budget + 1
    steps = np.arange(width)
    live = np.arange(len(sizes))
    at = low[:, None] + steps
    far = int(sizes.max(initial=0)) + width + 1
    row = np.where((at >= 0) & (at <= n[:, None]), 0, far)
    for i in range(1, int(sizes.max(initial=0)) + 1):
        pos = at[live] + i  # region characters used
        last = n[live][:, None]
        ok = (pos >= 0) & (pos <= last)
        char = text[left[live][:, None] + np.clip(pos - 1, 0, last - 1)]
        best = row + ((char != units[live, i - 1][:, None]) | (pos < 1) | ~ok)
        np.minimum(best[:, :-1], row[:, 1:] + 1, out=best[:, :-1])
        best[~ok] = far
        row = np.minimum.accumulate(best - steps, axis=1) + steps
        least = row.min(axis=1)
        ended = sizes[live] == i
        if ended.any():
            out[live[ended]] = np.minimum(least[ended], out[live[ended]])
        stay = ~ended & (least <= budget[live])
        if not stay.all():
            live, row = live[stay], row[stay]
            if not len(live):
                break
    return out


class Grams:
    """Sorted q-grams of the units that share one q."""

    def __init__(self, q: int, units: list[np.ndarray], which: np.ndarray):
        keys = [qgrams(units[i], q) for i in which.tolist()]
        key, unit = np.concatenate(keys), np.repeat(which, [len(k) for k in keys])
        pos = np.concatenate([np.arange(len(k)) for k in keys])
        order = np.argsort(key, kind="stable")
        self.q, self.key, self.unit, self.pos = q, key[order], unit[order], pos[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.slot(self.key)] = True

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _ODD) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


class Index:
    """The units of one benchmark block."""

    def __init__(self, pieces: list[tuple[int, bytes]]):
        self.whole: dict[bytes, list[int]] = {}  # items too short for a q-gram
        for item, body in pieces:
            if len(body) < Q:
                self.whole.setdefault(body, []).append(item)
        pieces = [x for x in pieces if len(x[1]) >= Q]
        self.items = np.array([i for i, _ in pieces], np.int64)
        self.units = [np.frombuffer(b, np.uint8) for _, b in pieces]
        self.size = np.array([len(u) for u in self.units], np.int64)
        self.budget = np.floor(self.size * EDITS).astype(np.int64)
        q = np.minimum(Q, self.size // (self.budget + 1))
        self.least = self.size + 1 - q * (self.budget + 1)
        self.matrix = np.zeros((len(self.units), int(self.size.max(initial=1))), np.uint8)
        for row, u in zip(self.matrix, self.units, strict=True):
            row[: len(u)] = u
        self.grams = [Grams(k, self.units, np.flatnonzero(q == k)) for k in np.unique(q).tolist()]
        self.shift = int(max(1, self.budget.max(initial=0))).bit_length()  # bands of 2 << shift diagonals, the budget at most half

    def search(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, edits) for every unit found."""
        text, off = normal(data, offsets)
        found: dict[tuple[int, int], int] = {}
        if self.whole:
            for d in np.flatnonzero(np.diff(off) < Q + 2).tolist():
                for item in self.whole.get(text[off[d] : off[d + 1]].tobytes().strip(b" "), []):
                    found[d, item] = 0
        for grams in self.grams:
            self._search(grams, text, off, found)
        keys = sorted(found)
        d = np.array([k[0] for k in keys], np.int64)
        i = np.array([k[1] for k in keys], np.int64)
        return d, i, np.array([found[k] for k in keys], np.int64)

    def _search(self, grams: Grams, text, off, found) -> None:
        own = qgrams(text, grams.q)
        if not len(own):
            return
        at = np.flatnonzero(grams.filter[grams.slot(own)])
        lo = np.searchsorted(grams.key, own[at], side="left")
        hi = np.searchsorted(grams.key, own[at], side="right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        doc = np.searchsorted(off, at, side="right") - 1
        whole = at + grams.q <= off[doc + 1]
        at, lo, n, doc = at[whole], lo[whole], n[whole], doc[whole]
        of_doc = np.searchsorted(doc, np.arange(len(off)))  # where each document's hits begin
        upto = np.concatenate([[0], np.cumsum(n)])[of_doc]
        for a, b in chunks(upto, MOST_HITS):  # the hits of some documents at a time, a document with more of them in parts
            p, r = of_doc[a], of_doc[b]
            if r > p and upto[b] - upto[a] <= MOST_HITS:
                self._regions(grams, text, off, at[p:r], lo[p:r], n[p:r], doc[p:r], found)
            elif r > p:
                for i, j in self._parts(at[p:r], n[p:r]):
                    self._regions(grams, text, off, at[p + i : p + j], lo[p + i : p + j], n[p + i : p + j], doc[p + i : p + j], found)

    def _parts(self, at: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of the hits of one document, about MOST_HITS each, that overlap so far that every region lies wholly in one."""
        reach = int(self.size.max() + self.budget.max()) + (2 << self.shift) + Q
        upto, first = np.concatenate([[0], np.cumsum(n)]), 0
        while True:
            last = max(int(np.searchsorted(at, at[first] + 2 * reach)), int(np.searchsorted(upto, upto[first] + MOST_HITS, side="right")) - 1)
            if last >= len(at):
                yield first, len(at)
                return
            yield first, last
            first = int(np.searchsorted(at, at[last] - reach))

    def _regions(self, grams: Grams, text, off, at, lo, n, doc, found) -> None:
        rep = np.repeat(np.arange(len(n)), n)
        post = lo[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        unit = grams.unit[post]
        diag = at[rep] - off[doc[rep]] - grams.pos[post] + (int(self.size.max()) + 2)
        band = diag >> self.shift
        first = int(doc[0])
        top = int(band.max()) + 2
        base = ((doc[rep] - first) * len(self.units) + unit) * top
        key = np.concatenate([base + band, base + band - 1])  # a band is two neighbouring halves
        kinds, count = np.unique(key, return_counts=True)
        good = kinds[count >= self.least[(kinds // top) % len(self.units)]]
        if not len(good):
            return
        b, rest = good % top, good // top
        u, d = rest % len(self.units), rest // len(self.units) + first
        low = (b << self.shift) - (int(self.size.max()) + 2)
        width = 2 << self.shift
        start, end = off[d], off[d + 1]
        left = np.maximum(0, low)
        n = np.minimum(end - start, low + width + self.size[u]) - left
        for a in range(0, len(good), 1024):
            some = np.arange(a, min(a + 1024, len(good)))
            some = some[n[some] > 0]
            v = u[some]
            edits = align(self.matrix[v], self.size[v], self.budget[v], text, (start + left)[some], n[some], (low - left)[some], width)
            for k in np.flatnonzero(edits <= self.budget[v]).tolist():
                pair = (int(d[some[k]]), int(self.items[v[k]]))
                found[pair] = min(int(edits[k]), found.get(pair, 1 << 30))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's units, a bounded block at a time."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-int(total) // block_bytes)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        got = part.toArrow()
        yield units(got.column("text").to_pylist(), got.column("item_id").to_pylist())


_INDEXES: dict[str, Index] = {}


def _index(name: str, pieces: list[tuple[int, bytes]]) -> Index:
    """A worker's index of a block, kept for its next task; one or two at a time."""
    if name not in _INDEXES:
        if len(_INDEXES) >= CHAIN:
            _INDEXES.clear()
        _INDEXES[name] = Index(pieces)
    return _INDEXES[name]


def _find(index: Index, texts: pa.Array):
    data, offsets = column(pc.utf8_lower(texts))
    for a, b in chunks(offsets, 1 << 20):
        d, i, e = index.search(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield d + a, i, e


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, contaminated, items (sorted) and the fewest edits, for every document row."""
    rows = ready(docs).select("doc_id", "text", F.expr("cast(array() as array<bigint>) as items"), F.expr("cast(null as bigint) as edits"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("items", pa.list_(pa.int64())), ("edits", pa.int64())])
    for k, pieces in enumerate(blocks(benchmark, block_bytes)):

        def scan(batches: Iterator[pa.RecordBatch], pieces: list = pieces, name: str = uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(name, pieces)
            for batch in batches:
                items, edits = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for d, i, e in _find(index, batch.column(1)):
                    for x, y, z in zip(d.tolist(), i.tolist(), e.tolist(), strict=True):
                        items[x].append(y)
                        edits[x] = z if edits[x] is None else min(z, edits[x])
                items = pa.array([sorted(set(v)) for v in items], schema.field(2).type)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), items, pa.array(edits, pa.int64())], schema=schema)

        if k and k % CHAIN == 0:
            rows = cut(rows, "matches")
        rows = rows.mapInArrow(tidy(scan), "doc_id long, text string, items array<long>, edits long")
    return rows.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "edits")


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns as they are, without those that hold a benchmark unit."""
    docs, at = ready(docs), docs.columns.index("text")
    for k, pieces in enumerate(blocks(benchmark, block_bytes)):

        def scan(batches: Iterator[pa.RecordBatch], pieces: list = pieces, name: str = uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(name, pieces)
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for d, _, _ in _find(index, batch.column(at)):
                    clean[d] = False
                yield batch.filter(pa.array(clean))

        if k and k % CHAIN == 0:
            docs = cut(docs, "clean")
        docs = docs.mapInArrow(tidy(scan), docs.schema)
    return docs
