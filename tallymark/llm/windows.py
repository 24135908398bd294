"""Repeated windows over whole tables: the steps that exact substring dedup and the fingerprint index share.

Every window of W tokens belongs to one segment: the run of consecutive windows with the same
anchor (the least k-gram hash in the window, the leftmost on ties).  Equal windows have equal anchors, so they
meet under it.  Hashes only say what to look at; nothing is marked before its bytes have been compared:

* inside a task, segments with equal hashes are compared byte by byte with the first one and collapse, so a hot group of copies leaves
  every task as one entry;
* an anchor under which entries of several places meet sends the bytes of all of them (pieces) to one group; there, equal pieces are
  compared with the first one and collapse, and what differs is looked at window by window (`compare`).

Entries and pieces travel as packed arrays: one blob per task and partition.  Three groupings by a partition number
follow each other: entries by anchor, texts with their marks by document, and pieces by anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Prefix, byte_values, chunks, column, dealt, mix, pack, unpack, word_hashes, words, tidy

NO_ID = -(1 << 63)
ROW = "p int, kind int, weight long, blob binary"
FULL, CHECK, RUN, TEXT = 1, 2, 3, 0
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class Unit:
    """What a window is made of and when an occurrence is removed."""

    kind: str  # byte or word
    window: int
    anchor: int
    by_document: bool  # removed only if the window starts in a smaller doc_id; else also if earlier in the same document

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token values and the documents' token offsets."""
        if self.kind == "byte":
            return byte_values(data), offsets
        starts, ends, first = words(data, offsets)
        return word_hashes(data, starts, ends), first

    def body(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Bytes that say the same as the tokens (words with one space behind each), where each token begins in them and the end (None: token
        numbers are places), and the documents' token offsets."""
        if self.kind == "byte":
            return data, None, offsets
        starts, ends, first = words(data, offsets)
        size = ends - starts + 1
        cum = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(starts - cum[:-1], size) + np.arange(cum[-1])
        body = np.append(data, np.uint8(32))[take] if len(take) else np.zeros(0, np.uint8)
        body[cum[1:] - 1] = 32
        return body, cum, first


def same_bytes(body: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes from a and from b are equal, for each of some places; sizes are 1 or more."""
    ok = np.ones(len(a), bool)
    for i, j in chunks(np.concatenate([[0], np.cumsum(size)]), 1 << 20):
        n = size[i:j]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(begin, n)
        equal = body[np.repeat(a[i:j], n) + step] == body[np.repeat(b[i:j], n) + step]
        ok[i:j] = np.logical_and.reduceat(equal, begin)
    return ok


def _sliding_least(v: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost least value in every span of values."""
    pos, width = np.arange(len(v), dtype=np.int32), 1
    while width < span:
        step = min(width, span - width)
        n = len(v) - step
        take = v[step:] < v[:n]
        pos, v = np.where(take, pos[step:], pos[:n]), np.where(take, v[step:], v[:n])
        width += step
    return pos


def segments(unit: Unit, values: np.ndarray, offsets: np.ndarray):
    """start, windows, anchor and content hash of all segments (token positions in values)."""
    w, k = unit.window, unit.anchor
    none = np.zeros(0, np.int64)
    if len(values) < w:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    seq = Prefix(values)
    v = seq.grams(k)
    least = _sliding_least((v >> np.uint64(32)).astype(np.uint32), w - k + 1)
    long = np.diff(offsets) >= w
    change = np.zeros(len(values) + 1, np.int32)
    np.add.at(change, offsets[:-1][long], 1)
    np.add.at(change, offsets[1:][long] - w + 1, -1)
    at = np.flatnonzero(np.cumsum(change)[: len(values) - w + 1])
    if not len(at):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    first = np.flatnonzero(new)
    start, n = at[first], np.diff(np.append(first, len(at)))
    return start, n, v[least[start]], seq.range(start, start + n + w - 1)


def _entries(blob) -> tuple[np.ndarray, ...]:
    raw = unpack(blob)
    n = len(raw) // 32
    return (*(np.frombuffer(raw, t, n, 8 * n * i) for i, t in enumerate((np.uint64, np.uint64, np.int64))), np.frombuffer(raw, np.int32, n, 24 * n), np.frombuffer(raw, np.int32, n, 28 * n))


def _marks(blob) -> tuple[np.ndarray, ...]:
    raw = unpack(blob)
    n = len(raw) // 24
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.int32, n, 16 * n), np.frombuffer(raw, np.int32, n, 20 * n)


def _collapse(unit: Unit, anchor, seg, doc, start):
    """(order, first-of-group flags, representatives flags): groups of equal segments in (doc, start) order."""
    order = np.lexsort((start, doc))
    order = order[np.argsort(anchor[order] ^ mix(seg[order]), kind="stable")]
    a, s, d, t = anchor[order], seg[order], doc[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    same_doc = d == d[head]
    rep = same_doc if unit.by_document else same_doc & (t == t[head])
    return order, new, rep


def _doc_part(doc: np.ndarray, n_parts: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)


def gather(body: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The size bytes from each place, one after the other."""
    out = np.empty(int(size.sum()), np.uint8)
    upto = np.concatenate([[0], np.cumsum(size)])
    for i, j in chunks(upto, 1 << 20):  # bounds the indexes
        n = size[i:j]
        out[upto[i] : upto[j]] = body[np.repeat(begin[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return out


def _deal(part: np.ndarray, kind: int, weight: np.ndarray | None, *arrays: np.ndarray):
    """Rows (p, kind, weight, blob) with the entries of each partition, in their order."""
    return [(p, kind, int(weight[i].sum()) if weight is not None else len(i), pack(*(x[i] for x in arrays))) for p, i in dealt(part)]


_SCHEMA = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("weight", pa.int64()), ("blob", pa.binary())])


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(cols, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def scan_some(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, unit: Unit, n_parts: int) -> pa.Table:
    """Rows of some documents: what is equal among them collapses here."""
    found = []
    for a, b in chunks(offsets, 1 << 20):
        values, toff = unit.tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        start, n, anchor, seg = segments(unit, values, toff)
        of = np.searchsorted(toff, start, side="right") - 1
        found.append((anchor, seg, a + of, (start - toff[of]).astype(np.int32), n.astype(np.int32)))
    anchor, seg, of, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = ids[of]
    order, new, rep = _collapse(unit, anchor, seg, doc, start)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.flatnonzero(~rep)
    if len(later):  # equal hashes: are the bytes equal too
        x, y = order[later], head[later]
        body, cum, first = unit.body(data, offsets)
        size = n.astype(np.int64) + unit.window - 1
        at = first[of] + start
        begin, stop = (at, at + size) if cum is None else (cum[at], cum[at + size])
        good = stop[x] - begin[x] == stop[y] - begin[y]
        good[good] = same_bytes(body, begin[x[good]], begin[y[good]], (stop - begin)[x[good]])
        rep[later[~good]] = True
    gone, keep = np.sort(order[~rep]), np.sort(order[rep])
    rows = _deal((anchor[keep] % np.uint64(n_parts)).astype(np.int64), RUN, None, *(x[keep] for x in (anchor, seg, doc, start, n)))
    first_of = np.empty(len(order), np.int64)
    first_of[order] = head
    # a repeated row (same doc_id and start as the first) is the same occurrence
    gone = gone[(doc[gone] != doc[first_of[gone]]) | (start[gone] != start[first_of[gone]])]
    return _table(rows + _deal(_doc_part(doc[gone], n_parts), FULL, None, anchor[gone], doc[gone], start[gone], n[gone]))


def scan_segments(docs: DataFrame, unit: Unit, n_parts: int) -> DataFrame:
    """Entries by anchor partition, and marks of what a task itself has found repeated by document partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = column(batch.column(1))
            for a, b in chunks(offsets, 8 << 20):
                yield from scan_some(ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], unit, n_parts).to_batches()

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(tidy(scan), ROW)


def merge_some(table: pa.Table, unit: Unit, n_parts: int, keep_runs: bool) -> pa.Table:
    """One anchor partition: new entries (kind RUN, weight >= 0) and history (weight < 0) that meet under an anchor are to be compared."""
    columns = [c.to_pylist() for c in table.columns]
    out = [(p, k, w, b) for p, k, w, b in zip(*columns, strict=True) if k == FULL]
    mine = [(w, _entries(b)) for _, k, w, b in zip(*columns, strict=True) if k == RUN]
    if not mine:
        return _table(out)
    part = columns[0][0]
    fresh = np.concatenate([np.full(len(e[0]), w >= 0) for w, e in mine])
    anchor, seg, doc, start, n = (np.concatenate(x) for x in zip(*(e for _, e in mine), strict=True))
    order, _, rep = _collapse(unit, anchor, seg, doc, start)
    once = np.ones(len(order), bool)  # an occurrence counts once, even if its row repeats
    once[1:] = np.any([x[order][1:] != x[order][:-1] for x in (anchor, doc, start)], axis=0)
    order, rep = order[once], rep[once]
    anchor, seg, doc, start, n, fresh = (x[order] for x in (anchor, seg, doc, start, n, fresh))
    by = np.argsort(anchor, kind="stable")
    a = anchor[by]
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.append(begin, len(a)))
    news = np.add.reduceat(fresh[by].astype(np.int64), begin)
    look = by[np.repeat((size > 1) & (news > 0), size)]
    out += _deal(_doc_part(doc[look], n_parts), CHECK, n[look].astype(np.int64) + unit.window - 1, anchor[look], doc[look], start[look], n[look])
    if keep_runs:  # the first of equal hashes stands for them in the index
        i = np.flatnonzero(fresh & rep)
        i = i[np.lexsort((seg[i], anchor[i]))]
        if len(i):
            out.append((part, RUN, -len(i), pack(anchor[i], seg[i], doc[i], start[i], n[i])))
    return _table(out)


def merge(rows: DataFrame, unit: Unit, n_parts: int, keep_runs: bool) -> DataFrame:
    """Marks FULL and CHECK by document partition and, with keep_runs, the sorted run of new segments of each anchor partition."""
    return rows.groupBy("p").applyInArrow(tidy(lambda table: merge_some(table, unit, n_parts, keep_runs)), ROW)


def compact(runs: DataFrame) -> DataFrame:
    """All runs of a partition as one sorted run."""

    def run(table: pa.Table) -> pa.Table:
        anchor, seg, doc, start, n = (np.concatenate(x) for x in zip(*(_entries(b.as_py()) for b in table.column("blob")), strict=True))
        i = np.lexsort((seg, anchor))
        return _table([(table.column("p")[0].as_py(), RUN, -len(i), pack(anchor[i], seg[i], doc[i], start[i], n[i]))])

    return runs.groupBy("p").applyInArrow(tidy(run), ROW)


def packed_texts(docs: DataFrame, n_parts: int) -> DataFrame:
    """Rows (p, TEXT, ...) with the whole texts of many documents each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = column(batch.column(1))
            rows = []
            for p, i in dealt(_doc_part(ids, n_parts)):
                size = offsets[i + 1] - offsets[i]
                body = np.concatenate([data[offsets[x] : offsets[x + 1]] for x in i.tolist()])
                rows.append((p, TEXT, len(i), pack(ids[i], size, body)))
            yield from _table(rows).to_batches()

    return docs.select("doc_id", "text").mapInArrow(tidy(scan), ROW)


def read_group(table: pa.Table):
    """ids, offsets and bytes of the texts of a group, by doc_id, and its marks by kind."""
    ids, sizes, bodies, marks = [], [], [], {FULL: [], CHECK: []}
    for kind, weight, blob in zip(table.column("kind").to_pylist(), table.column("weight").to_pylist(), table.column("blob"), strict=True):
        if kind == TEXT:
            raw = unpack(blob.as_py())
            ids.append(np.frombuffer(raw, np.int64, weight))
            sizes.append(np.frombuffer(raw, np.int64, weight, 8 * weight))
            bodies.append(np.frombuffer(raw, np.uint8, -1, 16 * weight) if len(raw) > 16 * weight else np.zeros(0, np.uint8))
        else:
            marks[kind].append(_marks(blob.as_py()))
    marks = {k: tuple(np.concatenate(x) for x in zip(*v, strict=True)) if v else tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int32, np.int32)) for k, v in marks.items()}
    if not ids:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8), marks
    ids, sizes, data = np.concatenate(ids), np.concatenate(sizes), np.concatenate(bodies)
    return ids, np.concatenate([[0], np.cumsum(sizes)]), data, marks


def cut_out(table: pa.Table, unit: Unit, n_parts: int) -> pa.Table:
    """The bytes of the segments to compare of a group of documents."""
    ids, offsets, data, found = read_group(table)
    anchor, doc, start, n = found[CHECK]
    if not len(doc) or not len(ids):
        return _table([])
    once = np.unique(np.stack([doc, start.astype(np.int64)], 1), axis=0, return_index=True)[1]
    anchor, doc, start, size = anchor[once], doc[once], start[once].astype(np.int64), n[once].astype(np.int64) + unit.window - 1
    known, row = np.unique(ids, return_index=True)
    row = row[np.searchsorted(known, doc)]  # the text of each mark
    rows = []
    for a, b in chunks(offsets, 4 << 20):
        own = np.flatnonzero((row >= a) & (row < b))
        if not len(own):
            continue
        body, cum, toff = unit.body(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        at = toff[row[own] - a] + start[own]
        begin, stop = (at, at + size[own]) if cum is None else (cum[at], cum[at + size[own]])
        n = stop - begin
        for p, i in dealt((mix(anchor[own]) % np.uint64(n_parts)).astype(np.int64)):
            rows.append((p, TEXT, len(i), pack(doc[own[i]], start[own[i]], n[i], gather(body, begin[i], n[i]))))
    return _table(rows)


def pieces(texts: DataFrame, marks: DataFrame, unit: Unit, n_parts: int) -> DataFrame:
    """The bytes of all segments to compare, by a partition of their anchors."""
    return texts.unionByName(marks.where(F.col("kind") == CHECK)).groupBy("p").applyInArrow(tidy(lambda table: cut_out(table, unit, n_parts)), ROW)


def read_pieces(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, size and bytes of the pieces of a group, in the order of (doc, start)."""
    docs, starts, sizes, bodies = [], [], [], []
    for n, blob in zip(table.column("weight").to_pylist(), table.column("blob"), strict=True):
        raw = unpack(blob.as_py())
        docs.append(np.frombuffer(raw, np.int64, n))
        starts.append(np.frombuffer(raw, np.int64, n, 8 * n))
        sizes.append(np.frombuffer(raw, np.int64, n, 16 * n))
        bodies.append(np.frombuffer(raw, np.uint8, -1, 24 * n))
    doc, start, size, body = (np.concatenate(x) for x in (docs, starts, sizes, bodies))
    order = np.lexsort((start, doc))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    return doc[order], start[order], size[order], gather(body, begin[order], size[order])


def copies(unit: Unit, doc: np.ndarray, size: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Which pieces are, byte for byte, an earlier piece (of a smaller document, if that is the rule), so that all their windows go."""
    begin = np.cumsum(size) - size
    h = np.empty(len(size), np.uint64)
    for i, j in chunks(np.concatenate([[0], np.cumsum(size)]), 1 << 20):
        at = begin[i:j] - begin[i]
        h[i:j] = Prefix(byte_values(body[begin[i] : begin[j - 1] + size[j - 1]])).range(at, at + size[i:j])
    order = np.argsort(h, kind="stable")  # pieces are in the order of (doc, start)
    head = np.maximum.accumulate(np.where(np.concatenate([[True], h[order][1:] != h[order][:-1]]), np.arange(len(order)), 0))
    x, y = order, order[head]
    ok = (x != y) & (size[x] == size[y]) & ((not unit.by_document) | (doc[x] != doc[y]))
    ok[ok] = same_bytes(body, begin[x[ok]], begin[y[ok]], size[x[ok]])
    out = np.zeros(len(size), bool)
    out[x[ok]] = True
    return out


def compare_some(table: pa.Table, unit: Unit, n_parts: int, repeated: Callable) -> pa.Table:
    """Marks FULL of one group of pieces."""
    doc, start, size, body = read_pieces(table)
    copy = copies(unit, doc, size, body)
    left = np.flatnonzero(~copy)
    piece, offset = repeated(unit, doc[left], size[left], body[np.repeat(~copy, size)])  # of windows: place and token in it
    order = np.lexsort((offset, piece))
    piece, offset = left[piece[order]], offset[order]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(piece)))
    whole = np.flatnonzero(copy)
    spaces = np.concatenate([[0], np.cumsum(body == 32)])
    end = np.cumsum(size)[whole]
    tokens = size[whole] if unit.kind == "byte" else spaces[end] - spaces[end - size[whole]]
    d = np.concatenate([doc[piece[first]], doc[whole]])
    s = np.concatenate([start[piece[first]] + offset[first], start[whole]]).astype(np.int32)
    n = np.concatenate([n, tokens - unit.window + 1]).astype(np.int32)
    return _table(_deal(_doc_part(d, n_parts), FULL, None, np.zeros(len(d), np.uint64), d, s, n))


def compare(groups: DataFrame, unit: Unit, n_parts: int, repeated: Callable) -> DataFrame:
    """Marks FULL of the windows that are copies or that `repeated` finds in each group of pieces."""
    return groups.groupBy("p").applyInArrow(tidy(lambda table: compare_some(table, unit, n_parts, repeated)), ROW)


def all_marks(texts: DataFrame, unit: Unit, marks: DataFrame, n_parts: int, repeated: Callable) -> DataFrame:
    """FULL marks of everything to remove; texts are those of all documents under CHECK marks (others do no harm)."""
    volume = marks.where(F.col("kind") == CHECK).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    full = marks.where(F.col("kind") == FULL)
    if not volume:
        return full
    n_groups = max(12, -(-int(volume) * (1 if unit.kind == "byte" else 7) // PIECE_BYTES))
    groups = pieces(packed_texts(texts.where("doc_id is not null and text is not null"), n_parts), marks, unit, n_groups)
    return full.unionByName(compare(groups, unit, n_parts, repeated))


def removed_mask(unit: Unit, ids: np.ndarray, toff: np.ndarray, marks: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which tokens of a group's texts some marked window covers (rows that repeat a doc_id alike)."""
    _, doc, start, n = marks
    change = np.zeros(toff[-1] + 1, np.int32)
    if len(doc) and len(ids):
        order = np.argsort(ids, kind="stable")
        lo, hi = np.searchsorted(ids[order], doc, "left"), np.searchsorted(ids[order], doc, "right")
        copies = hi - lo
        row = order[np.repeat(lo - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())]
        at = toff[row] + np.repeat(start, copies)
        np.add.at(change, at, 1)
        np.add.at(change, at + np.repeat(n, copies) + unit.window - 1, -1)
    return np.cumsum(change)[:-1] > 0


def finish(docs: DataFrame, marks: DataFrame, n_parts: int, rows: Callable, schema: str) -> DataFrame:
    """Texts and their marks brought together; rows(ids, offsets, data, marks) makes the result of a group."""

    def run(table: pa.Table) -> pa.Table:
        ids, offsets, data, found = read_group(table)
        some = [rows(ids[a:b], offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], found[FULL]) for a, b in chunks(offsets, 4 << 20)]
        return pa.concat_tables(some) if some else rows(ids, offsets, data, found[FULL])

    return packed_texts(docs, n_parts).unionByName(marks).groupBy("p").applyInArrow(tidy(run), schema)
