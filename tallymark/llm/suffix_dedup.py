"""Exact substring dedup by suffix arrays.

A byte is removed if a WINDOW-byte string over it also starts earlier (in a smaller doc_id or earlier in its
document).  Segments of windows are dealt by their anchors (`windows`), byte-equal segments collapse, and what
differs under a shared anchor is suffix-sorted per group in two stages: suffixes smaller than their successors
are sorted directly (to the window's depth), all others are induced by scanning the buckets of first
bytes in order.  Adjacent common prefixes of WINDOW bytes or more make the groups of equal windows.

Defined results for odd input: a null text is empty; a null doc_id is neither compared nor changed; rows
that repeat a doc_id with its text are one document and lose the same bytes, rows that share a doc_id with other texts are documents of their own, in the order of a hash; texts under WINDOW bytes lose
nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import Scratch, own_ids, parts, ready, with_doc_ids
from .windows import NO_ID, Unit, all_marks, finish, merge, removed_mask, scan_segments

WINDOW, ANCHOR = 100, 32
UNIT = Unit("byte", WINDOW, ANCHOR, by_document=False)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from each position as one number that sorts like them; depth + 8 zero bytes follow the text."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    return np.ndarray((len(text) + depth + 8,), ">u8", padded.data, 0, (1,)).astype(np.uint64)


def sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the depth bytes from each, 8 bytes at a time among those that are equal so far."""
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    for d in range(8, depth, 8):
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        key = words[at[tied] + d]
        order = np.lexsort((key, group))
        at[tied] = at[tied][order]
        key, group = key[order], group[order]
        split = np.ones(len(tied), bool)
        split[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[tied] = split
    return at


def suffix_array(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """All suffixes in the order of their first depth bytes (at least), by two-stage sorting."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    differs = np.flatnonzero(text[:-1] != text[1:])
    smaller = np.zeros(n, bool)  # smaller than its successor
    if len(differs):
        following = np.searchsorted(differs, np.arange(n))
        known = following < len(differs)
        at = differs[following[known]]
        smaller[known] = text[at] < text[at + 1]
    direct = sort_directly(np.flatnonzero(smaller), _words(text, depth), depth)
    ends = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, before all others
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        scanned = []
        while len(level):  # runs of c: a suffix with one more c follows
            scanned.append(level)
            before = level[level > 0] - 1
            level = before[text[before] == c]
        scanned.append(direct[ends[c] : ends[c + 1]])
        bucket = np.concatenate(scanned)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.searchsorted(first, np.arange(257))
        for f in np.flatnonzero(np.diff(cuts)).tolist():
            waiting[f].append(before[cuts[f] : cuts[f + 1]])
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in order whether it shares at least `least` bytes with the one before."""
    words = _words(text, least)
    same = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    for d in [*range(0, least - 7, 8), least - 8]:
        live = live[words[order[live] + d] == words[order[live - 1] + d]]
    same[live] = True
    return same


def repeated_windows(unit: Unit, doc: np.ndarray, size: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece and byte in it of windows that also start in an earlier piece or place; pieces are in the order of (doc, start)."""
    n = len(body)
    ends = np.repeat(np.cumsum(size), size)
    piece = np.repeat(np.arange(len(size)), size)  # a zero byte after each piece
    text = np.zeros(n + len(size), np.uint8)
    text[np.arange(n) + piece] = body
    inside = np.zeros(len(text), bool)
    inside[np.arange(n) + piece] = ends - np.arange(n) >= unit.window
    order = suffix_array(text, unit.window)
    order = order[inside[order]]
    if not len(order):
        return order, order
    new = ~common_prefixes(order, text, unit.window)
    first = np.minimum.reduceat(order, np.flatnonzero(new))
    gone = order[order != first[np.cumsum(new) - 1]]
    begin = np.cumsum(size + 1) - size - 1
    at = np.searchsorted(begin, gone, side="right") - 1
    return at, gone - begin[at]


def _result(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, marks) -> pa.Table:
    gone = removed_mask(UNIT, ids, offsets, marks)
    upto = np.concatenate([[0], np.cumsum(gone)])
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    edge = offsets[:-1][offsets[:-1] < len(gone)]
    begin[edge] = gone[edge]
    spans = np.concatenate([[0], np.cumsum(begin)])
    kept = data[~gone].tobytes()
    at = (offsets - upto[offsets]).tolist()
    sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table({
        "doc_id": pa.array(ids, mask=ids == NO_ID),
        "n_bytes": np.diff(offsets), "n_removed": np.diff(upto[offsets]), "n_spans": np.diff(spans[offsets]), "kept_sha256": pa.array(sha, pa.string()),
    })


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    scratch, n_parts = Scratch(docs.sparkSession), parts(docs, mb=4)
    docs, back = own_ids(ready(docs).select("doc_id", "text"))
    marks = scratch.cut(merge(scan_segments(docs, UNIT, n_parts), UNIT, n_parts, keep_runs=False), "marks")
    return with_doc_ids(finish(docs, all_marks(docs, UNIT, marks, n_parts, repeated_windows), n_parts, _result, SCHEMA), back)
