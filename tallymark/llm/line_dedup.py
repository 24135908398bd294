"""Fuzzy line dedup: MinHash, banding, exact verification and distributed union-find.

Lines are the \\n-separated parts that hold a word; A-Z count as lower case.  Two lines are alike if their sets
of SHINGLE-byte shingles have a Jaccard similarity of SIMILARITY or more (lines shorter than a
shingle: if they are equal).  Signatures are one-permutation MinHashes of BANDS x ROWS bins with empty bins
filled from their neighbours; lines that meet in a band are first paired with one line of the band and with the next
one.  Pairs are verified on the whole lines and joined by union-find; bands that then still touch several components
compare their members of different components, block by block, so that no pair that meets in a band and
joins two components is lost.  Each component keeps its first line by (doc_id, line number) and the others are removed.

Equal lines are one before any of this (partial aggregation), so a very common line costs no more than its scan.

Defined results for odd input: a null or empty text has no lines and stays as it is; lines without a
word stay; a document can lose all its lines and then has an empty text; rows with a null doc_id are left as they are;
rows that repeat a doc_id with the same text are one document, rows that share a doc_id with other texts are documents of their own, in the order of a hash; an empty table gives no rows; other columns
pass `without_repeats` as they are, whatever their names, but n_chars, if there, follows the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, blocks_of_mixed, pairs_in_groups
from .components import components
from .tables import Scratch, free_name, own_ids, parts, ready
from .textkit import WORD, Prefix, byte_values, chunks, column, dealt, fold_ascii, mix, pack, unpack, tidy

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: Estimated bytes up to which a table of line numbers by document is broadcast; beyond it the texts meet it in a shuffle.
BROADCAST_BYTES = 32 << 20
#: What a line counts besides its bytes in a block; dense cells of a block comparison.
LINE_COST, CELLS = 256, 1 << 22
#: Pairs of two blocks of a band from which they are compared as a matrix.
CROWD = 1 << 12
#: Bytes of text looked at at once: the arrays over them stay in the processor's cache.
STRETCH, SIGNED = 1 << 17, 1 << 16
#: Lines in one batch of occurrences at most, but for the last stretch's.
LINES = 1 << 18
_EMPTY = np.uint32(0xFFFFFFFF)
#: Factor of a bin's value by the distance of the empty bin that it fills.
_STEPS = np.multiply.accumulate(np.array([1] + [0x9E3779B1] * (BANDS * ROWS), np.uint32))


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document, number and has-a-word of every line."""
    breaks = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    per = 1 + np.diff(np.searchsorted(breaks, offsets))
    doc = np.repeat(np.arange(n), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    full = ends > starts
    if full.any():  # what lies between a line and the next one with bytes is breaks alone
        full[full] = np.logical_or.reduceat((data - np.uint8(9) > 4) & (data != 32), starts[full])
    return starts, ends, doc, number, full


def line_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Prefix(byte_values(folded)).range(starts, ends)


def signatures(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One-permutation MinHash signatures of lines of SHINGLE bytes or more, in the order of the text."""
    bins, n = BANDS * ROWS, ends - starts - SHINGLE + 1
    sig = np.full((len(starts) + 1, bins), _EMPTY, np.uint32)
    if not len(starts):
        return sig[:0]
    grams = np.ndarray((len(folded) - SHINGLE + 1,), "<u8", folded.data, 0, (1,)).copy()
    h = mix(grams)
    # the shingles of each line by turns with those that are no line's, which go to a row of their own
    rows, counts = (np.full(2 * len(starts) + 1, x) for x in (len(starts), 0))
    rows[1::2], counts[1::2] = np.arange(len(starts)), n
    counts[::2] = np.append(starts, len(grams)) - np.append(0, starts + n)
    cell = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).view(np.int64)
    cell += np.repeat(rows * bins, counts)
    np.minimum.at(sig.ravel(), cell, (h & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    sig = sig[:-1]
    rows = np.flatnonzero((sig == _EMPTY).any(axis=1))
    if len(rows):  # every line has a shingle, and no value of one is _EMPTY (they are even)
        part, own = sig[rows], np.arange(bins, dtype=np.int16)
        hole = part == _EMPTY
        after = np.where(hole, np.int16(2 * bins), own)
        after = np.minimum.accumulate(np.concatenate([after, after + np.int16(bins)], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :bins]
        part[hole] = (np.take_along_axis(part, (after % bins).astype(np.int64), axis=1) * _STEPS[after - own])[hole]
        sig[rows] = part
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) ^ sig[:, r::ROWS])
    return key


def _scan(texts: pa.Array):
    data, offsets = column(texts)
    for a, b in chunks(offsets, STRETCH):
        part = np.ascontiguousarray(data[offsets[a] : offsets[b]])
        yield a, part, split(part, offsets[a : b + 1] - offsets[a])


def occurrences(docs: DataFrame) -> DataFrame:
    """h, doc_id, line of every line with a word."""

    def rows(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["h", "doc_id", "line"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, n = batch.column(0).to_numpy(zero_copy_only=False), [], 0
            for a, part, (starts, ends, doc, number, full) in _scan(batch.column(1)):
                h = line_hashes(fold_ascii(part), starts[full], ends[full])
                found.append((h.view(np.int64), ids[a + doc[full]], number[full].astype(np.int32)))
                n += len(h)
                if n >= LINES:
                    yield rows(found)
                    found, n = [], 0
            if found:
                yield rows(found)

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(tidy(scan), "h long, doc_id long, line int")


def _small(df: DataFrame, lists: str, each: int) -> bool:
    """Whether rows of a doc_id and a list of `each` bytes an entry may be broadcast: their number and lengths are summed first."""
    n, entries = df.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return 64 * n + each * entries <= BROADCAST_BYTES


def candidates(docs: DataFrame, n_parts: int) -> DataFrame:
    """Pairs (a, b) of line hashes that meet in a band, and (key, a) of every member of a band of three or more.

    The key is a hash of the band's members: bands with the same members become one.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(1))
            found = []
            for a, part, (starts, ends, _, _, full) in _scan(batch.column(1)):
                long = full & (ends - starts >= SHINGLE)
                starts, ends = starts[long], ends[long]
                found.append((line_hashes(fold_ascii(part), starts, ends), offsets[a] + starts, offsets[a] + ends))
            h, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 3
            once = np.sort(np.unique(h, return_index=True)[1])  # equal lines are one, in the order of the text
            h, starts, ends = h[once], starts[once], ends[once]
            keys = []
            for i, j in chunks(np.append(starts, ends[-1:]), SIGNED):
                first = starts[i]
                keys.append(band_keys(signatures(fold_ascii(data[first : ends[j - 1]]), starts[i:j] - first, ends[i:j] - first)).ravel())
            if not keys:
                continue
            key, name = np.concatenate(keys), np.repeat(h, BANDS)
            rows = [(p, pack(key[i], name[i])) for p, i in dealt((key % np.uint64(n_parts)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["p", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        got = [np.frombuffer(unpack(b.as_py()), np.uint64) for b in table.column("blob")]
        key = np.concatenate([g[: len(g) // 2] for g in got])
        name = np.concatenate([g[len(g) // 2 :] for g in got])
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name = key[new], name[new]
        begin = np.concatenate([[True], key[1:] != key[:-1]])
        head = name[np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))]
        rest = np.flatnonzero(~begin)
        a, b = np.concatenate([head[rest], name[rest - 1]]), np.concatenate([name[rest], name[rest]])
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        first = np.flatnonzero(begin)
        size = np.diff(np.append(first, len(key)))
        many = np.repeat(size > 2, size)
        key = np.repeat(np.bitwise_xor.reduceat(mix(name), first), size) if len(name) else key
        none = pa.nulls(len(pairs), pa.int64())
        found = pa.table({"key": none, "a": pairs[:, 0].copy().view(np.int64), "b": pairs[:, 1].copy().view(np.int64)})
        more = pa.table({"key": key[many].view(np.int64), "a": name[many].view(np.int64), "b": pa.nulls(int(many.sum()), pa.int64())})
        return pa.concat_tables([found, more])

    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(tidy(bands), "p int, blob binary")
    return keyed.groupBy("p").applyInArrow(tidy(meet), "key long, a long, b long")


def _sorted_shingles(line: bytes) -> np.ndarray:
    folded = np.frombuffer(line.lower(), np.uint8)  # A-Z alone, as it is bytes
    grams = np.sort(np.ndarray((len(folded) - SHINGLE + 1,), "<u8", folded.data, 0, (1,)))
    new = np.ones(len(grams), bool)
    np.not_equal(grams[1:], grams[:-1], out=new[1:])
    return grams[new]


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets of shingles have the similarity; sizes that rule it out are not compared."""
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    merged = np.sort(np.concatenate([x, y]))
    common = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return common >= SIMILARITY * (len(x) + len(y) - common)


def bodies(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """h, body of the lines in the pairs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(firsts, "h")
    ids = scratch.cut(ids.groupBy("doc_id").agg(F.collect_list(F.struct("line", "h")).alias("wanted")), "wanted")
    few = _small(ids, "wanted", 32)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, lines = [], []
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                own = text.as_py().split("\n")
                for w in wanted.as_py():
                    h.append(w["h"])
                    lines.append(own[w["line"]].encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(lines, pa.binary())], names=["h", "body"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id").select("text", "wanted")
    return scratch.cut(rows.mapInArrow(tidy(pick), "h long, body binary").dropDuplicates(["h"]), "lines")


def verify(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs of line hashes whose lines are alike, by exact Jaccard similarity on the whole lines."""
    both = pairs.join(lines.withColumnsRenamed({"h": "b", "body": "lb"}), "b").join(lines.withColumnsRenamed({"h": "a", "body": "la"}), "a")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, last, sx = [], None, None
            for name, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if name != last:  # the pairs of a line follow each other
                    last, sx = name, _sorted_shingles(x.as_py())
                ok.append(_alike(sx, _sorted_shingles(y.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "la", "lb").mapInArrow(tidy(test), "a long, b long")


def _common(sets: list[np.ndarray], n_left: int) -> np.ndarray:
    """Numbers of shingles that the first n_left sets have in common with the others."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], (np.cumsum(count > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n_left, len(sets) - n_left), np.float64)
    n_cols = int(col[-1]) + 1 if len(col) else 0
    width = min(max(1, CELLS // len(sets)), n_cols)
    for c in range(0, n_cols, max(width, 1)):
        i, j = np.searchsorted(col, [c, c + width])
        cells = np.zeros((len(sets), width), np.float32)
        cells[row[i:j], col[i:j] - c] = 1
        out += cells[:n_left] @ cells[n_left:].T
    return out


def across(members: DataFrame, lines: DataFrame, group: DataFrame, n_parts: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of components that have like lines in a band; members: key, a.

    Every two blocks of a band meet in a group of their own, so a large band is compared in many tasks.
    """
    sized = lines.select(F.col("h"), (F.length("body") + LINE_COST).cast("long").alias("cost"))
    named = members.distinct().join(group, F.col("a") == F.col("node"), "left").select("key", F.col("a").alias("h"), F.coalesce("component", "a").alias("c"))
    met, n = blocks_of_mixed(named.join(sized, "h"), n_parts, scratch, BLOCK_BYTES)

    def test(table: pa.Table) -> pa.Table:
        key, h, c, block = (table.column(x).to_numpy() for x in ("key", "h", "c", "block"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        _, rep, member = np.unique(h, return_index=True, return_inverse=True)  # a line of many bands is cut into shingles once
        sets = [_sorted_shingles(x.as_py()) for x in table.column("body").take(pa.array(rep))]
        size = np.array([len(x) for x in sets], np.float64)
        a, b = [], []
        crowded = np.zeros(len(key), bool)
        for _, rows in dealt(key):
            left, right = rows[block[rows] == i], rows[block[rows] == j]
            if len(left) * len(right) <= CROWD:
                continue
            crowded[rows] = True
            x, y = member[left], member[right]
            common = _common([sets[k] for k in x.tolist()] + [sets[k] for k in y.tolist()], len(x))
            p, q = np.nonzero((c[left, None] != c[None, right]) & (common >= SIMILARITY * (size[x][:, None] + size[y][None, :] - common)))
            a.append(c[left][p])
            b.append(c[right][q])
        few = np.flatnonzero(~crowded)
        for x, y in pairs_in_groups(key[few], block[few], i, j):
            x, y = few[x], few[y]
            differ = c[x] != c[y]
            pairs = np.unique(np.stack([np.minimum(member[x], member[y])[differ], np.maximum(member[x], member[y])[differ]], 1), axis=0)
            good = np.array([_alike(sets[p], sets[q]) for p, q in pairs.tolist()], bool)
            a.append(c[rep[pairs[good, 0]]])
            b.append(c[rep[pairs[good, 1]]])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    full = met.join(lines, "h").select("key", "h", "c", "block", "i", "j", "body")
    return full.groupBy(F.pmod("key", F.lit(n)).alias("p"), "i", "j").applyInArrow(tidy(test), "a long, b long").distinct()


def removals(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers of the lines to remove (one row per document that loses a line)."""
    docs, scratch, n_parts = ready(docs), Scratch(docs.sparkSession), parts(docs)
    occ = scratch.cut(occurrences(docs), "occurrences")
    firsts = occ.groupBy("h").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"))
    firsts = scratch.cut(firsts.select("h", "first.doc_id", "first.line", "n"), "firsts")
    met = scratch.cut(candidates(docs, n_parts), "met")
    pairs = scratch.cut(met.where("key is null").select("a", "b").distinct(), "pairs")
    lines = bodies(docs, pairs, firsts.select("h", "doc_id", "line"), scratch)
    group = components(verify(pairs, lines), scratch)
    # bands of three or more that still touch several components
    more = scratch.cut(across(met.where("key is not null").select("key", "a"), lines, group, n_parts, scratch), "links")
    if not more.isEmpty():
        joined = components(more, scratch).withColumnsRenamed({"node": "root", "component": "least"})
        known = group.join(joined, F.col("component") == F.col("root"), "left").select("node", F.coalesce("least", "component").alias("component"))
        alone = joined.join(group, F.col("root") == F.col("node"), "left_anti").select(F.col("root").alias("node"), F.col("least").alias("component"))
        group = known.unionByName(alone)
    # only lines that occur again or have a like: the rest needs no join
    fuzzy = firsts.join(group, F.col("h") == F.col("node")).select("h", F.col("component").alias("root"), "doc_id", "line")
    keep = fuzzy.groupBy("root").agg(F.min(F.struct("doc_id", "line")).alias("keep"))
    fuzzy = fuzzy.join(keep, "root").select("h", "keep")
    exact = firsts.where("n > 1").join(group, F.col("h") == F.col("node"), "left_anti").select("h", F.struct("doc_id", "line").alias("keep"))
    losing = occ.join(fuzzy.unionByName(exact), "h").where((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("line") != F.col("keep.line")))
    out = scratch.cut(losing.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed")), "removed")
    scratch.close(out)
    return out


def _with_removed(docs: DataFrame) -> DataFrame:
    """docs, all columns, and the numbers of the lines to remove as the last one."""
    own, key, last = free_name(docs, "own_of"), free_name(docs, "removed_of"), free_name(docs, "removed")
    named, back = own_ids(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(docs.columns)]))
    gone = removals(named.select("doc_id", "text") if back is not None else docs.select(F.col("doc_id").cast("long"), "text"))
    few = _small(gone, "removed", 8)
    gone = gone.select(F.col("doc_id").alias(key), F.col("removed").alias(last))
    gone = F.broadcast(gone) if few else gone
    if back is None:
        return docs.join(gone, docs["doc_id"] == F.col(key), "left").select(*[docs[f"`{c}`"] for c in docs.columns], last)
    rows = named.select(F.col("doc_id").alias(own), *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)])
    return rows.join(gone, F.col(own) == F.col(key), "left").select(*[F.col(f"`{c}`") for c in docs.columns], last)


def _kept(text: str | None, removed: list[int] | None) -> tuple[str | None, int]:
    if text is None or not removed:
        return text, 0
    gone = set(removed)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), len(gone)


def without_repeats(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """docs, all columns, with one line of each component left in the texts.

    Documents that lose lines and keep less than the share `least` of their words go: what is left of them is no text of its own.
    """
    joined = _with_removed(docs)
    at, gone_at, word = docs.columns.index("text"), len(docs.columns), re.compile(WORD)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, stay = [], []
            for t, r in zip(batch.column(at).to_pylist(), batch.column(gone_at).to_pylist(), strict=True):
                kept, n = _kept(t, r)
                new.append(kept)
                stay.append(not least or not n or len(word.findall(kept)) >= least * len(word.findall(t)))
            arrays = [batch.column(i) for i in range(gone_at)]
            arrays[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:gone_at]).filter(pa.array(stay, pa.bool_()))

    out = joined.mapInArrow(tidy(scan), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the sha256 of the text that remains."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, removed, sha = np.zeros(len(batch), np.int64), [], []
            for a, _, (_, _, doc, _, full) in _scan(batch.column(1)):
                counts = np.bincount(doc[full])
                n_lines[a : a + len(counts)] = counts
            for t, r in zip(batch.column(1), batch.column(2), strict=True):
                new, n = _kept(t.as_py(), r.as_py())
                removed.append(n)
                sha.append(hashlib.sha256((new or "").encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines), pa.array(removed, pa.int64()), pa.array(sha)], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return _with_removed(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(tidy(scan), "doc_id long, n_lines long, n_removed long, kept_sha256 string")
