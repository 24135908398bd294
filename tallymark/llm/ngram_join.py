"""N-gram Jaccard join: a size-aware heavy-light set join.

A document's set holds its distinct SHINGLE-word shingles.  Equal sets are one class with one
representative; only representatives are joined.  Tokens have one order for all, from rare to
frequent by a sketch of fixed size (any order gives the same links; this one keeps lists short).
A link needs an overlap of most of both sets, so the first tokens of the two sets meet:

* small sets enumerate all subsets of two among their first p + 1 tokens and meet in a subset;
* large sets scan the inverted lists of their first p tokens;
* the boundary is where the subsets' cost passes that of the lists, both in expected rows; sets just above it
  do both, so that pairs across the boundary meet.

A list first pairs its members with one pivot (the member with the fewest rarer tokens), never all
with all; a positional bound and a bound from parity bitmaps drop pairs that can't reach the threshold.  Pairs are
verified exactly on the whole sets and links joined by union-find.  Lists that then still touch several components (lists with the
same members are one) compare the bitmaps of their members of different components, block by block in groups of bounded size, and only
pairs that the bitmaps allow leave a task and are verified; so no link that joins two components is lost.

Defined results for odd input: a null or blank text has no set and is its own component; texts under
SHINGLE words have one shingle; a null doc_id is in no group; rows repeating a doc_id with the same text are one document;
an empty table gives no rows; other columns pass `keep_one` as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocks_of_mixed, pairs_in_groups
from .components import components
from .tables import Scratch, free_name, parts, ready
from .textkit import Prefix, chunks, column, dealt, fold_ascii, mix, pack, unpack, word_hashes, words, tidy

SHINGLE = 4
NUMERATOR, DENOMINATOR = 85, 100
SKETCH_BITS = 20
SLICES = 64
BROADCAST_IDS = 500_000


def token_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    data = fold_ascii(data)
    starts, ends, first = words(data, offsets)
    seq = Prefix(word_hashes(data, starts, ends))
    grams = seq.grams(k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield seq.range(np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, np.uint64)


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, offsets = column(texts)
    for a, b in chunks(offsets, 1 << 20):
        yield from token_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)


def needed(n: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    """Least overlap with any set that a set of n must have to be linked."""
    return -(-num * n // den)


def first_pass(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per document: n and a 128-bit hash of its set; per task: slices of the token sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            n, s1, s2 = [], [], []
            pending: list[np.ndarray] = []
            for s in _sets(batch.column(1), k):
                n.append(len(s))
                s1.append(int(s.sum(dtype=np.uint64)))
                s2.append(int(mix(s).sum(dtype=np.uint64)))
                pending.append(s >> np.uint64(64 - SKETCH_BITS))
            if pending:
                counts += np.bincount(np.concatenate(pending).astype(np.int64), minlength=len(counts))
            none = pa.nulls(len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), none, pa.nulls(len(batch), pa.binary())], schema=schema)
        blobs = [pack(x) for x in counts.reshape(SLICES, -1)]
        empty = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(scan), "doc_id long, n long, s1 long, s2 long, slice int, counts binary")


def read_sketch(rows: DataFrame) -> np.ndarray:
    """Sums of the sketch's slices, added on the executors; 1 << SKETCH_BITS numbers come back."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(unpack(b.as_py()), np.int64) for b in table.column("counts"))
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([pack(total)], pa.binary())})

    got = rows.groupBy("slice").applyInArrow(tidy(add), "slice int, counts binary").toArrow().sort_by("slice")
    return np.concatenate([np.frombuffer(unpack(b.as_py()), np.int64) for b in got.column("counts")]) if got.num_rows else np.zeros(1 << SKETCH_BITS, np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Coarse frequency of each sketch cell relative to the mean, 0 to 31."""
    mean = max(counts.mean(), 4.0)
    return np.clip(np.floor(np.log2(np.maximum(counts / mean, 1)) * 2), 0, 31).astype(np.uint64)


def boundary(counts: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    """Largest size for which subsets cost no more rows than lists and the partners met in them."""
    total = max(counts.sum(), 1)
    met = max(0.0, float((counts.astype(float) ** 2).sum() / total / max(counts.mean(), 1) - 1))
    size = 1
    while size < 64:
        p = size + 1 - needed(size + 1, num, den) + 1
        if (p + 1) * p / 2 > p * (1 + met):
            break
        size += 1
    return size


def prefix_keys(tokens: np.ndarray, level: np.ndarray, bound: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set meets others, and the position of each key's first token in the set's order."""
    n = len(tokens)
    order = np.sort((level[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(58)) | (tokens >> np.uint64(6)))
    p = n - needed(n, num, den) + 1
    keys, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > bound:
        keys, at = mix(order[:p]), np.arange(p)
    if n <= bound * den // num + 1:
        pairs = np.array(list(combinations(range(min(n, p + 1)), 2)), np.int64).reshape(-1, 2)
        if len(pairs):
            keys = np.concatenate([keys, mix(order[pairs[:, 0]] * np.uint64(3) + mix(order[pairs[:, 1]]))])
            at = np.concatenate([at, pairs[:, 0]])
    return keys, at.astype(np.int32)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in about as many cells as there are tokens (a power of two)."""
    size = 1 << max(8, (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Sets differ in at least as many tokens as their bitmaps, folded to one size, differ in bits."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefixes(docs: DataFrame, reps: DataFrame, level: np.ndarray, bound: int, unique: bool, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, keys (packed) and bitmap of every representative with two shingles or more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, sizes, maps = [], [], []
            for s in _sets(batch.column(1), k):
                sizes.append(len(s))
                blobs.append(pack(*prefix_keys(s, level, bound, num, den)) if len(s) > 1 else None)
                maps.append(bitmap(s) if len(s) > 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary()), pa.array(maps, pa.binary())], names=["doc_id", "n", "keys", "bits"])

    own = docs.select("doc_id", "text").mapInArrow(tidy(scan), "doc_id long, n long, keys binary, bits binary").where("keys is not null").join(reps, "doc_id", "left_semi")
    return own if unique else own.dropDuplicates(["doc_id"])


def deal(own: DataFrame, n_parts: int) -> DataFrame:
    """The keys of all documents by partition, packed: a blob per task and partition.  own: doc_id, n, keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [unpack(b) for b in batch.column(2).to_pylist()]
            size = np.array([len(r) // 12 for r in raw], np.int64)
            if not size.sum():
                continue
            key, pos = (np.concatenate([np.frombuffer(r, t, m, at * m) for r, m in zip(raw, size.tolist(), strict=True)]) for t, at in ((np.uint64, 0), (np.int32, 8)))
            row = np.repeat(np.arange(len(size)), size)
            doc, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)[row] for i in (0, 1))
            rows = [(p, pack(key[i], doc[i], n[i].astype(np.int32), pos[i])) for p, i in dealt((key % np.uint64(n_parts)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["p", "blob"])

    return own.select("doc_id", "n", "keys").mapInArrow(tidy(scan), "p int, blob binary")


def _lists(table: pa.Table):
    """doc, n and pos of all members of lists of two or more, list by list, and the lists' begins and lengths."""
    got = [unpack(b.as_py()) for b in table.column("blob")]
    sizes = [len(g) // 24 for g in got]
    key, *cols = [np.concatenate([np.frombuffer(g, t, s, at * s) for g, s in zip(got, sizes, strict=True)]) for t, at in ((np.uint64, 0), (np.int64, 8), (np.int32, 16), (np.int32, 20))]
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(begin, len(key)))
    order, length = order[np.repeat(length > 1, length)], length[length > 1]
    doc, n, pos = (x[order] for x in cols)
    return doc, n.astype(np.int64), pos.astype(np.int64), (np.cumsum(length) - length).astype(np.int64), length


def _possible(na, ia, nb, ib, num: int, den: int) -> np.ndarray:
    """Whether members of a list at these positions can reach the overlap that their sizes need."""
    need = -(-(na + nb) * num // (num + den))
    return np.minimum(na - ia, nb - ib) >= need


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)


def stars(keyed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of each list's pivot and its other members, and (list, a) of every member of a list of three or more.

    A list is named by a hash of its members: lists with the same members become one.
    """

    def run(table: pa.Table) -> pa.Table:
        doc, n, pos, begin, length = _lists(table)
        if not len(begin):
            return pa.table({"list": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        by = np.lexsort((doc, pos, np.repeat(np.arange(len(begin)), length)))  # the pivot comes first
        head = np.repeat(by[begin], length)
        good = (doc != doc[head]) & _possible(n[head], pos[head], n, pos, num, den)
        pairs = _distinct(doc[good], doc[head][good])
        name = np.bitwise_xor.reduceat(mix(doc.astype(np.uint64)), begin)
        seen = np.zeros(len(begin), bool)
        seen[np.unique(name, return_index=True)[1]] = True
        many = np.repeat(seen & (length > 2), length)
        found = pa.table({"list": pa.nulls(len(pairs), pa.int64()), "a": pairs[:, 0], "b": pairs[:, 1]})
        more = pa.table({"list": np.repeat(name, length)[many].view(np.int64), "a": doc[many], "b": pa.nulls(int(many.sum()), pa.int64())})
        return pa.concat_tables([found, more])

    return keyed.groupBy("p").applyInArrow(tidy(run), "list long, a long, b long")


def fits(n: np.ndarray, bits: list[np.ndarray], x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of places have bitmaps, folded to the smaller size, that differ in few enough bits for a link."""
    size = np.array([len(b) for b in bits])
    both = n[x] + n[y]
    allowed = both - 2 * -(-both * num // (num + den))
    ok = np.zeros(len(x), bool)
    fold = lambda places, words_: np.stack([np.bitwise_xor.reduce(bits[k].reshape(-1, words_), axis=0) for k in places.tolist()])
    kind = size[x] * (int(size.max(initial=1)) + 1) + size[y]
    for _, some in dealt(kind):
        width = int(min(size[x[some[0]]], size[y[some[0]]]))
        for a in range(0, len(some), step := max(1, (1 << 20) // width)):
            pairs = some[a : a + step]
            left, i = np.unique(x[pairs], return_inverse=True)
            right, j = np.unique(y[pairs], return_inverse=True)
            differ = np.bitwise_count(fold(left, width)[i] ^ fold(right, width)[j]).sum(axis=1, dtype=np.int64)
            ok[pairs] = differ <= allowed[pairs]
    return ok


def across(members: DataFrame, bits: DataFrame, group: DataFrame, n_parts: int, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members of different components that meet in a list and whose bitmaps allow a link; members: list, a."""
    named = members.distinct().join(group, F.col("a") == F.col("node"), "left").select(F.col("list").alias("key"), F.col("a").alias("h"), F.coalesce("component", "a").alias("c"))
    sized = bits.select(F.col("doc_id").alias("h"), (F.length("bits") + 64).cast("long").alias("cost"))
    met, n_groups = blocks_of_mixed(named.join(sized, "h"), n_parts, scratch)

    def test(table: pa.Table) -> pa.Table:
        key, h, c, block = (table.column(x).to_numpy() for x in ("key", "h", "c", "block"))
        _, rep, member = np.unique(h, return_index=True, return_inverse=True)  # a member of many lists has one bitmap
        n = table.column("n").to_numpy()[rep].astype(np.int64)
        maps = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("bits").take(pa.array(rep))]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in pairs_in_groups(key, block, table.column("i")[0].as_py(), table.column("j")[0].as_py()):
            differ = c[x] != c[y]
            pairs = _distinct(member[x[differ]], member[y[differ]])
            x, y = pairs[:, 0], pairs[:, 1]
            able = np.minimum(n[x], n[y]) >= -(-(n[x] + n[y]) * num // (num + den))
            x, y = x[able], y[able]
            good = fits(n, maps, x, y, num, den)
            a.append(h[rep[x[good]]])
            b.append(h[rep[y[good]]])
        pairs = _distinct(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    full = met.join(bits.withColumnRenamed("doc_id", "h"), "h").select("key", "h", "c", "block", "i", "j", "n", "bits")
    return full.groupBy(F.pmod("key", F.lit(n_groups)).alias("p"), "i", "j").applyInArrow(tidy(test), "a long, b long").distinct()


def close(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose bitmaps allow the overlap that their sizes need; bits: doc_id, n, bits."""
    both = pairs.join(bits.withColumnsRenamed({"doc_id": "b", "n": "nb", "bits": "mb"}), "b").join(bits.withColumnsRenamed({"doc_id": "a", "n": "na", "bits": "ma"}), "a")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            need = -(-(na + nb) * num // (num + den))
            differ = np.array([least_difference(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(differ <= na + nb - 2 * need))

    return both.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(tidy(test), "a long, b long")


def verify(docs: DataFrame, pairs: DataFrame, unique: bool, scratch: Scratch, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    ids = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS  # a checked size; else the texts meet the ids in a shuffle

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(s) for s in _sets(batch.column(1), k)], pa.binary())], names=["doc_id", "tokens"])

    wanted = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = wanted.mapInArrow(tidy(pick), "doc_id long, tokens binary")
    sets = scratch.cut(sets if unique else sets.dropDuplicates(["doc_id"]), "sets")
    both = pairs.join(sets.withColumnsRenamed({"doc_id": "b", "tokens": "tb"}), "b").join(sets.withColumnsRenamed({"doc_id": "a", "tokens": "ta"}), "a")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(unpack(x.as_py()), np.uint64), np.frombuffer(unpack(y.as_py()), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(tidy(test), "a long, b long")


def classes(docs: DataFrame, k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs, scratch, n_parts = ready(docs), Scratch(docs.sparkSession), parts(docs)
    scanned = scratch.cut(first_pass(docs, k), "sets")
    meta = scanned.where("slice is null").select("doc_id", "n", "s1", "s2")
    sketch = read_sketch(scanned.where("slice is not null").select("slice", "counts"))
    full = meta.where("n > 0 and doc_id is not null")
    reps = scratch.cut(full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "reps")
    unique = meta.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    bound = boundary(sketch, num, den)
    own = scratch.cut(prefixes(docs, reps.where("n > 1").select(F.col("rep").alias("doc_id")), levels(sketch), bound, unique, k, num, den), "prefixes")
    bits = own.select("doc_id", "n", "bits")

    met = scratch.cut(stars(deal(own, n_parts), num, den), "stars")
    found = met.where("list is null").select("a", "b").distinct()
    star = scratch.cut(close(found, bits, num, den), "pairs")
    links = scratch.cut(verify(docs, star, unique, scratch, k, num, den), "links")
    group = components(links, scratch)

    # lists of three or more that still touch several components
    rest = across(met.where("list is not null").select("list", "a"), bits, group, n_parts, scratch, num, den)
    rest = scratch.cut(rest.join(star, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        group = components(links.unionByName(verify(docs, rest, unique, scratch, k, num, den)), scratch)
    group = scratch.cut(group, "components")
    scratch.close(scanned, reps, group)

    named = reps.join(group, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.col("n").alias("rn"), F.coalesce("component", "rep").alias("component"))
    key = (meta["s1"] == named["s1"]) & (meta["s2"] == named["s2"]) & (meta["n"] == named["rn"])
    out = meta.join(named, key, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns as they are, with the document of the smallest doc_id of each component."""
    found = classes(docs, k, num, den)
    dropped = Scratch(docs.sparkSession).cut(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    kept = docs.join(dropped, "doc_id", "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    rank = free_name(docs, "rank")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    ranked = kept.join(repeated, "doc_id", "left_semi").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    return kept.join(repeated, "doc_id", "left_anti").unionByName(ranked.select(*[F.col(f"`{c}`") for c in docs.columns]))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce((SELECT min(b) FROM reach r WHERE r.a = w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
