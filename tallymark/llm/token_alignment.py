"""Alignment of two tokenizers over a corpus, each distinct segment once.

A is a byte-level BPE file of the `tokenizers` library, B a `sentencepiece` BPE model that puts a space before a text; a text stands for
space + text.  Segments begin at white space that follows something else, where both vocabularies are checked not to merge (`breaks`): A's
pre-tokenizer splits there, and no piece of B holds the one behind the other.  So the tokens of a text are those of its segments.

1. One map cuts the texts into segments and numbers the distinct ones of each BATCH_BYTES; they are dealt by hash to parts whose number grows with the
   input, a packed row for each batch and part.  The batch's own row keeps which segment stands where.
2. A part takes its distinct segments of all batches, encodes each once with both tokenizers and aligns it.  It gives the counts of its id
   pairs (links times occurrences).
3. Counts of all parts are added up by pair, with the highest count of each B id.  They go back to the parts in blocks of MOST_PAIRS;
   their number is bounded by the vocabularies, not by the texts.
4. Each part joins the results back to the batches, and each batch composes its documents.

A segment is at most once in a batch, so copies and frequent words weigh as much as any other.  Tokens cover bytes without gaps, so a link is a stretch between
two neighbouring token ends of either side, and a group a stretch between two common ends.

B gives back the bytes of every text but those that hold its mark for a space, U+2581 (`verify` tries all characters).

Defined results for odd input: a null or empty text, and one whose joined A or B bytes are not space + text, has no tokens (zeros, '') and adds to no
count; repeated rows and null ids each give a row and count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_path, remove
from .bpe_tree import byte_letters
from .tables import parts, ready
from .textkit import chunks, column, dealt, distinct, pack, range_hashes, tidy, unpack

#: Text bytes whose segments are numbered together (a longer text is alone), and id pairs that tasks look up at a time.
BATCH_BYTES, MOST_PAIRS = 8 << 20, 1 << 21
MARK = "▁"  # B's space
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(0x1C, 0x20), 32]] = True


class Pair:
    """Both tokenizers on a worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        value = {c: i for i, c in enumerate(byte_letters())}
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        as_bytes = lambda t: bytes(value[c] for c in t) if all(c in value for c in t) else t.encode()
        self.bytes_a = [as_bytes(names.get(i, "")) for i in range(max(names) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.breaks = self._breaks()
        alone = [c for c in self.breaks if c != " "]
        if not alone or self._bytes(self.bytes_b, self.b.encode("x  y\n z ")) != b" x  y\n z ":
            raise ValueError("B does not keep white space as it is, or no white space stands alone in it")
        self.anchor = alone[0]  # in no piece: what follows it in a text is encoded as if nothing stood before
        self.lead = len(self.b.encode(self.anchor))

    def _breaks(self) -> str:
        """White space before which both vocabularies never merge."""
        ordinary = [p for i, p in enumerate(self.pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        inside = any(MARK in p.lstrip(MARK) for p in ordinary)
        splits = lambda c: all(any(at[0] == 1 for _, at in self.a.pre_tokenizer.pre_tokenize_str(x + c + y)) for x in "x1.é" for y in "x1.é \n")
        return "".join(c for c in " \n\t\r\v\f" if (not inside if c == " " else not any(c in p for p in ordinary)) and splits(c))

    @staticmethod
    def _bytes(table: list[bytes], ids: list[int]) -> bytes:
        return b"".join([table[i] for i in ids])

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of both sides."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        return a, [ids[self.lead :] for ids in self.b.encode([self.anchor + s for s in segments], num_threads=1)]

    def verify(self) -> None:
        """Try every character: B changes none but its mark."""
        for lo in range(0, 0x110000, 0x2000):
            text = "".join(chr(c) for c in range(lo, lo + 0x2000) if not 0xD800 <= c < 0xE000 and chr(c) != MARK)
            if self._bytes(self.bytes_b, self.b.encode(text)) != f" {text}".encode() * bool(text):
                raise ValueError("B changes characters, so segments would not have the tokens of their text")


@cache
def pair_for(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def segment_starts(data: np.ndarray, offsets: np.ndarray, breaks: str) -> np.ndarray:
    """Where segments begin in texts (UTF-8 bytes)."""
    can = np.zeros(256, bool)
    can[list(breaks.encode())] = True
    head = np.zeros(len(data) + 1, bool)
    head[1:-1] = can[data[1:]] & ~_WHITE[data[:-1]]
    p = np.flatnonzero(head)
    p = p[data[p - 1] >= 0x80]
    one, two, three = data[p - 1], data[p - 2], data[p - 3]  # white space beyond ASCII begins no run behind it
    wide = (two == 0xC2) & np.isin(one, (0x85, 0xA0)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | np.isin(one, (0xA8, 0xA9, 0xAF)))
    wide |= (three == 0xE2) & (two == 0x81) & (one == 0x9F) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
    head[p[wide]] = False
    head[offsets] = True
    return np.flatnonzero(head[:-1])


def _numbered(path_a: str, path_b: str, n_parts: int) -> Callable:
    """Map of (doc_id, text) to a row of each batch (part -1) and one of each part that it has segments in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        breaks, k = pair_for(path_a, path_b).breaks, TaskContext.get().partitionId() << 32
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(np.concatenate([[0], np.cumsum(size)]), BATCH_BYTES):
                texts = batch.column(1).slice(lo, hi - lo)
                has = pc.and_(pa.array(size[lo:hi] > 0), pc.invert(pc.fill_null(pc.match_substring(texts, MARK), False)))
                data, offsets = column(pc.if_else(has, pc.binary_join_element_wise(" ", texts, ""), None))
                starts = segment_starts(data, offsets, breaks) if len(data) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(data)) if len(starts) else starts
                h = range_hashes(data, starts, ends)
                first, which = distinct(data, starts, ends, h)
                s, e, part = starts[first], ends[first], (h[first] % np.uint64(n_parts)).astype(np.int64)
                number, n = np.empty(len(first), np.int64), np.bincount(which, minlength=len(first))
                rows, at = [], 0
                for p, own in dealt(part):  # in the order of parts, so a batch's numbers follow from it
                    number[own] = at + np.arange(len(own))
                    at += len(own)
                    raw = np.concatenate([data[a:b] for a, b in zip(s[own].tolist(), e[own].tolist(), strict=True)])
                    rows.append((p, None, pack(np.array([len(own)], np.int64), (e - s)[own].astype(np.int32), n[own].astype(np.int32), raw)))
                per_doc = np.diff(np.searchsorted(starts, offsets))
                rows.append((-1, batch.column(0).slice(lo, hi - lo).to_pylist(), pack(np.array([len(per_doc)], np.int64), per_doc.astype(np.int32), number[which].astype(np.int32))))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([k] * len(rows), pa.int64()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.binary())], names=["part", "batch", "ids", "blob"])
                k += 1

    return run


NUMBERED = "part int, batch long, ids array<long>, blob binary"


def align(segments: list[str], pair: Pair) -> dict[str, np.ndarray | list]:
    """n_a, n_b, n_groups, n_links and the groups as text of each segment; a and b of all links, in order."""
    a, b = pair.encode(segments)
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    ids_a, ids_b = (np.array([i for x in side for i in x], np.int64) for side in (a, b))
    end_a, end_b = np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b])
    upto = np.concatenate([[0], np.cumsum([len(s.encode()) for s in segments])]).astype(np.int64)
    if not (np.isin(upto[1:], end_a).all() and np.isin(upto[1:], end_b).all()):
        raise ValueError("tokens do not end where their segment does")
    cuts = np.union1d(end_a, end_b)
    begin = np.concatenate([[0], cuts[:-1]])[: len(cuts)]
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    edge_a, edge_b = (np.concatenate([[0], np.searchsorted(end, common, side="right")]).tolist() for end in (end_a, end_b))
    text_a, text_b = (list(map(str, x.tolist())) for x in (ids_a, ids_b))
    groups = [",".join(text_a[edge_a[i] : edge_a[i + 1]]) + "|" + ",".join(text_b[edge_b[i] : edge_b[i + 1]]) for i in range(len(common))]
    at = np.searchsorted(common, upto, side="right")
    edge = at.tolist()
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(at), "n_links": np.diff(np.searchsorted(cuts, upto, side="right")),
        "groups": [";".join(groups[x:y]).encode() for x, y in zip(edge, edge[1:], strict=False)],
        "a": ids_a[np.searchsorted(end_a, begin, side="right")], "b": ids_b[np.searchsorted(end_b, begin, side="right")],
    }


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _align_part(path_a: str, path_b: str) -> Callable:
    """A part's segments of all batches: a row (kind 0) for each batch with the numbers of its segments, the aligned segments (1), and pair counts (2)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pair = pair_for(path_a, path_b)
        size, n, raw = [], [], []
        for blob in rows["blob"]:
            data = unpack(blob.as_py())
            m = int(np.frombuffer(data[:8], np.int64)[0])
            size.append(np.frombuffer(data[8 : 8 + 4 * m], np.int32))
            n.append(np.frombuffer(data[8 + 4 * m : 8 + 8 * m], np.int32))
            raw.append(np.frombuffer(data[8 + 8 * m :], np.uint8))
        sizes, data = np.concatenate(size).astype(np.int64), np.concatenate(raw)
        ends = np.cumsum(sizes)
        first, which = distinct(data, ends - sizes, ends)
        times = np.zeros(len(first), np.int64)
        np.add.at(times, which, np.concatenate(n))
        text = data.tobytes()
        segments = [text[a:b].decode() for a, b in zip((ends - sizes)[first].tolist(), ends[first].tolist(), strict=True)]
        found = [align(segments[a:b], pair) for a, b in chunks(np.concatenate([[0], np.cumsum(sizes[first])]), 1 << 20)]
        x = {c: np.concatenate([f[c] for f in found]) for c in (*COUNTS, "a", "b")}
        groups = [g for f in found for g in f["groups"]]
        aligned = pack(np.array([len(first), len(x["a"])], np.int64), *[x[c].astype(np.int32) for c in COUNTS], np.array([len(g) for g in groups], np.int32), x["a"].astype(np.int32), x["b"].astype(np.int32), np.frombuffer(b"".join(groups), np.uint8))
        pairs, of = np.unique(x["a"] << 32 | x["b"], return_inverse=True)
        count = np.zeros(len(pairs), np.int64)
        np.add.at(count, of, np.repeat(times, x["n_links"]))
        upto = np.cumsum([0, *map(len, size)])
        blobs = [pack(which[a:b].astype(np.int32)) for a, b in zip(upto, upto[1:], strict=False)]
        k, part = len(blobs), key[0].as_py()
        kinds = [0] * k + [1, 2]
        return pa.table([pa.array(kinds, pa.int32()), pa.array([part] * (k + 2), pa.int32()), pa.array([*rows["batch"].to_pylist(), None, None], pa.int64()), pa.array([*blobs, aligned, pack(np.array([len(pairs)], np.int64), pairs, count)], pa.binary())], names=["kind", "part", "batch", "blob"])

    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            pairs, count = np.frombuffer(unpack(blob.as_py()), np.int64)[1:].reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(count)], names=["a", "b", "n"])


def _add_sums(handle) -> Callable:
    """Map over aligned parts: count sums and links whose count is the highest, over the pairs of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = handle.value
        for batch in batches:
            for part, blob, sums in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n, n_links = np.frombuffer((raw := unpack(blob))[:16], np.int64).tolist()
                values = np.frombuffer(raw[16 : 16 + 4 * (5 * n + 2 * n_links)], np.int32).astype(np.int64)
                links, a, b = values[3 * n : 4 * n], values[5 * n : 5 * n + n_links], values[5 * n + n_links :]
                at = np.minimum(np.searchsorted(keys, a << 32 | b), len(keys) - 1)
                hit = keys[at] == (a << 32 | b)
                seg = np.repeat(np.arange(n), links)
                total = np.zeros((2, n), np.int64) if sums is None else np.frombuffer(unpack(sums), np.int64).reshape(2, n).copy()
                np.add.at(total[0], seg, np.where(hit, best[at], 0))
                np.add.at(total[1], seg, np.where(hit, count[at], 0))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary()), pa.array([pack(total)], pa.binary())], names=["part", "blob", "sums"])

    return run


def _results(key: tuple, aligned: pa.Table, numbers: pa.Table) -> pa.Table:
    """For each batch of a part: n_a, n_b, n_groups, n_links, n_best, count_sum and groups of its segments, packed."""
    raw = unpack(aligned["blob"][0].as_py())
    n, n_links = np.frombuffer(raw[:16], np.int64).tolist()
    values = np.frombuffer(raw[16 : 16 + 20 * n], np.int32).reshape(5, n).astype(np.int64)
    text = np.frombuffer(raw[16 + 4 * (5 * n + 2 * n_links) :], np.uint8).tobytes()
    end = np.cumsum(values[4]).tolist()
    groups = [text[a:b] for a, b in zip([0, *end], end, strict=False)]
    table = np.concatenate([values[:4], np.frombuffer(unpack(aligned["sums"][0].as_py()), np.int64).reshape(2, n), values[4:]])
    blobs = []
    for blob in numbers["blob"]:
        own = np.frombuffer(unpack(blob.as_py()), np.int32)
        mine = table[:, own]
        small = mine[[0, 1, 2, 3, 6]].astype(np.int32)
        blobs.append(pack(np.array([len(own)], np.int64), mine[4:6], small, np.frombuffer(b"".join([groups[i] for i in own.tolist()]), np.uint8)))
    return pa.table([numbers["batch"], numbers["part"], pa.array(blobs, pa.binary())], names=["batch", "part", "blob"])


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
DIGEST = "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string"


def _compose(key: tuple, batch: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a batch from the results of its segments."""
    raw = unpack(batch["blob"][0].as_py())
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    places = np.frombuffer(raw[8:], np.int32)
    per_doc, seg = places[:n].astype(np.int64), places[n:]
    tables, groups = [np.zeros((6, 0), np.int64)], []
    for blob in found.sort_by("part")["blob"]:
        raw = unpack(blob.as_py())
        m = int(np.frombuffer(raw[:8], np.int64)[0])
        large, small = np.frombuffer(raw[8 : 8 + 16 * m], np.int64).reshape(2, m), np.frombuffer(raw[8 + 16 * m : 8 + 36 * m], np.int32).reshape(5, m)
        text, end = bytes(raw[8 + 36 * m :]), np.cumsum(small[4]).tolist()
        tables.append(np.concatenate([small[:4].astype(np.int64), large]))
        groups += [text[a:b] for a, b in zip([0, *end], end, strict=False)]
    table, texts = np.concatenate(tables, axis=1), np.empty(len(groups), object)
    texts[:] = groups
    edge = np.concatenate([[0], np.cumsum(per_doc)])
    columns = []
    for values in table:
        upto = np.concatenate([[0], np.cumsum(values[seg])])
        columns.append(pa.array(upto[edge[1:]] - upto[edge[:-1]]))
    of, edge = texts[seg].tolist(), edge.tolist()
    sha = [hashlib.sha256(b";".join(of[a:b])).hexdigest() if b > a else "" for a, b in zip(edge, edge[1:], strict=False)]
    return pa.table([batch["ids"][0].values, *columns, pa.array(sha, pa.string())], names=["doc_id", *SUMS, "groups_sha256"])


def _cogrouped(f: Callable) -> Callable:
    """f(key, left, right) that gives freed memory back."""

    def run(key, left, right):
        return tidy(lambda x: f(*x))((key, left, right))

    return run


def _grouped(f: Callable) -> Callable:
    def run(key, rows):
        return tidy(lambda x: f(*x))((key, rows))

    return run


def id_pairs(counts: DataFrame) -> DataFrame:
    """a, b, count and whether the count is the highest of its b, from counts (a, b, n) of parts."""
    pairs = counts.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = pairs.groupBy("b").agg(F.max("count").alias("most")).withColumnRenamed("b", "of")
    return pairs.join(most, F.col("b") == F.col("of")).select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def _in_blocks(pairs: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys in order, counts, best) of about MOST_PAIRS pairs at a time."""
    n = -(-pairs.count() // MOST_PAIRS)
    for i in range(n):
        block = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(n)) == i).toArrow()
        keys = block["a"].to_numpy() << 32 | block["b"].to_numpy()
        order = np.argsort(keys)
        yield keys[order], block["count"].to_numpy()[order], block["best"].to_numpy()[order]


def digest(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; both files lie at their paths on every executor."""
    spark = docs.sparkSession
    pair_for(path_a, path_b).verify()
    n = 2 * parts(docs)
    folder = new_path(spark, "alignment")

    def kept(df: DataFrame, name: str, by: str) -> DataFrame:
        df.write.option("compression", "none").partitionBy(by).parquet(f"{folder}/{name}")  # the blobs are compressed
        return df

    def read(schema: str, path: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{path}")

    numbered = ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_numbered(path_a, path_b, n)), NUMBERED)
    kept(numbered.withColumn("kind", (F.col("part") >= 0).cast("int")), "numbered", "kind")
    if read(f"{NUMBERED}, kind int", "numbered").where("kind = 1").isEmpty():  # no text with tokens
        zeros = [F.lit(0).cast("long").alias(c) for c in SUMS]
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *zeros, F.lit("").alias("groups_sha256"))
    dealt_out = read("part int, batch long, blob binary", "numbered/kind=1").repartition(n, "part")
    kept(dealt_out.groupBy("part").applyInArrow(_grouped(_align_part(path_a, path_b)), "kind int, part int, batch long, blob binary"), "aligned", "kind")
    remove(spark, f"{folder}/numbered/kind=1")
    id_pairs(read("blob binary", "aligned/kind=2").mapInArrow(tidy(_pair_rows), "a long, b long, n long")).write.parquet(f"{folder}/pairs")
    segments = read("part int, blob binary", "aligned/kind=1").withColumn("sums", F.lit(None).cast("binary"))
    for block in _in_blocks(read("a long, b long, count long, best long", "pairs")):
        segments = segments.mapInArrow(tidy(_add_sums(spark.sparkContext.broadcast(block))), "part int, blob binary, sums binary")
    numbers = read("part int, batch long, blob binary", "aligned/kind=0")
    found = segments.groupBy("part").cogroup(numbers.groupBy("part")).applyInArrow(_cogrouped(_results), "batch long, part int, blob binary")
    batches = read("batch long, ids array<long>, blob binary", "numbered/kind=0")
    return batches.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_cogrouped(_compose), DIGEST)
