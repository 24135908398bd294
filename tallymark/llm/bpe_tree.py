"""BPE encoding and decoding of whole texts, long unsplit stretches by tree concatenation.

The vocabulary is a `tokenizers` file of the kind with word ends: NFC, white space folded, lower case, pre-tokens by PATTERN, byte-level letters, BPE
with a suffix on a word's last letter.  A pre-token is text that nothing splits; it can be a word or megabytes of letters.

* A pre-token over LEAF_BYTES is halved until its parts are that small.  All parts of a batch are encoded at once, those that do not end a
  pre-token without the suffix.
* Neighbours are joined level by level up the tree, all joins of a level at once.  A join encodes a window around its seam anew, at
  first one token of either side, and doubles it on a side until the window's outermost token there is the token that the side itself has (or
  the side is used up).  Then every two neighbouring tokens of the joined sequence are neighbours in an encoding, and as BPE takes the
  lowest rank, leftmost first, the first merge over a boundary would also be the first in the encoding of its two neighbours: the
  sequence is the encoding of the whole.
* Equal pre-tokens of a batch are encoded once, and a worker remembers those of up to 256 bytes.

Special strings are cut out first and are one token each.  A text over SECTION_BYTES is worked on in sections that begin before white space.

Defined results for odd input: a null or empty text has no tokens (both digests are of the empty string); repeated rows each give a
row; an empty table gives no rows; other columns are not read.  A file of another kind raises ValueError.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ready
from .textkit import chunks, distinct, tidy

LEAF_BYTES = 12
#: Bytes of texts worked on at a time, and pre-tokens that a worker remembers before it starts anew.
SECTION_BYTES, MAX_KNOWN = 2 << 20, 1 << 19
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# Fixed values of this kind of file: the pattern of pre-tokens and the endings that stand alone behind an apostrophe.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_BREAK = regex.compile(r"(?<=[^ \n\t])[ \n\t]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Words:
    """Tokens of words (pre-tokens, as bytes) by tree concatenation."""

    def __init__(self, spec: dict, leaf_bytes: int = LEAF_BYTES):
        from tokenizers import Tokenizer

        bare = {**spec, "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": [], "truncation": None, "padding": None}
        suffix = spec["model"]["end_of_word_suffix"]
        self.ending = Tokenizer.from_str(json.dumps(bare))  # of a part that ends a word
        self.inner = Tokenizer.from_str(json.dumps({**bare, "model": {**spec["model"], "end_of_word_suffix": None}}))
        self.letters = {i: t.removesuffix(suffix) for t, i in spec["model"]["vocab"].items()}
        self.token = {i: t for t, i in spec["model"]["vocab"].items()}
        self.byte = dict(enumerate(byte_letters()))  # for str.translate
        if leaf_bytes < 2:
            raise ValueError("a leaf holds two bytes at least")
        self.leaf = leaf_bytes
        self.windows = 0  # encoded so far, for tests

    def _encode(self, parts: list[tuple[str, bool]]) -> list[list[int]]:
        """Tokens of parts (letters, whether they end a word)."""
        out: list = [None] * len(parts)
        for last, model in ((True, self.ending), (False, self.inner)):
            mine = [i for i, p in enumerate(parts) if p[1] == last]
            for i, e in zip(mine, model.encode_batch([parts[i][0] for i in mine], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def encode(self, words: list[bytes]) -> list[list[int]]:
        leaves, owner = [], []
        for w, raw in enumerate(words):
            text = raw.decode("latin-1").translate(self.byte)
            if len(raw) <= self.leaf:
                leaves.append((text, True))
                owner.append(w)
                continue
            depth = (-(-len(raw) // self.leaf) - 1).bit_length()
            edge = [len(raw) * k >> depth for k in range((1 << depth) + 1)]
            leaves += [(text[a:b], b == len(raw)) for a, b in zip(edge, edge[1:], strict=False)]
            owner += [w] * (1 << depth)
        nodes = [(w, last, ids) for w, (_, last), ids in zip(owner, leaves, self._encode(leaves), strict=True)]
        while len(nodes) > len(words):  # one level of all trees
            joined, pairs, k = [], [], 0
            while k < len(nodes):
                paired = k + 1 < len(nodes) and nodes[k + 1][0] == nodes[k][0]
                if paired:
                    pairs.append(len(joined))
                joined.append((nodes[k], nodes[k + 1]) if paired else nodes[k])
                k += 1 + paired
            for at, ids in zip(pairs, self._join([joined[i] for i in pairs]), strict=True):
                joined[at] = (joined[at][0][0], joined[at][1][1], ids)
            nodes = joined
        return [ids for _, _, ids in nodes]

    def _join(self, pairs: list[tuple]) -> list[list[int]]:
        """Tokens of neighbours put together: windows around the seams grow until both sides agree."""
        out: list = [None] * len(pairs)
        size = [(1, 1)] * len(pairs)
        todo = list(range(len(pairs)))
        while todo:
            parts = []
            for x in todo:
                (_, _, left), (_, last, right) = pairs[x]
                i, j = size[x]
                parts.append(("".join([self.letters[t] for t in left[len(left) - i :] + right[:j]]), last and j == len(right)))
            self.windows += len(parts)
            grown = []
            for x, ids in zip(todo, self._encode(parts), strict=True):
                (_, _, left), (_, _, right) = pairs[x]
                i, j = size[x]
                agree_left, agree_right = i == len(left) or ids[0] == left[-i], j == len(right) or ids[-1] == right[j - 1]
                if agree_left and agree_right:
                    out[x] = left[: len(left) - i] + ids + right[j:]
                else:
                    size[x] = (i if agree_left else min(2 * i, len(left)), j if agree_right else min(2 * j, len(right)))
                    grown.append(x)
            todo = grown
        return out


class Encoder:
    """A worker's encoder of one file."""

    def __init__(self, path: str, leaf_bytes: int = LEAF_BYTES):
        from tokenizers import Regex, Tokenizer, normalizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        if rule != PATTERN or not spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a word-end BPE file with the pattern that this operator knows")
        self.normal = Tokenizer.from_file(path).normalizer
        self.words = Words(spec, leaf_bytes)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.name = {**self.words.token, **{i: t for t, i in self.special.items()}}
        self.find = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.probes = [(k, normalizers.Replace(Regex(p), "!!")) for k, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))]
        self.fold = np.full(0x110000, -1, np.int32)  # the normalised character; -1 not looked at yet, -2 depends on its neighbours
        self.kind = np.full(0x110000, OTHER, np.uint8)
        self.known: dict[bytes, tuple[bytes, bytes]] = {}

    def _learn(self, codes: np.ndarray) -> None:
        """Classes and normalised forms of characters, as the library itself gives them for each alone."""
        for c in np.unique(codes[self.fold[codes] == -1]).tolist():
            char = chr(c)
            self.kind[c] = next((k for k, probe in self.probes if probe.normalize_str(char) == "!!"), OTHER)
            alone = self.normal.normalize_str(char)
            joins = unicodedata.category(char)[0] == "M" or unicodedata.combining(char) or 0x1100 <= c < 0x1200 or 0x16D60 <= c < 0x16D70  # marks and letters that compose with what stands before them
            self.fold[c] = -2 if joins or len(alone) != 1 else ord(alone)

    def normalised(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(code points, offsets) of texts in normal form: by character where neighbours cannot matter, else by the library on the whole text."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self._learn(codes)
        folded = self.fold[codes]
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(folded == -2), side="right") - 1)
        if len(odd):
            whole = {i: np.frombuffer(self.normal.normalize_str(texts[i]).encode("utf-32-le"), np.uint32).astype(np.int32) for i in odd.tolist()}
            parts = [whole.get(i, folded[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
            folded, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self._learn(folded)
        return folded, offsets

    def pretokens(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens among code points."""
        n, kind = len(codes), self.kind[codes]
        first = np.zeros(n + 1, bool)
        first[offsets] = True  # a text begins here, or all end
        run = first.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        head = run[:n] | (kind == NUMBER)
        edge = np.flatnonzero(run)
        begin, end = edge[:-1], edge[1:]
        quote = (kind[begin] == OTHER) & (end - begin == 1) & (codes[begin] == 39) & ~first[end]
        at = end[quote]  # a lone apostrophe stands before it
        at = at[kind[at] == LETTER]
        more = np.minimum(at + 1, n - 1)
        second = np.where((at + 1 < n) & ~first[at + 1], codes[more], 0)
        size = np.zeros(len(at), np.int64)
        for e in ENDINGS:
            size[(codes[at] == ord(e[0])) & ((len(e) == 1) | (second == ord(e[-1])))] = len(e)
        at, size = at[size > 0], size[size > 0]
        head[at] = False
        after = at + size
        head[after[after < n]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], n)
        keep = kind[starts] != SPACE
        return starts[keep], ends[keep]

    def _remember(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as text, tokens as text) of distinct words."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MAX_KNOWN:
            self.known.clear()
            new = words
        fresh = {}
        for w, ids in zip(new, self.words.encode(new), strict=True):
            fresh[w] = (" ".join(map(str, ids)).encode(), " ".join(map(self.name.__getitem__, ids)).encode())
        out = [fresh[w] if w in fresh else self.known[w] for w in words]
        self.known.update((w, x) for w, x in fresh.items() if len(w) <= 256)
        return out

    def sections(self, text: str) -> Iterator[str | int]:
        """Parts of a text that nothing joins: special tokens' ids, and stretches cut before white space."""
        at = 0
        for m in self.find.finditer(text) if self.find else ():
            yield from self._stretches(text[at : m.start()])
            yield self.special[m.group()]
            at = m.end()
        yield from self._stretches(text[at:])

    @staticmethod
    def _stretches(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SECTION_BYTES and (m := _BREAK.search(text, at + SECTION_BYTES // 2)):
            yield text[at : m.start()]
            at = m.start()
        if at < len(text):
            yield text[at:]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(tokens, ids as text, tokens as text) of each text."""
        parts = [[text] if text and len(text) <= SECTION_BYTES and not (self.find and self.find.search(text)) else list(self.sections(text)) for text in texts]
        flat = [p for own in parts for p in own if isinstance(p, str)]
        done: list[list] = []
        for a, b in chunks(np.concatenate([[0], np.cumsum([len(p) for p in flat])]), SECTION_BYTES):
            done += self._encode_some(flat[a:b])
        at = iter(done)
        for own in parts:
            found = [next(at) if isinstance(p, str) else (str(p).encode(), self.name[p].encode()) for p in own]
            ids, tokens = found[0] if len(found) == 1 else (b" ".join(x for x in (f[k] for f in found) if x) for k in (0, 1))
            yield ids.count(b" ") + 1 if ids else 0, ids, tokens

    def _encode_some(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        codes, offsets = self.normalised(texts)
        if not len(codes):
            return [(b"", b"")] * len(texts)
        starts, ends = self.pretokens(codes, offsets)
        where = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
        data = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        lo, hi = where[starts], where[ends]
        first, which = distinct(data, lo, hi)
        raw = data.tobytes()
        found = self._remember([raw[a:b] for a, b in zip(lo[first].tolist(), hi[first].tolist(), strict=True)])
        edge = np.searchsorted(starts, offsets).tolist()
        out = []
        for k in (0, 1):
            words = np.empty(len(first), object)
            words[:] = [f[k] for f in found]
            of = words[which].tolist()
            out.append([b" ".join(of[a:b]) for a, b in zip(edge, edge[1:], strict=False)])
        return list(zip(*out, strict=True))


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """(ids, what `encode` gives) of bounded parts of batches (doc_id, text)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for a, b in chunks(np.concatenate([[0], np.cumsum(size)]), SECTION_BYTES):
            part = batch.slice(a, b - a)
            yield part.column(0), list(encoder_for(path).encode(pc.fill_null(part.column(1), "").to_pylist()))


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (array of ints) of every whole text; the file must lie at tokenizer_path on every executor."""

    def run(batches):
        for ids, found in _encoded(tokenizer_path, batches):
            tokens = [np.array(f[1].split(), np.int32) for f in found]
            yield pa.RecordBatch.from_arrays([ids, pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of ids: tokens joined by a space, special ones kept, as this kind of file decodes; unknown ids give nothing, null ids null."""

    def run(batches):
        name = encoder_for(tokenizer_path).name
        for batch in batches:
            texts = [None if ids is None else " ".join(name[i] for i in ids if i in name) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ready(encoded).select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text; no shuffle."""

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for ids, found in _encoded(tokenizer_path, batches):
            columns = [ids, pa.array([f[0] for f in found], pa.int64()), pa.array([sha(f[1]) for f in found], pa.string()), pa.array([sha(f[2]) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ready(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
