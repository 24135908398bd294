"""Token counts by a compiled finite-state transducer.

A byte-level BPE file is compiled into two deterministic transducers whose transitions carry the number of tokens that
they add.

* The token machine (`TokenMachine`) reads the bytes of one pre-token.  Its state is, for every place from which a vocabulary token can still
  begin and reach further, the node of that token in the vocabulary's trie, the token that ends at that place and how many tokens fewer there were;
  a byte moves to the first (longest) token that now ends and may follow what stands before it.  States are numbered when texts first
  reach them; transitions and their counts are arrays.
* The text machine (`TextMachine`) reads characters.  Its state holds what pre-token is open, the token machine's state in it, and what may still
  change it: the start of a special string, the last white-space character of a run, the letters of an
  ending such as 're.

A chunk's map sends any state before it to (state after it, tokens).  Behind the first place where a non-space is followed by white space every
state is the same, so a map is kept as the characters up to that place, which are run from the state that comes in, and a constant for the rest.
Maps compose associatively whatever the cuts are; texts are cut into CHUNK_BYTES and their chunks' maps composed by a prefix scan (`scan`).

The constant part of a chunk is cut into pre-tokens by array operations; equal pre-tokens are run through the token machine once.

Defined results for odd input: a null text is empty and has 0 tokens; repeated rows count each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .tables import ready
from .textkit import chunks as ranges
from .textkit import column, mix, tidy

CHUNK_BYTES = 4 << 10
#: Most states of a token machine and most pre-tokens that a worker remembers; beyond that it starts anew.
MAX_STATES, MAX_KNOWN = 1 << 16, 1 << 20
LIMIT = 512
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]  # White_Space, a fixed set
#: Endings that are pre-tokens of their own after an apostrophe (fixed values of this pre-tokenizer).
ENDINGS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 byte values."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    spare = 256
    for b in range(256):
        if b not in plain:
            table[chr(spare)] = b
            spare += 1
    return table


class Classes:
    """Letter, number, white space or other, for every code point."""

    def __init__(self):
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.of = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                self.of[a : b + 1] = kind
        self.of[_WHITE] = SPACE


#: A token machine's state at the start of a pre-token: one entry at the root of the trie, behind nothing.
EMPTY = ((0, b"", 0),)


class TokenMachine:
    """The deterministic transducer of one vocabulary over the bytes of a pre-token; state 0 is the start."""

    def __init__(self, tokens: set[bytes], rank: dict[tuple[bytes, bytes], int]):
        self.rank = rank
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in tokens:
            node = 0
            for b in t:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][b]
            self.token[node] = t
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next = np.full((1 << 10, 256), -1, np.int32)
        self.adds = np.zeros((1 << 10, 256), np.int16)
        self._number(EMPTY)

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            if n == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.adds = np.concatenate([self.adds, np.zeros_like(self.adds)])
        return n

    def merge(self, text: bytes) -> list[bytes]:
        """Tokens of a short byte string under the merge ranks."""
        parts = [text[i : i + 1] for i in range(len(text))]
        rank = self.rank
        while len(parts) > 1:
            best, at = min((rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: bytes, token: bytes) -> bool:
        """Whether token behind the token before (nothing: at the start) stays a token."""
        known = self.pairs.get((before, token))
        if known is None:
            if len(self.pairs) > MAX_KNOWN:
                self.pairs.clear()
            known = self.pairs[before, token] = self.merge(before + token) == ([before, token] if before else [token])
        return known

    def compile(self, state: int, byte: int) -> None:
        """The transition of a state on a byte.  An entry of a state: trie node, token that ends where it began, tokens there less those here."""
        found, moved = None, []
        for node, before, less in self.states[state]:
            to = self.children[node].get(byte)
            if to is None:
                continue
            if found is None and self.token[to] is not None and self.follows(before, self.token[to]):
                found = (self.token[to], less + 1)
            if self.children[to]:
                moved.append((to, before, less))
        token, adds = found  # single bytes are tokens, so one is always found
        self.next[state, byte] = self._number((*((to, before, less - adds) for to, before, less in moved), (0, token, 0)))
        self.adds[state, byte] = adds

    def go(self, content: tuple, data: bytes) -> tuple[tuple, int]:
        """The content of a state and the tokens added after some bytes, from the content of a state."""
        if len(self.states) > MAX_STATES:
            self.reset()
        state, total = self.step(self._number(content), data)
        return self.states[state], total

    def step(self, state: int, data: bytes) -> tuple[int, int]:
        """State and tokens added after some bytes."""
        total = 0
        for b in data:
            if self.next[state, b] < 0:
                self.compile(state, b)
            total += int(self.adds[state, b])
            state = int(self.next[state, b])
        return state, total

    def run(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of many pre-tokens, a byte of all of them at a time."""
        if len(self.states) > MAX_STATES:
            self.reset()
        order = np.argsort(-sizes, kind="stable")
        at, size = starts[order], sizes[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live, i = len(at), 0
        while live:
            live = int(np.searchsorted(-size, -i, side="left"))  # those with size > i come first
            if live <= 8:
                break
            byte = data[at[:live] + i]
            s = state[:live]
            new = np.flatnonzero(self.next[s, byte] < 0)
            if len(new):
                for x in np.unique(s[new] << 8 | byte[new]).tolist():
                    self.compile(x >> 8, x & 255)
            total[:live] += self.adds[s, byte]
            state[:live] = self.next[s, byte]
            i += 1
        for k in range(live):  # the few longest go on alone
            state[k], more = self.step(int(state[k]), data[at[k] + i : at[k] + size[k]].tobytes())
            total[k] += more
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out


@dataclass(frozen=True)
class State:
    """What a text machine knows at a place; tokens of an open pre-token are counted as if it ended there."""

    held: str = ""  # may be the start of a special string
    open: str = ""  # '' none, L, N or O a run, W white space, A an apostrophe, E an apostrophe and a letter of an ending
    q: tuple = EMPTY  # the token machine's state in the open pre-token; W: without the last character
    last: str = ""  # W: the last white-space character; E: the letter
    adds: int = 0  # W: tokens that the last character adds to the run


START = State()


class TextMachine:
    """The deterministic transducer of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)}
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.find_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        every = {as_bytes(t) for t in spec["model"]["vocab"] if all(c in letters for c in t)} | {bytes([b]) for b in range(256)}
        self.tokens = TokenMachine(every, rank)
        self.classes = Classes().of
        self.spaced = any(self.classes[ord(c)] == SPACE for s in self.special for c in s)
        self.forget()

    def forget(self) -> None:
        """Counts of pre-tokens: of up to 16 bytes as sorted arrays (hash, both halves, length, count), of longer ones by their bytes."""
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.known_long: dict[bytes, int] = {}

    # --- one character at a time: what the maps' heads need -------------------------------------------------------------

    def _count(self, data: bytes) -> int:
        return self.tokens.step(0, data)[1]

    def read(self, state: State, char: str) -> tuple[State, int]:
        """The transition on a character: the next state and the tokens it adds."""
        if not self.special:
            return self._read(state, char)
        total, held = 0, state.held + char
        state = replace(state, held="")
        while held:
            if held in self.special:
                return START, total + 1
            if any(s.startswith(held) for s in self.special):
                return replace(state, held=held), total
            state, adds = self._read(state, held[0])
            total, held = total + adds, held[1:]
        return state, total

    def end(self, state: State) -> int:
        """Tokens that the end of the text adds: what is held turns out to be ordinary."""
        total, held = 0, state.held
        state = replace(state, held="")
        for c in held:
            state, adds = self._read(state, c)
            total += adds
        return total

    def _read(self, s: State, char: str) -> tuple[State, int]:
        kind, raw = int(self.classes[ord(char)]), char.encode("utf-8")
        opened = "LNO"[kind] if kind != SPACE else "W"
        total = 0
        if s.open == "E":  # an apostrophe and r, v or l
            if char == ENDINGS[s.last]:
                return START, self._count(b"'" + s.last.encode() + raw) - self._count(b"'") - self._count(s.last.encode())
            s = State("", "L", self.tokens.go(EMPTY, s.last.encode())[0])  # the apostrophe stands alone, its letter begins a run
        elif s.open == "A":
            if char in ENDINGS:
                if not ENDINGS[char]:
                    return START, self._count(b"'" + raw) - self._count(b"'")
                return State("", "E", EMPTY, char), self._count(raw)
            s = State("", "O" if kind == OTHER else "A", s.q)
        elif s.open == "W":
            run, adds = self.tokens.go(s.q, s.last.encode("utf-8"))
            if kind == SPACE:
                adds = self.tokens.go(run, raw)[1]
                return State("", "W", run, char, adds), adds
            total -= s.adds  # the last character leaves the run
            if s.last == " ":  # and is the blank before a word
                q, adds = self.tokens.go(EMPTY, b" " + raw)
                return State("", opened, q), total + adds
            s, total = START, total + self._count(s.last.encode("utf-8"))
        if kind == SPACE:
            adds = self._count(raw)
            return State("", "W", EMPTY, char, adds), total + adds
        grows = s.open == opened
        q, adds = self.tokens.go(s.q if grows else EMPTY, raw)
        return State("", opened if grows or char != "'" else "A", q), total + adds

    # --- many characters at a time -----------------------------------------------------------------------------------------

    def ordinary(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each of some texts (UTF-8 bytes) without special strings, every text from start to end."""
        out = np.zeros(len(offsets) - 1, np.int64)
        if not len(data):
            return out
        at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.classes[codes]
        n = len(codes)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(at, offsets)] = True  # a text begins here (or all end)
        run = first.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        head = run[:n].copy()
        begins = np.flatnonzero(run)  # of runs, and n
        begin, end = begins[:-1], begins[1:]
        k = kind[begin]
        inner = ~first[end]  # a run that another one of its text follows
        white = np.flatnonzero((k == SPACE) & inner)  # the last character leaves the run
        last = end[white] - 1
        head[last] = True
        blank = codes[last] == 32
        head[end[white[blank]]] = False  # and is the blank before the next one
        # endings: a run that is one apostrophe, not behind a blank, before letters
        quote = np.flatnonzero((k == OTHER) & inner & (end - begin == 1) & (codes[begin] == 39))
        quote = quote[head[begin[quote]]]
        quote = quote[kind[end[quote]] == LETTER]
        c, more = codes[end[quote]], np.minimum(end[quote] + 1, n - 1)
        d = np.where((end[quote] + 1 < n) & ~first[end[quote] + 1], codes[more], 0)
        size = np.zeros(len(quote), np.int64)
        for a, b in ENDINGS.items():
            size[(c == ord(a)) & (True if not b else d == ord(b))] = 1 + len(b)
        quote, size = quote[size > 0], size[size > 0]
        head[end[quote]] = False
        after = end[quote] + size
        head[after[after < n]] = True
        starts = at[np.flatnonzero(head)]
        sizes = np.diff(np.append(starts, len(data)))
        text = np.searchsorted(offsets, starts, side="right") - 1
        return np.bincount(text, self.counts(data, starts, sizes), len(out)).astype(np.int64)

    def counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of pre-tokens; equal ones are run once."""
        out = np.empty(len(starts), np.int64)
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(data) + 9,), "<u8", padded.data, 0, (1,))
        short = np.flatnonzero(sizes <= 16)
        s, m = starts[short], sizes[short]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask = lambda k: np.where(k >= 8, full, (np.uint64(1) << (np.clip(k, 0, 7) * 8).astype(np.uint64)) - np.uint64(1))
        low, high = eight[s] & mask(m), np.where(m > 8, eight[np.minimum(s + 8, len(data))], 0) & mask(np.maximum(m - 8, 0))
        h = mix(low ^ mix(high + m.astype(np.uint64)))
        _, rep, where = np.unique(h, return_index=True, return_inverse=True)
        clash = (low != low[rep][where]) | (high != high[rep][where]) | (m != m[rep][where])
        found = self.remembered(padded, h[rep], low[rep], high[rep], m[rep], s[rep])
        out[short] = found[where]
        rest = np.concatenate([short[clash], np.flatnonzero(sizes > 16)])  # clashing hashes are run one by one
        new: dict[bytes, list[int]] = {}
        for i in rest.tolist():
            raw = data[starts[i] : starts[i] + sizes[i]].tobytes()
            count = self.known_long.get(raw)
            if count is None:
                new.setdefault(raw, []).append(i)
            else:
                out[i] = count
        if new:
            firsts = np.array([v[0] for v in new.values()])
            got = self.tokens.run(data, starts[firsts], sizes[firsts])
            if len(self.known_long) > MAX_KNOWN // 8:
                self.known_long.clear()
            for (raw, places), count in zip(new.items(), got.tolist(), strict=True):
                out[places] = count
                if len(raw) <= 256:
                    self.known_long[raw] = count
        return out

    def remembered(self, data, h, low, high, m, s) -> np.ndarray:
        """Counts of distinct short pre-tokens (in the order of h): looked up, or run and remembered."""
        kh, klow, khigh, km, kn = self.known
        at = np.minimum(np.searchsorted(kh, h), max(len(kh) - 1, 0))
        out = np.zeros(len(h), np.int64)
        hit = (kh[at] == h) & (klow[at] == low) & (khigh[at] == high) & (km[at] == m) if len(kh) else np.zeros(len(h), bool)
        out[hit] = kn[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            out[new] = self.tokens.run(data, s[new], m[new])
            if len(kh) + len(new) > MAX_KNOWN:
                self.forget()
                kh, klow, khigh, km, kn = self.known
            merged = [np.concatenate([a, b[new]]) for a, b in zip((kh, klow, khigh, km, kn), (h, low, high, m, out), strict=True)]
            order = np.argsort(merged[0], kind="stable")
            self.known = tuple(x[order] for x in merged)
        return out

    # --- maps of chunks --------------------------------------------------------------------------------------------------

    def sync(self, text: str) -> int:
        """A place before white space that follows something else: what comes after it does not depend on what was before."""
        if self.spaced:
            return -1
        white = self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == SPACE
        found = np.flatnonzero(white[1:] & ~white[:-1])
        return int(found[0]) + 1 if len(found) else -1

    def chunk(self, text: str) -> ChunkMap:
        """The map of any part of a text, cut anywhere."""
        return self.maps([text])[0]

    def maps(self, texts: list[str]) -> list[ChunkMap]:
        """The maps of many parts; what is constant in them is counted all at once."""
        cuts, bodies = [], []
        for text in texts:
            white = self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == SPACE
            found = np.flatnonzero(white[1:] & ~white[:-1]) + 1 if not self.spaced else ()
            if len(found):  # from the first such place on nothing depends on what was before; what is behind the last one stays open
                cuts.append((int(found[0]), int(found[-1])))
                bodies.append(text[cuts[-1][0] : cuts[-1][1]])
            else:
                cuts.append(None)
        counts = iter(self.wholes(bodies))
        out = []
        for text, cut in zip(texts, cuts, strict=True):
            if cut is None:
                out.append(ChunkMap(text, None, 0))
            else:
                state, tail = self.advance(START, text[cut[1] :])
                out.append(ChunkMap(text[: cut[0]], state, next(counts) + tail))
        return out

    def advance(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for c in text:
            state, adds = self.read(state, c)
            total += adds
        return state, total

    def apply(self, part: ChunkMap, state: State) -> tuple[State, int]:
        """State after a chunk and the tokens in it, from the state before."""
        state, total = self.advance(state, part.head)
        if part.exit is None:
            return state, total
        return part.exit, total + self.end(state) + part.adds

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a chunk and the one behind it; associative."""
        if a.exit is None:
            if not a.head:
                return b
            if (at := self.sync(a.head + b.head)) >= 0:  # a cut at the very place
                state, adds = self.advance(START, (a.head + b.head)[at:])
                if b.exit is None:
                    return ChunkMap((a.head + b.head)[:at], state, adds)
                return ChunkMap((a.head + b.head)[:at], b.exit, adds + self.end(state) + b.adds)
            return ChunkMap(a.head + b.head, b.exit, b.adds)
        state, adds = self.apply(b, a.exit)
        return ChunkMap(a.head, state, a.adds + adds)

    def wholes(self, texts: list[str]) -> list[int]:
        """Tokens of texts from their start to their end; special strings are one token each."""
        parts = [self.find_special.split(t) if self.find_special and self.find_special.search(t) else [t] for t in texts]
        raw = [p.encode("utf-8") for own in parts for p in own]
        counts = self.ordinary(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
        upto, at = np.concatenate([[0], np.cumsum(counts)]), np.cumsum([0, *map(len, parts)])
        return [len(own) - 1 + int(upto[b] - upto[a]) for own, a, b in zip(parts, at, at[1:], strict=False)]

    def whole(self, text: str) -> int:
        return self.wholes([text])[0]

    def counts_by_chunks(self, texts: list[str], size: int = CHUNK_BYTES) -> list[int]:
        """Tokens of texts by the maps of their chunks, composed by a prefix scan."""
        pieces = [[t[i : i + size] for i in range(0, len(t), size)] for t in texts]
        maps = iter(self.maps([p for own in pieces for p in own]))
        out = []
        for own in pieces:
            found = scan([next(maps) for _ in own], self.compose)
            state, total = self.apply(found[-1], START) if found else (START, 0)
            out.append(total + self.end(state))
        return out

    def count(self, text: str, size: int = CHUNK_BYTES) -> int:
        return self.counts_by_chunks([text], size)[0]


@dataclass(frozen=True)
class ChunkMap:
    """state -> (state, tokens): head is run from the state before; exit and adds hold for all of them (exit None: head is all)."""

    head: str
    exit: State | None
    adds: int


def scan(maps: list, compose) -> list:
    """Inclusive prefix scan under an associative operation: pairs first, then the places between; 2 n compositions, log n deep."""
    if len(maps) < 2:
        return list(maps)
    pairs = [compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
    upto = scan(pairs, compose)
    return [maps[0] if i == 0 else upto[i // 2] if i % 2 else compose(upto[i // 2 - 1], maps[i]) for i in range(len(maps))]


_MACHINES: dict[str, TextMachine] = {}


def machine_for(path: str) -> TextMachine:
    """The worker's machine for a file: what one task has compiled serves the next."""
    if path not in _MACHINES:
        _MACHINES[path] = TextMachine(path)
    return _MACHINES[path]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _count_some(machine: TextMachine, texts: pa.Array) -> np.ndarray:
    """Tokens of texts: those longer than a chunk or with special strings by their chunks' maps, all others, one chunk each, at once."""
    data, offsets = column(texts)
    size = np.diff(offsets)
    apart = size > CHUNK_BYTES
    if machine.special:
        has = np.zeros(len(texts), bool)
        for s in machine.special:
            has |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        apart |= has
    counts = np.empty(len(texts), np.int64)
    far = np.flatnonzero(apart)
    counts[far] = machine.counts_by_chunks(texts.take(pa.array(far)).to_pylist())
    rest = np.flatnonzero(~apart)
    if not apart.any():
        counts[:] = machine.ordinary(data, offsets)
    elif len(rest):
        part = texts.take(pa.array(rest))
        counts[rest] = machine.ordinary(*column(part))
    return counts


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text; no shuffle.

    tokenizer_path names a byte-level BPE file that every executor has at that path.
    """

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_for(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.empty(len(batch), np.int64)
            for a, b in ranges(np.concatenate([[0], np.cumsum(sizes)]), 4 << 20):
                counts[a:b] = _count_some(machine, texts.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return ready(docs).select("doc_id", "text").mapInArrow(tidy(scan_batches), SCHEMA)
