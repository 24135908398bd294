"""Vectorised text primitives shared by the corpus operators.

Everything here works on an Arrow string column as one byte buffer plus document
offsets, so no per-word Python objects are made.  A null text counts as empty.
"""

from __future__ import annotations

import ctypes
import functools
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Words are maximal runs of anything but space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(WORD_SEPARATORS)] = True
_RANDOM = np.random.RandomState(20260131).randint(0, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j (mod 2**64) for j < n, kept between calls."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Prefix:
    """Prefix sums of a token sequence from which the hash of any range follows in O(1)."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of every k consecutive tokens."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + np.uint64(k)) if n > 0 else np.zeros(0, np.uint64)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _RANDOM.take(data, mode="clip")


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, target: int):
    """Ranges (first, last) of documents of about target bytes each; a longer document is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + target, side="right")) - 1)
        last = min(last, n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document where its words begin."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    sep = _IS_SEP[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = sep[:-1], sep[1:]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = True
    after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(~sep & before), np.flatnonzero(~sep & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Prefix(byte_values(data)).range(starts, ends)


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, everything else as it is."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(blob: bytes) -> memoryview:
    size = int.from_bytes(blob[:8], "little")
    return memoryview(pa.decompress(blob[8:], size, codec="zstd", asbytes=True)) if size else memoryview(b"")


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges in ascending order, a bounded stretch of data at a time."""
    stretches = chunks(np.append(starts, len(data)), 1 << 21) if len(starts) else ()
    return np.concatenate([np.zeros(0, np.uint64), *(word_hashes(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]) for a, b in stretches)])


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): a place of each distinct byte range (in ascending order), and for every range which of them it equals.  Hashes propose, bytes decide."""
    h = range_hashes(data, starts, ends) if h is None else h
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    size = ends - starts
    clash = size != size[first][which]
    for a, b in chunks(np.concatenate([[0], np.cumsum(size)]), 1 << 22):
        n = np.where(clash[a:b], 0, size[a:b])
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = data[np.repeat(starts[first[which[a:b]]], n) + within] != data[np.repeat(starts[a:b], n) + within]
        clash[a + np.repeat(np.arange(b - a), n)[other]] = True
    own: dict[bytes, int] = {}
    for i in np.flatnonzero(clash).tolist():  # equal hashes, other bytes
        raw = data[starts[i] : ends[i]].tobytes()
        if raw not in own:
            own[raw] = len(first)
            first = np.append(first, i)
        which[i] = own[raw]
    return first, which


def dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, places of its entries in their order) for the partitions that have entries."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True):
        yield int(part[order[i]]), order[i:j]


_RELEASED = [0.0]


def release() -> None:
    """Give freed memory back to the system: idle workers stay alive, and several share an executor's memory."""
    if time.monotonic() - _RELEASED[0] > 0.5:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass
        _RELEASED[0] = time.monotonic()


def _released(batches: Iterator) -> Iterator:
    yield from batches
    release()


def tidy(f: Callable) -> Callable:
    """f, a map over batches or a function of a group, with freed memory given back when it is done."""

    @functools.wraps(f)
    def run(arg):
        out = f(arg)
        if isinstance(out, Iterator):
            return _released(out)
        release()
        return out

    return run
