"""Windows are marked only where bytes are equal, whatever the hashes say; the index outlives an application."""

import hashlib
import random
import re

import numpy as np
import pytest

from tallymark.llm import fingerprint_index, suffix_dedup, windows
from tallymark.llm.textkit import Prefix, pack

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_left(rows, w=13):
    first, out = {}, {}
    for d, t in sorted(rows):
        x = WORD.findall(t or "")
        for i in range(len(x) - w + 1):
            first.setdefault(tuple(x[i : i + w]), d)
    for d, t in rows:
        x = WORD.findall(t or "")
        gone = {i + k for i in range(len(x) - w + 1) if first[tuple(x[i : i + w])] < d for k in range(w)}
        kept = " ".join(v for i, v in enumerate(x) if i not in gone)
        out[d] = (len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(40)]
    shared = [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(4)]
    rows = []
    for d in range(n):
        x = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            p, a = r.choice(shared).split(), r.randint(0, 30)
            x[r.randint(0, len(x)) : 0] = p[a : a + r.randint(5, 30)]
        rows.append((d, r.choice([" ", "  ", "\n"]).join(x)))
    return rows


def groups_of(*tables):
    out = {}
    for t in tables:
        for row in t.to_pylist():
            out.setdefault(row["p"], []).append(tuple(row[c] for c in ("p", "kind", "weight", "blob")))
    return [windows._table(v) for v in out.values()]


def run_alone(module, rows, n_parts=3):
    """The whole operator without Spark: every grouping by p in turn, with a task of three documents each."""
    unit = module.UNIT
    packed = []
    for i in range(0, len(rows), 3):
        raw = [t.encode() for _, t in rows[i : i + 3]]
        packed.append((np.array([d for d, _ in rows[i : i + 3]]), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])))
    scanned = [windows.scan_some(ids, data, off, unit, n_parts) for ids, data, off in packed]
    marks = [windows.merge_some(t, unit, n_parts, False) for t in groups_of(*scanned)]
    held = []
    for ids, data, off in packed:
        part = windows._doc_part(ids, n_parts)
        held += [(int(p), windows.TEXT, 1, pack(ids[i : i + 1], np.diff(off)[i : i + 1], data[off[i] : off[i + 1]])) for i, p in enumerate(part)]
    cut = [windows.cut_out(t, unit, n_parts) for t in groups_of(windows._table(held), *[windows._table([x for x in map(tuple, (r.values() for r in m.to_pylist())) if x[1] == windows.CHECK]) for m in marks])]
    full = [windows._table([x for x in map(tuple, (r.values() for r in m.to_pylist())) if x[1] == windows.FULL]) for m in marks]
    full += [windows.compare_some(t, unit, n_parts, module.repeated_windows) for t in groups_of(*cut)]
    out = {}
    for t in groups_of(windows._table(held), *full):
        ids, off, data, found = windows.read_group(t)
        for row in module._result(ids, off, data, found[windows.FULL]).to_pylist():
            out[row["doc_id"]] = tuple(row.values())[1:]
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_hashes_decide_nothing(monkeypatch, clash):
    """With every content hash the same, the results are still those of brute force."""
    from .test_corpus import brute_bytes

    if clash:
        monkeypatch.setattr(windows.Prefix, "range", lambda self, a, b: np.zeros(len(a), np.uint64))
        monkeypatch.setattr(windows.Prefix, "grams", lambda self, k, real=Prefix.grams: real(self, k) % np.uint64(3))
    rows = texts(1, 24) + [(100, "ab" * 300), (101, ""), (102, "ab" * 200)]
    assert run_alone(suffix_dedup, rows) == brute_bytes(rows)
    if not clash:  # the windows of words are found by hash, so a clash may keep a text but never remove one
        assert run_alone(fingerprint_index, rows) == words_left(rows)
    else:
        want = words_left(rows)
        assert all(v[1] <= want[d][1] for d, v in run_alone(fingerprint_index, rows).items())


def test_index_takes_a_batch_of_a_later_application(spark, tmp_path):
    rows = texts(2, 60)
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    path, got = f"file://{tmp_path}/index", {}
    for a, b in ((0, 20), (20, 45), (45, 60)):
        df = fingerprint_index.add_batch(frame(rows[a:b]), frame(rows[:a]), path, 4)  # each opens the folder anew
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}
    assert got == words_left(rows) == {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fingerprint_index.digest(frame(rows)).collect()}
    index = fingerprint_index.FingerprintIndex(spark, path)
    assert index.last == 59 and len(index.names) == 1 and index.n_parts == 4
    with pytest.raises(ValueError):
        index.add(frame(rows[:3]))
