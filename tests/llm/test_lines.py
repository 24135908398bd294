"""The line scan of op3 against plain formulas, and what it reads and takes."""

import random
import re
import tracemalloc

import numpy as np

from tallymark.llm import line_dedup
from tallymark.llm.tables import own_ids
from tallymark.llm.textkit import fold_ascii

WORD = re.compile(rb"[^\x20\x09-\x0D]")
BINS = line_dedup.BANDS * line_dedup.ROWS
M = (1 << 64) - 1


def made(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab \n\t\r\x0bXZ@[é") * rng.randint(1, 4) for _ in range(rng.choice((0, 3, 90)))).encode() for _ in range(rng.randint(1, 9))]


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M
    return x ^ x >> 33


def signature(line):
    least = [None] * BINS
    for i in range(len(line) - 7):
        h = mixed(int.from_bytes(line[i : i + 8], "little"))
        b, v = (h >> 32) * BINS >> 32, h & 0xFFFFFFFE
        least[b] = v if least[b] is None else min(v, least[b])
    out = []
    for b in range(BINS):
        d = next(d for d in range(BINS) if least[(b + d) % BINS] is not None)
        out.append(least[(b + d) % BINS] * pow(0x9E3779B1, d, 1 << 32) % (1 << 32))
    return out


def test_lines_and_signatures_by_plain_formulas():
    for seed in range(150):
        texts = made(seed)
        data, offsets = joined(texts)
        starts, ends, doc, number, full = line_dedup.split(data, offsets)
        want = [(d, i, x, bool(WORD.search(x))) for d, t in enumerate(texts) for i, x in enumerate(t.split(b"\n"))]
        assert [(d, i, data[a:b].tobytes(), f) for a, b, d, i, f in zip(starts, ends, doc.tolist(), number.tolist(), full.tolist(), strict=True)] == want
        folded = fold_ascii(data)
        assert folded.tobytes() == b"".join(texts).lower()
        some = full & (ends - starts >= line_dedup.SHINGLE) & (np.arange(len(full)) % 3 > 0)  # lines between them are not looked at
        sig = line_dedup.signatures(folded, starts[some], ends[some])
        assert sig.tolist() == [signature(folded[a:b].tobytes()) for a, b in zip(starts[some], ends[some], strict=True)]
        keys = line_dedup.band_keys(sig)
        assert keys.shape == (len(sig), line_dedup.BANDS)
        for row, got in zip(sig[:2].tolist(), keys[:2].tolist(), strict=True):
            for b, key in enumerate(got):
                k = b + 1
                for v in row[b * line_dedup.ROWS : (b + 1) * line_dedup.ROWS]:
                    k = mixed(k * 0x100000001B3 & M ^ v)
                assert k == key


def test_the_scan_takes_a_few_bytes_for_each_of_the_text():
    data, offsets = joined([b"some words of a line of text\n" * 100] * 400)
    tracemalloc.start()
    line_dedup.split(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * len(data)


def test_ids_that_name_one_row_each_are_seen_without_the_texts(spark):
    docs = spark.range(5).selectExpr("id as doc_id", "raise_error('a text was read') as text")
    assert own_ids(docs)[1] is None


def test_lines_in_many_batches_of_occurrences(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "STRETCH", 50)
    monkeypatch.setattr(line_dedup, "SIGNED", 50)
    monkeypatch.setattr(line_dedup, "LINES", 3)
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") * 6 for _ in range(9)) + str(i) * 9 for i in range(9)]
    texts = ["\n".join(rng.choice(pool) for _ in range(6)) for _ in range(9)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = set(), []
    for t in texts:
        lines = []
        for x in (t or "").split("\n"):
            if x not in seen:
                lines.append(x)
                seen.add(x) if x else None
        want.append("\n".join(lines) if t is not None else None)
    assert [r.text for r in line_dedup.without_repeats(docs).orderBy("doc_id").collect()] == want
