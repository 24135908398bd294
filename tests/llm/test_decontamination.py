"""The lemma filter and the banded alignment against plain edit distances."""

import random

import numpy as np

from tallymark.llm import decontamination as dc


def least_edits(unit, text):
    """Fewest edits that turn unit into some part of text."""
    row = [0] * (len(text) + 1)
    for i, u in enumerate(unit, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (u != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(r, s, n, kinds="sid"):
    s = list(s)
    for _ in range(n):
        at, kind = r.randrange(len(s)), r.choice(kinds)
        if kind == "s":
            s[at] = r.choice("xyz")
        elif kind == "d" and len(s) > 1:
            del s[at]
        else:
            s.insert(at, r.choice("xyz"))
    return "".join(s)


def test_align_is_edit_distance():
    r = random.Random(1)
    for _ in range(300):
        unit = "".join(r.choice("ab") for _ in range(r.randint(8, 30)))
        text = "".join(r.choice("ab") for _ in range(r.randint(1, 10))) + edited(r, unit, r.randint(0, 5)) + "b" * r.randint(0, 5)
        u, t = (np.frombuffer(x.encode(), np.uint8) for x in (unit, text))
        budget, width = np.array([6]), len(text) + len(unit) + 1  # all diagonals
        got = dc.align(u[None, :], np.array([len(u)]), budget, t, np.array([0]), np.array([len(t)]), np.array([-len(unit)]), width)
        assert got[0] == min(least_edits(unit, text), 7)


def test_every_unit_within_its_edits_is_found():
    r = random.Random(2)
    missed = 0
    for size in [*range(1, 64), 75, 79, 80, 99, 160, 239, 240]:
        for _ in range(6):
            unit = "".join(r.choice("abcdefgh ") for _ in range(size)).strip() or "a"
            unit = " ".join(unit.split())
            budget = int(len(unit) * dc.EDITS)
            body = edited(r, unit, budget, "s")
            around = "" if len(unit) < dc.Q else "qqqqqqqqq"
            text = around + body + around
            index = dc.Index(dc.units([unit], [7]))
            raw = np.frombuffer(text.encode(), np.uint8)
            d, i, e = index.search(raw, np.array([0, len(raw)]))
            if len(unit) <= dc.UNIT + dc.STRIDE and not (i.tolist() == [7] and e[0] == least_edits(unit, dc.normal(raw, np.array([0, len(raw)]))[0].tobytes().decode())):
                missed += 1
    assert missed == 0


def test_matches_by_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    bench = [(i, " ".join(word() for _ in range(r.randint(1, 12)))) for i in range(25)]
    docs = []
    for i in range(60):
        body = [word() for _ in range(r.randint(0, 30))]
        if i % 3:
            item = r.choice(bench)[1]
            body.insert(r.randint(0, len(body)), edited(r, item, r.randint(0, len(item) // 8)))
        docs.append((None if i % 20 == 0 else i // 2, " ".join(body)))
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = sorted((str(d), [i for i, u in bench if (len(u) >= dc.Q and least_edits(u, t) <= int(len(u) * dc.EDITS)) or u == t]) for d, t in docs)
    for size in (dc.BLOCK_BYTES, 120):  # one block, and several with rests in between: a row for every row
        assert sorted((str(x.doc_id), x["items"]) for x in dc.matches(df, b, size).collect()) == want
        assert dc.keep_clean(df, b, size).count() == sum(not x[1] for x in want)


def test_a_document_with_many_hits_is_counted_in_parts(monkeypatch):
    """Repetitive texts and units: whatever the size of the parts, what is found is the same."""
    r = random.Random(9)
    units = ["a" * 160, "ab" * 70, "abc" * 40 + "xyz" * 10, "na na hey " * 12]
    texts = []
    for _ in range(30):
        t = "".join(r.choice(["a" * r.randint(1, 300), "ab" * r.randint(1, 90), "abc" * r.randint(1, 60), "na na hey " * r.randint(1, 15), "zq w "]) for _ in range(12))
        texts.append(t + edited(r, r.choice(units), r.randint(0, 10)) + t[:100])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    index = dc.Index([(i, u.encode()) for i, u in enumerate(units)])
    whole = [x.tolist() for x in index.search(data, offsets)]
    assert whole[0]
    for most in (1, 500, 20_000):
        monkeypatch.setattr(dc, "MOST_HITS", most)
        assert [x.tolist() for x in index.search(data, offsets)] == whole


def test_memory_does_not_grow_with_a_text_of_one_letter():
    import tracemalloc

    index = dc.Index([(1, b"a" * 160)])
    peaks = []
    for size in (40_000, 160_000):
        data = np.full(size, 97, np.uint8)
        tracemalloc.start()
        d, i, e = index.search(data, np.array([0, size]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (d.tolist(), i.tolist(), e.tolist()) == ([0], [1], [0])
    assert peaks[1] < 1.2 * peaks[0] < 500e6
