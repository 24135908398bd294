import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import decontamination, fingerprint_index, language_id, line_dedup, mixing, ngram_join, quality_model, quality_rules, suffix_dedup, token_counts
from tallymark.llm.components import components
from tallymark.llm.queries import ORACLES, QUERIES, tokenizer_path
from tallymark.llm.tables import Scratch

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# é-texts, repeats, ties, empties and columns whose names the operators use themselves
BASE = " ".join(f"w{i}é" for i in range(60))
ODD = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("w30", "x30"), "fr", None), (4, None, None, None), (5, "", "en", "b"), (6, " \n\t ", "de", "b"),
    (7, BASE, "en", "a"), (7, BASE, "en", "a"), (8, "one", "en", "c"), (9, ("the same line again and again\n" * 40) + BASE, "en", "c"), (10, "x" * 300_000, "en", "c"), (None, BASE, "en", "a"), (11, "x " * 3000, "es", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n int, bits int, size int, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, len(r[1] or "")) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], connect(SF))


def brute_bytes(rows, w=100):
    seen, out = set(), {}
    for d, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            s = b[i : i + w]
            if s in seen:
                m[i : i + w] = True
            seen.add(s)
        spans = int((m & ~np.concatenate([[False], m[:-1]])).sum()) if len(b) else 0
        out[d] = (len(b), int(m.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest())
    return out


def test_suffix_array_is_sorted():
    r = np.random.RandomState(0)
    for _ in range(40):
        t = r.randint(1, r.randint(2, 6), r.randint(1, 300)).astype(np.uint8)
        b = t.tobytes()
        assert suffix_dedup.suffix_array(t, 1000).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_suffix_dedup(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, odd.where("doc_id is null or doc_id <> 10")):
        got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(df).collect() if r.doc_id is not None}
        want = brute_bytes([(r.doc_id, r.text) for r in df.collect()])
        assert got == {(d, *v) for d, v in want.items()}


def test_fingerprint_index_is_the_same_in_any_number_of_batches(docs):
    one, many = ({tuple(r) for r in fingerprint_index.digest(docs, n).collect()} for n in (1, 5))
    assert one == many


def test_mixing(spark, docs, odd):
    d = mixing.digest(docs).collect()
    targets = {r.source_size: r.target for r in d}
    assert abs(sum(targets.values()) - sum(targets)) < 1 and all(t <= 3 * s for s, t in targets.items())
    assert all(r.taken <= 3 * r["size"] for r in d)
    got = mixing.digest(odd).collect()
    assert len(got) == len(ODD) and all(r.taken == 0 for r in got if r.doc_id in (4, 5, 6))
    assert mixing.emit(odd).columns == odd.columns


def test_line_dedup(docs, rows):
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in line_dedup.digest(docs).collect()}
    fold = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    occ, texts = defaultdict(list), dict(rows)
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                occ[fold(line.encode())].append((d, i))
    lines = list(occ)
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    inv, shared, root = defaultdict(list), Counter(), list(range(len(lines)))
    for i, s in enumerate(sets):
        for g in s:
            for j in inv[g]:
                shared[j, i] += 1
            inv[g].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in shared.items():
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    groups, gone = defaultdict(list), defaultdict(set)
    for i, x in enumerate(lines):
        groups[find(i)] += occ[x]
    for g in groups.values():
        for d, i in sorted(g)[1:]:
            gone[d].add(i)
    want = {d: (len(gone[d]), hashlib.sha256("\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d]).encode()).hexdigest()) for d, t in texts.items()}
    same = sum(got[d] == want[d] for d in want)
    assert same >= 0.995 * len(want)  # banding has a recall just under 1


def lines_left(texts):
    """The texts with the first line of each component of like lines, by all pairs; one line a text, all of 8 bytes or more."""
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in (t.lower().encode() for t in texts)]
    root = list(range(len(texts)))
    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if len(x & y) >= 0.8 * len(x | y):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [t if root[i] == i else "" for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [line_dedup.BLOCK_BYTES, 20_000])
def test_line_dedup_joins_all_variants_of_a_line(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", block)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(40)]
    texts = [" ".join(base)]
    for _ in range(300):
        own = list(base)
        for i in r.sample(range(40), 2):
            own[i] = word()
        texts.append(" ".join(own))
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [x.text for x in line_dedup.without_repeats(df).orderBy("doc_id").collect()]
    assert got == lines_left(texts)


def test_line_dedup_of_repeated_content(spark):
    texts = ["-" * 10, "-" * 80, "ab" * 6, "ab" * 60, "something else that stands alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [x.text for x in line_dedup.without_repeats(df).orderBy("doc_id").collect()]
    assert got == lines_left(texts) == [texts[0], "", texts[2], "", texts[4]]


def test_language_and_quality_on_held_out_rows(spark, docs):
    lang = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    quality = quality_model.score(docs, labels).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert lang > 0.97 and quality > 0.95


def test_token_counts_are_the_library_s(odd):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    machine = token_counts.TextMachine(tokenizer_path())
    number = lambda s: len(tk.encode(s, add_special_tokens=False).ids)
    r = random.Random(3)
    pool = [*"aAbe'stdremvl  \n\t\r\x0b\x1c\x1f\x85\xa0\u2003\u30001½é中\U0001f642.,$#<|>", "<|endoftext|>", "'re", "'ll", "   "]
    draw = lambda: "".join(r.choice(pool) for _ in range(r.randint(0, 40)))
    for _ in range(2000):
        s = draw()
        state, n = machine.advance(token_counts.START, s)  # a character at a time, by arrays, and by maps of random chunks
        assert n + machine.end(state) == machine.whole(s) == machine.count(s, r.randint(1, 9)) == number(s)
    for _ in range(60):  # a text cut at every position; four chunks composed in both orders
        s = draw()
        cuts = sorted(r.randint(0, len(s)) for _ in range(3))
        a, b, c, d = (machine.chunk(s[i:j]) for i, j in zip([0, *cuts], [*cuts, len(s)], strict=True))
        two = machine.compose
        for m in [two(machine.chunk(s[:i]), machine.chunk(s[i:])) for i in range(len(s) + 1)] + [two(two(a, b), two(c, d)), two(a, two(b, two(c, d)))]:
            state, n = machine.apply(m, token_counts.START)
            assert n + machine.end(state) == number(s)
    some = [draw() for _ in range(300)]
    machine.tokens.reset()  # numbers of states are not part of a state
    assert [machine.whole(s) for s in some] == [number(s) for s in some]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd, tokenizer_path()).collect())
    assert got == sorted((d or 0, len((t or "").encode()), len(tk.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in ODD)


def test_decontamination_finds_edited_passages_only(spark):
    r = random.Random(5)
    bench = [(b.item_id, b.text) for b in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    rows, want = [], {}
    for k, d in enumerate(spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()):
        t = d.text
        if k % 2:
            item, s = bench[k][0], list(bench[k][1])
            for _ in range(k % 4 * len(s) // 60):
                s[r.randrange(len(s))] = r.choice(["q", "", "zz"])
            at = r.randint(0, len(t))
            t, want[d.doc_id] = t[:at] + " " + "".join(s).upper() + " " + t[at:], item
        rows.append((d.doc_id, t))
    df, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontamination.matches(df, b).collect()}
    assert all(i in got[d] for d, i in want.items())
    assert got == {r.doc_id: r["items"] for r in decontamination.matches(df, b, block_bytes=9000).collect()}
    assert decontamination.matches(df, b.limit(0)).where("contaminated").count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_join_with_other_parameters(docs, rows):
    got = {r.doc_id: r.component_id for r in ngram_join.classes(docs, 5, 80, 100).collect()}
    fold = {i: i + 32 for i in range(65, 91)}
    sets, inv, shared, root = {}, defaultdict(list), Counter(), {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets[d], root[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()), d
        for g in sets[d]:
            for e in inv[g]:
                shared[e, d] += 1
            inv[g].append(d)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in shared.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {d: find(d) for d in root}


def test_odd_input(spark, odd):
    """Nulls, empties, repeats, long texts, clashing columns and empty tables: one row for each row."""
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (8, 0, None), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, BASE[:200]), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    runs = {
        "suffix": suffix_dedup.digest, "mix": mixing.digest, "lines": line_dedup.digest, "index": fingerprint_index.digest, "quality": lambda d: quality_model.score(d, labels), "bench": lambda d: decontamination.matches(d, bench),
        "lang": language_id.identify, "tokens": lambda d: token_counts.count_tokens(d, tokenizer_path()), "rules": quality_rules.digest, "join": ngram_join.classes,
    }
    for name, f in runs.items():
        assert f(odd).count() == len(ODD), name
        assert f(odd.limit(0)).count() == 0, name
    join = {(r.doc_id, r.component_id) for r in ngram_join.classes(odd).collect()}
    assert {(1, 1), (2, 1), (7, 1), (4, 4), (5, 5), (None, None)} <= join
    kept = [r.doc_id for r in ngram_join.keep_one(odd).collect()]
    assert kept.count(7) == 0 and 1 in kept and 4 in kept
    for f in (line_dedup.without_repeats, ngram_join.keep_one, lambda d: quality_model.keep_good(d, labels), lambda d: decontamination.keep_clean(d, bench), mixing.emit):
        assert f(odd).columns == odd.columns and f(odd.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == docs.columns and 0 < out.count()
    assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
