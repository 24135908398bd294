"""Alignment of two tokenizers, and BPE by tree concatenation, against the libraries themselves."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallymark.llm import bpe_tree, token_alignment
from tallymark.llm.queries import tokenizer_path

BYTE, PIECE, WORD = (tokenizer_path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
PARTS = [
    "a", "b", "'s", "''", "don't", " ", "  ", "\n", " \n ", "\t", "\r", "\r\n", " ", "　", " ", "é", "é", "İ", "Σ", "ſ", "K", "1", "½", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>",
    "<s>", "<0x41>", "漢字", "\U0001f600", "\x00", "\x1c", "-", "the", "ing", ";\r", "\x85", "가", "가", "▁", "'ll", "'S",
]
SCHEMA = "doc_id long, text string, n long, ids int, batch string, seg string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", None) for r in rows], SCHEMA)


def some_rows(n, seed=3):
    rng = random.Random(seed)
    odd = [(None, "no id"), (7, None), (8, ""), (9, " "), (9, "  "), (9, "other text, same id"), (10, "the ▁ mark"), (11, "x" * 60_000), (12, "ha" * 40_000 + " end"), (13, "w " * 9000), (13, "w " * 9000)]
    return odd + [(100 + i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))) for i in range(n)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- op12 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def whole(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def key(r):
    return tuple(str(x) for x in r)


def test_encode_and_decode_equal_the_library(spark, library):
    rows = some_rows(400)
    docs = frame(spark, rows)
    want = sorted(((d, *whole(library, t)) for d, t in rows), key=key)
    assert sorted((tuple(r) for r in bpe_tree.digest(docs, WORD).collect()), key=key) == want
    encoded = bpe_tree.encode(docs, WORD)
    assert sorted(((r.doc_id, len(r.ids), sha(" ".join(map(str, r.ids)))) for r in encoded.collect()), key=key) == sorted((w[:3] for w in want), key=key)
    assert sorted(((r.doc_id, sha(r.text)) for r in bpe_tree.decode(encoded, WORD).collect()), key=key) == sorted(((w[0], w[3]) for w in want), key=key)
    assert bpe_tree.digest(docs.limit(0), WORD).count() == 0
    assert bpe_tree.decode(spark.createDataFrame([(1, None), (2, [49407, 10**6])], "doc_id long, ids array<int>"), WORD).collect() == [(1, None), (2, "<|endoftext|>")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abehinrst'é", min_size=0, max_size=300), st.integers(2, 9))
def test_trees_of_any_leaf_equal_plain_merging(library, text, leaf):
    with open(WORD, encoding="utf-8") as f:
        words = WORDS.setdefault(leaf, bpe_tree.Words(json.load(f), leaf))
    parts = ["".join(c for c in text if c.isalpha()) or "a"]
    assert words.encode([p.encode() for p in parts]) == [library.encode(p, add_special_tokens=False).ids for p in parts]


WORDS: dict[int, bpe_tree.Words] = {}


def test_windows_grow_where_one_token_does_not_agree(library):
    with open(WORD, encoding="utf-8") as f:
        words = bpe_tree.Words(json.load(f), 4)
    rng = random.Random(2)
    parts = ["".join(rng.choice("aeinrst") for _ in range(2000)) for _ in range(5)]
    assert words.encode([p.encode() for p in parts]) == [library.encode(p, add_special_tokens=False).ids for p in parts]
    assert words.windows > 5 * 511  # more windows than seams: some had to grow


def test_classes_and_forms_of_all_characters(library):
    encoder = bpe_tree.encoder_for(WORD)
    for lo in range(0, 0x110000, 0x8000):
        text = " ".join(f"a{chr(c)}b {chr(c)}" for c in range(lo, lo + 0x8000, 7) if not 0xD800 <= c < 0xE000)
        assert [int(x) for x in next(encoder.encode([text]))[1].split()] == library.encode(text, add_special_tokens=False).ids


def test_long_texts_are_worked_on_in_sections(library, monkeypatch):
    monkeypatch.setattr(bpe_tree, "SECTION_BYTES", 40)
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(200)) for _ in range(20)]
    got = [[int(x) for x in e[1].split()] for e in bpe_tree.Encoder(WORD).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="word-end"):
        bpe_tree.Encoder(BYTE)


# --- op11 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return token_alignment.pair_for(BYTE, PIECE)


def brute(pair, rows):
    """The contract, text by text: both tokenizers on whole texts, overlaps from byte ranges."""
    kept, count = [], Counter()
    for d, t in rows:
        raw = (" " + (t or "")).encode()
        a = pair.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        if not t or b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
            kept.append((d, None))
            continue
        spans = lambda ids, size: list(zip(ids, np.cumsum([0, *size[ids]])[:-1].tolist(), np.cumsum(size[ids]).tolist(), strict=True))
        sa, sb = spans(a, pair.size_a), spans(b, pair.size_b)
        links, j = [], 0
        for x, lo, hi in sa:
            while sb[j][2] <= lo:
                j += 1
            k = j
            while k < len(sb) and sb[k][1] < hi:
                links.append((x, sb[k][0]))
                k += 1
        common = sorted({e for *_, e in sa} & {e for *_, e in sb})
        of = lambda s: [[str(x) for x, _, e in s if lo < e <= hi] for lo, hi in zip([0, *common], common, strict=False)] if len(common) < 400 else None
        if len(common) < 400:
            groups = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(of(sa), of(sb), strict=True))
        else:
            at = {e: i for i, e in enumerate(common)}
            sides = []
            for s in (sa, sb):
                out, now = [], []
                for x, _, e in s:
                    now.append(str(x))
                    if e in at:
                        out.append(",".join(now))
                        now = []
                sides.append(out)
            groups = ";".join(f"{x}|{y}" for x, y in zip(*sides, strict=True))
        kept.append((d, (len(a), len(b), len(common), links, groups)))
        count.update(links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    for d, x in kept:
        if x is None:
            yield (d, 0, 0, 0, 0, 0, 0, "")
        else:
            yield (d, *x[:3], len(x[3]), sum(count[p] == best[p[1]] for p in x[3]), sum(count[p] for p in x[3]), sha(x[4]))


def test_alignment_equals_whole_texts(spark, pair):
    """With texts that have no tokens: their other segments count nowhere."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + some_rows(500) + [(50, "the of ▁ and the"), (51, "the of and the")]
    got = token_alignment.digest(frame(spark, rows).repartition(5), BYTE, PIECE).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(pair, rows), key=key)


def test_more_pairs_than_a_block_holds(spark, pair, monkeypatch):
    monkeypatch.setattr(token_alignment, "MOST_PAIRS", 7)
    rows = [(i, f"one two{i} three_{i % 3}") for i in range(30)]
    got = token_alignment.digest(frame(spark, rows).repartition(3), BYTE, PIECE).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(pair, rows), key=key)


def test_only_the_mark_is_changed_by_b(pair):
    pair.verify()


def test_alignment_without_bad_texts_and_of_nothing(spark, pair):
    rows = [(1, "one two"), (2, "two\nthree"), (2, "two\nthree"), (None, "one two"), (3, None)]
    got = token_alignment.digest(frame(spark, rows), BYTE, PIECE).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(pair, rows), key=key)
    assert token_alignment.digest(frame(spark, []), BYTE, PIECE).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=30).map("".join))
def test_segments_have_the_tokens_of_the_text(pair, text):
    data = np.frombuffer((" " + text).encode(), np.uint8)
    at = [*token_alignment.segment_starts(data, np.array([0, len(data)]), pair.breaks).tolist(), len(data)]
    segments = [data[i:j].tobytes().decode() for i, j in zip(at, at[1:], strict=False)]
    a, b = pair.encode(segments)
    assert sum(a, []) == pair.a.encode(" " + text, add_special_tokens=False).ids
    assert sum(b, []) == pair.b.encode(text)


def test_breaks_are_read_off_the_vocabularies(pair):
    assert set(pair.breaks) == set(" \n\t")  # some pieces hold a carriage return behind other characters


# --- op8 ----------------------------------------------------------------------------------------------------------------


def test_given_texts_go_through_the_maps_of_their_chunks(spark):
    import pyarrow as pa

    from tallymark.llm import token_counts

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    machine = token_counts.TextMachine(BYTE)
    composed = []
    compose = machine.compose
    machine.compose = lambda a, b: composed.append(1) or compose(a, b)
    got = token_counts._count_some(machine, pa.array(texts)).tolist()
    assert sum(len(t.encode()) > token_counts.CHUNK_BYTES for t in texts) > 100 and len(composed) > 200
    library = Tokenizer.from_file(BYTE)
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
