"""Ranked search over a tiered index against a plain ranking."""

import math
import random
import re
from collections import Counter

import pytest

from tallymark.llm import tiered_search
from tallymark.llm.queries import QUERIES

from ..oracle import assert_same, connect

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_all, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_all // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, shard int"), spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, score string")


def made(seed=4, n=700):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "DON", "a b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 80)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 9)))) for i in range(12)]
    return docs, items


def test_equals_a_plain_ranking(spark):
    docs, items = made()
    docs += [(None, "w50 w51"), (5, "w50 other text of that id"), (5, "w50 other text of that id"), (9000, None), (9001, ""), (9002, "-- !!"), (9003, "w3 " * 30_000)]
    items += [(20, None), (21, ""), (22, "nowhere"), (23, "w50"), (23, "w51 W51"), (None, "w1 w2"), (24, "ärger NAÏVE")]
    d, i = frames(spark, docs, items)
    got = tiered_search.rank_documents(d.repartition(7), i).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items)


def test_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(tiered_search, "BLOCK_BYTES", 30)
    docs, items = [(i, "same words here") for i in range(40)], [(i, "same words") for i in range(6)]
    docs += [(100 + i, "filler") for i in range(60)]
    d, i = frames(spark, docs, items)
    got = tiered_search.rank_documents(d.repartition(5), i).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items)


def test_proof_completion_and_fall_through(spark):
    """Items with ten clear hits are proven by the first tier and completed; the others need lower ones."""
    docs, items = made()
    docs += [(10_000 + i, f"needle {'w0 ' * (i + 1)} pin{'x' * (i % 3)} needle") for i in range(14)]
    items += [(50, "needle w0"), (51, "needle w0 w1 w2")]
    d, _ = frames(spark, docs, items)
    index = tiered_search.Index.build(d.repartition(3))
    log = []
    got = tiered_search.search_block(index, items, log=log)
    assert sorted(got, key=str) == plain(docs, items)
    assert log[0][2] > 0 and len(log) > 1 and sum(x[2] for x in log) == len(items)


def test_an_index_is_opened_again(spark):
    docs, items = made(n=100)
    d, i = frames(spark, docs, items)
    built = tiered_search.Index.build(d)
    again = tiered_search.search(tiered_search.Index(spark, built.path), i, k=3)
    assert sorted(map(tuple, again.collect()), key=str) == plain(docs, items, 3)


def test_empty_tables(spark):
    d, i = frames(spark, [], [(1, "a")])
    assert tiered_search.rank_documents(d, i).count() == 0
    d, i = frames(spark, [(1, "a")], [])
    assert tiered_search.rank_documents(d, i).count() == 0


@pytest.mark.parametrize("name", ["op13_tiered_search"])
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    assert_same(QUERIES[name](spark, sf), tiered_search.ORACLE, connect(sf))
