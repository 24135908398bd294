"""The trained operators' numbers against plain formulas: Kneser-Ney probabilities, and the attention scorer's forward pass."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymark.llm import language_id, quality_model
from tallymark.llm.language_id import DISCOUNT, ORDER, KneserNey

TEXTS = {"en": ["the cat and the hat", "a dog", "the dog and a hat at the gate"], "xx": ["tata dada tata", "ada tada", "gag"]}


def packed(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)


def grams_of(text):
    s = " " + text.lower()
    return [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)]


def plain_model(texts, alphabet_size):
    """gram -> probability of its last letter after the others, by the textbook recursion with dictionaries."""
    counts = {ORDER: Counter(g for t in texts for g in grams_of(t))}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])  # continuations: in how many kinds of contexts
    totals, kinds = defaultdict(float), Counter()
    for n in range(1, ORDER + 1):
        for g, c in counts[n].items():
            totals[n, g[:-1]] += c
            kinds[n, g[:-1]] += 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / alphabet_size
        total = totals[n, g[:-1]]
        if not total:
            return p(g[1:])
        return max(counts[n][g] - DISCOUNT, 0) / total + DISCOUNT * kinds[n, g[:-1]] / total * p(g[1:])

    return p


@pytest.fixture(scope="module")
def models():
    langs = sorted(TEXTS)
    keys, of, counts = [], [], []
    for i, lang in enumerate(langs):
        key, _ = language_id.grams(*language_id.letters(*packed(TEXTS[lang])))
        k, n = np.unique(key, return_counts=True)
        keys.append(k), of.append(np.full(len(k), i)), counts.append(n)
    keys, of, counts = (np.concatenate(x) for x in (keys, of, counts))
    size = max(2, len({g[-1] for t in TEXTS.values() for x in t for g in grams_of(x)}) + 1)
    return KneserNey(langs, of, keys, counts.astype(float)), [plain_model(TEXTS[v], size) for v in langs]


def test_probabilities_are_those_of_the_formula(models):
    model, plain = models
    alphabet = " tadghez"  # z is never seen
    every = ["".join(g) for g in itertools.product(alphabet, repeat=ORDER)]
    key = np.array([sum(ord(c) << 16 * (ORDER - 1 - i) for i, c in enumerate(g)) for g in every], np.uint64)
    got = model.lookup(key)
    for column, p in enumerate(plain):
        want = np.array([math.log(p(g)) for g in every])
        assert np.abs(got[:, column] - want).max() < 1e-4


def test_cross_entropies_and_choices(models):
    model, plain = models
    texts = ["the hat", "tada", "dog at the gate and", "Gag DADA", "zzz"]
    data, offsets = packed(texts)
    got, n = model.entropies(data, offsets)
    for i, t in enumerate(texts):
        own = grams_of(t)
        want = [-sum(math.log(p(g)) for g in own) / len(own) for p in plain]
        assert n[i] == len(own) and got[i] == pytest.approx(want, abs=1e-4)


def test_scores_are_a_forward_pass_by_hand(spark):
    """Every document of the small table, passage by passage, with the parameters that were trained."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.train(docs, labels)
    p = {k: np.asarray(v, np.float64).tolist() for k, v in model.p.items()}
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda a, m, j: sum(x * row[j] for x, row in zip(a, m, strict=True))

    def by_hand(text):
        x, begin = quality_model.encode(*packed([text]))
        hidden, weights = [], []
        for row in x[begin[0] : begin[1]]:
            v = [min(6.0, max(-6.0, (a - m) * s)) for a, m, s in zip(row.tolist(), model.mean.tolist(), model.scale.tolist(), strict=True)]
            h = [math.tanh(dot(v, p["W"], j) + p["b"][j]) for j in range(quality_model.HIDDEN)]
            gate = [math.tanh(dot(h, p["V"], j)) * sigmoid(dot(h, p["U"], j)) for j in range(quality_model.GATE)]
            hidden.append(h)
            weights.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        bag = [sum(w * h[j] for w, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(quality_model.HIDDEN)]
        return sigmoid(sum(z * c for z, c in zip(bag, p["c"], strict=True)) + p["c0"][0])

    got = {r.doc_id: r.score for r in quality_model.score(docs, labels).collect()}
    some = [r for r in docs.orderBy("doc_id").collect() if len(r.text or "") < 4000][:60]
    assert len(some) > 40
    for r in some:
        assert got[r.doc_id] == pytest.approx(by_hand(r.text or ""), abs=1e-3)


def test_a_score_does_not_depend_on_the_neighbours(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.train(docs, labels)
    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(80).collect()] + ["", "\n\n  led by white space", "", "#", "trailing \n\n", "x"]
    alone = [model.score(*packed([t]))[0] for t in texts]
    assert model.score(*packed(texts)) == pytest.approx(alone, abs=1e-6)
    assert model.score(*packed(texts[::-1]))[::-1] == pytest.approx(alone, abs=1e-6)
