"""The sketches decide: fences follow their group, and junk in a group can't lift its fence."""

import random

from pyspark.sql import functions as F

from tallymark.llm import quality_rules


def text(r, n, size, junk=0):
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size + r.randint(-1, 1))) for _ in range(n)]
    return " ".join(w + "#" * junk for w in words)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return {r.doc_id: r.kept for r in quality_rules.apply_rules(df).collect()}, df


def fences_of(df):
    base = quality_rules.measures(df)
    base = base.select("*", *[F.expr(v).alias(f"v_{m}") for m, v in quality_rules._values().items()])
    return {r.source_own: r for r in quality_rules.fences(quality_rules.sketches(base)).collect()}


def test_fences_differ_and_a_verdict_follows_its_group(spark):
    r = random.Random(4)
    short = [(i, text(r, 200, 4), "en", "short") for i in range(60)]
    long = [(100 + i, text(r, 200, 9), "en", "long") for i in range(60)]
    stranger = text(r, 200, 9)
    kept, df = run(spark, [*short, *long, (900, stranger, "en", "short")])
    other, _ = run(spark, [*short, *long, (900, stranger, "en", "long")])
    f = fences_of(df)
    assert f["short"].fence_long < f["long"].fence_long
    assert not kept[900] and other[900]
    assert sum(kept.values()) >= 0.95 * 120
    # the same document in a group whose distribution has moved
    moved = [(i, text(r, 200, 9 if i % 2 else 4), "en", "short") for i in range(60)]
    assert run(spark, [*moved, *long, (900, stranger, "en", "short")])[0][900]


def test_a_third_of_junk_does_not_lift_the_fence(spark):
    r = random.Random(5)
    clean = [(i, text(r, 200, 5), "en", "a") for i in range(80)]
    junk = [(100 + i, text(r, 200, 5, junk=2), "en", "a") for i in range(40)]
    kept, _ = run(spark, [*clean, *junk])
    assert not any(kept[d] for d, *_ in junk) and sum(kept[d] for d, *_ in clean) >= 78


def test_repeat_words_are_exact(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(r.randint(0, 90))), "en", "a") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for row in quality_rules.measures(df).collect():
        w = rows[row.doc_id][1].split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert row.n_repeat_words == len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", None), (2, "", "en", None), (None, "a b", None, "x")]
    kept, df = run(spark, rows)
    assert kept == {1: False, 2: False, None: False} and quality_rules.digest(df.limit(0)).count() == 0
