import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import dictionary, render, text
from tallymark.operators import audit, lookup, reconcile, runs, scoring
from tallymark.plans import coordinator, tools
from tallymark.schema import CLAIMS, EXTRACTED, FACTS
from tallymark.sources import filings
from tallymark.streaming import landing


def fact(concept, value, start, end, filed="2023-11-03", accn="a", form="10-K", unit="USD", ord_=1):
    return ("T", "0000000001", concept, concept, float(value), unit, start, end, 2023, "FY", form, filed, accn, ord_)


def claim(id_, metric, kind, value, end="2023-09-30", start="2022-09-25", cend=None, cstart=None, den=None, tol=None, as_of=None, unit="USD"):
    return (id_, "T", metric, kind, float(value), end, start, cend, cstart, den, unit, tol, as_of)


PRIOR = {"cend": "2022-09-24", "cstart": "2021-09-26"}
BOOK = [
    fact("Revenues", 394_328e6, "2021-09-26", "2022-09-24", "2022-10-28", "b", ord_=1), fact("Revenues", 383_285e6, "2022-09-25", "2023-09-30", ord_=2),
    fact("GrossProfit", 170_782e6, "2021-09-26", "2022-09-24", "2022-10-28", "b", ord_=3), fact("GrossProfit", 169_148e6, "2022-09-25", "2023-09-30", ord_=4),
    fact("Revenues", 380_000e6, "2022-09-25", "2023-09-30", "2024-06-01", "c", "10-K/A", ord_=5), fact("Zero", 0, "2021-09-26", "2022-09-24", ord_=6), fact("Zero", 5, "2022-09-25", "2023-09-30", ord_=7),
    fact("Twice", 1, "2022-09-25", "2023-09-30", ord_=8), fact("Twice", 1, "2023-07-01", "2023-09-30", ord_=9),
]


def test_reconcile_cases(spark):
    cases = [
        (claim("right", "Revenues", "absolute", 383_285e6, as_of="2024-01-01"), "consistent", "match"),
        (claim("restated", "Revenues", "absolute", 380_000e6), "consistent", "match"),
        (claim("boundary", "GrossProfit", "absolute", 169_148e6 * 1.01), "consistent", "match"),
        (claim("near", "GrossProfit", "absolute", 169_148e6 * 1.015), "inconsistent", "near_miss"),
        (claim("large", "GrossProfit", "absolute", 500_000e6), "inconsistent", "large_miss"),
        (claim("growth", "Revenues", "growth_pct", -2.8, as_of="2024-01-01", **PRIOR), "consistent", "match"),
        (claim("sign", "Revenues", "growth_pct", 2.8, as_of="2024-01-01", **PRIOR), "inconsistent", "large_miss"),
        (claim("change", "Revenues", "absolute_change", -11_043e6, as_of="2024-01-01", **PRIOR), "consistent", "match"),
        (claim("bps", "GrossProfit", "bps_change", 82, den="Revenues", as_of="2024-01-01", **PRIOR), "consistent", "match"),
        (claim("no context", "Revenues", "growth_pct", 1), "unverifiable", "missing_comparison_context"),
        (claim("no denominator", "Revenues", "bps_change", 1, **PRIOR), "unverifiable", "missing_comparison_context"),
        (claim("zero", "Zero", "growth_pct", 1, **PRIOR), "unverifiable", "zero_denominator"),
        (claim("missing", "Nothing", "absolute", 1), "unverifiable", "missing_fact"),
        (claim("unit", "Revenues", "absolute", 1, unit="EUR"), "unverifiable", "missing_fact"),
        (claim("ambiguous", "Twice", "absolute", 1, start=None), "unverifiable", "ambiguous_period"),
        (claim("kind", "Revenues", "ratio", 1), "unverifiable", "unsupported_comparison_type"),
    ]
    got = reconcile.reconcile(spark.createDataFrame([c for c, _, _ in cases], CLAIMS), spark.createDataFrame(BOOK, FACTS))
    assert {r.claim_id: (r.verdict, r.reason_code) for r in got.collect()} == {c[0]: (v, w) for c, v, w in cases}


def test_lookup_matches_the_rule_on_random_facts(spark):
    rnd = random.Random(5)
    starts = [None, "2020-01-01", "2020-04-01"]
    book = [("T", "1", rnd.choice("ab"), "l", float(rnd.randint(1, 3)), "USD", rnd.choice(starts), rnd.choice(["2020-06-30", "2020-09-30"]), 2020, "Q2", "10-Q", rnd.choice(["", "2020-08-01", "2020-10-01"]), rnd.choice("xyz"), i) for i in range(60)]
    asks = [(f"r{i}", "T", rnd.choice("abc"), "USD", rnd.choice(["2020-06-30", "2020-09-30"]), rnd.choice(starts), rnd.choice([None, "2020-08-15"])) for i in range(200)]
    got = lookup.lookup(spark.createDataFrame(asks, "req_id string, ticker string, concept string, unit string, period_end string, period_start string, as_of string"), spark.createDataFrame(book, FACTS)).collect()
    for r in got:
        c = [f for f in book if f[2] == r.concept and f[7] == r.period_end and (r.as_of is None or f[11] <= r.as_of)]
        c = [f for f in c if f[6] == r.period_start] if r.period_start else c
        if len({f[6] for f in c}) > 1:
            want = ("ambiguous_period", None, None)
        elif not c:
            want = ("missing_fact", None, None)
        else:
            several = len({f[4] for f in c}) > 1
            f = max(c, key=lambda f: (f[11], f[12], -f[13])) if several else min(c, key=lambda f: (f[11], f[12], f[13]))
            want = ("found", f[4], f[12])
        assert (r.status, r.value, r.accession) == want


def test_dictionary_size():
    rows = dictionary.metric_rows()
    assert len({r[0] for r in rows}) == 67 and len({r[1] for r in rows}) == 40


def test_hints(spark):
    rows = [("fiscal year 2025", 2025, None), ("FY 2024", 2024, None), ("in 2023", 2023, None), ("fiscal years 2026 and on", None, None), ("third fiscal quarter", None, "Q3"), ("Q2 of fiscal 2022", 2022, "Q2"), ("the September quarter", None, None)]
    df = spark.createDataFrame(rows, "p string, y int, q string").select("y", "q", text.hint_year(F.col("p")).alias("gy"), text.hint_quarter(F.col("p")).alias("gq"))
    assert all((r.y, r.q) == (r.gy, r.gq) for r in df.collect())


def test_greedy_matching_takes_the_first_that_is_left(spark):
    c = lambda m, v, k="absolute", u="USD": (m, float(v), u, "", k, "")
    df = spark.createDataFrame([(1, [c("Net revenue", 10), c("revenue", 10), c("tax", 3)], [c("revenue", 10), c("revenue", 10), c("revenue", 10)]), (2, [], [c("x", 1)]), (3, [c("x", 1)], [])], f"id int, preds {EXTRACTED}, golds {EXTRACTED}")
    got = {r.id: (r.hits, len(r.left)) for r in scoring.match_greedy(df).collect()}
    assert got == {1: ([True, True, False], 1), 2: ([False], 0), 3: ([], 1)}


def test_verdicts_and_rewards(spark):
    rows = [("VERDICT: consistent then Verdict: INCONSISTENT", "inconsistent", "near_miss", 1.0), ("nothing", "consistent", "match", -2.0), ("VERDICT: consistent", "inconsistent", "near_miss", -0.7), ("VERDICT: unverifiable", "consistent", "match", 0.0)]
    df = spark.createDataFrame(rows, "c string, v string, r string, w double").select("w", scoring.reward(F.col("c"), F.col("v"), F.col("r")).alias("g"))
    assert all(abs(r.w - r.g) < 1e-12 for r in df.collect())


def test_md5_bucket_is_the_number_modulo(spark):
    import hashlib

    ids = [f"abs-{i}" for i in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "i string").select("i", text.md5_bucket(F.col("i"), 7).alias("b"))
    assert all(r.b == int(hashlib.md5(r.i.encode()).hexdigest(), 16) % 7 for r in df.collect())


def test_leaf_blocks_and_sections(spark):
    html = "<div>lost<p>Item 7.</p><p>Management’s Discussion</p><p>We sold more of everything this year.<div><span>Costs</span> <b>fell a lot too, which helped.</b></div><td>short</td><p>Item 8 – Financial Statements</p></div>"
    assert filings.leaf_blocks(html)[:2] == ["Item 7.", "Management’s Discussion"]
    df = spark.createDataFrame([("f", html), ("g", "<p>nothing</p>"), ("h", None)], "k string, html string")
    got = {(r.k, r.chunk_index, r.text, r.error) for r in filings.get_section(df, "k", "10-K").collect()}
    assert ("f", 0, "We sold more of everything this year.", None) in got and ("g", None, None, filings.NO_START) in got and ("h", None, None, filings.NO_START) in got


def test_budget_counts_failures_as_calls_only(spark):
    rows = [("r", i, i in (1, 2), float(i)) for i in range(6)]
    got = runs.within_budget(spark.createDataFrame(rows, "run string, ord int, failed boolean, elapsed double"), max_chunks=2).orderBy("ord").collect()
    assert [r.processed for r in got] == [True, True, True, True, False, False] and got[4].reason == "chunks"


def test_short_numbers_read_like_printf(spark):
    values = [0.0, 1.0, 123456.0, 1234567.0, 0.0001, 0.00001234, -2.5, 99.99996, 1e22, 0.1 + 0.2, 100.0, 341004.99, 999999.5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", render.short(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.v:g}" for r in got]


def test_explanations_and_the_tool_surface(spark):
    t = tools.Tools(spark, spark.createDataFrame(BOOK, FACTS))
    r = t.reconcile_claim("t", "Revenues", "absolute", 383_285e6, "2023-09-30", period_start="2022-09-25", as_of="2024-01-01").first()
    assert (r.verdict, r.reason_code, r.citations) == ("consistent", "match", ["a"]) and "383,285,000,000" in r.explanation
    r = t.reconcile_claim("T", "GrossProfit", "bps_change", 82, "2023-09-30", "2022-09-25", "2022-09-24", "2021-09-26", "Revenues", as_of="2024-01-01").first()
    assert r.verdict == "consistent" and "82.1 bps" in r.explanation and "43.3096%" in r.explanation
    assert t.reconcile_claim("T", "Nothing", "absolute", 1, "2023-09-30").first().explanation.endswith("missing fact")
    assert [r.concept for r in t.list_concepts("t").collect()] == ["GrossProfit", "Revenues", "Twice", "Zero"] and t.get_xbrl_facts("T", ["Zero"]).count() == 2 and t.ping() == "pong"


def test_section_tool_gives_error_rows(spark):
    docs = spark.createDataFrame([("T", "10-K", "a1", "2024-01-01", "<p>none</p>"), ("T", "10-K", "a0", "2023-01-01", "<p>older</p>")], "ticker string, form string, accession_number string, filing_date string, html string")
    t = tools.Tools(spark, spark.createDataFrame([], FACTS), documents=docs)
    assert [(r.accession_number, r.error) for r in t.get_mdna("t").collect()] == [("a1", filings.NO_START)]
    with pytest.raises(ValueError):
        t.get_mdna("t", "8-K")


def test_feedback_and_case_checks(spark):
    c = lambda m, v, k="absolute", u="USD": (m, float(v), u, "", k, "")
    rows = [(1, [c("revenue", 10), c("tax", 3)], [c("revenue", 10), c("cash", 4)]), (2, [c("revenue", 10)], [c("revenue", 10)])]
    m = scoring.match_greedy(spark.createDataFrame(rows, f"id int, preds {EXTRACTED}, golds {EXTRACTED}"))
    got = {r.id: r for r in m.select("id", render.feedback().alias("f"), audit.all_found(F.col("hits"), F.col("left")).alias("ok"), audit.only_type(F.col("preds"), "absolute").alias("kind"), audit.qualified_apart(F.col("preds"), F.lit("revenue"), F.lit(3.0)).alias("apart")).collect()}
    assert got[1].f == "1/2 claims found. missed: absolute 'cash' ~4. extra: absolute 'tax' ~3" and not got[1].ok and got[1].kind and got[1].apart
    assert got[2].ok and not got[2].apart


def test_answers_are_read_inside_and_outside_fences(spark):
    body = '{"claims": [{"metric": "revenue", "value": 1.5, "value_unit": "USD", "period": "", "comparison_type": "absolute", "quote": "q"}]}'
    rows = [(0, body, 1), (1, f"```json\n{body}\n```", 1), (2, f" ```\n{body}\n```\nas asked", 1), (3, "no json", None), (4, None, None)]
    df = spark.createDataFrame(rows, "i int, t string, n int").select("n", F.when(render.parse_answer(F.col("t")).isNotNull(), F.size(render.parse_answer(F.col("t")))).alias("g"))
    assert all(r.n == r.g for r in df.collect())


def test_quotes_and_no_break_spaces(spark):
    chunks = spark.createDataFrame([("a", 0, "net sales rose")], "accession string, chunk_index int, text string")
    labels = spark.createDataFrame([("a", 0, "net sales"), ("a", 0, "fell"), ("b", 0, "net sales"), ("a", 0, None)], "accession string, chunk_index int, quote string")
    assert sorted(r.found for r in audit.check_quotes(labels, chunks).collect()) == [False, False, False, True]


def test_stale_state(spark):
    side = lambda *names: spark.createDataFrame([(n,) for n in names], "accession string")
    stale = lambda a, b: runs.is_stale(a, b).first().stale
    assert not stale(side("a", "b", "a"), side("b", "a")) and stale(side("a"), side("a", "b")) and stale(side("a", "b"), side("a")) and not stale(side(), side())


def test_run_stops_resumes_and_traces(spark):
    chunks = spark.createDataFrame([("r", "a", i, i == 1, 0.0) for i in range(4)], "run string, accession string, chunk_index int, failed boolean, elapsed double")
    first = coordinator.plan(chunks, max_chunks=2)
    state = coordinator.state_of(first)
    assert {(r.chunk_index, r.status) for r in state.collect()} == {(0, "done"), (1, "failed"), (2, "done")}
    again = coordinator.plan(chunks.withColumn("failed", F.lit(False)), state)
    assert {r.chunk_index for r in again.where("processed").collect()} == {1, 3}
    claims = spark.createDataFrame([("a", 0, "c1", 0, "revenue", 5.0, "USD", "consistent")], "accession string, chunk_index int, claim_id string, claim_ord int, metric string, value double, value_unit string, verdict string")
    log = [(r.step, r.action) for r in coordinator.trace(first, claims, claims).orderBy("step").collect()]
    assert log == list(enumerate(["extract", "verify", "claim_verdict", "extract", "extraction_failed", "extract", "skip_empty_chunk", "budget_exceeded"], 1))
    r = coordinator.report(first, claims).first()
    assert r.partial and r.partial_reason == "chunks" and (r.consistent, r.inconsistent, r.unverifiable) == (1, 0, 0)


def test_stream_appends_new_files_only(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{n}" for n in ("in", "out", "ck"))
    go = lambda: landing.append_batches(landing.landed(spark, src, "k int", 1), lambda b: b.withColumn("twice", F.col("k") * 2), out, ck).awaitTermination()
    for round_ in range(2):
        spark.createDataFrame([(round_,)], "k int").coalesce(1).write.mode("append").parquet(src)
        go()
    assert sorted((r.k, r.twice) for r in spark.read.parquet(out).collect()) == [(0, 0), (1, 2)]


def test_extractor_scores_label_checks_and_judge_inputs(spark):
    c = lambda m, v: (m, v, "USD", "", "absolute", "")
    rows = [("x", 1, [c("revenue", 10.0)], [c("revenue", 10.0), c("cash", 4.0)]), ("x", 2, None, [c("tax", 3.0)]), ("y", 1, [c("debt", 1.0)], [])]
    df = spark.createDataFrame(rows, f"extractor string, id int, preds {EXTRACTED}, golds {EXTRACTED}")
    got = {r.extractor: (r.tp, r.fp, r.fn, r.failed, r.p, r.r) for r in audit.score_runs(df).collect()}
    assert got == {"x": (1, 0, 2, 1, 1.0, 1 / 3), "y": (0, 1, 0, 0, 0.0, 1.0)}
    labels = spark.createDataFrame([([c("a", 1.0), c("b", None)],), ([],), (None,)], f"claims {EXTRACTED}")
    assert tuple(audit.validate_labels(labels).first()) == (3, 2, 2, 1)
    matches = spark.createDataFrame([("m", "T", "Revenues", "2022-09-25", "2023-09-30"), ("n", "T", "None", None, "2023-09-30")], "match_id string, ticker string, concept string, period_start string, period_end string")
    got = {r.match_id: [e.value for e in r.evidence] for r in audit.judge_inputs(matches, spark.createDataFrame(BOOK, FACTS)).collect()}
    assert got == {"m": [383_285e6, 380_000e6], "n": []}


def test_overlapping_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    texts = lambda n: [(i, " ".join(rng.choices("alpha beta gamma delta the of eps zeta eta 7".split(), k=rng.randrange(0, 9)))) for i in range(n)]
    left, right = texts(60) + [(60, None), (61, ""), (62, "the of")], texts(40) + [(40, None), (41, "the")]
    bag = lambda t: set((t or "").split()) - set(text.STOPWORDS)
    for least in (0.5, 0.8, 1.0):
        want = {(a, b, len(bag(s) & bag(t)) / max(len(bag(s)), len(bag(t)))) for a, s in left for b, t in right if bag(s) and bag(t) and len(bag(s) & bag(t)) >= least * max(len(bag(s)), len(bag(t)))}
        rows = scoring.overlapping(spark.createDataFrame(left, "a int, text string"), spark.createDataFrame(right, "b int, text string"), least).collect()
        assert len(rows) == len(want) > 0 and {tuple(r) for r in rows} == want


def test_section_errors_by_cause(spark):
    start, end, body = "<p>Item 7.</p><p>Management's</p><p>Discussion</p>", "<p>Item 8. Financial Statements</p>", "<p>We sold more than in the year before.</p>"
    pages = {"all": start + body + end, "contents": start + end + start + body * 3 + end, "short": start + "<p>few</p>" + end, "endless": start + body, "startless": body + end, "backward": end + body + start, "null": None}
    rows = filings.get_section(spark.createDataFrame(list(pages.items()), "k string, html string"), "k", "10-K").collect()
    assert {(r.k, r.error) for r in rows if r.error} == {("endless", filings.NO_END), ("startless", filings.NO_START), ("null", filings.NO_START), ("backward", filings.NO_PAIR)}
    assert sorted((r.k, r.chunk_index) for r in rows if not r.error) == [("all", 0), ("contents", 0), ("contents", 1), ("contents", 2)]
    with pytest.raises(ValueError):
        filings.get_section(spark.createDataFrame(list(pages.items()), "k string, html string"), "k", "8-K")
