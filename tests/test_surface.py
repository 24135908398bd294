"""State that outlives a run, the tool surface, sources of candidates, helpers, and the verification path case by case."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions import dictionary, render
from tallymark.operators import audit, resolve
from tallymark.plans import tools
from tallymark.schema import FACTS
from tallymark.sources import filings
from tallymark.streaming import landing


def fact(concept, value, start, end, fy, fp, filed, ord_, unit="USD"):
    return ("T", "0000000001", concept, concept, float(value), unit, start, end, fy, fp, "10-K" if fp == "FY" else "10-Q", filed, f"a{ord_}", ord_)


BOOK = [
    fact("Revenues", 400, "2023-01-01", "2023-12-31", 2023, "FY", "2024-02-01", 1), fact("Revenues", 300, "2022-01-01", "2022-12-31", 2022, "FY", "2023-02-01", 2),
    fact("Revenues", 120, "2023-10-01", "2023-12-31", 2023, "Q4", "2024-02-01", 3), fact("Revenues", 110, "2023-07-01", "2023-09-30", 2023, "Q3", "2023-11-01", 4),
    fact("Revenues", 90, "2022-10-01", "2022-12-31", 2022, "Q4", "2023-02-01", 5), fact("Revenues", 80, "2022-07-01", "2022-09-30", 2022, "Q3", "2022-11-01", 6),
    fact("GrossProfit", 200, "2023-01-01", "2023-12-31", 2023, "FY", "2024-02-01", 7), fact("GrossProfit", 120, "2022-01-01", "2022-12-31", 2022, "FY", "2023-02-01", 8),
    fact("Assets", 1000, None, "2023-12-31", 2023, "FY", "2024-02-01", 9), fact("Assets", 900, None, "2022-12-31", 2022, "FY", "2023-02-01", 10),
    fact("EffectiveIncomeTaxRateContinuingOperations", 0.15, "2023-01-01", "2023-12-31", 2023, "FY", "2024-02-01", 11, "pure"),
]
CASES = [  # metric, value, unit, period, kind, occurrence, as_of -> verdict, computed
    ("total revenue", 400.0, "USD", "fiscal year 2023", "absolute", 0, None, "consistent", 400.0),
    ("total revenue", 300.0, "USD", "fiscal year 2022", "absolute", 0, None, "consistent", 300.0),
    ("total revenue", 300.0, "USD", "fiscal year 2023", "absolute", 0, None, "inconsistent", 400.0),
    ("total revenue", 110.0, "USD", "third quarter of fiscal 2023", "absolute", 0, None, "consistent", 110.0),
    ("total revenue", 120.0, "USD", "Q4", "absolute", 0, None, "consistent", 120.0),
    ("Total Assets ", 1000.0, "USD", "", "absolute", 0, None, "consistent", 1000.0),
    ("total assets", 900.0, "USD", "", "absolute", 1, None, "consistent", 900.0),
    ("total assets", 900.0, "USD", "a year ago", "absolute", 0, None, "consistent", 900.0),
    ("total assets", 900.0, "USD", "", "absolute", 0, "2023-06-30", "consistent", 900.0),
    ("effective tax rate", 15.0, "percent", "", "absolute", 0, None, "consistent", 0.15),
    ("total assets", 10.0, "percent", "", "absolute", 0, None, "unverifiable", None),
    ("gross profit", 200.0 / 3, "percent", "fiscal year 2023", "growth_pct", 0, None, "consistent", 200.0 / 3),
    ("gross profit", 80.0, "USD", "fiscal year 2023", "absolute_change", 0, None, "consistent", 80.0),
    ("gross margin percentage", 1000.0, "bps", "fiscal year 2023", "bps_change", 0, None, "consistent", 1000.0),
    ("effective tax rate", 1.0, "percent", "", "growth_pct", 0, None, "unverifiable", None),
    ("happiness", 1.0, "USD", "", "absolute", 0, None, "unverifiable", None),
    ("total revenue", 1.0, "USD", "", "absolute", 0, "2020-01-01", "unverifiable", None),
]


def test_verification_case_by_case(spark):
    rows = [(f"c{i:02d}", "T", *c[:2], c[2], c[3], c[4], c[5], c[6]) for i, c in enumerate(CASES)]
    claims = spark.createDataFrame(rows, "claim_id string, ticker string, metric string, value double, value_unit string, period string, comparison_type string, occurrence int, as_of string")
    got = {r.claim_id: (r.verdict, r.computed_value) for r in resolve.verify(claims, spark.createDataFrame(BOOK, FACTS), dictionary.metrics(spark), dictionary.ratios(spark)).collect()}
    for i, c in enumerate(CASES):
        assert got[f"c{i:02d}"][0] == c[7], c
        assert got[f"c{i:02d}"][1] == (None if c[8] is None else pytest.approx(c[8])), c


def test_tool_surface(spark):
    arrays = ", ".join(f"{n} array<string>" for n in filings.INDEX_FIELDS)
    index = spark.createDataFrame([("T", "12", ["1-2-3", "1-2-4"], ["2024-02-01", "2024-01-01"], ["2023-12-31", "2023-12-31"], ["10-K", "4"], ["x.htm", "y.htm"], ["", ""])], f"ticker string, cik string, {arrays}")
    t = tools.Tools(spark, spark.createDataFrame(BOOK, FACTS), index)
    assert [(r.form, r.filing_url) for r in t.list_filings(" t ").collect()] == [("10-K", "https://www.sec.gov/Archives/edgar/data/12/123/x.htm")]
    with pytest.raises(ValueError):
        t.list_filings("absent")
    with pytest.raises(ValueError):
        t.get_mdna("T", "8-K")
    assert t.ping() == "pong" and t.get_xbrl_facts("t", ["Assets"]).count() == 2
    assert {r.concept for r in t.list_concepts("T").collect()} == {r[2] for r in BOOK}


def test_unknown_companies_raise_in_every_tool_and_in_sql(spark):
    known = spark.createDataFrame([("t",), ("QUIET",)], "ticker string")
    docs = spark.createDataFrame([], "ticker string, form string, accession_number string, filing_date string, html string")
    t = tools.Tools(spark, spark.createDataFrame(BOOK, FACTS), documents=docs, companies=known)
    for call in (t.get_xbrl_facts, t.list_concepts, t.get_mdna):
        with pytest.raises(ValueError, match="unknown ticker: X"):
            call(" x ")
    assert t.get_xbrl_facts("quiet").isEmpty() and t.get_mdna("quiet").isEmpty()
    t.in_sql("unit_")
    assert spark.sql("SELECT * FROM unit_xbrl_facts(' t ')").count() == len(BOOK)
    assert spark.sql("SELECT count(*) FROM unit_concepts_of('T')").first()[0] == len({r[2] for r in BOOK})
    assert spark.sql("SELECT * FROM unit_xbrl_facts('quiet')").isEmpty()
    with pytest.raises(Exception, match="unknown ticker: X"):
        spark.sql("SELECT * FROM unit_xbrl_facts('x')").collect()


def test_the_last_landed_entry_counts_also_on_ties(spark):
    rows = spark.createDataFrame([("a", 1.0, "x"), ("a", 1.0, "y"), ("b", 2.0, "z"), ("b", None, "n")], "key string, fetched_at double, data string")
    assert sorted(map(tuple, filings.landing_latest(rows, 10, 100).collect())) == [("a", 1.0, "y"), ("b", 2.0, "z")]


def test_a_snapshot_reads_new_files_alone(spark, tmp_path):
    source, schema = f"file://{tmp_path}/landed", "key string, fetched_at double, data string"
    land = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    land(*[(f"k{i}", 1.0, "old") for i in range(200)])
    held = landing.Snapshot(spark, source, f"file://{tmp_path}/state")
    first = held.update()
    first.awaitTermination()
    land(("k3", 2.0, "new"), ("k3", 2.0, "newer"), ("k4", 0.5, "late"), ("other", 1.0, "x"))
    second = landing.Snapshot(spark, source, f"file://{tmp_path}/state").update()
    second.awaitTermination()
    assert sum(p["numInputRows"] for p in second.recentProgress) < 200  # the first file is not read again
    full = filings.landing_latest(spark.read.schema(schema).parquet(source), 0, None)
    assert sorted(map(tuple, held.current().select("key", "fetched_at", "data").collect())) == sorted(map(tuple, full.collect()))
    assert held.current().where("key = 'k3'").first().data == "newer"


def test_evidence_of_a_judge(spark):
    facts = spark.createDataFrame(BOOK, FACTS)
    claims = spark.createDataFrame([("c", "T", "GrossProfit", "Revenues"), ("d", "T", "Assets", None), ("e", "T", "None", None)], "claim_id string, ticker string, metric string, denominator_metric string")
    got = {r.claim_id: r for r in audit.judge_inputs_by_concept(claims, facts).collect()}
    assert {r.as_of for r in got.values()} == {"2024-02-01"} and [len(got[c].evidence) for c in "cde"] == [8, 2, 0]
    match = spark.createDataFrame([("m", "T", "Assets", None, "2023-12-31"), ("n", "T", "Assets", "2023-01-01", "2023-12-31")], "match_id string, ticker string, concept string, period_start string, period_end string")
    assert {r.match_id: [e.value for e in r.evidence] for r in audit.judge_inputs(match, facts).collect()} == {"m": [1000.0], "n": []}
    line = facts.where("fact_ord = 1").select(render.fact_line().alias("l")).first().l
    assert line == "[a1 / 10-K / 2024-02-01] for 2023-01-01 to 2023-12-31: " + facts.where("fact_ord = 1").select(render.amount(F.col("value"), F.col("unit"))).first()[0]


def test_sources_of_candidates(spark):
    hits = spark.createDataFrame([(1, ["7"], ["Old"], "2022"), (2, ["7", "8"], ["New"], "2023"), (3, [], ["None"], "2023")], "ord int, ciks array<string>, names array<string>, file_date string")
    assert [tuple(r) for r in filings.search_candidates(hits).collect()] == [("0000000007", "New", "2023")]
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, n int")
    assert filings.only_companies(rows, None).count() == 2
    assert [r.n for r in filings.only_companies(rows, spark.createDataFrame([(" b ",)], "ticker string")).collect()] == [2]
    tickers = spark.createDataFrame([("a", "1")], "ticker string, cik string")
    assert filings.known_ciks(rows.where("n = 1"), tickers).first().cik == "0000000001"
    with pytest.raises(ValueError, match="B"):
        filings.known_ciks(rows, tickers)
    wanted = spark.createDataFrame([("A", "x"), ("A", "y")], "ticker string, accession_number string")
    index = spark.createDataFrame([("A", "x")], "ticker string, accession_number string")
    chunks = spark.createDataFrame([(a, i) for a in "xy" for i in range(70)], "accession_number string, chunk_index int")
    assert filings.original_chunks(wanted, index, chunks).count() == 60


def test_helpers(spark, tmp_path):
    path = f"file://{tmp_path}/lines"
    filings.write_json_lines(spark.createDataFrame([(1, "x")], "a int, b string"), path, single=True)
    assert tuple(filings.read_json_lines(spark, path, "a int, b string").first()) == (1, "x")
    cases = spark.createDataFrame([("c1", "consistent", "inconsistent"), ("c2", "consistent", "consistent")], "label string, verdict string, expected_verdict string")
    assert [r.label for r in audit.falsely_accepted(cases).collect()] == ["c1"]
    two = spark.createDataFrame([(0.5, 0.55, 0.1), (0.5, 0.7, 0.1)], "a double, b double, w double")
    assert [r[0] for r in two.select(audit.within_noise(F.col("a"), F.col("b"), F.col("w"))).collect()] == [True, False]
    texts = {r.concept: r.metric_texts for r in dictionary.texts_by_concept(spark).collect()}
    assert texts["StockholdersEquity"] == ["shareholders' equity", "stockholders' equity", "total stockholders' equity"]
    lines = spark.createDataFrame(BOOK, FACTS).where("fact_ord = 9").select(render.fact_line().alias("l"), render.chat(F.lit("hello")).alias("c")).first()
    assert "2023-12-31" in lines.l and lines.c[1]["content"] == "hello"
