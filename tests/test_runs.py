"""User functions with errors and deadlines, and runs that stop and go on."""

import dataclasses
import time

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tallymark.functions import dictionary
from tallymark.operators import userfn
from tallymark.operators.userfn import UserFunction
from tallymark.plans import coordinator
from tallymark.plans.runstate import TABLES, RunStore
from tallymark.schema import FACTS

from .test_surface import BOOK

CLAIM = "array<struct<metric:string,value:double>>"


@dataclasses.dataclass
class Made:
    metric: str
    value: float


def behave(text):
    if text == "bad":
        raise ValueError("no good")
    if text == "slow":
        time.sleep(20)
    if text == "busy":
        while True:
            pass
    if text == "swallow":
        try:
            time.sleep(20)
        except Exception:
            return []
    return {"odd": [{"metric": "a", "worth": 1.0}], "type": [{"metric": 1, "value": 1.0}], "short": [("a",)], "scalar": 5, None: None, "two": [("a", 1), Made("b", 2.0)]}.get(text, [{"metric": text, "value": 1}])


def test_one_bad_and_one_slow_row_leave_the_others_right(spark):
    texts = ["x", "bad", "slow", "two", "busy", None, "odd", "type", "short", "scalar", "swallow", "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    out = {r.text: r for r in userfn.apply(df, UserFunction(behave, CLAIM, deadline=0.3), ["text"], "claims").collect()}
    assert [tuple(c) for c in out["two"].claims] == [("a", 1.0), ("b", 2.0)] and [tuple(c) for c in out["y"].claims] == [("y", 1.0)]
    assert out[None].claims is None and out[None].claims_error is None
    assert out["bad"].claims_error == "ValueError: no good"
    for late in ("slow", "busy", "swallow"):
        assert out[late].claims_error == "TimeoutError: no result within 0.3 s" and 0.25 < out[late].claims_seconds < 5
    assert "unknown fields: worth" in out["odd"].claims_error and "expected string" in out["type"].claims_error
    assert "expected 2 fields" in out["short"].claims_error and "expected a list" in out["scalar"].claims_error
    assert all(out[t].claims is None for t in ("bad", "slow", "odd", "type", "short", "scalar"))
    counts = userfn.outcomes(userfn.apply(df, UserFunction(behave, CLAIM, deadline=0.3), ["text"], "claims"), [], "claims").first()
    assert (counts.calls, counts.failed, counts.late) == (12, 8, 3)


def test_batches_fail_alone(spark):
    def halves(xs):
        if pc.any(pc.equal(xs, 7)).as_py():
            raise RuntimeError("seven")
        return pc.divide(pc.cast(xs, "float64"), 2)

    df = spark.range(20).coalesce(1)
    rows = userfn.apply(df, UserFunction(halves, "double", batch=True), ["id"], "half").collect()
    assert {r.id: r.half for r in rows} == {i: None if i == 7 else i / 2 for i in range(20)}
    assert [r.half_error for r in rows if r.half_error] == ["RuntimeError: seven"]
    wrong = userfn.apply(df, UserFunction(lambda xs: [1.0], "double", batch=True), ["id"], "half").where("id > 0")
    assert wrong.where("half = 1.0").count() == 19  # the batch does not fit, its single rows do


def test_names_are_checked_and_empty_tables_work(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert userfn.apply(df, UserFunction(behave, CLAIM), ["text"], "claims").count() == 0
    with pytest.raises(ValueError, match="taken"):
        userfn.apply(df, UserFunction(behave, CLAIM), ["text"], "ID")
    with pytest.raises(ValueError, match="no such"):
        userfn.apply(df, UserFunction(behave, CLAIM), ["body"], "claims")


def test_table_function(spark):
    userfn.register(spark, "behave", UserFunction(behave, CLAIM, deadline=0.3))
    userfn.register(spark, "longer", UserFunction(lambda s: len(s) + 1, "bigint"))
    spark.createDataFrame([("x",), ("bad",), ("two",), ("slow",)], "text string").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT t.text, b.* FROM some_texts t, LATERAL behave(t.text) b").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("x", "x", 1.0, None), ("bad", None, None, "ValueError: no good"), ("two", "a", 1.0, None), ("two", "b", 2.0, None), ("slow", None, None, "TimeoutError: no result within 0.3 s")], key=str)
    assert spark.sql("SELECT * FROM longer('abc')").first() == (4, None)


def test_rewards_by_a_user(spark):
    df = spark.createDataFrame([(1, "VERDICT: consistent", "consistent"), (2, "?", "consistent")], "id int, completion string, gold string")
    reward = UserFunction(lambda c, g: 1.0 if c.endswith(g) else -1.0, "double")
    assert {r.id: r.reward for r in userfn.apply(df, reward, ["completion", "gold"], "reward").collect()} == {1: 1.0, 2: -1.0}


# --- runs -----------------------------------------------------------------------------------------------------------------

CHUNKS = [("T", a, i) for a in ("f1", "f2") for i in range(3)]


def world(spark, chunks=CHUNKS, failed=()):
    c = spark.createDataFrame([(*x, x[1:] in failed, 0.0) for x in chunks], "run string, accession string, chunk_index int, failed boolean, elapsed double")
    claims = spark.createDataFrame([(f"{a}/{i}", "T", a, i, 0, "total revenue", 400.0, "USD", "fiscal year 2023", "absolute", None) for _, a, i in chunks], "claim_id string, ticker string, accession string, chunk_index int, claim_ord int, metric string, value double, value_unit string, period string, comparison_type string, as_of string")
    return c, claims


def session(spark, store, c, claims, **kw):
    return coordinator.run_session(store, c, claims, spark.createDataFrame(BOOK, FACTS), dictionary.metrics(spark), dictionary.ratios(spark), **kw)


def done(store):
    return sorted((r.session, r.accession, r.chunk_index, r.status) for r in store.latest("chunks").collect())


@pytest.mark.parametrize("first", [1, 2, 4])
def test_a_run_of_two_filings_stops_anywhere_and_goes_on_twice(spark, tmp_path, first):
    store = RunStore(spark, f"file://{tmp_path}/s")
    c, claims = world(spark)
    session(spark, store, c, claims, max_chunks=first)
    again = RunStore(spark, f"file://{tmp_path}/s")  # another application
    session(spark, again, c, claims, max_chunks=1)
    state = session(spark, again, c, claims)
    assert state.runs.first().resumed and state.runs.first().done == first + 1
    order = [x[1:] for x in CHUNKS]
    assert done(again) == sorted((1 if k < first else 2 if k == first else 3, *x, "done") for k, x in enumerate(order))  # each once
    steps = [r.step for r in again.latest("trace").orderBy("step").collect()]
    assert steps == list(range(1, len(steps) + 1))
    actions = [r.action for r in again.latest("trace").orderBy("step").collect()]
    assert actions.count("resumed") == 2 and actions.count("chunks_retrieved") == 1 and actions.count("budget_exceeded") == 2
    verdicts = again.latest("verdicts").collect()
    assert len(verdicts) == 6 and {v.verdict for v in verdicts} == {"consistent"} and {v.computed_value for v in verdicts} == {400.0}
    assert again.open_epochs().isEmpty()  # finished, so the next session begins anew
    assert not session(spark, again, c, claims, max_chunks=1).runs.first().resumed


def test_other_filings_drop_the_state_and_other_runs_keep_theirs(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    c, claims = world(spark, [*CHUNKS, ("U", "g", 0), ("U", "g", 1)])
    session(spark, store, c, claims, max_chunks=1)
    changed, more = world(spark, [("T", "f1", 0), ("T", "f3", 0), ("U", "g", 0), ("U", "g", 1)])
    runs = {r.run: r for r in session(spark, store, changed, more, max_chunks=1).runs.collect()}
    assert (runs["T"].resumed, runs["T"].epoch, runs["U"].resumed, runs["U"].epoch) == (False, 2, True, 1)
    assert {(r.run, r.accession) for r in store.latest("filings").collect()} == {("T", "f1"), ("T", "f3"), ("U", "g")}
    fewer, _ = world(spark, [("T", "f1", 0)])
    assert not store.begin(fewer).runs.first().resumed
    assert not store.begin(changed, resume=False).runs.where("resumed").count()


def test_failed_chunks_come_again(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    c, claims = world(spark, failed={("f1", 1)})
    session(spark, store, c, claims, max_calls=3)
    assert done(store) == [(1, "f1", 0, "done"), (1, "f1", 1, "failed"), (1, "f1", 2, "done")]
    c, claims = world(spark)
    session(spark, store, c, claims, max_calls=1)
    assert done(store)[-1] == (2, "f1", 1, "done")


def test_a_session_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    store = RunStore(spark, f"file://{tmp_path}/s")
    c, claims = world(spark)
    session(spark, store, c, claims, max_chunks=2)
    with monkeypatch.context() as m:  # all tables are written, the commit is not
        names = {n: [c.split()[0] for c in s.split(", ")] for n, s in TABLES.items()}
        m.setattr(RunStore, "_write", lambda self, tables: [df.select(*names[n]).write.mode("overwrite").parquet(f"{self.path}/{n}/gen=2") for n, df in tables.items()])
        session(spark, store, c, claims, max_chunks=1)
    assert len(done(store)) == 2
    session(spark, store, c, claims, max_chunks=1)
    assert [x[0] for x in done(store)] == [1, 1, 2]


def test_compaction_and_dropping(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    c, claims = world(spark, [*CHUNKS, ("U", "g", 0)])
    session(spark, store, c, claims, max_chunks=2)  # U is finished by it
    session(spark, store, c.where("run = 'T'"), claims, max_chunks=1)
    before = done(store)
    store.compact()
    assert [x for x in before if x[1] != "g"] == done(store)
    assert session(spark, store, c, claims, max_chunks=1).runs.orderBy("run").select("resumed", "epoch").collect() == [(True, 1), (False, 2)]
    store.drop(spark.createDataFrame([("T",)], "run string"))
    assert not store.begin(c.where("run = 'T'")).runs.first().resumed


def test_extractor_failures_reach_trace_and_report(spark):
    rows = [("T", "f1", i, t) for i, t in enumerate(["x", "bad", "slow", "y"])]
    chunks = spark.createDataFrame(rows, "run string, accession string, chunk_index int, text string")
    out = coordinator.extract(chunks, UserFunction(behave, CLAIM, deadline=0.3))
    claims = coordinator.claims_of(out, [])
    assert {(r.chunk_index, r.claim_id, r.metric) for r in claims.collect()} == {(0, "f1/0/0", "x"), (3, "f1/3/0", "y")}
    planned = coordinator.plan(out)
    judged = claims.withColumns({"verdict": F.lit("consistent"), "value_unit": F.lit("USD"), "run": F.lit("T")})
    log = [(r.action, r.detail) for r in coordinator.trace(planned, judged, judged.drop("run")).orderBy("step").collect()]
    assert [d for a, d in log if a == "extraction_failed"] == ["chunk 1: ValueError: no good", "chunk 2: TimeoutError: no result within 0.3 s"]
    r = coordinator.report(planned, judged.drop("run")).first()
    assert (r.chunks, r.chunks_failed, r.chunks_late, r.consistent) == (4, 2, 1, 2)
