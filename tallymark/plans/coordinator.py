"""A whole run: chunks to claims by a user's extractor, to verdicts, a trace, a report, and sessions that go on from saved state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import resolve, runs, userfn
from ..operators.userfn import UserFunction
from ..storage import cut
from .runstate import RunStore, Session


def plan(chunks: DataFrame, state: DataFrame | None = None, **budget) -> DataFrame:
    """chunks (run, accession, chunk_index, failed, elapsed) still to do, with processed and the reason where a run stops."""
    left = chunks if state is None else runs.pending(chunks, state)
    ordered = left.withColumn("ord", F.row_number().over(Window.partitionBy("run").orderBy("accession", "chunk_index")))
    return runs.within_budget(ordered, **budget)


def verdicts(planned: DataFrame, claims: DataFrame, facts: DataFrame, dictionary: DataFrame, ratios: DataFrame) -> DataFrame:
    """Verdicts of the claims of chunks that were processed without a failure; claims carry accession and chunk_index."""
    ready = planned.where("processed and not failed").select("accession", "chunk_index")
    mine = claims.join(ready, ["accession", "chunk_index"], "left_semi").withColumn("chunk_id", F.concat_ws("/", "accession", "chunk_index"))
    mine = resolve.number_occurrences(mine)
    return mine.join(resolve.verify(mine, facts, dictionary, ratios), "claim_id")


def trace(planned: DataFrame, claims: DataFrame, judged: DataFrame, start: int = 0) -> DataFrame:
    """The ordered audit log: run, step, kind, agent, action, detail.

    Each chunk reached gives a call and, if it failed or had no claims, a decision; each claim a call and its verdict; a run that
    stops gives the reason.  Steps count on from start.  planned may carry `error`, the text of a failure.
    """
    event = lambda rank, kind, agent, action, detail: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(agent).alias("agent"), F.lit(action).alias("action"), detail.alias("detail"))
    chunk = F.concat(F.lit("chunk "), F.col("chunk_index").cast("string"))
    why = F.concat_ws(": ", chunk, F.col("error")) if "error" in planned.columns else chunk
    has = claims.select("accession", "chunk_index").distinct().withColumn("has", F.lit(True))
    reached = planned.where("processed").join(has, ["accession", "chunk_index"], "left")
    none = F.lit(None)
    per_chunk = F.array_compact(F.array(
        event(0, "tool_call", "extraction", "extract", chunk),
        F.when(F.col("failed"), event(1, "decision", "coordinator", "extraction_failed", why)).when(F.col("has").isNull(), event(1, "decision", "coordinator", "skip_empty_chunk", chunk)).otherwise(none),
    ))
    a = reached.select("run", "ord", F.lit(0).alias("claim_ord"), F.lit("").alias("claim_id"), F.explode(per_chunk).alias("e"))
    at = planned.select("accession", "chunk_index", "run", "ord")
    named = F.col("metric")
    per_claim = F.array(event(0, "tool_call", "verification", "verify", F.concat_ws("=", named, F.concat(F.format_string("%.2f", F.col("value")), "value_unit"))), event(1, "decision", "coordinator", "claim_verdict", F.concat_ws(" -> ", named, "verdict")))
    b = judged.join(at, ["accession", "chunk_index"]).select("run", "ord", (F.col("claim_ord") + 1).alias("claim_ord"), "claim_id", F.explode(per_claim).alias("e"))
    stops = planned.where("not processed").groupBy("run").agg(F.min(F.struct("ord", "reason")).alias("x"))
    c = stops.select("run", "x.ord", F.lit(0).alias("claim_ord"), F.lit("").alias("claim_id"), event(0, "decision", "coordinator", "budget_exceeded", F.col("x.reason")).alias("e"))
    order = Window.partitionBy("run").orderBy("ord", "claim_ord", "claim_id", "e.rank")
    log = a.unionByName(b).unionByName(c)
    return log.select("run", (F.row_number().over(order) + start).alias("step"), "e.kind", "e.agent", "e.action", "e.detail")


def report(planned: DataFrame, judged: DataFrame) -> DataFrame:
    """run, verdict counts, chunks reached, failed and stopped at their deadline, and whether and why it is partial.  planned may carry `error`."""
    late = F.col("error").startswith("TimeoutError") if "error" in planned.columns else F.lit(False)
    state = planned.groupBy("run").agg(
        F.bool_or(~F.col("processed")).alias("partial"), F.min("reason").alias("partial_reason"), F.count_if("processed").alias("chunks"),
        F.count_if(F.col("processed") & F.col("failed")).alias("chunks_failed"), F.count_if(F.col("processed") & F.coalesce(late, F.lit(False))).alias("chunks_late"),
    )
    at = planned.select("accession", "chunk_index", "run")
    n = judged.join(at, ["accession", "chunk_index"]).groupBy("run").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("consistent", "inconsistent", "unverifiable")])
    return state.join(n, "run", "left").na.fill(0, ["consistent", "inconsistent", "unverifiable"])


def state_of(planned: DataFrame) -> DataFrame:
    """Rows to append to the run state: chunks processed, failed ones marked so that they come again."""
    return planned.where("processed").select("run", "accession", "chunk_index", F.when(F.col("failed"), "failed").otherwise("done").alias("status"))


def headings(session: Session, facts_of: DataFrame | None = None) -> DataFrame:
    """The first events of a session: what was retrieved, or from where it goes on.  facts_of (run, n): facts at hand."""
    runs = session.runs if facts_of is None else session.runs.join(facts_of.select("run", F.col("n").alias("n_facts")), "run", "left")
    event = lambda kind, agent, action, detail: F.struct(F.lit(kind).alias("kind"), F.lit(agent).alias("agent"), F.lit(action).alias("action"), detail.alias("detail"))
    number = lambda c: F.col(c).cast("string")
    n_facts = F.lit("0") if facts_of is None else F.coalesce(number("n_facts"), F.lit("0"))
    fresh = F.array(
        event("tool_call", "retrieval", "get_chunks", F.col("run")), event("decision", "coordinator", "chunks_retrieved", F.concat(number("total"), F.lit(" chunks"))),
        event("tool_call", "retrieval", "get_facts", F.col("run")), event("decision", "coordinator", "facts_retrieved", F.concat(n_facts, F.lit(" facts"))),
    )
    again = F.array(event("decision", "coordinator", "resumed", F.concat(number("done"), F.lit(" of "), number("total"), F.lit(" chunks were done"))))
    return runs.select("run", "steps", F.posexplode(F.when(F.col("resumed"), again).otherwise(fresh)).alias("at", "e")).select("run", (F.col("steps") + F.col("at") + 1).alias("step"), "e.*")


def run_session(store: RunStore, chunks: DataFrame, claims: DataFrame, facts: DataFrame, dictionary: DataFrame, ratios: DataFrame, resume: bool = True, **budget) -> Session:
    """One session of every run in chunks (run, accession, chunk_index, failed, elapsed): what is left is planned, judged, logged and saved.

    claims are those of chunks that an extractor has read; the budget is a session's.  The trace goes on from the last step that is saved.
    """
    session = store.begin(chunks, resume)
    planned = cut(plan(session.left.drop("epoch"), **budget), "planned")
    judged = cut(verdicts(planned, claims, facts, dictionary, ratios), "judged")
    first = headings(session, facts.groupBy(F.col("ticker").alias("run")).agg(F.count("*").alias("n")))
    after = first.groupBy("run").agg(F.max("step").alias("last"))
    log = trace(planned, claims, judged).join(after, "run").withColumn("step", F.col("step") + F.col("last")).drop("last")
    store.save(session, chunks, planned, judged, first.unionByName(log))
    return session


def extract(chunks: DataFrame, extractor: UserFunction, text: str = "text") -> DataFrame:
    """chunks (run, accession, chunk_index, text, ...) with claims, error, seconds, failed and elapsed, each chunk called once and written.

    elapsed adds up the seconds of a run's calls in the order of its chunks.
    """
    called = cut(userfn.apply(chunks, extractor, [text], "claims"), "extracted").withColumnsRenamed({"claims_error": "error", "claims_seconds": "seconds"})
    upto = Window.partitionBy("run").orderBy("accession", "chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return called.withColumns({"failed": F.col("error").isNotNull(), "elapsed": F.sum("seconds").over(upto)})


def claims_of(extracted: DataFrame, keep: list[str]) -> DataFrame:
    """The claims of extracted chunks: keep, accession, chunk_index, claim_ord, claim_id and the claim's fields."""
    each = userfn.rows_out(extracted, ["accession", "chunk_index", *keep], "claims", "claim_ord")
    return each.withColumn("claim_id", F.concat_ws("/", "accession", "chunk_index", "claim_ord"))
