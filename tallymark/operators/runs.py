"""Run state: budgets, resume, traces and the rollups of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within_budget(chunks: DataFrame, max_chunks: int | None = None, max_calls: int | None = None, max_seconds: float | None = None) -> DataFrame:
    """chunks (run, ord, failed, elapsed) with `processed` and the reason where a run stopped.

    The budget is looked at before each chunk: chunks done, then calls made (a failed extraction is a call, not a chunk), then
    the seconds elapsed before it.
    """
    before = Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.count_if(~F.col("failed")).over(before), F.lit(0))
    calls = F.coalesce(F.count("*").over(before), F.lit(0))
    spent = F.coalesce(F.max("elapsed").over(before), F.lit(0.0))
    never = F.lit(False)
    reason = (
        F.when(done >= max_chunks if max_chunks is not None else never, "chunks")
        .when(calls >= max_calls if max_calls is not None else never, "calls")
        .when(spent >= max_seconds if max_seconds is not None else never, "seconds")
    )
    marked = chunks.withColumn("__reason", reason)
    upto = Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.first("__reason", ignorenulls=True).over(upto)
    return marked.withColumns({"processed": stop.isNull(), "reason": stop}).drop("__reason")


def pending(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks without a completed entry in the run state; failed ones come again.  Keys: accession and chunk_index."""
    return chunks.join(state.where("status = 'done'").select("accession", "chunk_index"), ["accession", "chunk_index"], "left_anti")


def is_stale(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """One row: whether the state was made for another set of filings (either side has one that the other lacks)."""
    side = lambda df, name: df.select("accession").distinct().withColumn(name, F.lit(True))
    both = side(chunks, "now").join(side(state, "then"), "accession", "full_outer")
    return both.agg(F.coalesce(F.bool_or(F.col("now").isNull() | F.col("then").isNull()), F.lit(False)).alias("stale"))


def trace_summary(events: DataFrame) -> DataFrame:
    """events (run, kind, agent, step, elapsed): steps, calls by kind, first and last elapsed per run."""
    return events.groupBy("run").agg(
        F.count("*").alias("steps"), F.count_if(F.col("kind") == "tool").alias("tool_calls"), F.count_if(F.col("kind") == "error").alias("errors"),
        F.count_distinct("agent").alias("agents"), F.min_by("elapsed", "step").alias("first_elapsed"), F.max_by("elapsed", "step").alias("last_elapsed"),
    )


def calls_by_agent(events: DataFrame) -> DataFrame:
    """Tool calls of each run by agent."""
    return events.where("kind = 'tool'").groupBy("run", "agent").agg(F.count("*").alias("n"))


def batch_lists(runs: DataFrame) -> DataFrame:
    """One row: the failed runs, and the partial ones of those that succeeded, by name in order."""
    names = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.col("run"))))
    return runs.agg(names(~F.col("ok")).alias("failed"), names(F.col("ok") & F.col("partial")).alias("partial"))


def batch_rollup(runs: DataFrame) -> DataFrame:
    """runs (run, ok, partial, consistent, inconsistent, unverifiable, tool_calls, steps, elapsed): one row for the batch.

    Verdicts, claims, calls, steps and partial runs are those of runs that succeeded; the time is that of all.
    """
    of_ok = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), c)), F.lit(0)).cast("long")
    verdicts = ("consistent", "inconsistent", "unverifiable")
    sums = [of_ok(F.col(c)).alias(c) for c in (*verdicts, "tool_calls", "steps")]
    rolled = runs.agg(
        F.count("*").alias("runs"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok") & F.col("partial")).alias("partial"), *sums, F.sum("elapsed").alias("elapsed"),
    )
    claims = F.col("consistent") + F.col("inconsistent") + F.col("unverifiable")
    return rolled.withColumns({"claims": claims, "inconsistent_rate": F.try_divide("inconsistent", F.col("consistent") + F.col("inconsistent"))})


def most_common(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Counts of a key, most common first, ties by key (a top-k report if n is given)."""
    out = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)
    return out.limit(n) if n else out


def cost_model(calls: DataFrame, per_million_in: float = 0.03, per_million_out: float = 0.13, companies: int = 500) -> DataFrame:
    """calls (prompt_tokens, completion_tokens, company): cost of a call, a filing and many filings."""
    mean = calls.agg(F.avg("prompt_tokens").alias("tin"), F.avg("completion_tokens").alias("tout"), F.count("*").alias("calls"), F.count_distinct("company").alias("filings"))
    per_call = F.col("tin") / 1e6 * per_million_in + F.col("tout") / 1e6 * per_million_out
    per_filing = per_call * F.col("calls") / F.col("filings")
    return mean.select(per_call.alias("per_call"), per_filing.alias("per_filing"), (per_filing * companies).alias("per_batch"))
