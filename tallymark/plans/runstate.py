"""State of runs that survives a stop: filings, chunks done and failed, verdicts and trace.

The state of all runs lies in tables of one folder, written in generations.  A session writes its rows under the next number and then appends that number
to `commits`, a table of one small file for each; readers see committed generations only, so a session that dies leaves no trace and
its number is written over by the next one.  A folder has one writer at a time.

A run's state belongs to an epoch.  It is open while the run has chunks left, and holds for the very filings that it was begun with: other filings,
or a run that was finished, begin a new epoch.  `compact` rewrites what is open and drops the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, remove

TABLES = {
    "filings": "run string, epoch int, accession string",
    "chunks": "run string, epoch int, session int, accession string, chunk_index int, status string",
    "verdicts": "run string, epoch int, accession string, chunk_index int, claim_id string, metric string, value double, value_unit string, verdict string, reason_code string, computed_value double",
    "trace": "run string, epoch int, step int, kind string, agent string, action string, detail string",
    "closed": "run string, epoch int",
}


@dataclass
class Session:
    """What a session works on: `runs` (run, epoch, session, resumed, done, total, steps) and `left`, the chunks to do with their run's epoch."""

    runs: DataFrame
    left: DataFrame


class RunStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in {**TABLES, "commits": "gen int, base boolean"}.items():
            target = f"{self.path}/{name}" if name == "commits" else f"{self.path}/{name}/gen=0"
            spark.createDataFrame([], schema).write.mode("ignore").parquet(target)

    def _commits(self) -> list:
        return self.spark.read.schema("gen int, base boolean").parquet(f"{self.path}/commits").collect()  # a row a session, few since the last compaction

    def table(self, name: str) -> DataFrame:
        """The committed rows of a table."""
        commits = self._commits()
        base = max((c.gen for c in commits if c.base), default=0)
        gens = [c.gen for c in commits if c.gen >= base]
        rows = self.spark.read.schema(f"{TABLES[name]}, gen int").parquet(f"{self.path}/{name}")
        return rows.where(F.col("gen").isin(*gens) if gens else F.lit(False)).drop("gen")

    def latest(self, name: str) -> DataFrame:
        """The rows of each run's last epoch, open or finished."""
        last = self.table("filings").groupBy("run").agg(F.max("epoch").alias("epoch"))
        return self.table(name).join(last, ["run", "epoch"])

    def open_epochs(self) -> DataFrame:
        last = self.table("filings").groupBy("run").agg(F.max("epoch").alias("epoch"))
        return last.join(self.table("closed"), ["run", "epoch"], "left_anti")

    def begin(self, chunks: DataFrame, resume: bool = True) -> Session:
        """chunks (run, accession, chunk_index, ...): those still to do.  A run goes on where its state is open and its filings are the same, else it begins anew (always, without resume)."""
        now = chunks.select("run", "accession").distinct()
        known = self.table("filings")
        last = known.groupBy("run").agg(F.max("epoch").alias("last"))
        of_open = known.join(self.open_epochs(), ["run", "epoch"])
        both = now.withColumn("now", F.lit(True)).join(of_open.select("run", "accession", "epoch"), ["run", "accession"], "full_outer")
        same = both.groupBy("run").agg(F.bool_and(F.col("now").isNotNull() & F.col("epoch").isNotNull()).alias("same"))
        runs = now.select("run").distinct().join(same, "run", "left").join(last, "run", "left")
        resumed = F.coalesce("same", F.lit(False)) & F.lit(resume)
        runs = runs.select("run", resumed.alias("resumed"), F.when(resumed, F.col("last")).otherwise(F.coalesce("last", F.lit(0)) + 1).alias("epoch"))
        done = self.table("chunks").groupBy("run", "epoch").agg(F.count_if(F.col("status") == "done").alias("done"), F.max("session").alias("session"))
        steps = self.table("trace").groupBy("run", "epoch").agg(F.max("step").alias("steps"))
        total = chunks.groupBy("run").agg(F.count("*").alias("total"))
        runs = runs.join(done, ["run", "epoch"], "left").join(steps, ["run", "epoch"], "left").join(total, "run")
        runs = runs.select("run", "epoch", (F.coalesce("session", F.lit(0)) + 1).alias("session"), "resumed", F.coalesce("done", F.lit(0)).cast("int").alias("done"), F.col("total").cast("int").alias("total"), F.coalesce("steps", F.lit(0)).alias("steps"))
        runs = cut(runs, "runs")
        finished = self.table("chunks").where("status = 'done'").select("run", "epoch", "accession", "chunk_index")
        left = chunks.join(runs.select("run", "epoch"), "run").join(finished, ["run", "epoch", "accession", "chunk_index"], "left_anti")
        return Session(runs, left)

    def save(self, session: Session, chunks: DataFrame, planned: DataFrame, judged: DataFrame, trace: DataFrame) -> None:
        """Append a session: its filings (of all chunks given to begin), the chunks reached, their verdicts and the trace; a run without chunks left is closed."""
        runs = session.runs
        mine = lambda df: df.join(runs.select("run", "epoch", "session"), "run")
        reached = mine(planned.drop("epoch").where("processed")).withColumn("status", F.when(F.col("failed"), "failed").otherwise("done"))
        stopped = planned.where("not processed").select("run").distinct()
        self._write({
            "filings": mine(chunks.select("run", "accession").distinct()).join(runs.where("not resumed").select("run"), "run", "left_semi"),
            "chunks": reached,
            "verdicts": mine(judged.drop("epoch", "run").join(planned.select("run", "accession", "chunk_index"), ["accession", "chunk_index"])),
            "trace": mine(trace),
            "closed": runs.join(stopped, "run", "left_anti"),
        })

    def _write(self, tables: dict[str, DataFrame], base: bool = False) -> int:
        gen = max((c.gen for c in self._commits()), default=0) + 1
        for name, df in tables.items():
            columns = [c.split()[0] for c in TABLES[name].split(", ")]
            df.select(*columns).to(self.spark.createDataFrame([], TABLES[name]).schema).write.mode("overwrite").parquet(f"{self.path}/{name}/gen={gen}")
        self.spark.createDataFrame([(gen, base)], "gen int, base boolean").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return gen

    def drop(self, runs: DataFrame) -> None:
        """Give up the open state of runs (run): their next session begins anew."""
        empty = {n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}
        self._write({**empty, "closed": self.open_epochs().join(runs.select("run").distinct(), "run", "left_semi")})

    def compact(self) -> None:
        """Rewrite the rows of open epochs (and the numbers of closed ones) as one generation and delete the others."""
        old = [c.gen for c in self._commits()]
        is_open = self.open_epochs()
        last = self.table("filings").groupBy("run").agg(F.max("epoch").alias("epoch"))
        shut = last.join(is_open, ["run", "epoch"], "left_anti")
        kept = {n: self.table(n).join(is_open, ["run", "epoch"], "left_semi") for n in TABLES}
        # a closed run keeps one filing row and its mark, so that its next epoch has a number of its own
        kept["filings"] = kept["filings"].unionByName(shut.select("run", "epoch", F.lit(None).cast("string").alias("accession")))
        kept["closed"] = shut
        self._write(kept, base=True)
        for gen in old:
            for name in TABLES:
                remove(self.spark, f"{self.path}/{name}/gen={gen}")
