"""Bitemporal fact lookup: the value of a (concept, unit, period) as known on a date, restatements included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("ticker", "concept", "unit", "period_end")


def versions(facts: DataFrame) -> DataFrame:
    """One row per (ticker, concept, unit, period_end): all that was filed for it, in the order of filing date, accession and ingestion.

    An array holds the restatements of one value, and those of other periods with the same end: a few entries.
    """
    entry = F.struct(F.coalesce("filed", F.lit("")).alias("filed"), F.coalesce("accession_number", F.lit("")).alias("order"), "fact_ord", "period_start", "value", F.col("accession_number").alias("accession"))
    return facts.groupBy(*[F.col(c).alias(f"f_{c}") for c in KEY]).agg(F.sort_array(F.collect_list(entry)).alias("f_versions"))


def lookup(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """requests with status, value and accession found.

    requests: any columns, with ticker, concept, unit, period_end, period_start (null: any), as_of (null: now).
    A request meets the one row of its key's versions, and nothing is aggregated by request.  More than one distinct start among the candidates is
    ambiguous; one distinct value cites its earliest filing, several cite the latest and take its value.
    """
    on = [F.col(c) == F.col(f"f_{c}") for c in KEY]
    known = lambda v: (F.col("as_of").isNull() | (v["filed"] <= F.col("as_of"))) & (F.col("period_start").isNull() | v["period_start"].eqNullSafe(F.col("period_start")))
    rows = requests.join(versions(facts), on, "left").withColumn("f_versions", F.filter("f_versions", known))
    every = lambda f: F.transform("f_versions", f)
    start, value = every(lambda v: F.coalesce(v["period_start"], F.lit("none"))), every(lambda v: v["value"])
    latest = F.array_max(every(lambda v: F.struct(v["filed"], v["order"], (-v["fact_ord"]).alias("o"), v["value"].alias("value"), v["accession"].alias("accession"))))
    first = F.try_element_at("f_versions", F.lit(1))
    status = F.when(F.coalesce(F.size("f_versions"), F.lit(0)) <= 0, "missing_fact").when(F.array_min(start) != F.array_max(start), "ambiguous_period").otherwise("found")
    pick = F.when(F.array_min(value) != F.array_max(value), F.struct(latest["value"].alias("value"), latest["accession"].alias("accession"))).otherwise(F.struct(first["value"].alias("value"), first["accession"].alias("accession")))
    rows = rows.withColumns({"f_status": status, "f_pick": pick})
    ok = F.col("f_status") == "found"
    return rows.select(*requests.columns, F.col("f_status").alias("status"), F.when(ok, F.col("f_pick.value")).alias("value"), F.when(ok, F.col("f_pick.accession")).alias("accession"))
