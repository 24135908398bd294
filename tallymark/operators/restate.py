"""Restatement mining, matching of prose claims to restatements, and the before/after backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import metric_key
from ..schema import AMENDED_FORMS, MATERIALITY
from .reconcile import reconcile

KEY = ("cik", "concept", "unit", "period_start", "period_end")
MATCH_TOLERANCE = 0.05


def fingerprints(facts: DataFrame, concepts: DataFrame | None = None, least: float = MATERIALITY, require_later: bool = False) -> DataFrame:
    """One row per (company, concept, unit, period) whose latest amended value differs from the first original one.

    The amended filing need not be later than the original unless require_later is set.
    """
    f = facts.where(F.col("period_end").isNotNull())
    if concepts is not None:
        f = f.join(F.broadcast(concepts.select("concept").distinct()), "concept", "left_semi")  # a dictionary of fixed size
    amended = F.col("form").isin(*AMENDED_FORMS)
    side = F.struct("value", "filed", "form", "accession_number")
    got = f.groupBy(*KEY).agg(
        F.min(F.when(~amended, F.struct("filed", "fact_ord", side.alias("x")))).alias("o"),
        F.max(F.when(amended, F.struct("filed", (-F.col("fact_ord")).alias("ord"), side.alias("x")))).alias("r"),
        F.min("ticker").alias("ticker"),
    )
    got = got.where("o is not null and r is not null")
    out = got.select(
        "ticker", *KEY,
        *[F.col(f"o.x.{c}").alias(f"original_{n}") for c, n in (("value", "value"), ("filed", "filed"), ("form", "form"), ("accession_number", "accession"))],
        *[F.col(f"r.x.{c}").alias(f"restated_{n}") for c, n in (("value", "value"), ("filed", "filed"), ("form", "form"), ("accession_number", "accession"))],
    )
    base = F.when(F.col("original_value") == 0, 1.0).otherwise(F.abs("original_value"))
    out = out.withColumn("relative_diff", F.abs(F.col("restated_value") - F.col("original_value")) / base)
    out = out.where((F.col("original_value") != F.col("restated_value")) & (F.col("relative_diff") >= least))
    return out.where("restated_filed > original_filed") if require_later else out


def top_companies(found: DataFrame, n: int = 60) -> DataFrame:
    """The n companies with the largest original values."""
    return found.groupBy("cik").agg(F.max(F.abs("original_value")).alias("largest")).orderBy(F.desc("largest"), "cik").limit(n)


def clean_companies(companies: DataFrame, found: DataFrame) -> DataFrame:
    return companies.join(found.select("cik").distinct(), "cik", "left_anti")


def match_prose(claims: DataFrame, found: DataFrame, dictionary: DataFrame, tolerance: float = MATCH_TOLERANCE) -> DataFrame:
    """claims (claim_id, accession, metric, value, value_unit) joined to fingerprints of the same original filing."""
    keyed = claims.withColumn("__key", metric_key(F.col("metric"))).join(F.broadcast(dictionary.select(F.col("metric_key").alias("__key"), F.col("concept").alias("__concept"))), "__key")
    both = keyed.join(found, (F.col("accession") == F.col("original_accession")) & (F.col("__concept") == F.col("concept")))
    base = F.when(F.col("original_value") == 0, 1.0).otherwise(F.abs("original_value"))
    unlike = (F.col("value_unit") == "percent") & (F.abs("value") <= 100) & (F.abs("original_value") > 100)
    return both.where(~F.coalesce(unlike, F.lit(False)) & (F.abs(F.col("value") - F.col("original_value")) / base <= tolerance)).drop("__key", "__concept")


def backtest(matches: DataFrame, facts: DataFrame) -> DataFrame:
    """Each match reconciled as of its original and its restated filing date, in one pass, and classified."""
    sides = F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("original_filed").alias("as_of")), F.struct(F.lit("after").alias("side"), F.col("restated_filed").alias("as_of"))))
    claims = matches.select("match_id", "ticker", F.col("concept").alias("metric"), "comparison_type", F.col("value").alias("claimed_value"), "period_end", "period_start", "unit", sides.alias("s")).select(
        F.concat_ws("/", "match_id", "s.side").alias("claim_id"), "match_id", F.col("s.side").alias("side"), "ticker", "metric", "comparison_type", "claimed_value", "period_end", "period_start", "unit", F.col("s.as_of").alias("as_of"),
        *[F.lit(None).cast("string").alias(c) for c in ("comparison_period_end", "comparison_period_start", "denominator_metric")], F.lit(None).cast("double").alias("tolerance"),
    )
    done = reconcile(claims, facts).groupBy("match_id").agg(*[F.max(F.when(F.col("side") == s, F.col("verdict"))).alias(s) for s in ("before", "after")])
    outcome = (
        F.when((F.col("before") == "consistent") & (F.col("after") == "inconsistent"), "expected_flip")
        .when(F.col("before") == "inconsistent", "already_inconsistent_at_original")
        .when((F.col("before") == "consistent") & (F.col("after") == "consistent"), "restatement_too_small_for_tolerance")
        .otherwise(F.concat(F.lit("other("), F.col("before"), F.lit("->"), F.col("after"), F.lit(")")))
    )
    return done.withColumn("outcome", outcome)
