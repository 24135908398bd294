"""The four tolerance comparisons of a claim against facts: verdict, reason, computed value, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ABSOLUTE, BPS, CHANGE, CONSISTENT, DEFAULT_TOLERANCE, GROWTH, INCONSISTENT, NEAR_MISS_FACTOR, UNVERIFIABLE
from .lookup import lookup

ROLES = ("cur", "den_cur", "pri", "den_pri")


def default_tolerance() -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in DEFAULT_TOLERANCE.items() for x in kv])
    return F.coalesce(F.col("tolerance"), kinds[F.col("comparison_type")], F.lit(0.0))


def nonzero(c: Column) -> Column:
    return F.when(c == 0, 1.0).otherwise(F.abs(c))


def requests(claims: DataFrame) -> DataFrame:
    """One lookup per role that a claim's type needs (1, 2 or 4)."""
    pri_end, pri_start = F.col("comparison_period_end"), F.col("comparison_period_start")
    role = lambda name, concept, end, start, want: F.when(want, F.struct(F.lit(name).alias("role"), concept.alias("concept"), end.alias("period_end"), start.alias("period_start")))
    kind = F.col("comparison_type")
    context = pri_end.isNotNull()
    ratio = (kind == BPS) & context & F.col("denominator_metric").isNotNull()
    two = kind.isin(GROWTH, CHANGE) & context
    wanted = F.array_compact(F.array(
        role("cur", F.col("metric"), F.col("period_end"), F.col("period_start"), (kind == ABSOLUTE) | two | ratio),
        role("den_cur", F.col("denominator_metric"), F.col("period_end"), F.col("period_start"), ratio),
        role("pri", F.col("metric"), pri_end, pri_start, two | ratio),
        role("den_pri", F.col("denominator_metric"), pri_end, pri_start, ratio),
    ))
    out = claims.select("claim_id", "ticker", "unit", "as_of", F.explode(wanted).alias("r")).select("claim_id", "ticker", "unit", "as_of", "r.*")
    return out.withColumn("req_id", F.concat_ws("/", "claim_id", "role"))


def with_roles(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claims with value and status of each role."""
    got = lookup(requests(claims), facts).groupBy("claim_id").agg(
        *[F.max(F.when(F.col("role") == r, F.struct("status", "value", "accession"))).alias(r) for r in ROLES]
    )
    return claims.join(got, "claim_id", "left")


def judge(claims: DataFrame) -> DataFrame:
    """Verdict columns for claims that carry a struct (status, value, accession) per role."""
    kind, claimed = F.col("comparison_type"), F.col("claimed_value")
    v = {r: F.col(f"{r}.value") for r in ROLES}
    missing = F.coalesce(*[F.when(F.col(f"{r}.status") != "found", F.col(f"{r}.status")) for r in ROLES])
    context = F.when(kind == ABSOLUTE, True).when(kind == BPS, F.col("comparison_period_end").isNotNull() & F.col("denominator_metric").isNotNull()).otherwise(F.col("comparison_period_end").isNotNull())
    zero = ((kind == GROWTH) & (v["pri"] == 0)) | ((kind == BPS) & ((v["den_cur"] == 0) | (v["den_pri"] == 0)))
    problem = (
        F.when(~F.coalesce(kind.isin(ABSOLUTE, GROWTH, CHANGE, BPS), F.lit(False)), "unsupported_comparison_type")
        .when(~context, "missing_comparison_context")
        .when(missing.isNotNull(), missing)
        .when(F.coalesce(zero, F.lit(False)), "zero_denominator")
    )
    computed = (
        F.when(kind == ABSOLUTE, v["cur"])
        .when(kind == GROWTH, F.try_divide(v["cur"] - v["pri"], F.abs(v["pri"])) * 100)
        .when(kind == CHANGE, v["cur"] - v["pri"])
        .when(kind == BPS, (F.try_divide(v["cur"], v["den_cur"]) - F.try_divide(v["pri"], v["den_pri"])) * 10000)
    )
    off = F.abs(F.col("__computed") - claimed)
    largest = F.greatest(F.abs(v["cur"]), F.abs(v["pri"]))
    difference = F.when(kind == ABSOLUTE, off / nonzero(v["cur"])).when(kind == CHANGE, off / nonzero(largest)).otherwise(off)
    tolerance = F.when(F.col("__problem") == "unsupported_comparison_type", F.coalesce("tolerance", F.lit(0.0))).otherwise(default_tolerance())
    out = claims.withColumn("__problem", problem).withColumn("__computed", F.when(F.col("__problem").isNull(), computed))
    out = out.withColumn("__difference", F.when(F.col("__problem").isNull(), difference)).withColumn("__tolerance", tolerance)
    agrees = F.col("__difference") <= F.col("__tolerance")
    near = F.col("__difference") <= NEAR_MISS_FACTOR * F.col("__tolerance")
    return out.select(
        *[c for c in claims.columns if c not in (*ROLES, "tolerance")],
        F.col("__tolerance").alias("tolerance"),
        F.when(F.col("__problem").isNotNull(), UNVERIFIABLE).when(agrees, CONSISTENT).otherwise(INCONSISTENT).alias("verdict"),
        F.coalesce("__problem", F.when(agrees, "match").when(near, "near_miss").otherwise("large_miss")).alias("reason_code"),
        F.col("__computed").alias("computed_value"),
        F.col("__difference").alias("difference"),
        F.when(F.col("__problem").isNull(), F.array_compact(F.array(*[F.col(f"{r}.accession") for r in ROLES]))).otherwise(F.array().cast("array<string>")).alias("citations"),
    )


def reconcile(claims: DataFrame, facts: DataFrame) -> DataFrame:
    return judge(with_roles(claims, facts))
