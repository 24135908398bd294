"""Free text to facts: metric text to concept by recency, period hints to a current and a comparison fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hint_quarter, hint_sequential, hint_year, hint_year_ago, metric_key
from ..storage import cut

# Days.
NEAR_DAYS, LENGTH_DAYS, QUARTER_DAYS = 60, 20, 91


def ranked(facts: DataFrame) -> DataFrame:
    """One row per (ticker, concept): `ranks`, its facts from the newest, ties in the order of ingestion.

    Built once for any number of claims.  An array holds what one company has filed for one concept: a few values a quarter.
    """
    days = F.date_diff(F.col("period_end").cast("date"), F.col("period_start").cast("date"))
    fact = F.struct("period_end", (-F.col("fact_ord")).alias("o"), "fact_ord", "period_start", "fiscal_year", "fiscal_period", F.coalesce("filed", F.lit("")).alias("filed"), days.alias("days"), "unit")
    newest = F.reverse(F.sort_array(F.collect_list(fact)))  # sort_array puts nulls first, so they come last
    lists = facts.groupBy(F.col("ticker").alias("ft"), F.col("concept").alias("fc")).agg(newest.alias("ranks"))
    placed = F.transform("ranks", lambda f, i: F.struct(i.alias("rank"), *[f[c].alias(c) for c in ("fact_ord", "period_start", "period_end", "fiscal_year", "fiscal_period", "filed", "days", "unit")]))
    return lists.select("ft", "fc", placed.alias("ranks"))


def known_by(ranks, as_of):
    """The facts of an array that were filed by a date (all if it is null), in their order."""
    return F.when(as_of.isNull(), ranks).otherwise(F.filter(ranks, lambda f: f["filed"] <= as_of))


def resolve_concept(claims: DataFrame, facts: DataFrame, dictionary: DataFrame, out: str = "concept") -> DataFrame:
    """claims (claim_id, ticker, metric, as_of) with the candidate concept of the latest period_end filed by as_of.

    Exact keys only; ties keep dictionary order; null if nothing is found.  Facts are reduced to one row
    per (ticker, concept) before they meet the claims: the latest period by each filing date, in the order of the dates.
    """
    keyed = claims.select("claim_id", "ticker", "as_of", metric_key(F.col("metric")).alias("metric_key"))
    wanted = keyed.join(F.broadcast(dictionary), "metric_key")  # a dictionary of fixed size
    by_date = facts.groupBy(F.col("ticker").alias("ft"), F.col("concept").alias("fc"), F.coalesce("filed", F.lit("")).alias("filed")).agg(F.max("period_end").alias("latest"))
    slim = by_date.groupBy("ft", "fc").agg(F.collect_list(F.struct("filed", "latest")).alias("dates"))
    hit = wanted.join(slim, (F.col("ticker") == F.col("ft")) & (F.col("concept") == F.col("fc")))
    seen = F.when(F.col("as_of").isNull(), F.col("dates")).otherwise(F.filter("dates", lambda d: d["filed"] <= F.col("as_of")))
    hit = hit.withColumn("latest", F.array_max(F.transform(seen, lambda d: d["latest"]))).where(F.size(seen) > 0)
    best = hit.groupBy("claim_id").agg(F.max_by("concept", F.struct("latest", -F.col("priority"))).alias(out))
    return claims.join(best, "claim_id", "left")


def with_hints(claims: DataFrame) -> DataFrame:
    p = F.col("period")
    return claims.withColumns({"hint_year": hint_year(p), "hint_quarter": hint_quarter(p), "hint_sequential": hint_sequential(p), "hint_year_ago": hint_year_ago(p)})


def resolve_periods(claims: DataFrame, facts: DataFrame, keep: bool = False) -> DataFrame:
    """claims (claim_id, ticker, concept, as_of and the hint columns) with cur_ord and cmp_ord, the facts chosen; with keep also cur and cmp, the facts themselves.

    A claim meets one row: the ranked facts of its concept, in which every rule is a filter.  Nothing is made for each pair of a claim and a fact.
    """
    at = lambda xs: F.try_element_at(xs, F.lit(1))  # noqa: E731  the first, null if there is none
    some = lambda xs, rest: F.when(F.size(xs) > 0, xs).otherwise(rest)
    col = F.col
    rows = claims.join(ranked(facts), (col("ticker") == col("ft")) & (col("concept") == col("fc")), "left")
    rows = rows.withColumn("__f", known_by(col("ranks"), col("as_of"))).drop("ft", "fc", "ranks")
    # the current fact: of the quarter that is named (of its year, of a quarter's length, where there are such), of the year, or the newest
    rows = rows.withColumn("__q", F.filter("__f", lambda f: f["fiscal_period"] == col("hint_quarter")))
    rows = rows.withColumn("__q", some(F.filter("__q", lambda f: f["fiscal_year"] == col("hint_year")), col("__q")))
    rows = rows.withColumn("__q", some(F.filter("__q", lambda f: F.abs(f["days"] - QUARTER_DAYS) <= LENGTH_DAYS), col("__q")))
    annual = lambda year: at(F.filter("__f", lambda f: (f["fiscal_period"] == "FY") & (f["fiscal_year"] == year)))
    of_year = F.coalesce(annual(col("hint_year")), annual(col("hint_year") - 1), at(F.filter("__f", lambda f: f["fiscal_year"] == col("hint_year"))), at(col("__f")))
    rows = rows.withColumn("cur", F.when(col("hint_quarter").isNotNull(), at(col("__q"))).when(col("hint_year").isNotNull(), of_year).otherwise(at(col("__f"))))
    # the comparison: an older fact of another period, of the same length where there is one, about a year before where that is asked for
    other = lambda f: ~(f["period_start"].eqNullSafe(col("cur.period_start")) & f["period_end"].eqNullSafe(col("cur.period_end")))
    rows = rows.withColumn("__old", F.filter("__f", lambda f: (f["rank"] > col("cur.rank")) & other(f)))
    rows = rows.withColumn("__like", F.filter("__old", lambda f: F.abs(f["days"] - col("cur.days")) <= LENGTH_DAYS))
    away = lambda f, side: F.abs(F.date_diff(f[side].cast("date"), F.add_months(col(f"cur.{side}").cast("date"), -12)))
    nearest = lambda xs, side: F.array_min(F.transform(xs, lambda f: F.struct(away(f, side).alias("d"), f["rank"].alias("rank"), f.alias("fact"))))
    rows = rows.withColumns({"__end": nearest(F.filter("__old", lambda f: f["period_start"].isNull()), "period_end"), "__start": nearest(col("__like"), "period_start")})
    first_old, first_like, instant = at(col("__old")), at(col("__like")), col("cur.period_start").isNull()
    default = F.when(instant, F.when(col("__end.d") <= NEAR_DAYS, col("__end.fact")).otherwise(first_old)).otherwise(F.coalesce(first_like, first_old))
    chosen = (
        F.when(col("hint_sequential") & ~instant, F.coalesce(first_like, default))
        .when(col("hint_year_ago") & ~instant & (col("__start.d") <= NEAR_DAYS), col("__start.fact"))
        .otherwise(default)
    )
    rows = rows.withColumn("cmp", F.when(col("cur").isNotNull(), chosen)).drop("__f", "__q", "__old", "__like", "__end", "__start")
    out = rows.withColumns({"cur_ord": col("cur.fact_ord"), "cmp_ord": col("cmp.fact_ord")})
    return out if keep else out.drop("cur", "cmp")


def number_occurrences(claims: DataFrame) -> DataFrame:
    """Occurrence of a repeated (metric, value_unit) in one chunk; only absolute claims without a period count."""
    eligible = (F.col("comparison_type") == "absolute") & (F.coalesce("period", F.lit("")) == "")
    w = Window.partitionBy("chunk_id", eligible, metric_key(F.col("metric")), "value_unit").orderBy("claim_ord", "claim_id")
    return claims.withColumn("occurrence", F.when(eligible, F.row_number().over(w) - 1).otherwise(0))


def verify(claims: DataFrame, facts: DataFrame, dictionary: DataFrame, ratios: DataFrame) -> DataFrame:
    """Extracted claims to verdicts: concept, periods, unit rules, then reconciliation.  Resolution runs when this is called.

    claims: claim_id, ticker, metric, value, value_unit, period, comparison_type, occurrence, as_of.
    """
    from .reconcile import reconcile

    named = with_hints(resolve_concept(resolve_concept(claims, facts, dictionary), facts, ratios, out="denominator_metric"))
    j = resolve_periods(named, facts, keep=True)
    absolute = F.col("comparison_type") == "absolute"
    swap = absolute & (((F.col("occurrence") == 1) & (F.coalesce("period", F.lit("")) == "")) | F.col("hint_year_ago"))
    j = j.withColumn("main", F.when(swap, F.col("cmp")).otherwise(F.col("cur")))
    problem = (
        F.when(F.col("concept").isNull(), "unresolved_concept")
        .when(F.col("cur").isNull(), "unresolved_period")
        .when(F.col("main").isNull(), "no_comparison_period")
        .when(~absolute & F.col("cmp").isNull(), "no_comparison_period")
        .when(absolute & (F.col("value_unit") == "percent") & (F.col("main.unit") != "pure"), "percent_against_amount")
    )
    # the resolved claims are written and read again: the plan of the comparison begins there, and nothing above runs twice
    j = cut(j.withColumn("problem", problem).select("claim_id", "ticker", "concept", "comparison_type", "value", "value_unit", "denominator_metric", "as_of", "main", "cmp", "problem"), "resolved")
    ready = j.where("problem is null").select(
        "claim_id", "ticker", F.col("concept").alias("metric"), "comparison_type",
        F.when(absolute & (F.col("main.unit") == "pure") & (F.col("value_unit") == "percent"), F.col("value") / 100).otherwise(F.col("value")).alias("claimed_value"),
        F.col("main.period_end").alias("period_end"), F.col("main.period_start").alias("period_start"),
        F.when(~absolute, F.col("cmp.period_end")).alias("comparison_period_end"), F.when(~absolute, F.col("cmp.period_start")).alias("comparison_period_start"),
        F.when(F.col("comparison_type") == "bps_change", F.col("denominator_metric")).alias("denominator_metric"),
        F.col("main.unit").alias("unit"), F.lit(None).cast("double").alias("tolerance"), "as_of",
    )
    done = reconcile(ready, facts).select("claim_id", "verdict", "reason_code", "computed_value")
    stuck = j.where("problem is not null").select("claim_id", F.lit("unverifiable").alias("verdict"), F.lit(None).cast("string").alias("reason_code"), F.lit(None).cast("double").alias("computed_value"))
    return done.unionByName(stuck)
