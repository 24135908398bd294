"""Training examples from facts: deduplication, comparable pairs, ratio pairs, perturbations, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_bucket
from ..schema import ABSOLUTE, BPS, CHANGE, DEFAULT_TOLERANCE, GROWTH
from .reconcile import judge

PERTURBATIONS = ("sign_flip", "magnitude_1000x", "magnitude_0001x", "near_miss", "large_miss")
LENGTH_DAYS, QUARTERLY_DAYS = 20, 120
# Facts and pairs drawn per (ticker, concept), perturbations per true claim, parts of the split.
FACTS_DRAWN, PAIRS_DRAWN, KINDS_DRAWN, SPLIT_PARTS = 6, 3, 2, 5


def days(start: str = "period_start", end: str = "period_end") -> Column:
    return F.date_diff(F.col(end).cast("date"), F.col(start).cast("date"))


def one_per_period(facts: DataFrame, never_restated: bool = False) -> DataFrame:
    """The first filing of each (ticker, concept, period); with never_restated only of periods for which one value was ever filed."""
    keys = ["ticker", "concept", "period_start", "period_end"]
    rest = [c for c in facts.columns if c not in keys]
    first = facts.groupBy(*keys).agg(F.min(F.struct("filed", "accession_number", "fact_ord", F.struct(*rest).alias("x"))).alias("m"), F.min("value").alias("a"), F.max("value").alias("b"))
    return first.where("a = b" if never_restated else F.lit(True)).select(*keys, "m.x.*")


def adjacent_pairs(facts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each fact with the nearest earlier one of another period_end and a length within LENGTH_DAYS; cur and pri hold the columns to carry.

    One aggregation to an ordered array per (ticker, concept), in which every fact looks back; no row is made for a pair that does not count.  An array holds
    what one company has filed for one concept.
    """
    held = F.struct(*carry) if carry else F.lit(None).cast("int")
    entry = F.struct("period_end", "fact_ord", F.unix_date(F.col("period_end").cast("date")).alias("at"), days().alias("days"), held.alias("held"))
    lists = facts.where(days().isNotNull()).groupBy("ticker", "concept").agg(F.sort_array(F.collect_list(entry)).alias("fs"))
    earlier = lambda x, i: F.filter(F.slice("fs", F.lit(1), i), lambda y: (y["at"] < x["at"]) & (F.abs(y["days"] - x["days"]) <= LENGTH_DAYS))
    pairs = F.transform("fs", lambda x, i: F.struct(x.alias("cur"), F.try_element_at(earlier(x, i), F.lit(-1)).alias("pri")))
    got = lists.select("ticker", "concept", F.explode(pairs).alias("p")).where("p.pri is not null")
    out = [F.col("p.cur.fact_ord").alias("cur_ord"), F.col("p.pri.fact_ord").alias("pri_ord")]
    return got.select("ticker", "concept", *out, *([F.col("p.cur.held").alias("cur"), F.col("p.pri.held").alias("pri")] if carry else []))


def dominant_length(facts: DataFrame) -> DataFrame:
    """Facts of the larger length class per (ticker, concept): up to QUARTERLY_DAYS, or longer; ties go to the short."""
    short = F.coalesce(days(), F.lit(0)) <= QUARTERLY_DAYS
    per = Window.partitionBy("ticker", "concept")
    f = facts.withColumns({"__short": short, "__n": F.count_if(short).over(per), "__all": F.count("*").over(per)})
    return f.where(F.col("__short") == (F.col("__n") >= F.col("__all") - F.col("__n"))).drop("__short", "__n", "__all")


def ratio_pairs(facts: DataFrame, numerators: list[str], denominators: list[str]) -> DataFrame:
    """Consecutive periods in which both sides of a ratio are reported, the last fact of a period_end winning."""
    f = dominant_length(facts).groupBy("ticker", "concept", "period_end").agg(F.max_by(F.struct("value", "unit", "period_start"), "fact_ord").alias("x"))
    side = lambda names, concept, p: f.where(F.col("concept").isin(names)).select("ticker", F.col("concept").alias(concept), "period_end", F.col("x.value").alias(p), F.col("x.unit").alias(f"{p}_unit"), F.col("x.period_start").alias(f"{p}_start"))
    num, den = side(numerators, "numerator", "num"), side(denominators, "denominator", "den")
    order = Window.partitionBy("ticker", "numerator", "denominator").orderBy("period_end")
    both = num.join(den, ["ticker", "period_end"])
    both = both.withColumns({"prior_end": F.lag("period_end").over(order), **{f"prior_{c}": F.lag(c).over(order) for c in ("num", "num_unit", "num_start", "den", "den_unit", "den_start")}})
    return both.where("prior_end is not null and den <> 0 and prior_den <> 0")


def perturb(kind: Column, comparison_type: Column, value: Column, tolerance: Column, scale: Column | None = None) -> Column:
    own = F.when(value == 0, 1.0).otherwise(F.abs(value))
    scale = own if scale is None else F.coalesce(scale, own)
    unit = F.when(comparison_type.isin("growth_pct", "bps_change"), tolerance).otherwise(scale * tolerance)
    return (
        F.when(kind == "sign_flip", F.when(value == 0, scale).otherwise(-value))
        .when(kind == "magnitude_1000x", value * 1000)
        .when(kind == "magnitude_0001x", value * 0.001)
        .when(kind == "near_miss", value + unit * 1.5)
        .when(kind == "large_miss", value + unit * 6)
    )


def sample_per_group(rows: DataFrame, keys: list[str], order: str, k: int, seed: str) -> DataFrame:
    """k rows of each group by a seeded hash (a sampling operator: the limit is its purpose)."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(seed), F.col(order).cast("string")).cast("binary")), order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def _role(value: Column, known: Column) -> Column:
    known = F.coalesce(known, F.lit(False))
    return F.struct(F.when(known, "found").otherwise("missing_fact").alias("status"), F.when(known, value).alias("value"), F.lit(None).cast("string").alias("accession"))


def _bases(facts: DataFrame, numerators: list[str], denominators: list[str], seed: str) -> DataFrame:
    """True claims of the four types, each with the values of its roles, its truth and the scale of a perturbation."""
    one = one_per_period(facts)
    yes = F.lit(True)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def row(prefix, metric, kind, unit, start, end, pri_start, pri_end, den, truth, scale, roles, key):
        id_ = F.concat_ws("-", prefix, "ticker", metric, key)
        cols = {"claim_id": id_, "ticker": F.col("ticker"), "metric": metric, "comparison_type": kind, "unit": unit, "period_start": start, "period_end": end, "comparison_period_start": pri_start, "comparison_period_end": pri_end, "denominator_metric": den, "truth": truth, "scale": scale, **roles}
        return [c.alias(n) for n, c in cols.items()]

    col = F.col
    few = sample_per_group(one, ["ticker", "concept"], "fact_ord", FACTS_DRAWN, seed)
    absent = F.lit(None).cast("struct<status:string,value:double,accession:string>")  # a role that the type does not need
    absolute = few.select(*row(F.lit("abs"), col("concept"), F.lit(ABSOLUTE), col("unit"), col("period_start"), col("period_end"), text, text, text, col("value"), none, {"cur": _role(col("value"), yes), "den_cur": absent, "pri": absent, "den_pri": absent}, col("fact_ord").cast("string")))

    pairs = adjacent_pairs(one, ("value", "unit", "period_start", "period_end"))
    pairs = sample_per_group(pairs, ["ticker", "concept"], "cur_ord", PAIRS_DRAWN, seed).where("pri.value <> 0").withColumn("kind", F.explode(F.array(F.lit(GROWTH), F.lit(CHANGE))))
    c, p, growth = col("cur.value"), col("pri.value"), col("kind") == GROWTH
    largest = F.greatest(F.abs(c), F.abs(p))
    truth, scale = F.when(growth, F.try_divide(c - p, F.abs(p)) * 100).otherwise(c - p), F.when(~growth, F.when(largest == 0, 1.0).otherwise(largest))
    roles = {"cur": _role(c, yes), "den_cur": absent, "pri": _role(p, col("cur.unit") == col("pri.unit")), "den_pri": absent}
    paired = pairs.select(*row(F.when(growth, "gpct").otherwise("achg"), col("concept"), col("kind"), col("cur.unit"), col("cur.period_start"), col("cur.period_end"), col("pri.period_start"), col("pri.period_end"), text, truth, scale, roles, col("cur_ord").cast("string")))

    ratios = ratio_pairs(one, numerators, denominators).withColumn("at", F.concat_ws("-", "denominator", "period_end"))
    ratios = sample_per_group(ratios, ["ticker", "numerator", "denominator"], "at", PAIRS_DRAWN, seed)
    like = lambda d, n: (col(f"{d}_unit") == col("num_unit")) & (col(f"{n}_start").isNull() | col(f"{d}_start").eqNullSafe(col(f"{n}_start")))
    roles = {"cur": _role(col("num"), yes), "den_cur": _role(col("den"), like("den", "num")), "pri": _role(col("prior_num"), col("prior_num_unit") == col("num_unit")), "den_pri": _role(col("prior_den"), like("prior_den", "prior_num"))}
    bps = ratios.select(*row(F.lit("bps"), col("numerator"), F.lit(BPS), col("num_unit"), col("num_start"), col("period_end"), col("prior_num_start"), col("prior_end"), col("denominator"), (col("num") / col("den") - col("prior_num") / col("prior_den")) * 10000, none, roles, col("at")))
    return absolute.unionByName(paired).unionByName(bps)


def build_examples(facts: DataFrame, numerators: list[str], denominators: list[str], seed: str = "2026") -> DataFrame:
    """Labelled training examples: true claims, perturbed ones, and two kinds that can't be verified.

    Per (ticker, concept) FACTS_DRAWN facts and PAIRS_DRAWN pairs are drawn by a seeded hash (the sampling is the feature); ratio
    pairs with a zero divisor are left out before the draw.  Each true claim comes with KINDS_DRAWN of the five perturbations; growth
    claims come once more with the comparison withheld, ratio claims with a divisor of zero.  Gold labels judge an
    example's own facts alone.  Ids are made of the content, so no global numbering is needed; one in SPLIT_PARTS is a test.
    """
    base = _bases(facts, numerators, denominators, seed)
    drawn = F.slice(F.array_sort(F.array(*[F.struct(F.md5(F.concat(F.lit(seed), "claim_id", F.lit(k)).cast("binary")).alias("h"), F.lit(k).alias("kind")) for k in PERTURBATIONS])), 1, KINDS_DRAWN)
    growth, withheld, zero = F.col("comparison_type") == GROWTH, F.lit("comparison withheld"), F.lit("zero denominator")
    made = F.when(growth, F.array(withheld)).when(F.col("comparison_type") == BPS, F.array(zero)).otherwise(F.array().cast("array<string>"))
    rows = base.withColumn("note", F.explode(F.concat(F.array(F.lit("")), F.transform(drawn, lambda d: d["kind"]), made)))
    note, tolerance = F.col("note"), F.create_map(*[F.lit(x) for kv in DEFAULT_TOLERANCE.items() for x in kv])[F.col("comparison_type")]
    changed = perturb(note, F.col("comparison_type"), F.col("truth"), tolerance, F.col("scale"))
    no_den = F.struct(F.col("den_cur.status").alias("status"), F.when(F.col("den_cur.status") == "found", 0.0).alias("value"), F.col("den_cur.accession").alias("accession"))
    rows = rows.withColumns({
        "source": F.when(note == "", "real").when(note.isin(*PERTURBATIONS), "perturbed").otherwise("synthetic"), "claimed_value": F.when(note.isin(*PERTURBATIONS), changed).otherwise(F.col("truth")),
        "comparison_period_start": F.when(note != withheld, F.col("comparison_period_start")), "pri": F.when(note == withheld, _role(F.lit(None).cast("double"), F.lit(False))).otherwise(F.col("pri")),
        "den_cur": F.when(note == zero, no_den).otherwise(F.col("den_cur")), "claim_id": F.concat_ws("-", "claim_id", F.when(note != "", F.replace("note", F.lit(" "), F.lit("_")))),
    })
    values = {"current_value": "cur", "comparison_value": "pri", "denominator_current_value": "den_cur", "denominator_comparison_value": "den_pri"}
    rows = rows.withColumns({n: F.col(f"{r}.value") for n, r in values.items()}).withColumn("tolerance", F.lit(None).cast("double")).drop("truth", "scale")
    gold = {"claim_id": "id", "verdict": "gold_verdict", "reason_code": "gold_reason_code", "computed_value": "gold_computed_value", "difference": "gold_difference"}
    out = judge(rows).drop("citations").withColumnsRenamed(gold)
    return out.withColumn("part", F.when(md5_bucket(F.col("id"), SPLIT_PARTS) == 0, "test").otherwise("train"))


def label_counts(examples: DataFrame) -> DataFrame:
    """Examples by gold verdict and reason."""
    return examples.groupBy("gold_verdict", "gold_reason_code").agg(F.count("*").alias("n"))
