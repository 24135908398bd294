"""Checks of the checker: audits against expected verdicts, labels against their texts, extractors against golds, judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import judge_verdict, metric_key
from ..schema import CONSISTENT, INCONSISTENT
from .scoring import match_greedy, noise_floor, prf

#: Three over n bounds a rate of which n cases showed none (95 %).
RULE_OF_THREE = 3.0


def audit(cases: DataFrame) -> DataFrame:
    """cases (verdict, expected_verdict, demo: left out of the rates): one row of counts, recall and the rate of false acceptance.

    No case of a kind: its rate is null; the bound is given only if nothing was falsely accepted.
    """
    good, said = F.col("expected_verdict") == CONSISTENT, F.col("verdict") == CONSISTENT
    real = ~F.col("demo")
    n = cases.agg(
        F.count("*").alias("cases"), F.count_if(F.col("verdict") == F.col("expected_verdict")).alias("matched"),
        F.count_if(real & good).alias("n_good"), F.count_if(real & good & said).alias("accepted"), F.count_if(real & ~good).alias("n_bad"), F.count_if(real & ~good & said).alias("falsely_accepted"),
    )
    return n.withColumns({
        "recall": F.try_divide("accepted", "n_good"), "false_positive_rate": F.try_divide("falsely_accepted", "n_bad"),
        "false_positive_bound": F.when(F.col("falsely_accepted") == 0, F.try_divide(F.lit(RULE_OF_THREE), F.col("n_bad"))),
    })


def falsely_accepted(cases: DataFrame) -> DataFrame:
    return cases.where((F.col("verdict") == CONSISTENT) & (F.col("expected_verdict") != CONSISTENT))


def check_quotes(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """labels (accession, chunk_index, quote) with found: whether the quote stands in its chunk (no-break spaces read as spaces)."""
    plain = lambda c: F.translate(c, "\u00a0", " ")
    texts = chunks.select("accession", "chunk_index", F.col("text").alias("__text"))
    hit = F.coalesce(F.contains(plain(F.col("__text")), plain(F.col("quote"))), F.lit(False))
    return labels.join(texts, ["accession", "chunk_index"], "left").withColumn("found", hit).drop("__text")


def validate_labels(records: DataFrame) -> DataFrame:
    """records (claims): their number, claims, records without any, and claims that lack a required field."""
    bad = F.exists("claims", lambda c: c["metric"].isNull() | c["value"].isNull() | c["value_unit"].isNull() | c["comparison_type"].isNull())
    n = F.coalesce(F.size("claims"), F.lit(0))
    return records.agg(F.count("*").alias("records"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("claims"), F.count_if(n == 0).alias("negatives"), F.count_if(F.coalesce(bad, F.lit(False))).alias("invalid"))


def score_runs(examples: DataFrame) -> DataFrame:
    """examples (extractor, id, preds: null if it failed, golds): P, R, F1, failures and the noise floor per extractor."""
    filled = examples.withColumn("failed", F.col("preds").isNull()).withColumn("preds", F.coalesce("preds", F.filter("golds", lambda g: F.lit(False))))
    m = match_greedy(filled)
    hit = lambda want: F.size(F.filter("hits", lambda h: h == want))
    c = m.groupBy("extractor").agg(F.sum(hit(True)).cast("long").alias("tp"), F.sum(F.size("left")).cast("long").alias("fp"), F.sum(hit(False)).cast("long").alias("fn"), F.count_if("failed").alias("failed"))
    out = c.select("extractor", "tp", "fp", "fn", "failed", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
    return out.withColumn("half_width", noise_floor(F.col("f1"), F.col("tp") + F.col("fp") + F.col("fn")))


def within_noise(a: Column, b: Column, half_width: Column) -> Column:
    """Whether two scores differ by less than the noise floor."""
    return F.abs(a - b) < half_width


def all_found(hits: Column, left: Column) -> Column:
    """A generalisation case passes: every gold found, nothing extra."""
    return F.forall(hits, lambda h: h) & (F.size(left) == 0)


def only_type(preds: Column, kind: str) -> Column:
    return (F.size(preds) > 0) & F.forall(preds, lambda p: p["comparison_type"] == kind)


def qualified_apart(preds: Column, metric: Column, value: Column) -> Column:
    """The qualified value stands under another name than the bare metric, and never under the bare one."""
    bare = lambda p: metric_key(p["metric"]) == metric
    return F.exists(preds, lambda p: ~bare(p) & (p["value"] == value)) & ~F.exists(preds, lambda p: bare(p) & (p["value"] == value))


_EVIDENCE = ("fact_ord", "value", "unit", "period_start", "period_end", "filed", "form", "accession_number")


def judge_inputs(matches: DataFrame, facts: DataFrame) -> DataFrame:
    """matches with evidence: the facts of exactly that company, concept and period, each with the start compared null-safely."""
    keys = {"ticker": "__t", "concept": "__c", "period_start": "__s", "period_end": "__e"}
    f = facts.groupBy(*[F.col(c).alias(k) for c, k in keys.items()]).agg(F.array_sort(F.collect_list(F.struct(*_EVIDENCE))).alias("evidence"))  # one period's filings: a few
    on = (F.col("ticker") == F.col("__t")) & (F.col("concept") == F.col("__c")) & F.col("period_start").eqNullSafe(F.col("__s")) & (F.col("period_end") == F.col("__e"))
    return matches.join(f, on, "left").withColumn("evidence", F.coalesce("evidence", F.array())).drop(*keys.values())


def judge_inputs_by_concept(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claims (ticker, metric, denominator_metric, ...) with as_of, the latest date on which the company filed anything, and evidence: all its facts of those concepts."""
    latest = facts.groupBy(F.col("ticker").alias("__l")).agg(F.max("filed").alias("__filed"))
    lists = facts.groupBy(F.col("ticker").alias("__t"), F.col("concept").alias("__c")).agg(F.array_sort(F.collect_list(F.struct(*_EVIDENCE))).alias("__f"))
    out = claims.drop("as_of").join(latest, F.col("ticker") == F.col("__l"), "left")
    for name, column in (("__own", "metric"), ("__den", "denominator_metric")):
        side = lists.select(F.col("__t").alias(f"{name}_t"), F.col("__c").alias(f"{name}_c"), F.col("__f").alias(name))
        out = out.join(side, (F.col("ticker") == F.col(f"{name}_t")) & (F.col(column) == F.col(f"{name}_c")), "left")
    none = F.array().cast(facts.select(F.array(F.struct(*_EVIDENCE))).schema[0].dataType)
    own = F.coalesce("__own", none)
    both = F.when(F.col("denominator_metric").isNull() | (F.col("denominator_metric") == F.col("metric")), own).otherwise(F.concat(own, F.coalesce("__den", none)))
    return out.select(*[c for c in claims.columns if c != "as_of"], F.col("__filed").alias("as_of"), F.array_sort(both).alias("evidence"))


# Cases made of a pair of periods (name, category, expected verdict).
CASE_KINDS = (
    ("stated", "known_good", CONSISTENT), ("stated_growth", "known_good", CONSISTENT), ("stated_change", "known_good", CONSISTENT),
    ("inflated", "known_bad", INCONSISTENT), ("inflated_growth", "known_bad", INCONSISTENT),
    ("flipped_growth", "adversarial", INCONSISTENT), ("flipped_change", "adversarial", INCONSISTENT), ("thousandth", "adversarial", INCONSISTENT),
    ("inside_edge", "adversarial", CONSISTENT), ("outside_edge", "adversarial", INCONSISTENT), ("growth_as_amount", "adversarial", INCONSISTENT),
)


def cases_from(pairs: DataFrame) -> DataFrame:
    """Audit claims made of pairs (ticker, concept, cur, pri: structs of value, unit, period_start, period_end, filed), each with what must come out.

    A claim is judged as of the later filing.  Where a flipped sign would stay within the tolerance there is no such case.
    """
    cur, pri = F.col("cur.value"), F.col("pri.value")
    growth, change = (cur - pri) / F.abs(pri) * 100, cur - pri
    steep, large = F.abs(growth) > 1, F.abs(change) / F.greatest(F.abs(cur), F.abs(pri)) > 0.01
    claimed = {
        "stated": ("absolute", cur, None), "stated_growth": ("growth_pct", growth, None), "stated_change": ("absolute_change", change, None),
        "inflated": ("absolute", cur * 1.3, None), "inflated_growth": ("growth_pct", growth + 10, None),
        "flipped_growth": ("growth_pct", -growth, steep), "flipped_change": ("absolute_change", -change, large), "thousandth": ("absolute", cur / 1000, None),
        "inside_edge": ("absolute", cur * 1.0099, None), "outside_edge": ("absolute", cur * 1.0101, None), "growth_as_amount": ("absolute", growth, None),
    }
    each = []
    for name, category, expected in CASE_KINDS:
        kind, value, only = claimed[name]
        case = F.struct(F.lit(name).alias("label"), F.lit(category).alias("category"), F.lit(kind).alias("comparison_type"), value.alias("claimed_value"), F.lit(expected).alias("expected_verdict"))
        each.append(case if only is None else F.when(only, case))
    rows = pairs.where((pri != 0) & (cur != 0)).withColumn("case", F.explode(F.array_compact(F.array(*each))))
    two = F.col("case.comparison_type") != "absolute"
    text = lambda c: F.lit(c).cast("string")
    return rows.select(
        F.concat_ws("/", "ticker", "concept", "cur.period_start", "cur.period_end", "case.label").alias("claim_id"), "ticker", F.col("concept").alias("metric"), "case.comparison_type", "case.claimed_value",
        "cur.period_end", "cur.period_start", F.when(two, F.col("pri.period_end")).alias("comparison_period_end"), F.when(two, F.col("pri.period_start")).alias("comparison_period_start"),
        text(None).alias("denominator_metric"), "cur.unit", F.lit(None).cast("double").alias("tolerance"), F.greatest("cur.filed", "pri.filed").alias("as_of"), "case.label", "case.category", "case.expected_verdict",
    )


def audit_by_label(judged: DataFrame) -> DataFrame:
    """label, category, cases, matched and falsely accepted of judged cases."""
    wrong = (F.col("verdict") == CONSISTENT) & (F.col("expected_verdict") != CONSISTENT)
    return judged.groupBy("label", "category").agg(F.count("*").alias("cases"), F.count_if(F.col("verdict") == F.col("expected_verdict")).alias("matched"), F.count_if(wrong).alias("falsely_accepted"))


def of_verdict(judged: DataFrame, verdict: str, *columns: str) -> DataFrame:
    """The claims of one verdict, with the columns that a report lists."""
    return judged.where(F.col("verdict") == verdict).select(*columns)


def judge_outcomes(judged: DataFrame) -> DataFrame:
    """judged (before, after: a judge's raw answers): cleaned verdicts and whether they flip as a restatement should."""
    out = judged.withColumns({"before": judge_verdict(F.col("before")), "after": judge_verdict(F.col("after"))})
    return out.withColumn("flips", F.coalesce((F.col("before") == CONSISTENT) & (F.col("after") == INCONSISTENT), F.lit(False)))


def status_counts(rows: DataFrame, statuses: list[str], col: str = "status") -> DataFrame:
    """One row: how often each status came up in a scan."""
    return rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(col) == s).alias(s) for s in statuses])
