"""Extraction scoring: greedy one-to-one matching, precision and recall, and judged completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import OVERLAP, keywords, metric_overlap, parse_verdict

# Shaping of a wrong verdict by the gold reason, and the two penalties.
SHAPING = {"near_miss": 0.3, "large_miss": 0.0, "missing_fact": 0.1, "ambiguous_period": 0.1, "zero_denominator": 0.1, "missing_comparison_context": 0.1, "unsupported_comparison_type": 0.1, "match": 0.0}
FALSE_CONSISTENT_PENALTY = 1.0
FORMAT_FAILURE = -2.0


def claims_match(p: Column, g: Column) -> Column:
    close = F.abs(p["value"] - g["value"]) <= F.greatest(F.lit(0.05), F.abs(g["value"]) * 0.01)
    return (p["comparison_type"] == g["comparison_type"]) & (p["value_unit"] == g["value_unit"]) & close & (metric_overlap(p["metric"], g["metric"]) >= OVERLAP)


def overlapping(left: DataFrame, right: DataFrame, least: float = OVERLAP) -> DataFrame:
    """left (a, text) and right (b, text), ids unique: a, b, overlap of all pairs with an overlap of at least `least` (above 0).

    Such a pair shares least * n words of either side's n, so with the words of both sides in one order it shares one of each side's
    first n - least * n + 1.  Only those meet; the order is rarest in `right` first, so that what everybody says stays
    out, and words that `right` lacks are not sent at all.  A text without keywords meets nothing.
    """
    words = lambda df, k: df.select(k, F.explode(keywords(F.col("text"))).alias("word"))
    rarity = words(right, "b").groupBy("word").agg(F.count("*").alias("n"))

    def first_words(df: DataFrame, k: str) -> DataFrame:
        ranked = words(df, k).join(rarity, "word", "left")
        whole = ranked.groupBy(k).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("o"))
        size = F.size("o")
        first = F.filter(F.slice("o", F.lit(1), (size - F.ceil(size * least - 1e-9) + 1).cast("int")), lambda o: o["n"] > 0)
        return whole.select(k, size.alias(f"size_{k}"), F.transform("o", lambda o: o["word"]).alias(f"w_{k}"), F.explode(first).alias("o")).withColumn("word", F.col("o.word")).drop("o")

    met = first_words(left, "a").join(first_words(right, "b"), "word").where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * least - 1e-9)
    mine = F.array_intersect("w_a", "w_b")
    pairs = met.where(F.element_at(mine, 1) == F.col("word"))  # the first shared word reports a pair, so that none comes twice
    return pairs.select("a", "b", (F.size(mine) / F.greatest("size_a", "size_b")).alias("overlap")).where(F.col("overlap") >= least)


def match_greedy(examples: DataFrame) -> DataFrame:
    """examples (id, preds, golds: arrays of claims) with hits, one flag per gold, and left, the predictions not matched.

    A fold over the golds in order: each takes the first prediction left that matches it.
    """
    state = F.struct(F.col("preds").alias("left"), F.expr("cast(array() as array<boolean>)").alias("hits"))

    def step(acc: Column, g: Column) -> Column:
        flags = F.transform(acc["left"], lambda p: F.coalesce(claims_match(p, g), F.lit(False)))
        at = F.array_position(flags, True)
        rest = F.filter(acc["left"], lambda p, i: i != at.cast("int") - 1)
        return F.struct(F.when(at > 0, rest).otherwise(acc["left"]).alias("left"), F.concat(acc["hits"], F.array(at > 0)).alias("hits"))

    folded = examples.withColumn("__m", F.aggregate("golds", state, step))
    return folded.select(*examples.columns, F.col("__m.hits").alias("hits"), F.col("__m.left").alias("left"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = F.when(tp + fp == 0, 1.0).otherwise(F.try_divide(tp, tp + fp))
    r = F.when(tp + fn == 0, 1.0).otherwise(F.try_divide(tp, tp + fn))
    f1 = F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r))
    return [p.alias("p"), r.alias("r"), f1.alias("f1")]


def counts_by_type(matched: DataFrame) -> DataFrame:
    """tp and fn by the gold's type, fp by the prediction's."""
    golds = matched.select(F.explode(F.arrays_zip("golds", "hits")).alias("g")).select(F.col("g.golds.comparison_type").alias("category"), F.col("g.hits").cast("int").alias("tp"), F.lit(0).alias("fp"), (1 - F.col("g.hits").cast("int")).alias("fn"))
    preds = matched.select(F.explode("left").alias("p")).select(F.col("p.comparison_type").alias("category"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    return golds.unionByName(preds).groupBy("category").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def noise_floor(p: Column, n: Column) -> Column:
    """Half-width of a 95 % interval; NaN without cases."""
    return F.coalesce(1.96 * F.sqrt(F.try_divide(p * (1 - p), n)), F.lit(float("nan")))


def precision_ceiling(precision: Column, recall: Column, false_rate: Column) -> Column:
    return F.coalesce(F.try_divide(precision * recall, precision * recall + (1 - precision) * false_rate), F.lit(float("nan")))


def reward(completion: Column, gold_verdict: Column, gold_reason: Column) -> Column:
    said = parse_verdict(completion)
    shaping = F.coalesce(F.create_map(*[F.lit(x) for kv in SHAPING.items() for x in kv])[gold_reason], F.lit(0.0))
    value = F.when(said == gold_verdict, 1.0).otherwise(shaping) - F.when((said == "consistent") & (gold_verdict != "consistent"), FALSE_CONSISTENT_PENALTY).otherwise(0.0)
    return F.when(said.isNull(), FORMAT_FAILURE).otherwise(value)


def evaluate(rows: DataFrame) -> DataFrame:
    """Accuracy and mean reward over all rows and by comparison type (grouping sets).  rows: completion, gold_verdict, gold_reason, comparison_type."""
    said = parse_verdict(F.col("completion"))
    r = rows.withColumns({"said": said, "reward": reward(F.col("completion"), F.col("gold_verdict"), F.col("gold_reason"))})
    right = (F.coalesce(F.col("said") == F.col("gold_verdict"), F.lit(False))).cast("int")
    false_ = (F.coalesce(F.col("said") == "consistent", F.lit(False)) & (F.col("gold_verdict") != "consistent")).cast("int")
    return r.rollup("comparison_type").agg(
        F.count("*").alias("n"), F.sum(right).cast("long").alias("n_right"), (F.sum(F.round(F.col("reward") * 10).cast("long")).cast("double") / F.count("*") / 10).alias("mean_reward"),
        F.sum(false_).cast("long").alias("false_consistent"), F.count_if(F.col("said").isNull()).alias("format_failures"), F.grouping("comparison_type").cast("int").alias("total"),
    )
