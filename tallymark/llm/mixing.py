"""Mixing sources to target weights (DataFrame functions only).

Tokens are summed per source, a target is set for each source, and every document
is emitted floor(rate) times plus one more time with a probability equal to the
fraction, drawn from a hash of the seed and its doc_id.

Defined results for odd input: a null or empty text has size 0 and is taken 0 words;
a null source is a source of its own, the last in order; repeated rows draw alike, since
the draw depends on doc_id alone (a null doc_id draws as the text 'null'); an empty table gives no rows; further columns
pass through `emit` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import WORD

SEED = "mix-1"
MAX_RATE = 3
_P = "__mix_"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """One row per source with its size, weight and target.

    sizes has __mix_source and __mix_size.  Sources weigh 1, 2, 3, 1, ... by code point.
    Resharing a capped source's excess by weight until none is above its cap ends at
    target = min(cap, level * weight) for one common level; sources reach their caps in the
    order of cap / weight, so running sums over that order give the level without a loop.
    The windows see one row per source, which the aggregation has made.
    """
    per = sizes.groupBy(f"{_P}source").agg(F.sum(f"{_P}size").alias(f"{_P}source_size"))
    by_name = Window.orderBy(F.col(f"{_P}source").asc_nulls_last())
    per = per.withColumn(f"{_P}weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    per = per.withColumn(f"{_P}cap", F.lit(max_rate) * F.col(f"{_P}source_size"))
    per = per.withColumn(f"{_P}ratio", F.col(f"{_P}cap").cast("double") / F.col(f"{_P}weight"))
    order = Window.orderBy(f"{_P}ratio", F.col(f"{_P}source").asc_nulls_last())
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum(f"{_P}cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum(f"{_P}weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum(f"{_P}source_size").over(everything)
    per = per.withColumn(f"{_P}level", (total - capped).cast("double") / open_weight)
    level = F.max(f"{_P}level").over(everything)  # levels rise while caps are under them and fall after that
    target = F.least(F.col(f"{_P}cap").cast("double"), level * F.col(f"{_P}weight"))
    return per.select(f"{_P}source", f"{_P}source_size", target.alias(f"{_P}target"))


def with_copies(docs: DataFrame, seed: str = SEED, max_rate: int = MAX_RATE) -> tuple[DataFrame, str]:
    """docs, all columns, with size, source_size, target and copies under a prefix that none of their names has, and that prefix."""
    p = _P
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    sized = docs.withColumn(f"{p}size", word_count(docs["text"]))
    targets = source_targets(sized.select(F.col("source").alias(f"{_P}source"), F.col(f"{p}size").alias(f"{_P}size")), max_rate)
    targets = targets.select(F.col(f"{_P}source").alias(f"{p}key"), F.col(f"{_P}source_size").alias(f"{p}source_size"), F.col(f"{_P}target").alias(f"{p}target"))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col(f"{p}key")))
    rate = F.coalesce(F.try_divide(F.col(f"{p}target"), F.col(f"{p}source_size")), F.lit(0.0))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    draw = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn(f"{p}copies", copies.cast("long")).drop(f"{p}key"), p


def emit(docs: DataFrame, seed: str = SEED, max_rate: int = MAX_RATE) -> DataFrame:
    """The mixture itself: every document as often as it was drawn, with docs' own columns."""
    drawn, p = with_copies(docs, seed, max_rate)
    repeated = drawn.withColumn(f"{p}copy", F.explode(F.array_repeat(F.lit(1), F.col(f"{p}copies").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, seed: str = SEED) -> DataFrame:
    d, p = with_copies(docs.select("doc_id", "text", "source"), seed)
    return d.select(
        "doc_id",
        F.col(f"{p}size").alias("size"),
        F.col(f"{p}source_size").alias("source_size"),
        F.col(f"{p}target").alias("target"),
        (F.col(f"{p}size") * F.col(f"{p}copies")).alias("taken"),
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM per
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM ranked
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(lev) OVER ()) AS target FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
