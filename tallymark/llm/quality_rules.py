"""Quality rules with adaptive thresholds (DataFrame functions only).

Each document gets whole-number measures.  A mergeable quantile sketch per language and source counts their
values in buckets (exact under 1024, a relative error of at most 1/512 above), so two sketches merge by adding counts and the
result does not depend on the order of merging.  All thresholds are quantiles of these sketches; none is fixed:

    fence = median + REACH * max(spread, width of the bucket at the median)

The spread is Q50 - Q25, the lower half of a distribution, which junk above the median can't widen until it is half of the
group; a group takes at least the median spread of its language's groups, so that a group full of copies of one document is not too narrow.
Where that is zero (a measure that is zero for most documents) it is half of the least Q90 - Q50 of the group, its language and
the whole.  A group of fewer than `least` documents takes its language's merged sketch, a language with fewer the whole one.

Symbols, repeated words and repeated lines count in excess of two chance events (two symbols, two windows met twice, two lines),
so that a fence of zero does not turn a single accident into a verdict.

Defined results for odd input: a null or empty text has no words and fails the base rule;
null languages and sources are groups of their own; repeated rows count each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut
from .textkit import WORD

SYMBOLS = "#*$%&|<>"
MEASURES = ("symbols", "repeats", "lines", "long", "short")
#: Events that may be chance: symbols, words of repeated windows, repeated lines.
CHANCE = {"symbols": 2, "repeats": 12, "lines": 2}
#: Spreads from the median to the fence; Q50 - Q25 is 0.67 standard deviations of a normal distribution.
REACH = 8
LEAST = 20


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and binds it in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """Words in 3-word windows that occur twice or more.

    A window is one long: its hash shifted left over as many bits as positions need, then its position; one
    primitive sort brings windows together that may be equal.  These alone are sorted by their full hashes and compared
    word by word; their positions in order then each add the words up to the next one, three at most.
    """
    near = "((j > 0 and shiftright(p[j], b) = shiftright(p[j - 1], b)) or (j < size(p) - 1 and shiftright(p[j], b) = shiftright(p[j + 1], b)))"
    packed = "sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | cast(i as bigint)))"
    maybe = f"transform(filter(sequence(0, size(p) - 1), j -> {near}), j -> cast(p[j] & (shiftleft(1L, b) - 1L) as int))"
    hashed = "sort_array(transform(c, i -> named_struct('h', xxhash64(w[i], w[i + 1], w[i + 2]), 'i', i)))"
    equal = lambda x, y: f"(s[{x}].h = s[{y}].h and w[s[{x}].i] = w[s[{y}].i] and w[s[{x}].i + 1] = w[s[{y}].i + 1] and w[s[{x}].i + 2] = w[s[{y}].i + 2])"
    same = f"((k > 0 and {equal('k', 'k - 1')}) or (k < size(s) - 1 and {equal('k', 'k + 1')}))"
    positions = f"sort_array(transform(filter(sequence(0, size(s) - 1), k -> {same}), k -> cast(s[k].i as bigint)))"
    added = "3L + aggregate(sequence(1, size(r) - 1), 0L, (a, j) -> a + least(3L, r[j] - r[j - 1]))"
    counted = _let(positions, "r", f"if(size(r) < 2, 0L, {added})")
    verified = f"if(size(c) < 2, 0L, {_let(hashed, 's', counted)})"
    inner = _let(packed, "p", _let(maybe, "c", verified))
    return f"if(size(w) < 4, 0L, {_let('length(bin(cast(size(w) as bigint)))', 'b', inner)})"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base measures, in one pass over the texts."""
    text = "coalesce(text, '')"
    extracted = f"regexp_extract_all({text}, r'{WORD}', 0)"
    has_word = f"rlike(l, r'{WORD}')"
    lines = _let(f"filter(split({text}, '\n'), l -> {has_word})", "q", "named_struct('n', cast(size(q) as bigint), 'd', cast(size(q) - size(array_distinct(q)) as bigint))")
    stats = docs.select(
        "doc_id",
        "lang",
        "source",
        F.expr(_let(extracted, "w", f"named_struct('n', cast(size(w) as bigint), 'r', {_repeat_words()})")).alias("s"),
        F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(F.coalesce("text", F.lit(""))) - F.length(F.translate(F.coalesce("text", F.lit("")), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(lines).alias("q"),
    )
    return stats.select("doc_id", "lang", "source", F.col("s.n").alias("n_words"), "word_chars", "n_symbols", F.col("q.d").alias("n_dup_lines"), F.col("s.r").alias("n_repeat_words"), F.col("q.n").alias("n_lines"))


def _values() -> dict[str, str]:
    """Shares in thousandths of word characters, words and lines; mean word length in hundredths, above and below."""
    share = lambda a, b: f"coalesce(cast(floor(try_divide(1000.0D * greatest({a}, 0L), {b})) as bigint), 0L)"
    mean = "coalesce(cast(floor(try_divide(100 * word_chars, n_words)) as bigint), 0L)"
    return {
        "symbols": share(f"n_symbols - {CHANCE['symbols']}", "word_chars"), "repeats": share(f"n_repeat_words - {CHANCE['repeats']}", "n_words"),
        "lines": share(f"n_dup_lines - {CHANCE['lines']}", "n_lines"), "long": mean, "short": f"greatest(0L, 2000L - {mean})",
    }


def _width(v: str) -> str:
    """Width of the sketch bucket of a non-negative whole number."""
    return f"shiftleft(1L, greatest(0, length(bin({v})) - 10))"


def _bucket(v: str) -> str:
    """Lower end of that bucket."""
    return f"{v} - {v} % {_width(v)}"


def sketches(base: DataFrame) -> DataFrame:
    """lang, source, measure, low, n: the sketch of every group, combined on the map side first."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"v_{m}").alias("v")) for m in MEASURES]))
    long = base.select("lang", "source", rows.alias("x")).select("lang", "source", "x.measure", F.col("x.v").alias("v"))
    return long.groupBy("lang", "source", "measure", F.expr(_bucket("v")).alias("low")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source and a fence per measure, from the group's own sketch and the merged ones."""
    levels = {"own": ["lang", "source"], "lang": ["lang"], "all": []}
    found = None
    for level, keys in levels.items():
        merged = sketch.groupBy(*keys, "measure", "low").agg(F.sum("n").alias("n"))
        part = ", ".join([*keys, "measure"])
        cum = merged.select("*", F.expr(f"sum(n) over (partition by {part} order by low)").alias("upto"), F.expr(f"sum(n) over (partition by {part})").alias("total"))
        at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("low")))
        quant = cum.groupBy(*keys, "measure").agg(F.max("total").alias(f"n_{level}"), at(25).alias("q25"), at(50).alias(f"mid_{level}"), at(90).alias("q90"))
        quant = quant.select(
            *[F.col(k).alias(f"{k}_{level}") for k in keys], F.col("measure").alias(f"measure_{level}"), f"n_{level}", f"mid_{level}",
            (F.col(f"mid_{level}") - F.col("q25")).alias(f"below_{level}"), (F.col("q90") - F.col(f"mid_{level}")).alias(f"above_{level}"),
        )
        if found is None:
            found = quant
        else:
            on = F.col("measure_own") == F.col(f"measure_{level}")
            for k in keys:
                on = on & F.col(f"{k}_own").eqNullSafe(F.col(f"{k}_{level}"))
            found = found.join(quant, on)
    own, lang = F.col("n_own") >= least, F.col("n_lang") >= least
    nearest = lambda x: F.when(own, F.col(f"{x}_own")).when(lang, F.col(f"{x}_lang")).otherwise(F.col(f"{x}_all"))
    middle = nearest("mid")
    pooled = found.where(own).groupBy("lang_own", "measure_own").agg(F.expr("percentile_disc(0.5) within group (order by below_own)").alias("pooled"))
    pooled = pooled.withColumnsRenamed({"lang_own": "lang_pooled", "measure_own": "measure_pooled"})
    found = found.join(pooled, F.col("lang_own").eqNullSafe(F.col("lang_pooled")) & (F.col("measure_own") == F.col("measure_pooled")), "left")
    below = F.when(own, F.greatest("below_own", "pooled")).otherwise(nearest("below"))
    above = F.least(nearest("above"), F.when(lang, F.col("above_lang")), F.col("above_all"))
    found = found.select("lang_own", "source_own", "measure_own", middle.alias("middle"), F.when(below > 0, below).otherwise(F.floor(above / 2)).alias("spread"))
    fence = F.col("middle") + REACH * F.greatest(F.col("spread"), F.expr(_width("middle")))
    return found.groupBy("lang_own", "source_own").agg(*[F.max(F.when(F.col("measure_own") == m, fence)).alias(f"fence_{m}") for m in MEASURES])


def apply_rules(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The base measures, base_failed and kept of every document."""
    base = measures(docs.select("doc_id", "text", "lang", "source"))
    base = cut(base.select("*", *[F.expr(v).alias(f"v_{m}") for m, v in _values().items()]), "measures")
    limits = fences(sketches(base), least)
    joined = base.join(limits, F.col("lang").eqNullSafe(F.col("lang_own")) & F.col("source").eqNullSafe(F.col("source_own")), "left")
    within = F.lit(True)
    for m in MEASURES:
        within = within & (F.col(f"v_{m}") <= F.col(f"fence_{m}"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(within, F.lit(True)))


def digest(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, i FROM wins JOIN (SELECT doc_id, g FROM wins GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)
), repw AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN repw USING (doc_id) LEFT JOIN lines USING (doc_id)
), vals AS (
  SELECT *, CASE WHEN word_chars = 0 THEN 0 ELSE 1000 * greatest(n_symbols - 2, 0) // word_chars END AS symbols,
    CASE WHEN n_words = 0 THEN 0 ELSE 1000 * greatest(n_repeat_words - 12, 0) // n_words END AS repeats,
    CASE WHEN n_lines = 0 THEN 0 ELSE 1000 * greatest(n_dup_lines - 2, 0) // n_lines END AS lines, CASE WHEN n_words = 0 THEN 0 ELSE 100 * word_chars // n_words END AS long FROM base
), full_vals AS (SELECT *, greatest(0, 2000 - long) AS short FROM vals
), unp AS (
  SELECT doc_id, lang, source, 'symbols' AS m, symbols AS v FROM full_vals UNION ALL SELECT doc_id, lang, source, 'repeats', repeats FROM full_vals
  UNION ALL SELECT doc_id, lang, source, 'lines', lines FROM full_vals UNION ALL SELECT doc_id, lang, source, 'long', long FROM full_vals
  UNION ALL SELECT doc_id, lang, source, 'short', short FROM full_vals
), buck AS (
  SELECT *, v - v % (1 << greatest(0, length(bin(v)) - 10)) AS low FROM unp
), q AS (
  SELECT DISTINCT lang, source, m,
    quantile_disc(low, 0.25) OVER (PARTITION BY lang, source, m) AS a1, quantile_disc(low, 0.5) OVER (PARTITION BY lang, source, m) AS a2, quantile_disc(low, 0.9) OVER (PARTITION BY lang, source, m) AS a3,
    quantile_disc(low, 0.25) OVER (PARTITION BY lang, m) AS b1, quantile_disc(low, 0.5) OVER (PARTITION BY lang, m) AS b2, quantile_disc(low, 0.9) OVER (PARTITION BY lang, m) AS b3,
    quantile_disc(low, 0.25) OVER (PARTITION BY m) AS c1, quantile_disc(low, 0.5) OVER (PARTITION BY m) AS c2, quantile_disc(low, 0.9) OVER (PARTITION BY m) AS c3,
    count(*) OVER (PARTITION BY lang, source, m) >= 20 AS own, count(*) OVER (PARTITION BY lang, m) >= 20 AS by_lang
  FROM buck
), pooled AS (
  SELECT lang, m, quantile_disc(a2 - a1, 0.5) AS p FROM q WHERE own GROUP BY lang, m
), near AS (
  SELECT q.lang, source, q.m, CASE WHEN own THEN a2 WHEN by_lang THEN b2 ELSE c2 END AS middle,
    CASE WHEN own THEN greatest(a2 - a1, p) WHEN by_lang THEN b2 - b1 ELSE c2 - c1 END AS below,
    least(CASE WHEN own THEN a3 - a2 WHEN by_lang THEN b3 - b2 ELSE c3 - c2 END, CASE WHEN by_lang THEN b3 - b2 ELSE c3 - c2 END, c3 - c2) AS above FROM q LEFT JOIN pooled ON q.lang IS NOT DISTINCT FROM pooled.lang AND q.m = pooled.m
), fence AS (
  SELECT lang, source, m, middle + 8 * greatest(CASE WHEN below > 0 THEN below ELSE above // 2 END, 1 << greatest(0, length(bin(middle)) - 10)) AS f FROM near
), verdict AS (
  SELECT doc_id, bool_and(v <= f) AS within FROM unp JOIN fence ON unp.m = fence.m AND unp.lang IS NOT DISTINCT FROM fence.lang AND unp.source IS NOT DISTINCT FROM fence.source GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND within AS kept
FROM full_vals JOIN verdict USING (doc_id)
"""
