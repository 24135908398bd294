"""Texts made of claims and facts: explanations, prompts, feedback, fact lines.

All are native expressions.  Numbers follow printf rounding, which may differ in the last digit shown from other
languages; texts are for readers and are never compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ABSOLUTE, BPS, CHANGE, GROWTH

# How the unit of a claimed value reads, and the line that the verdict parser looks for.
UNIT_NAMES = {"USD": "dollars", "percent": "percent", "bps": "bps", "pure": "as a fraction"}
CLAIMED_UNITS = {GROWTH: "percent", BPS: "bps"}
VERDICT_LINE = "VERDICT: <consistent|inconsistent|unverifiable>"

SYSTEM_TEXT = "Check the stated figure against the reported data below. Show the arithmetic before the verdict."
RULES = {
    ABSOLUTE: "Compare the stated value with the reported one; the gap is relative to the reported value.",
    GROWTH: "Compute 100 * (current - prior) / |prior|; the gap is in percentage points.",
    CHANGE: "Compute current - prior; the gap is relative to the larger of the two.",
    BPS: "Compute 10000 * (current ratio - prior ratio) of metric to denominator; the gap is in basis points.",
}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def whole(c: Column) -> Column:
    """A number without decimals, thousands separated."""
    return F.format_number(c, 0)


def fixed(c: Column, places: int, suffix: str = "") -> Column:
    return F.when(c.isNotNull(), F.concat(F.format_string(f"%.{places}f", c.cast("double")), F.lit(suffix)))


def short(c: Column) -> Column:
    """Six significant digits without trailing zeros; an exponent below 1e-4 and from 1e6."""
    c = c.cast("double")
    sci = F.format_string("%.5e", c)
    exponent = F.substring_index(sci, "e", -1).cast("int")
    mantissa = F.regexp_replace(F.substring_index(sci, "e", 1), r"\.?0+$", "")
    plain = F.format_string("%.9f", F.round(c, 9))
    for e in range(-4, 6):
        plain = F.when(exponent == e, F.format_string(f"%.{5 - e}f", c)).otherwise(plain)
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(c.isNotNull(), F.when(exponent.between(-4, 5), plain).otherwise(F.concat(mantissa, F.lit("e"), F.substring_index(sci, "e", -1))))


def amount(value: Column, unit: Column) -> Column:
    """A value with its unit: whole dollars, six places of a fraction, else short."""
    known = F.when(unit == "USD", F.concat(F.lit("$"), whole(value))).when(unit == "pure", fixed(value, 6)).otherwise(F.concat_ws(" ", short(value), F.coalesce(_map(UNIT_NAMES)[unit], unit)))
    return F.coalesce(F.when(value.isNotNull(), known), F.lit("(no such fact)"))


def explanation() -> Column:
    """Why a verdict was given, from the columns of reconciled claims with the structs of their roles."""
    said, got, gap = F.col("claimed_value"), F.col("computed_value"), F.col("difference")
    v = {r: F.col(f"{r}.value") for r in ("cur", "den_cur", "pri", "den_pri")}
    moved = F.concat(whole(v["pri"]), F.lit(" -> "), whole(v["cur"]))
    ratio = lambda n, d: fixed(F.try_divide(v[n], v[d]) * 100, 4, "%")
    say = lambda stated, reported, off: F.concat(F.lit("stated "), stated, F.lit("; reported data give "), reported, F.lit("; gap "), off)
    name = F.col("metric")
    kind = F.col("comparison_type")
    text = (
        F.when(kind == ABSOLUTE, F.concat(name, F.lit(": "), say(whole(said), F.concat(whole(got), F.lit(" at "), F.col("period_end")), fixed(gap * 100, 2, "%"))))
        .when(kind == GROWTH, F.concat(name, F.lit(" growth: "), say(fixed(said, 2, "%"), F.concat(fixed(got, 2, "%"), F.lit(" ("), moved, F.lit(")")), fixed(gap, 2, " points"))))
        .when(kind == CHANGE, F.concat(name, F.lit(" change: "), say(whole(said), F.concat(whole(got), F.lit(" ("), moved, F.lit(")")), fixed(gap * 100, 2, "%"))))
        .when(kind == BPS, F.concat(name, F.lit("/"), F.col("denominator_metric"), F.lit(": "), say(fixed(said, 1, " bps"), F.concat(fixed(got, 1, " bps ("), ratio("pri", "den_pri"), F.lit(" -> "), ratio("cur", "den_cur"), F.lit(")")), fixed(gap, 1, " bps"))))
    )
    return F.when(F.col("verdict") == "unverifiable", F.concat(name, F.lit(": not verifiable, "), F.replace("reason_code", F.lit("_"), F.lit(" ")))).otherwise(text)


def prompt() -> Column:
    """The user message for a training example (the columns that build_examples gives): the statement, a table of facts, the rule, the answer's form."""
    kind, unit = F.col("comparison_type"), F.col("unit")
    metric, den, end, prior = (F.col(c) for c in ("metric", "denominator_metric", "period_end", "comparison_period_end"))
    row = lambda name, at, value: F.concat_ws(" | ", name, at, amount(F.col(value), unit))
    stated = F.concat(F.lit("A filing states "), amount(F.col("claimed_value"), F.coalesce(_map(CLAIMED_UNITS)[kind], unit)), F.lit(" as the "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" of "), metric, F.lit("."))
    facts = F.concat_ws(
        "\n", F.lit("concept | period end | reported"), row(metric, end, "current_value"), F.when(kind != ABSOLUTE, row(metric, prior, "comparison_value")),
        F.when(kind == BPS, row(den, end, "denominator_current_value")), F.when(kind == BPS, row(den, prior, "denominator_comparison_value")),
    )
    accepted = F.concat(_map(RULES)[kind], F.lit(" It holds if the gap is at most "), short(F.col("tolerance")), F.lit("; without the facts it can't be decided."))
    return F.concat_ws("\n\n", stated, facts, accepted, F.concat(F.lit("Last line: "), F.lit(VERDICT_LINE)))


def chat(user: Column) -> Column:
    """System and user message as an array of (role, content)."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM_TEXT)), message("user", user))


def describe_claim(c: Column) -> Column:
    unit = c["value_unit"]
    suffix = F.when(unit == "USD", "").when(unit == "percent", "%").otherwise(F.concat(F.lit(" "), unit))
    return F.concat(c["comparison_type"], F.lit(" '"), c["metric"], F.lit("' ~"), short(c["value"]), suffix)


def feedback() -> Column:
    """What an extractor got right, missed and made up, from matched examples (golds, hits, left)."""
    missed = F.transform(F.filter(F.arrays_zip("golds", "hits"), lambda z: ~z["hits"]), lambda z: describe_claim(z["golds"]))
    extra = F.transform("left", describe_claim)
    right = F.size(F.filter("hits", lambda h: h))
    part = lambda label, items: F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, "; ")))
    exact = F.when((F.size(missed) == 0) & (F.size(extra) == 0), F.lit("nothing missed, nothing extra"))
    return F.concat_ws(". ", F.concat(right.cast("string"), F.lit("/"), F.size("golds").cast("string"), F.lit(" claims found")), part("missed: ", missed), part("extra: ", extra), exact)


def fact_line() -> Column:
    """A fact as a judge without tools reads it: its source in brackets, then what it says of which time."""
    source = F.concat(F.lit("["), F.concat_ws(" / ", "accession_number", "form", F.nullif(F.col("filed"), F.lit(""))), F.lit("] "))
    time = F.when(F.col("period_start").isNull(), F.concat(F.lit("as at "), "period_end")).otherwise(F.concat(F.lit("for "), "period_start", F.lit(" to "), "period_end"))
    return F.concat(source, time, F.lit(": "), amount(F.col("value"), F.col("unit")))


def parse_answer(c: Column) -> Column:
    """Claims of a model's JSON answer, inside a code fence or bare; null where the answer is no JSON of that form."""
    from ..schema import EXTRACTED

    bare = F.regexp_extract(F.trim(c), r"(?s)^```(?:json)?(.*?)(?:```.*)?$", 1)
    text = F.when(F.trim(c).startswith("```"), F.trim(bare)).otherwise(F.trim(c))
    return F.from_json(text, f"struct<claims:{EXTRACTED}>")["claims"]
