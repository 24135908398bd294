"""Column expressions over free text: keys, period hints, keywords, verdict lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of period hints, verdict lines and stop words.
FISCAL_YEAR = r"(?i)fiscal\s+(?:year\s+)?(\d{4})|\bFY\s?(\d{4})\b"
BARE_YEAR = r"(?i)^\s*(?:in\s+)?(\d{4})\s*$"
QUARTER = r"(?i)\b(first|second|third|fourth)\s+(?:fiscal\s+)?quarter\b|\bQ([1-4])\b"
SEQUENTIAL = r"(?i)\bsequential(?:ly)?\b"
YEAR_AGO = r"(?i)\ba year (?:ago|earlier)\b|\byear[- ]over[- ]year\b|\bprior year\b|\bsame (?:period|quarter) last year\b"
VERDICT = r"(?i)VERDICT:\s*(consistent|inconsistent|unverifiable)"
STOPWORDS = ("the", "a", "an", "of", "and", "or", "for", "to", "in", "on")
OVERLAP = 0.5


def strip(c: Column) -> Column:
    """Without white space (no-break space included) at both ends."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def metric_key(c: Column) -> Column:
    return F.lower(strip(c))


def hint_year(c: Column) -> Column:
    named = F.coalesce(F.nullif(F.regexp_extract(c, FISCAL_YEAR, 1), F.lit("")), F.nullif(F.regexp_extract(c, FISCAL_YEAR, 2), F.lit("")))
    return F.coalesce(named, F.nullif(F.regexp_extract(c, BARE_YEAR, 1), F.lit(""))).cast("int")


def hint_quarter(c: Column) -> Column:
    word, digit = F.lower(F.regexp_extract(c, QUARTER, 1)), F.regexp_extract(c, QUARTER, 2)
    names = F.create_map(*[F.lit(x) for kv in (("first", "Q1"), ("second", "Q2"), ("third", "Q3"), ("fourth", "Q4")) for x in kv])
    return F.when(word != "", names[word]).when(digit != "", F.concat(F.lit("Q"), digit))


def hint_sequential(c: Column) -> Column:
    return F.coalesce(c.rlike(SEQUENTIAL), F.lit(False))


def hint_year_ago(c: Column) -> Column:
    return F.coalesce(c.rlike(YEAR_AGO), F.lit(False))


def keywords(c: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS]))


def metric_overlap(a: Column, b: Column) -> Column:
    """Shared keywords over the larger keyword set; two empty sets match fully."""
    x, y = keywords(a), keywords(b)
    most = F.greatest(F.size(x), F.size(y))
    both_empty = F.when(most == 0, 1.0).otherwise(0.0)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), both_empty).otherwise(F.try_divide(F.size(F.array_intersect(x, y)), most))


def parse_verdict(c: Column) -> Column:
    """The last verdict line, in lower case; null if there is none."""
    return F.lower(F.try_element_at(F.regexp_extract_all(c, F.lit(VERDICT), F.lit(1)), F.lit(-1)))


def judge_verdict(c: Column) -> Column:
    """A judge's bare answer: one of the verdicts, else the beginning of what it said."""
    clean = metric_key(c)
    return F.when(clean.isin("consistent", "inconsistent", "unverifiable"), clean).otherwise(F.concat(F.lit("unparseable:"), F.substring(clean, 1, 60)))


def md5_bucket(c: Column, n: int) -> Column:
    """int(md5(text), 16) mod n, folded over the hex digits."""
    digits = F.split(F.md5(c.cast("binary")), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("long")) % n)
