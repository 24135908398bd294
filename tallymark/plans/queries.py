"""Registered queries of the claim-checking operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionary as dic
from ..functions import render
from ..functions import text as tx
from ..operators import audit, dataset, lookup, reconcile, resolve, restate, runs, scoring
from ..sources import filings
from ..storage import cut
from . import adapter, coordinator, tools
from .adapter import CLAIMS, EVENTS, EXTRACTED, FACTS, PROSE, build, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_F, _C, _X, _P, _E = (f"({duck(s)})" for s in (FACTS, CLAIMS, EXTRACTED, PROSE, EVENTS))
_DICT, _RATIO = dic.values_sql(dic.metric_rows()), dic.values_sql(dic.ratio_rows())


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


facts = lambda spark, d: build(spark, d, FACTS)
claims = lambda spark, d: build(spark, d, CLAIMS)

# ---- sources ----

@query(f"SELECT ticker, cik, concept, unit, period_start, period_end, value, form, filed, accession_number FROM {_F} WHERE concept <> 'Assets'")
def q_facts_flatten(spark, sf_dir):
    f = facts(spark, sf_dir)
    e = F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end"), F.col("value").alias("val"), F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"), "form", "filed", F.col("accession_number").alias("accn"))
    units = f.groupBy("ticker", "cik", "concept", "unit").agg(F.collect_list(e).alias("entries"))
    by_concept = units.groupBy("ticker", "cik", "concept").agg(F.struct(F.col("concept").alias("label"), F.map_from_entries(F.collect_list(F.struct("unit", "entries"))).alias("units")).alias("c"))
    tax = by_concept.groupBy("ticker", "cik").agg(F.map_from_entries(F.collect_list(F.struct("concept", "c"))).alias("t"))
    raw = tax.select(F.lower("ticker").alias("ticker"), F.to_json(F.struct(F.col("cik").cast("long").alias("cik"), F.create_map(F.lit("us-gaap"), F.col("t")).alias("facts"))).alias("body"))
    wanted = ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "GrossProfit", "NetIncomeLoss", "OperatingIncomeLoss"]
    return filings.flatten_facts(raw, concepts=wanted).select("ticker", "cik", "concept", "unit", "period_start", "period_end", "value", "form", "filed", "accession_number")


@query(f"""
WITH i AS (SELECT DISTINCT ticker, cik, accession_number, form, filed FROM {_F} WHERE form IN ('10-Q', '10-K') AND filed <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filed DESC, accession_number DESC) AS rn FROM i)
SELECT ticker, cik, accession_number, form, filed AS filing_date, rn, CAST(CAST(cik AS BIGINT) AS VARCHAR) || '/' || replace(accession_number, '-', '') || '/main.htm' AS filing_path FROM r WHERE rn <= 10""")
def q_filing_index_topn(spark, sf_dir):
    f = facts(spark, sf_dir).where("filed <> ''").select("ticker", "cik", "accession_number", "form", "filed").distinct()
    row = F.struct("filed", "accession_number", "form")
    idx = f.groupBy("ticker", "cik").agg(F.sort_array(F.collect_list(row), asc=False).alias("r"))  # one company's filings: bounded
    col = lambda c: F.transform("r", lambda x: x[c])
    blank = F.transform("r", lambda x: F.lit(""))
    raw = idx.select("ticker", "cik", col("accession_number").alias("accessionNumber"), col("filed").alias("filingDate"), blank.alias("reportDate"), col("form").alias("form"), F.transform("r", lambda x: F.lit("main.htm")).alias("primaryDocument"), blank.alias("primaryDocDescription"))
    out = filings.filing_index(raw, ["10-Q", "10-K"], 10)
    return out.select("ticker", "cik", "accession_number", "form", "filing_date", F.col("rn").cast("long").alias("rn"), "filing_path")


@query(f"SELECT DISTINCT concept FROM {_F} ORDER BY concept")
def q_concept_list(spark, sf_dir):
    return filings.list_concepts(facts(spark, sf_dir))


@query("SELECT s_suppkey, n_name AS label, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT s_suppkey, 'CIK' || lpad(CAST(s_nationkey AS VARCHAR), 10, '0'), lpad(CAST(s_nationkey AS VARCHAR), 10, '0') FROM supplier WHERE s_nationkey % 2 = 1")
def q_cik_lookup(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("cik"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lpad(F.col("s_nationkey").cast("string"), 10, "0").alias("cik"))
    return filings.label_companies(rows, known).select("s_suppkey", "label", "cik")


@query("SELECT user_id AS key, max(event_id) AS fetched_at, CAST(max_by(event_type, event_id) AS VARCHAR) AS data FROM events WHERE 1000000 - event_id < 998000 GROUP BY user_id")
def q_landing_latest(spark, sf_dir):
    landed = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("fetched_at"), F.col("event_type").alias("data"))
    return filings.landing_latest(landed, 1_000_000, 998_000)


@query()
def q_paragraph_extract(spark, sf_dir):
    return filings.paragraphs(table(spark, sf_dir, "pages"), "page_id")


_LINES = r"""(WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)
SELECT doc_id, pos, CASE pos % 8 WHEN 2 THEN 'Item 7. Management''s Discussion' WHEN 5 THEN 'ITEM 7A - Quantitative and other' ELSE text END AS text FROM l)"""


def _lines(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return raw.withColumn("text", F.when(F.col("pos") % 8 == 2, "Item 7. Management's Discussion").when(F.col("pos") % 8 == 5, "ITEM 7A - Quantitative and other").otherwise(F.col("text")))


@query(rf"""
WITH lines AS {_LINES}, s AS (SELECT doc_id, pos AS s FROM lines WHERE pos % 8 = 2), e AS (SELECT doc_id, pos AS e FROM lines WHERE pos % 8 = 5),
s2 AS (SELECT doc_id, s FROM s), p AS (SELECT s2.doc_id, s, min(e) AS e FROM s2 JOIN e ON s2.doc_id = e.doc_id AND e.e > s GROUP BY ALL),
b AS (SELECT doc_id, s, e FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s) = 1)
SELECT lines.doc_id, CAST(pos AS INT) AS pos, text FROM lines JOIN b ON lines.doc_id = b.doc_id AND pos > s AND pos < e""")
def q_section_pick(spark, sf_dir):
    return filings.sections(_lines(spark, sf_dir), "doc_id", "10-K")


_BODY = "'The year ' || doc_id || ' went as we had planned.'"


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 END AS chunk_index, CASE WHEN doc_id % 4 = 0 THEN {_BODY} END AS text,
CASE doc_id % 4 WHEN 1 THEN 'no start heading' WHEN 2 THEN 'no end heading' WHEN 3 THEN 'no end heading after a start heading' END AS error FROM documents""")
def q_section_errors(spark, sf_dir):
    """Both forms: whole sections, and each cause why there is none."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    body = F.concat(F.lit("<p>"), F.expr(_BODY), F.lit("</p><p>short</p>"))

    def of(form, start, end, rest):
        s, e = F.lit(f"<td>{start}</td>"), F.lit(f"<div>{end}</div>")
        case = F.col("doc_id") % 4
        html = F.when(case == 0, F.concat(s, body, e)).when(case == 1, F.concat(body, e)).when(case == 2, F.concat(s, body)).otherwise(F.concat(e, body, s))
        return filings.get_section(d.where(F.col("doc_id").bitwiseAND(4) == rest).withColumn("html", html), "doc_id", form)

    year = of("10-K", "Item 7. Management&#8217;s Discussion", "Item 8. Financial Statements", 0)
    return year.unionByName(of("10-Q", "Item 2</td><td>Management's Discussion", "Item 3 - Quantitative", 4))


@query(rf"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS chunk_index, text FROM {_LINES} WHERE length(text) >= 20")
def q_chunk_filter(spark, sf_dir):
    return filings.chunks(_lines(spark, sf_dir), "doc_id")


# ---- lookups and comparisons ----

_ROLES = f"""
roles AS (
  SELECT claim_id, r.role, ticker, CASE WHEN r.role LIKE 'den%' THEN denominator_metric ELSE metric END AS concept, unit, as_of,
    CASE WHEN r.role LIKE '%pri' THEN comparison_period_end ELSE period_end END AS pe, CASE WHEN r.role LIKE '%pri' THEN comparison_period_start ELSE period_start END AS ps
  FROM {_C} c, (VALUES ('cur'), ('den_cur'), ('pri'), ('den_pri')) r(role)
  WHERE (comparison_type = 'absolute' AND r.role = 'cur') OR (comparison_type IN ('growth_pct', 'absolute_change') AND comparison_period_end IS NOT NULL AND r.role IN ('cur', 'pri'))
    OR (comparison_type = 'bps_change' AND comparison_period_end IS NOT NULL AND denominator_metric IS NOT NULL)
), cand AS (
  SELECT roles.claim_id, roles.role, f.period_start, f.value, f.filed, f.accession_number, f.fact_ord FROM roles JOIN {_F} f
    ON roles.ticker = f.ticker AND roles.concept = f.concept AND roles.unit = f.unit AND roles.pe = f.period_end AND (as_of IS NULL OR f.filed <= as_of) AND (ps IS NULL OR f.period_start IS NOT DISTINCT FROM ps)
), grp AS (
  SELECT claim_id, role, count(DISTINCT coalesce(period_start, 'none')) AS ns, count(DISTINCT value) AS nv, list(struct_pack(v := value, a := accession_number) ORDER BY filed, accession_number, fact_ord) AS l FROM cand GROUP BY ALL
), looked AS (
  SELECT roles.claim_id, roles.role, CASE WHEN ns > 1 THEN 'ambiguous_period' WHEN ns IS NULL THEN 'missing_fact' ELSE 'found' END AS status,
    CASE WHEN ns > 1 THEN NULL WHEN nv > 1 THEN l[len(l)].v ELSE l[1].v END AS value, CASE WHEN ns > 1 THEN NULL WHEN nv > 1 THEN l[len(l)].a ELSE l[1].a END AS accession
  FROM roles LEFT JOIN grp ON roles.claim_id = grp.claim_id AND roles.role = grp.role
)"""
_RECON = f"""
{_ROLES}, wide AS (
  SELECT c.*, {", ".join(f"max(CASE WHEN role = '{r}' THEN l.value END) AS {r}_v, max(CASE WHEN role = '{r}' THEN l.status END) AS {r}_s, max(CASE WHEN role = '{r}' THEN l.accession END) AS {r}_a" for r in reconcile.ROLES)}
  FROM {_C} c LEFT JOIN looked l ON c.claim_id = l.claim_id GROUP BY ALL
), prob AS (
  SELECT *, CASE WHEN comparison_type NOT IN ('absolute', 'growth_pct', 'absolute_change', 'bps_change') THEN 'unsupported_comparison_type'
    WHEN comparison_type <> 'absolute' AND comparison_period_end IS NULL THEN 'missing_comparison_context' WHEN comparison_type = 'bps_change' AND denominator_metric IS NULL THEN 'missing_comparison_context'
    WHEN cur_s <> 'found' THEN cur_s WHEN den_cur_s <> 'found' THEN den_cur_s WHEN pri_s <> 'found' THEN pri_s WHEN den_pri_s <> 'found' THEN den_pri_s
    WHEN comparison_type = 'growth_pct' AND pri_v = 0 THEN 'zero_denominator' WHEN comparison_type = 'bps_change' AND (den_cur_v = 0 OR den_pri_v = 0) THEN 'zero_denominator' END AS problem,
    CASE WHEN comparison_type = 'ratio' THEN coalesce(tolerance, 0.0) ELSE coalesce(tolerance, CASE comparison_type WHEN 'growth_pct' THEN 1.0 WHEN 'bps_change' THEN 50.0 ELSE 0.01 END) END AS tol FROM wide
), comp AS (
  SELECT *, CASE WHEN problem IS NULL THEN CASE comparison_type WHEN 'absolute' THEN cur_v WHEN 'growth_pct' THEN (cur_v - pri_v) / abs(pri_v) * 100 WHEN 'absolute_change' THEN cur_v - pri_v ELSE (cur_v / den_cur_v - pri_v / den_pri_v) * 10000 END END AS computed FROM prob
), diff AS (
  SELECT *, CASE comparison_type WHEN 'absolute' THEN abs(computed - claimed_value) / CASE WHEN cur_v = 0 THEN 1.0 ELSE abs(cur_v) END
    WHEN 'absolute_change' THEN abs(computed - claimed_value) / CASE WHEN greatest(abs(cur_v), abs(pri_v)) = 0 THEN 1.0 ELSE greatest(abs(cur_v), abs(pri_v)) END ELSE abs(computed - claimed_value) END AS d FROM comp
), final AS (
  SELECT claim_id, comparison_type, CASE WHEN problem IS NOT NULL THEN 'unverifiable' WHEN d <= tol THEN 'consistent' ELSE 'inconsistent' END AS verdict,
    coalesce(problem, CASE WHEN d <= tol THEN 'match' WHEN d <= 2 * tol THEN 'near_miss' ELSE 'large_miss' END) AS reason_code, computed AS computed_value, d AS difference, CAST(tol AS DOUBLE) AS tolerance,
    CASE WHEN problem IS NULL THEN concat_ws(',', cur_a, den_cur_a, pri_a, den_pri_a) ELSE '' END AS citations FROM diff
)"""


def _looked(spark, sf_dir):
    return lookup.lookup(reconcile.requests(claims(spark, sf_dir)), facts(spark, sf_dir)).select("claim_id", "role", "status", "value", "accession")


@query(f"WITH {_ROLES} SELECT * FROM looked")
def q_lookup_asof(spark, sf_dir):
    return _looked(spark, sf_dir)


@query(f"WITH {_ROLES} SELECT claim_id, role FROM looked WHERE status = 'ambiguous_period'")
def q_lookup_ambiguous(spark, sf_dir):
    return _looked(spark, sf_dir).where("status = 'ambiguous_period'").select("claim_id", "role")


def _reconciled(spark, sf_dir, kind=None):
    c = claims(spark, sf_dir)
    out = reconcile.reconcile(c if kind is None else c.where(F.col("comparison_type") == kind), facts(spark, sf_dir))
    return out.select("claim_id", "comparison_type", "verdict", "reason_code", "computed_value", "difference", "tolerance", F.array_join("citations", ",").alias("citations"))


@query(f"WITH {_RECON} SELECT * FROM final")
def q_reconcile_all(spark, sf_dir):
    return _reconciled(spark, sf_dir)


def _by_type(name, kind):
    def q(spark, sf_dir):
        return _reconciled(spark, sf_dir, kind)

    q.__name__ = name
    query(f"WITH {_RECON} SELECT * FROM final WHERE comparison_type = '{kind}'")(q)


for _name, _kind in (("q_reconcile_absolute", "absolute"), ("q_reconcile_growth", "growth_pct"), ("q_reconcile_change", "absolute_change"), ("q_reconcile_bps", "bps_change")):
    _by_type(_name, _kind)


@query(f"WITH {_RECON} SELECT comparison_type, verdict, reason_code, count(*) AS n FROM final GROUP BY ALL")
def q_reason_code_mix(spark, sf_dir):
    return _reconciled(spark, sf_dir).groupBy("comparison_type", "verdict", "reason_code").agg(F.count("*").alias("n"))


# ---- resolution ----


def _recency(d: str) -> str:
    return f"""
  SELECT claim_id, arg_max(concept, (latest, -priority)) AS concept FROM (
    SELECT x.claim_id, d.concept, d.priority, max(f.period_end) AS latest FROM {_X} x JOIN {d} ON trim(lower(x.metric)) = d.metric_key
    JOIN {_F} f ON f.ticker = x.ticker AND f.concept = d.concept AND (x.as_of IS NULL OR f.filed <= x.as_of) GROUP BY ALL) GROUP BY claim_id"""


@query(f"SELECT x.claim_id, r.concept FROM {_X} x LEFT JOIN ({_recency(_DICT)}) r ON x.claim_id = r.claim_id")
def q_concept_recency(spark, sf_dir):
    return resolve.resolve_concept(build(spark, sf_dir, EXTRACTED), facts(spark, sf_dir), dic.metrics(spark)).select("claim_id", "concept")


@query(f"SELECT x.claim_id, r.concept AS denominator_metric FROM {_X} x LEFT JOIN ({_recency(_RATIO)}) r ON x.claim_id = r.claim_id")
def q_ratio_denominator(spark, sf_dir):
    return resolve.resolve_concept(build(spark, sf_dir, EXTRACTED), facts(spark, sf_dir), dic.ratios(spark), "denominator_metric").select("claim_id", "denominator_metric")


_HINTS = r"""(SELECT *, TRY_CAST(coalesce(nullif(regexp_extract(period, '(?i)fiscal\s+(?:year\s+)?(\d{4})|\bFY\s?(\d{4})\b', 1), ''), nullif(regexp_extract(period, '(?i)fiscal\s+(?:year\s+)?(\d{4})|\bFY\s?(\d{4})\b', 2), ''), nullif(regexp_extract(period, '(?i)^\s*(?:in\s+)?(\d{4})\s*$', 1), '')) AS INT) AS hint_year,
  CASE lower(regexp_extract(period, '(?i)\b(first|second|third|fourth)\s+(?:fiscal\s+)?quarter\b', 1)) WHEN 'first' THEN 'Q1' WHEN 'second' THEN 'Q2' WHEN 'third' THEN 'Q3' WHEN 'fourth' THEN 'Q4' ELSE nullif('Q' || regexp_extract(period, '(?i)\bQ([1-4])\b', 1), 'Q') END AS hint_quarter,
  regexp_matches(period, '(?i)\bsequential(?:ly)?\b') AS hint_sequential, regexp_matches(period, '(?i)\ba year (?:ago|earlier)\b|\byear[- ]over[- ]year\b|\bprior year\b|\bsame (?:period|quarter) last year\b') AS hint_year_ago FROM """ + _X + ")"


@query(f"SELECT claim_id, hint_year, hint_quarter, hint_sequential, hint_year_ago FROM {_HINTS} h")
def q_hint_parse(spark, sf_dir):
    return resolve.with_hints(build(spark, sf_dir, EXTRACTED)).select("claim_id", "hint_year", "hint_quarter", "hint_sequential", "hint_year_ago")


_PERIODS = f"""
named AS (SELECT h.*, r.concept FROM {_HINTS} h LEFT JOIN ({_recency(_DICT)}) r ON h.claim_id = r.claim_id), fx AS {_F}, elig AS (
  SELECT n.claim_id, hint_year, hint_quarter, hint_sequential, hint_year_ago, f.*, row_number() OVER (PARTITION BY n.claim_id ORDER BY f.period_end DESC, f.fact_ord) AS rn, date_diff('day', CAST(period_start AS DATE), CAST(period_end AS DATE)) AS days
  FROM named n JOIN fx f ON n.ticker = f.ticker AND n.concept = f.concept AND (n.as_of IS NULL OR f.filed <= n.as_of)
), c1 AS (
  SELECT claim_id, CASE
    WHEN any_value(hint_quarter) IS NOT NULL THEN
      CASE WHEN any_value(hint_year) IS NOT NULL AND count(*) FILTER (fiscal_period = hint_quarter AND fiscal_year = hint_year) > 0
        THEN coalesce(min(rn) FILTER (fiscal_period = hint_quarter AND fiscal_year = hint_year AND abs(days - 91) <= 20), min(rn) FILTER (fiscal_period = hint_quarter AND fiscal_year = hint_year))
        ELSE coalesce(min(rn) FILTER (fiscal_period = hint_quarter AND abs(days - 91) <= 20), min(rn) FILTER (fiscal_period = hint_quarter)) END
    WHEN any_value(hint_year) IS NOT NULL THEN coalesce(min(rn) FILTER (fiscal_period = 'FY' AND fiscal_year = hint_year), min(rn) FILTER (fiscal_period = 'FY' AND fiscal_year = hint_year - 1), min(rn) FILTER (fiscal_year = hint_year), 1)
    ELSE 1 END AS cur FROM elig GROUP BY claim_id
), c2 AS (
  SELECT e.*, cur, k.period_start AS cs, k.period_end AS ce, k.days AS cd, k.fact_ord AS cur_ord FROM elig e JOIN c1 USING (claim_id) JOIN elig k ON k.claim_id = e.claim_id AND k.rn = cur
), old AS (
  SELECT *, coalesce(abs(days - cd) <= 20, false) AS sim, abs(date_diff('day', CAST(ce AS DATE) - INTERVAL 1 YEAR, CAST(period_end AS DATE))) AS de, abs(date_diff('day', CAST(cs AS DATE) - INTERVAL 1 YEAR, CAST(period_start AS DATE))) AS ds
  FROM c2 WHERE rn > cur AND NOT (period_start IS NOT DISTINCT FROM cs AND period_end IS NOT DISTINCT FROM ce)
), pick AS (
  SELECT claim_id, any_value(cs) AS cs, bool_or(hint_sequential) AS seq, bool_or(hint_year_ago) AS ago, arg_min(fact_ord, rn) AS anyo, arg_min(fact_ord, rn) FILTER (sim) AS likeo,
    arg_min(fact_ord, (de, rn)) FILTER (period_start IS NULL) AS neo, min(de) FILTER (period_start IS NULL) AS ned, arg_min(fact_ord, (ds, rn)) FILTER (sim) AS nso, min(ds) FILTER (sim) AS nsd FROM old GROUP BY claim_id
), placed AS (
  SELECT n.*, k.cur_ord, CASE WHEN cs IS NULL THEN CASE WHEN ned <= 60 THEN neo ELSE anyo END WHEN seq THEN coalesce(likeo, anyo) WHEN ago AND nsd <= 60 THEN nso ELSE coalesce(likeo, anyo) END AS cmp_ord
  FROM named n LEFT JOIN (SELECT DISTINCT claim_id, cur_ord FROM c2) k ON n.claim_id = k.claim_id LEFT JOIN pick p ON n.claim_id = p.claim_id
)"""


def _placed(spark, sf_dir):
    f = cut(facts(spark, sf_dir), "facts")  # read by both steps
    named = resolve.with_hints(resolve.resolve_concept(build(spark, sf_dir, EXTRACTED), f, dic.metrics(spark)))
    return resolve.resolve_periods(named, f)


@query(f"WITH {_PERIODS} SELECT claim_id, concept, cur_ord, cmp_ord FROM placed")
def q_resolve_periods(spark, sf_dir):
    return _placed(spark, sf_dir).select("claim_id", "concept", "cur_ord", "cmp_ord")


for _name, _where in (("default", "hint_quarter IS NULL AND hint_year IS NULL AND NOT hint_sequential AND NOT hint_year_ago"), ("quarter", "hint_quarter IS NOT NULL"), ("year", "hint_quarter IS NULL AND hint_year IS NOT NULL"), ("sequential", "hint_sequential"), ("yearago", "hint_year_ago"), ("instant", "concept = 'Assets'")):

    def _resolved(spark, sf_dir, where=_where):
        return _placed(spark, sf_dir).where(where).select("claim_id", "cur_ord", "cmp_ord")

    _resolved.__name__ = f"q_resolve_{_name}"
    query(f"WITH {_PERIODS} SELECT claim_id, cur_ord, cmp_ord FROM placed WHERE {_where}")(_resolved)

_OCC = f"(SELECT *, CASE WHEN comparison_type = 'absolute' AND period = '' THEN CAST(row_number() OVER (PARTITION BY chunk_id, comparison_type = 'absolute' AND period = '', trim(lower(metric)), value_unit ORDER BY claim_ord, claim_id) - 1 AS INT) ELSE 0 END AS occurrence FROM {_X})"


def _numbered(spark, sf_dir):
    x = build(spark, sf_dir, EXTRACTED).withColumn("claim_ord", F.struct("claim_ord", "claim_id"))
    return resolve.number_occurrences(x)


@query(f"SELECT claim_id, occurrence FROM {_OCC}")
def q_occurrence(spark, sf_dir):
    return _numbered(spark, sf_dir).select("claim_id", "occurrence")


_VERIFY = f"""
{_PERIODS}, side AS (
  SELECT p.*, o.occurrence, d.concept AS den, c.fact_ord IS NOT NULL AS has_cur, m.fact_ord IS NOT NULL AS has_cmp, m.period_start AS cmp_start, m.period_end AS cmp_end,
    p.comparison_type = 'absolute' AND ((o.occurrence = 1 AND coalesce(p.period, '') = '') OR p.hint_year_ago) AS swap,
    c.period_start AS cur_start, c.period_end AS cur_end, c.unit AS cur_unit, m.unit AS cmp_unit
  FROM placed p JOIN {_OCC} o USING (claim_id) LEFT JOIN ({_recency(_RATIO)}) d USING (claim_id)
  LEFT JOIN fx c ON c.ticker = p.ticker AND c.fact_ord = p.cur_ord LEFT JOIN fx m ON m.ticker = p.ticker AND m.fact_ord = p.cmp_ord
), main AS (
  SELECT *, CASE WHEN swap THEN cmp_unit ELSE cur_unit END AS main_unit,
    concept IS NULL OR NOT has_cur OR NOT (CASE WHEN swap THEN has_cmp ELSE has_cur END) OR (comparison_type <> 'absolute' AND NOT has_cmp)
      OR coalesce(comparison_type = 'absolute' AND value_unit = 'percent' AND (CASE WHEN swap THEN cmp_unit ELSE cur_unit END) <> 'pure', false) AS stuck FROM side
), ready AS (
  SELECT claim_id, ticker, concept AS metric, comparison_type, CASE WHEN comparison_type = 'absolute' AND main_unit = 'pure' AND value_unit = 'percent' THEN value / 100 ELSE value END AS claimed_value,
    CASE WHEN swap THEN cmp_end ELSE cur_end END AS period_end, CASE WHEN swap THEN cmp_start ELSE cur_start END AS period_start,
    CASE WHEN comparison_type <> 'absolute' THEN cmp_end END AS comparison_period_end, CASE WHEN comparison_type <> 'absolute' THEN cmp_start END AS comparison_period_start,
    CASE WHEN comparison_type = 'bps_change' THEN den END AS denominator_metric, main_unit AS unit, CAST(NULL AS DOUBLE) AS tolerance, as_of FROM main WHERE NOT stuck
), {_RECON.strip().replace(_C, "ready")}"""


@query(f"""WITH {_VERIFY} SELECT claim_id, verdict, reason_code, computed_value FROM final
UNION ALL SELECT claim_id, 'unverifiable', NULL, NULL FROM main WHERE stuck""")
def q_verify_pipeline(spark, sf_dir):
    return resolve.verify(_numbered(spark, sf_dir), cut(facts(spark, sf_dir), "facts"), dic.metrics(spark), dic.ratios(spark))


# ---- restatements ----

_FP = f"""
fx AS {_F}, o AS (SELECT * FROM fx WHERE form NOT IN ('10-K/A', '10-Q/A') QUALIFY row_number() OVER (PARTITION BY cik, concept, unit, period_start, period_end ORDER BY filed, fact_ord) = 1),
r AS (SELECT * FROM fx WHERE form IN ('10-K/A', '10-Q/A') QUALIFY row_number() OVER (PARTITION BY cik, concept, unit, period_start, period_end ORDER BY filed DESC, fact_ord) = 1),
fp AS (SELECT o.ticker, o.cik, o.concept, o.unit, o.period_start, o.period_end, o.value AS original_value, o.filed AS original_filed, o.accession_number AS original_accession, r.value AS restated_value, r.filed AS restated_filed,
  abs(r.value - o.value) / CASE WHEN o.value = 0 THEN 1.0 ELSE abs(o.value) END AS relative_diff
  FROM o JOIN r ON o.cik = r.cik AND o.concept = r.concept AND o.unit = r.unit AND o.period_start IS NOT DISTINCT FROM r.period_start AND o.period_end = r.period_end
  WHERE o.value <> r.value AND abs(r.value - o.value) / CASE WHEN o.value = 0 THEN 1.0 ELSE abs(o.value) END >= 0.01)"""


def _fps(spark, sf_dir):
    return restate.fingerprints(facts(spark, sf_dir), dic.metrics(spark))


_FPC = ["ticker", "cik", "concept", "unit", "period_start", "period_end", "original_value", "original_filed", "original_accession", "restated_value", "restated_filed", "relative_diff"]


@query(f"WITH {_FP} SELECT * FROM fp")
def q_fingerprints(spark, sf_dir):
    return _fps(spark, sf_dir).select(*_FPC)


@query(f"WITH {_FP} SELECT concept, count(*) AS n, count(DISTINCT cik) AS companies FROM fp GROUP BY concept")
def q_fingerprints_by_concept(spark, sf_dir):
    return _fps(spark, sf_dir).groupBy("concept").agg(F.count("*").alias("n"), F.count_distinct("cik").alias("companies"))


@query(f"WITH {_FP} SELECT lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, n_name FROM nation WHERE lpad(CAST(n_nationkey AS VARCHAR), 10, '0') NOT IN (SELECT cik FROM fp)")
def q_clean_set(spark, sf_dir):
    companies = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 10, "0").alias("cik"), "n_name")
    return restate.clean_companies(companies, _fps(spark, sf_dir))


@query(f"WITH {_FP} SELECT cik, max(abs(original_value)) AS largest FROM fp GROUP BY cik ORDER BY largest DESC, cik LIMIT 60")
def q_top_companies(spark, sf_dir):
    return restate.top_companies(_fps(spark, sf_dir))


_MATCH = f"""{_FP}, m AS (
  SELECT p.claim_id || '/' || fp.concept AS match_id, p.claim_id, p.comparison_type, p.value, fp.* FROM {_P} p JOIN {_DICT} ON trim(lower(p.metric)) = d.metric_key JOIN fp ON p.accession = fp.original_accession AND d.concept = fp.concept
  WHERE NOT (p.value_unit = 'percent' AND abs(p.value) <= 100 AND abs(fp.original_value) > 100) AND abs(p.value - fp.original_value) / CASE WHEN fp.original_value = 0 THEN 1.0 ELSE abs(fp.original_value) END <= 0.05)"""


def _matches(spark, sf_dir):
    m = restate.match_prose(build(spark, sf_dir, PROSE), _fps(spark, sf_dir), dic.metrics(spark))
    return m.withColumn("match_id", F.concat_ws("/", "claim_id", "concept"))


@query(f"WITH {_MATCH} SELECT match_id, claim_id, concept, cik, value, original_value, restated_value FROM m")
def q_prose_match(spark, sf_dir):
    return _matches(spark, sf_dir).select("match_id", "claim_id", "concept", "cik", "value", "original_value", "restated_value")


_BACK = f"""{_MATCH}, s AS (
  SELECT match_id, side, CASE WHEN comparison_type <> 'absolute' THEN 'unverifiable' ELSE (
    SELECT CASE WHEN count(*) = 0 OR count(DISTINCT coalesce(f.period_start, 'none')) > 1 THEN 'unverifiable'
      WHEN abs(CASE WHEN count(DISTINCT f.value) > 1 THEN arg_max(f.value, (f.filed, f.accession_number, -f.fact_ord)) ELSE min(f.value) END - m.value)
        / abs(CASE WHEN count(DISTINCT f.value) > 1 THEN arg_max(f.value, (f.filed, f.accession_number, -f.fact_ord)) ELSE min(f.value) END) <= 0.01 THEN 'consistent' ELSE 'inconsistent' END
    FROM fx f WHERE f.ticker = m.ticker AND f.concept = m.concept AND f.unit = m.unit AND f.period_end = m.period_end AND f.period_start IS NOT DISTINCT FROM m.period_start AND f.filed <= CASE side WHEN 'before' THEN m.original_filed ELSE m.restated_filed END) END AS verdict
  FROM m, (VALUES ('before'), ('after')) t(side)
), b AS (SELECT match_id, max(verdict) FILTER (side = 'before') AS before, max(verdict) FILTER (side = 'after') AS after FROM s GROUP BY match_id),
outc AS (SELECT *, CASE WHEN before = 'consistent' AND after = 'inconsistent' THEN 'expected_flip' WHEN before = 'inconsistent' THEN 'already_inconsistent_at_original'
  WHEN before = 'consistent' AND after = 'consistent' THEN 'restatement_too_small_for_tolerance' ELSE 'other(' || before || '->' || after || ')' END AS outcome FROM b)"""


@query(f"WITH {_BACK} SELECT * FROM outc")
def q_backtest(spark, sf_dir):
    return restate.backtest(_matches(spark, sf_dir), facts(spark, sf_dir))


@query(f"WITH {_BACK} SELECT outcome, count(*) AS n FROM outc GROUP BY outcome")
def q_backtest_tally(spark, sf_dir):
    return runs.most_common(restate.backtest(_matches(spark, sf_dir), facts(spark, sf_dir)), "outcome")


# ---- scoring ----


def _examples(spark, sf_dir):
    """Golds are a year's extracted claims of a company; predictions are those with some values off or types changed."""
    x = build(spark, sf_dir, EXTRACTED)
    claim = lambda v, t: F.struct(F.concat("metric", F.lit(" "), F.split("claim_id", "/")[1]).alias("metric"), v.alias("value"), "value_unit", t.alias("comparison_type"))
    off = F.col("value") * F.when(F.col("claim_ord") == 2, 1.03).otherwise(1.005)
    kind = F.when(F.col("claim_ord") == 3, "absolute").otherwise(F.col("comparison_type"))
    item = lambda c: F.sort_array(F.collect_list(F.struct("claim_id", c.alias("c"))))
    got = x.groupBy(F.col("chunk_id").alias("id")).agg(item(claim(F.col("value"), F.col("comparison_type"))).alias("g"), item(claim(off, kind)).alias("p"))
    return got.select("id", F.transform("p", lambda r: r["c"]).alias("preds"), F.transform("g", lambda r: r["c"]).alias("golds"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(metric), '[a-z0-9]+'), lambda w: w NOT IN ('the', 'a', 'an', 'of', 'and', 'or', 'for', 'to', 'in', 'on')))"
# a walk over the golds in order: each takes the first prediction that matches it and is left
_WALK = f"""
RECURSIVE one AS (
  SELECT chunk_id AS id, metric || ' ' || string_split(claim_id, '/')[2] AS metric, value, value_unit, comparison_type, claim_ord, row_number() OVER (PARTITION BY chunk_id ORDER BY claim_id) AS k FROM {_X}
), gold AS (SELECT *, {_WORDS} AS w FROM one),
pred AS (
  SELECT * REPLACE (value * CASE WHEN claim_ord = 2 THEN 1.03 ELSE 1.005 END AS value, CASE WHEN claim_ord = 3 THEN 'absolute' ELSE comparison_type END AS comparison_type), {_WORDS} AS w FROM one
), able AS (
  SELECT g.id, g.k, list(p.k ORDER BY p.k) AS ps FROM gold g JOIN pred p ON g.id = p.id AND p.comparison_type = g.comparison_type AND p.value_unit = g.value_unit
    AND abs(p.value - g.value) <= greatest(0.05, abs(g.value) * 0.01)
    AND CASE WHEN len(p.w) = 0 OR len(g.w) = 0 THEN len(p.w) = len(g.w) ELSE len(list_intersect(p.w, g.w)) >= {tx.OVERLAP} * greatest(len(p.w), len(g.w)) END GROUP BY ALL
), walk AS (
  SELECT DISTINCT id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM gold
  UNION ALL
  SELECT id, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (
    SELECT w.id, g.k, w.used, list_filter(coalesce(a.ps, []), lambda x: NOT list_contains(w.used, x))[1] AS pick
    FROM walk w JOIN gold g ON g.id = w.id AND g.k = w.k + 1 LEFT JOIN able a ON a.id = g.id AND a.k = g.k)
), done AS (SELECT id, arg_max(used, k) AS used, max(k) AS n FROM walk GROUP BY id)"""


@query(f"WITH {_WALK} SELECT id, len(used) AS tp, n - len(used) AS fp, n - len(used) AS fn FROM done")
def q_claim_match_greedy(spark, sf_dir):
    m = scoring.match_greedy(_examples(spark, sf_dir))
    return m.select("id", F.size(F.filter("hits", lambda h: h)).alias("tp"), F.size("left").alias("fp"), F.size(F.filter("hits", lambda h: ~h)).alias("fn"))


@query("""
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn FROM labels)
SELECT tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r,
  2 * (CAST(tp AS DOUBLE) / (tp + fp)) * (CAST(tp AS DOUBLE) / (tp + fn)) / (CAST(tp AS DOUBLE) / (tp + fp) + CAST(tp AS DOUBLE) / (tp + fn)) AS f1 FROM c""")
def q_prf_micro(spark, sf_dir):
    c = table(spark, sf_dir, "labels").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("tp", "quality = 1 and toxic = 0"), ("fp", "quality = 0 and toxic = 0"), ("fn", "quality = 1 and toxic = 1"))])
    return c.select("tp", "fp", "fn", *scoring.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"""
WITH {_WALK}, c AS (
  SELECT comparison_type AS category, CAST(pick IS NOT NULL AS INT) AS tp, 0 AS fp, CAST(pick IS NULL AS INT) AS fn FROM walk JOIN gold USING (id, k)
  UNION ALL SELECT comparison_type, 0, 1, 0 FROM pred JOIN done USING (id) WHERE NOT list_contains(used, k)
), t AS (SELECT category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY category
), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM t)
SELECT category, tp, fp, fn, CAST(p AS DOUBLE) AS p, CAST(r AS DOUBLE) AS r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM r""")
def q_prf_by_category(spark, sf_dir):
    c = scoring.counts_by_type(scoring.match_greedy(_examples(spark, sf_dir)))
    return c.select("category", "tp", "fp", "fn", *scoring.prf(F.col("tp"), F.col("fp"), F.col("fn")))


_KEYWORDS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ('the', 'a', 'an', 'of', 'and', 'or', 'for', 'to', 'in', 'on')))"


@query(f"""
WITH i AS (SELECT item_id, {_KEYWORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_KEYWORDS} AS w FROM documents),
p AS (SELECT item_id, doc_id, CAST(len(list_intersect(i.w, d.w)) AS DOUBLE) / greatest(len(i.w), len(d.w)) AS overlap FROM i JOIN d ON least(len(i.w), len(d.w)) >= 0.5 * greatest(len(i.w), len(d.w)) WHERE len(i.w) > 0 AND len(d.w) > 0)
SELECT item_id, doc_id, overlap FROM p WHERE overlap >= 0.5""")
def q_keyword_overlap(spark, sf_dir):
    items, docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("b"), "text"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), "text")
    return scoring.overlapping(docs, items).select(F.col("b").alias("item_id"), F.col("a").alias("doc_id"), "overlap")


@query("SELECT lang, count(*) AS n, 1.96 * sqrt(avg(CAST(quality AS DOUBLE)) * (1 - avg(CAST(quality AS DOUBLE))) / count(*)) AS half_width FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def q_noise_floor(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.col("quality").cast("double")).alias("p"))
    return j.select("lang", "n", scoring.noise_floor(F.col("p"), F.col("n")).alias("half_width"))


@query("WITH c AS (SELECT avg(CAST(quality AS DOUBLE)) AS p, avg(CAST(toxic AS DOUBLE)) AS f FROM labels) SELECT p * 1.0 / (p * 1.0 + (1 - p) * f) AS ceiling FROM c")
def q_precision_ceiling(spark, sf_dir):
    c = table(spark, sf_dir, "labels").agg(F.avg(F.col("quality").cast("double")).alias("p"), F.avg(F.col("toxic").cast("double")).alias("f"))
    return c.select(scoring.precision_ceiling(F.col("p"), F.lit(1.0), F.col("f")).alias("ceiling"))


# ---- datasets ----


@query(f"SELECT ticker, concept, period_start, period_end, min_by(value, (filed, accession_number, fact_ord)) AS value, min(filed) AS filed FROM {_F} GROUP BY ALL")
def q_dedup_period(spark, sf_dir):
    return dataset.one_per_period(facts(spark, sf_dir)).select("ticker", "concept", "period_start", "period_end", "value", "filed")


@query(f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY ticker, concept ORDER BY period_end, fact_ord) AS rn, date_diff('day', CAST(period_start AS DATE), CAST(period_end AS DATE)) AS days FROM {_F} WHERE period_start IS NOT NULL)
SELECT a.ticker, a.concept, a.fact_ord AS cur_ord, arg_max(b.fact_ord, b.rn) AS pri_ord FROM f a JOIN f b ON a.ticker = b.ticker AND a.concept = b.concept AND b.rn < a.rn AND a.period_end <> b.period_end AND abs(a.days - b.days) <= 20 GROUP BY ALL""")
def q_adjacent_pairs(spark, sf_dir):
    return dataset.adjacent_pairs(facts(spark, sf_dir))


@query(f"""
WITH f AS (SELECT *, CASE WHEN coalesce(date_diff('day', CAST(period_start AS DATE), CAST(period_end AS DATE)), 0) <= 120 THEN 1 ELSE 0 END AS short FROM {_F}),
g AS (SELECT *, sum(short) OVER (PARTITION BY ticker, concept) AS ns, count(*) OVER (PARTITION BY ticker, concept) AS na FROM f),
k AS (SELECT ticker, concept, period_end, arg_max(value, fact_ord) AS value FROM g WHERE short = CASE WHEN ns >= na - ns THEN 1 ELSE 0 END GROUP BY ALL),
j AS (SELECT a.ticker, a.concept AS numerator, b.concept AS denominator, a.period_end, a.value AS num, b.value AS den FROM k a JOIN k b USING (ticker, period_end)
  WHERE a.concept IN ('GrossProfit', 'OperatingIncomeLoss', 'NetIncomeLoss') AND b.concept IN ('Revenues', 'RevenueFromContractWithCustomerExcludingAssessedTax')),
l AS (SELECT *, lag(period_end) OVER w AS prior_end, lag(num) OVER w AS prior_num, lag(den) OVER w AS prior_den FROM j WINDOW w AS (PARTITION BY ticker, numerator, denominator ORDER BY period_end))
SELECT ticker, numerator, denominator, period_end, prior_end, (num / den - prior_num / prior_den) * 10000 AS bps FROM l WHERE prior_end IS NOT NULL AND den <> 0 AND prior_den <> 0""")
def q_ratio_pairs(spark, sf_dir):
    p = dataset.ratio_pairs(facts(spark, sf_dir), list(dic.RATIO_NUMERATORS), list(dic.RATIO_DENOMINATORS))
    return p.select("ticker", "numerator", "denominator", "period_end", "prior_end", ((F.col("num") / F.col("den") - F.col("prior_num") / F.col("prior_den")) * 10000).alias("bps"))


@query("""
SELECT p_partkey, kind, CASE kind WHEN 'sign_flip' THEN CASE WHEN v = 0 THEN 1.0 ELSE -v END WHEN 'magnitude_1000x' THEN v * 1000 WHEN 'magnitude_0001x' THEN v * 0.001
  WHEN 'near_miss' THEN v + CASE WHEN t = 'growth_pct' THEN 1.0 ELSE CASE WHEN v = 0 THEN 1.0 ELSE abs(v) END * 0.01 END * 1.5 ELSE v + CASE WHEN t = 'growth_pct' THEN 1.0 ELSE CASE WHEN v = 0 THEN 1.0 ELSE abs(v) END * 0.01 END * 6 END AS value
FROM (SELECT p_partkey, p_retailprice AS v, CASE WHEN p_size % 2 = 0 THEN 'growth_pct' ELSE 'absolute' END AS t FROM part), (VALUES ('sign_flip'), ('magnitude_1000x'), ('magnitude_0001x'), ('near_miss'), ('large_miss')) k(kind)""")
def q_perturb(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("v"), F.when(F.col("p_size") % 2 == 0, "growth_pct").otherwise("absolute").alias("t"), F.explode(F.array(*[F.lit(k) for k in dataset.PERTURBATIONS])).alias("kind"))
    return p.select("p_partkey", "kind", dataset.perturb(F.col("kind"), F.col("t"), F.col("v"), F.when(F.col("t") == "growth_pct", 1.0).otherwise(0.01)).alias("value"))


@query("SELECT doc_id, CAST(list_sum(list_transform(string_split(md5(CAST(doc_id AS VARCHAR)), ''), lambda x: strpos('0123456789abcdef', x) - 1)) % 5 AS BIGINT) AS bucket FROM documents")
def q_md5_split(spark, sf_dir):
    # 16 mod 5 is 1, so the digits' sum gives the same bucket of five: the oracle uses that, the operator folds for any n
    return table(spark, sf_dir, "documents").select("doc_id", tx.md5_bucket(F.col("doc_id").cast("string"), 5).alias("bucket"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM documents")
def q_index_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("part"))


_PERTURBED = """CASE k WHEN '' THEN truth WHEN 'sign_flip' THEN CASE WHEN truth = 0 THEN sc ELSE -truth END WHEN 'magnitude_1000x' THEN truth * 1000 WHEN 'magnitude_0001x' THEN truth * 0.001
  ELSE truth + CASE WHEN kind IN ('growth_pct', 'bps_change') THEN tol ELSE sc * tol END * CASE k WHEN 'near_miss' THEN 1.5 ELSE 6 END END"""


@query(f"""
WITH one AS (SELECT *, date_diff('day', CAST(period_start AS DATE), CAST(period_end AS DATE)) AS days FROM {_F} QUALIFY row_number() OVER (PARTITION BY ticker, concept, period_start, period_end ORDER BY filed, accession_number, fact_ord) = 1),
few AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY ticker, concept ORDER BY md5('2026' || fact_ord), fact_ord) <= 6),
f AS (SELECT *, row_number() OVER (PARTITION BY ticker, concept ORDER BY period_end, fact_ord) AS rn FROM one WHERE days IS NOT NULL),
adj AS (SELECT a.ticker, a.concept, a.fact_ord AS cur_ord, arg_max(b.fact_ord, b.rn) AS pri_ord FROM f a JOIN f b ON a.ticker = b.ticker AND a.concept = b.concept AND b.rn < a.rn AND a.period_end <> b.period_end AND abs(a.days - b.days) <= 20 GROUP BY ALL),
drawn AS (SELECT * FROM adj QUALIFY row_number() OVER (PARTITION BY ticker, concept ORDER BY md5('2026' || cur_ord), cur_ord) <= 3),
pr AS (SELECT d.ticker, d.concept, d.cur_ord, c.value AS c, p.value AS p FROM drawn d JOIN one c ON c.ticker = d.ticker AND c.fact_ord = d.cur_ord JOIN one p ON p.ticker = d.ticker AND p.fact_ord = d.pri_ord WHERE p.value <> 0),
h AS (SELECT *, CASE WHEN coalesce(days, 0) <= 120 THEN 1 ELSE 0 END AS short FROM one), hh AS (SELECT *, sum(short) OVER (PARTITION BY ticker, concept) AS ns, count(*) OVER (PARTITION BY ticker, concept) AS na FROM h),
k AS (SELECT ticker, concept, period_end, arg_max(struct_pack(v := value, s := period_start), fact_ord) AS x FROM hh WHERE short = CASE WHEN ns >= na - ns THEN 1 ELSE 0 END GROUP BY ALL),
j AS (SELECT a.ticker, a.concept AS numerator, b.concept AS denominator, a.period_end, a.x.v AS num, b.x.v AS den, a.x.s IS NULL OR a.x.s IS NOT DISTINCT FROM b.x.s AS ok FROM k a JOIN k b USING (ticker, period_end)
  WHERE a.concept IN ('GrossProfit', 'OperatingIncomeLoss', 'NetIncomeLoss') AND b.concept IN ('Revenues', 'RevenueFromContractWithCustomerExcludingAssessedTax')),
l AS (SELECT *, lag(num) OVER w AS pnum, lag(den) OVER w AS pden, lag(ok) OVER w AS pok FROM j WINDOW w AS (PARTITION BY ticker, numerator, denominator ORDER BY period_end)),
m AS (SELECT *, denominator || '-' || period_end AS akey FROM l WHERE pnum IS NOT NULL AND den <> 0 AND pden <> 0),
mm AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY ticker, numerator, denominator ORDER BY md5('2026' || akey), akey) <= 3),
base AS (
  SELECT concat_ws('-', 'abs', ticker, concept, fact_ord) AS id, 'absolute' AS kind, value AS truth, NULL AS scale, value AS c, NULL AS dc, NULL AS p, NULL AS dp, true AS ok, 0.01 AS tol FROM few
  UNION ALL SELECT concat_ws('-', 'gpct', ticker, concept, cur_ord), 'growth_pct', (c - p) / abs(p) * 100, NULL, c, NULL, p, NULL, true, 1.0 FROM pr
  UNION ALL SELECT concat_ws('-', 'achg', ticker, concept, cur_ord), 'absolute_change', c - p, CASE WHEN greatest(abs(c), abs(p)) = 0 THEN 1.0 ELSE greatest(abs(c), abs(p)) END, c, NULL, p, NULL, true, 0.01 FROM pr
  UNION ALL SELECT concat_ws('-', 'bps', ticker, numerator, akey), 'bps_change', (num / den - pnum / pden) * 10000, NULL, num, den, pnum, pden, ok AND pok, 50.0 FROM mm),
b2 AS (SELECT *, coalesce(scale, CASE WHEN truth = 0 THEN 1.0 ELSE abs(truth) END) AS sc FROM base),
kinds AS (SELECT id, k FROM base, (VALUES ('sign_flip'), ('magnitude_1000x'), ('magnitude_0001x'), ('near_miss'), ('large_miss')) t(k) QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5('2026' || id || k), k) <= 2 UNION ALL SELECT id, '' FROM base),
ex AS (
  SELECT CASE WHEN k = '' THEN id ELSE id || '-' || k END AS id, kind, k AS note, CASE WHEN k = '' THEN 'real' ELSE 'perturbed' END AS source, {_PERTURBED} AS claimed, c, dc, p, dp, ok, tol FROM b2 JOIN kinds USING (id)
  UNION ALL SELECT id || '-comparison_withheld', kind, 'comparison withheld', 'synthetic', truth, c, dc, NULL, dp, false, tol FROM b2 WHERE kind = 'growth_pct'
  UNION ALL SELECT id || '-zero_denominator', kind, 'zero denominator', 'synthetic', truth, c, 0.0, p, dp, ok, tol FROM b2 WHERE kind = 'bps_change'),
co AS (SELECT *, CASE WHEN NOT ok THEN 'missing_fact' WHEN kind = 'bps_change' AND dc = 0 THEN 'zero_denominator' END AS problem FROM ex),
cc AS (SELECT *, CASE WHEN problem IS NULL THEN CASE kind WHEN 'absolute' THEN c WHEN 'growth_pct' THEN (c - p) / abs(p) * 100 WHEN 'absolute_change' THEN c - p ELSE (c / dc - p / dp) * 10000 END END AS computed FROM co),
dd AS (SELECT *, abs(computed - claimed) / CASE kind WHEN 'absolute' THEN CASE WHEN c = 0 THEN 1.0 ELSE abs(c) END WHEN 'absolute_change' THEN CASE WHEN greatest(abs(c), abs(p)) = 0 THEN 1.0 ELSE greatest(abs(c), abs(p)) END ELSE 1.0 END AS d FROM cc)
SELECT id, kind AS comparison_type, source, note, claimed AS claimed_value, CASE WHEN problem IS NOT NULL THEN 'unverifiable' WHEN d <= tol THEN 'consistent' ELSE 'inconsistent' END AS gold_verdict,
  coalesce(problem, CASE WHEN d <= tol THEN 'match' WHEN d <= 2 * tol THEN 'near_miss' ELSE 'large_miss' END) AS gold_reason_code, computed AS gold_computed_value,
  CASE WHEN list_sum(list_transform(string_split(md5(id), ''), lambda x: strpos('0123456789abcdef', x) - 1)) % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM dd""")
def q_examples(spark, sf_dir):
    return _built(spark, sf_dir).select("id", "comparison_type", "source", "note", "claimed_value", "gold_verdict", "gold_reason_code", "gold_computed_value", "part")


def _built(spark, sf_dir):
    return dataset.build_examples(cut(facts(spark, sf_dir), "facts"), list(dic.RATIO_NUMERATORS), list(dic.RATIO_DENOMINATORS))


@query()
def q_prompts(spark, sf_dir):
    return _built(spark, sf_dir).select("id", render.prompt().alias("prompt"))


_N = "format('{{:,.0f}}', {})".format
_GAP = "'; gap ' || printf('%.2f%%', d * 100)"


@query(f"""
WITH {_RECON}, say AS (SELECT f.verdict, f.reason_code, x.* FROM diff x JOIN final f USING (claim_id))
SELECT claim_id, verdict, CASE WHEN verdict = 'unverifiable' THEN metric || ': not verifiable, ' || replace(reason_code, '_', ' ') ELSE CASE comparison_type
  WHEN 'absolute' THEN metric || ': stated ' || {_N("claimed_value")} || '; reported data give ' || {_N("computed")} || ' at ' || period_end || {_GAP}
  WHEN 'growth_pct' THEN metric || ' growth: stated ' || printf('%.2f%%', claimed_value) || '; reported data give ' || printf('%.2f%%', computed) || ' (' || {_N("pri_v")} || ' -> ' || {_N("cur_v")} || ')' || '; gap ' || printf('%.2f points', d)
  WHEN 'absolute_change' THEN metric || ' change: stated ' || {_N("claimed_value")} || '; reported data give ' || {_N("computed")} || ' (' || {_N("pri_v")} || ' -> ' || {_N("cur_v")} || ')' || {_GAP}
  ELSE metric || '/' || denominator_metric || ': stated ' || printf('%.1f bps', claimed_value) || '; reported data give ' || printf('%.1f bps (', computed) || printf('%.4f%%', pri_v / den_pri_v * 100) || ' -> ' || printf('%.4f%%', cur_v / den_cur_v * 100) || ')' || '; gap ' || printf('%.1f bps', d)
END END AS explanation FROM say""")
def q_explanations(spark, sf_dir):
    return tools.explained(claims(spark, sf_dir), facts(spark, sf_dir)).select("claim_id", "verdict", "explanation")


# ---- audits ----

# The audit's figures for two years of one company, and its cases (metric, type, claimed value, expected verdict, demonstration).
_REPORTED = {"Revenues": (383285e6, 394328e6), "GrossProfit": (169148e6, 170782e6), "EffectiveIncomeTaxRateContinuingOperations": (0.147, None)}
_CASES = [
    ("Revenues", "absolute", 383285e6, "consistent", False), ("Revenues", "growth_pct", -2.8, "consistent", False), ("GrossProfit", "bps_change", 82.0, "consistent", False),
    ("Revenues", "absolute_change", -11043e6, "consistent", False), ("Revenues", "absolute", 500000e6, "inconsistent", False), ("Revenues", "growth_pct", 12.0, "inconsistent", False),
    ("Revenues", "growth_pct", 2.8, "inconsistent", False), ("GrossProfit", "bps_change", -82.0, "inconsistent", False), ("Revenues", "absolute_change", 11043e6, "inconsistent", False),
    ("Revenues", "absolute", 383285.0, "inconsistent", False), ("Revenues", "absolute", -2.8, "inconsistent", False), ("Revenues", "absolute", 383285e6 * 1.01, "consistent", False),
    ("Revenues", "absolute", 383285e6 * 1.0101, "inconsistent", False), ("EffectiveIncomeTaxRateContinuingOperations", "absolute", 0.147, "consistent", False), ("Revenues", "absolute", 383285e6, "inconsistent", True),
]
_RESTATED = 390000e6


@query(f"""
WITH c AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{k}', CAST({v!r} AS DOUBLE), '{e}', {d})" for m, k, v, e, d in _CASES)}) t(metric, kind, v, expected_verdict, demo)),
r AS (SELECT * FROM (VALUES {", ".join(f"('{m}', CAST({c!r} AS DOUBLE), CAST({'NULL' if p is None else repr(p)} AS DOUBLE))" for m, (c, p) in _REPORTED.items())}) t(metric, cur, pri)),
x AS (SELECT c.*, CASE WHEN demo THEN {_RESTATED!r} ELSE r.cur END AS cur, r.pri, d.cur AS dc, d.pri AS dp FROM c JOIN r USING (metric) CROSS JOIN (SELECT * FROM r WHERE metric = 'Revenues') d CROSS JOIN nation),
s AS (SELECT *, CASE WHEN CASE kind WHEN 'absolute' THEN abs(cur - v) / abs(cur) <= 0.01 WHEN 'growth_pct' THEN abs((cur - pri) / abs(pri) * 100 - v) <= 1 WHEN 'absolute_change' THEN abs(cur - pri - v) / greatest(abs(cur), abs(pri)) <= 0.01 ELSE abs((cur / dc - pri / dp) * 10000 - v) <= 50 END THEN 'consistent' ELSE 'inconsistent' END AS verdict FROM x),
n AS (SELECT count(*) AS cases, count(*) FILTER (verdict = expected_verdict) AS matched, count(*) FILTER (NOT demo AND expected_verdict = 'consistent') AS n_good, count(*) FILTER (NOT demo AND expected_verdict = 'consistent' AND verdict = 'consistent') AS accepted,
  count(*) FILTER (NOT demo AND expected_verdict <> 'consistent') AS n_bad, count(*) FILTER (NOT demo AND expected_verdict <> 'consistent' AND verdict = 'consistent') AS falsely_accepted FROM s)
SELECT *, CAST(accepted AS DOUBLE) / n_good AS recall, CAST(falsely_accepted AS DOUBLE) / n_bad AS false_positive_rate, CASE WHEN falsely_accepted = 0 THEN CAST(3.0 AS DOUBLE) / n_bad END AS false_positive_bound FROM n""")
def q_audit(spark, sf_dir):
    """The fixed cases for every company of the given tables, their dollar figures scaled by a power of two (so that no quotient changes)."""
    now, before = ("2022-09-25", "2023-09-30", "2023-11-03", "n"), ("2021-09-26", "2022-09-24", "2022-10-28", "b")
    rows = [(m, v, *when, "10-K") for m, values in _REPORTED.items() for v, when in zip(values, (now, before)) if v is not None]
    rows.append(("Revenues", _RESTATED, now[0], now[1], "2024-03-01", "r", "10-K/A"))
    as_struct = lambda names, row: F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip(names, row)])
    text, number = (lambda *names: [(n, "string") for n in names]), (lambda *names: [(n, "double") for n in names])
    fact = [*text("concept"), *number("value"), *text("period_start", "period_end", "filed", "accession_number", "form"), ("fact_ord", "long")]
    case = [*text("claim", "metric", "comparison_type"), *number("claimed_value"), *text("comparison_period_end", "comparison_period_start", "denominator_metric", "as_of", "expected_verdict"), ("demo", "boolean")]
    asked = []
    for i, (metric, kind, value, expected, demo) in enumerate(_CASES):
        two = kind != "absolute"
        asked.append((str(i), metric, kind, value, before[1] if two else None, before[0] if two else None, "Revenues" if kind == "bps_change" else None, None if demo else "2023-12-31", expected, demo))
    company = table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker"), F.pow(F.lit(2.0), F.col("n_nationkey") % 8).alias("scale"))
    unit = lambda metric: F.when(metric.startswith("Effective"), "pure").otherwise("USD")
    dollars = lambda value, metric: F.when(metric.startswith("Effective"), value).otherwise(value * F.col("scale"))
    f = company.select("ticker", "scale", F.explode(F.array(*[as_struct(fact, (*r, n)) for n, r in enumerate(rows)])).alias("f"))
    f = f.select("ticker", "f.*", "scale", unit(F.col("f.concept")).alias("unit")).withColumn("value", dollars(F.col("value"), F.col("concept")))
    c = company.select("ticker", "scale", F.explode(F.array(*[as_struct(case, r) for r in asked])).alias("c")).select("ticker", "scale", "c.*")
    stated = F.when(F.col("comparison_type").isin("absolute", "absolute_change"), dollars(F.col("claimed_value"), F.col("metric"))).otherwise(F.col("claimed_value"))
    c = c.withColumns({"claim_id": F.concat_ws("/", "ticker", "claim"), "claimed_value": stated, "unit": unit(F.col("metric")), "period_end": F.lit(now[1]), "period_start": F.lit(now[0]), "tolerance": F.lit(None).cast("double")})
    return audit.audit(reconcile.reconcile(c, f))


@query("SELECT doc_id AS accession, CAST(doc_id % 7 AS INT) AS chunk_index, coalesce(strpos(replace(text, chr(160), ' '), CASE WHEN doc_id % 3 = 0 THEN 'no such quote 123' ELSE substr(replace(text, chr(160), ' '), 5, 20) END) > 0, false) AS found FROM documents")
def q_quote_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("accession"), (F.col("doc_id") % 7).cast("int").alias("chunk_index"), "text")
    quote = F.when(F.col("accession") % 3 == 0, "no such quote 123").otherwise(F.substring("text", 5, 20))
    return audit.check_quotes(d.select("accession", "chunk_index", quote.alias("quote")), d).select("accession", "chunk_index", "found")


@query(f"SELECT count(*) AS n, count(*) FILTER (agent = 'error') AS error, count(*) FILTER (agent = 'click') AS click, count(*) FILTER (agent = 'timeout') AS timeout FROM {_E}")
def q_status_counts(spark, sf_dir):
    return audit.status_counts(build(spark, sf_dir, EVENTS), ["error", "click", "timeout"], "agent")


_PRF = "CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r"


@query(f"""
WITH {_WALK}, t AS (
  SELECT 'noisy' AS extractor, sum(len(used)) AS tp, sum(n - len(used)) AS fp, sum(n - len(used)) AS fn, 0 AS failed FROM done
  UNION ALL SELECT 'perfect', sum(n), 0, 0, 0 FROM done UNION ALL SELECT 'failing', 0, 0, sum(n), count(*) FROM done
), q AS (SELECT *, {_PRF} FROM t), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM q)
SELECT extractor, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(failed AS BIGINT) AS failed, CAST(p AS DOUBLE) AS p, CAST(r AS DOUBLE) AS r, f1, 1.96 * sqrt(f1 * (1 - f1) / (tp + fp + fn)) AS half_width FROM f""")
def q_score_extractors(spark, sf_dir):
    e = _examples(spark, sf_dir)
    none = F.lit(None).cast(e.schema["preds"].dataType)
    perfect = e.select("id", F.lit("perfect").alias("extractor"), F.col("golds").alias("preds"), "golds")
    failing = e.select("id", F.lit("failing").alias("extractor"), none.alias("preds"), "golds")
    return audit.score_runs(e.select("id", F.lit("noisy").alias("extractor"), "preds", "golds").unionByName(perfect).unionByName(failing))


# ties of the sixth digit go up, which a nudge of the value makes printf do
_SHOWN = "comparison_type || ' ''' || metric || '''' || ' ~' || printf('%g', value * (1 + 1e-12)) || CASE value_unit WHEN 'USD' THEN '' WHEN 'percent' THEN '%' ELSE ' ' || value_unit END"


@query(f"""
WITH {_WALK}, m AS (SELECT g.id, string_agg({_SHOWN.replace("comparison_type", "g.comparison_type")}, '; ' ORDER BY g.k) AS t FROM gold g JOIN walk w ON w.id = g.id AND w.k = g.k WHERE w.pick IS NULL GROUP BY g.id),
x AS (SELECT p.id, string_agg({_SHOWN}, '; ' ORDER BY p.k) AS t FROM pred p JOIN done d ON d.id = p.id WHERE NOT list_contains(d.used, p.k) GROUP BY p.id)
SELECT d.id, concat_ws('. ', len(d.used) || '/' || d.n || ' claims found', 'missed: ' || m.t, 'extra: ' || x.t, CASE WHEN m.t IS NULL AND x.t IS NULL THEN 'nothing missed, nothing extra' END) AS feedback
FROM done d LEFT JOIN m ON m.id = d.id LEFT JOIN x ON x.id = d.id""")
def q_feedback(spark, sf_dir):
    return scoring.match_greedy(_examples(spark, sf_dir)).select("id", render.feedback().alias("feedback"))


@query(f"SELECT count(DISTINCT chunk_id) AS records, count(*) AS claims, CAST(0 AS BIGINT) AS negatives, count(DISTINCT chunk_id) FILTER (metric IS NULL OR value IS NULL OR value_unit IS NULL OR comparison_type IS NULL) AS invalid FROM {_X}")
def q_validate_labels(spark, sf_dir):
    return audit.validate_labels(_examples(spark, sf_dir).select(F.col("golds").alias("claims")))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, CASE l_partkey % 3 WHEN 0 THEN 'consistent' WHEN 1 THEN 'inconsistent' ELSE 'unparseable:maybe' END AS before, CASE l_suppkey % 2 WHEN 0 THEN 'consistent' ELSE 'inconsistent' END AS after, l_partkey % 3 = 0 AND l_suppkey % 2 = 1 AS flips FROM lineitem")
def q_judge_outcomes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    before = F.when(F.col("l_partkey") % 3 == 0, " Consistent").when(F.col("l_partkey") % 3 == 1, "INCONSISTENT\n").otherwise("Maybe ")
    after = F.when(F.col("l_suppkey") % 2 == 0, "consistent").otherwise(" inconsistent ")
    return audit.judge_outcomes(li.select("l_orderkey", "l_linenumber", "l_shipdate", before.alias("before"), after.alias("after")))


@query(f"""
WITH {_MATCH}, g AS (
  SELECT m.match_id, count(f.fact_ord) AS n, arg_min(f.value, f.fact_ord) AS first_value FROM m LEFT JOIN fx f ON f.ticker = m.ticker AND f.concept = m.concept AND f.period_start IS NOT DISTINCT FROM m.period_start AND f.period_end = m.period_end GROUP BY m.match_id)
SELECT m.match_id, CAST(g.n AS INT) AS n, g.first_value FROM m JOIN g ON m.match_id = g.match_id""")
def q_judge_inputs(spark, sf_dir):
    m = audit.judge_inputs(_matches(spark, sf_dir), facts(spark, sf_dir))
    return m.select("match_id", F.size("evidence").alias("n"), F.element_at("evidence", 1)["value"].alias("first_value"))


# ---- rewards and evaluation ----

_COMPL = """(SELECT l_orderkey, l_linenumber, l_shipdate, CASE l_linenumber % 4 WHEN 0 THEN 'absolute' WHEN 1 THEN 'growth_pct' WHEN 2 THEN 'absolute_change' ELSE 'bps_change' END AS comparison_type,
  CASE l_returnflag WHEN 'A' THEN 'consistent' WHEN 'N' THEN 'inconsistent' ELSE 'unverifiable' END AS gold_verdict,
  CASE l_returnflag WHEN 'A' THEN 'match' WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'near_miss' ELSE 'large_miss' END ELSE 'missing_fact' END AS gold_reason,
  concat('First I thought verdict: Consistent. ', CASE l_partkey % 4 WHEN 0 THEN 'VERDICT:  consistent' WHEN 1 THEN 'so Verdict: INCONSISTENT!' WHEN 2 THEN 'VERDICT: unverifiable' ELSE 'no more' END) AS c1, l_partkey % 7 AS m FROM {lineitem})"""
_ROWS = _COMPL.replace("{lineitem}", "lineitem")
_SAID = f"(SELECT *, CASE WHEN m = 0 THEN NULL ELSE list_last(regexp_extract_all(lower(c1), 'verdict:\\s*(consistent|inconsistent|unverifiable)', 1)) END AS said FROM {_ROWS} t)"
_REWARD = "CASE WHEN said IS NULL THEN -2.0 ELSE CASE WHEN said = gold_verdict THEN 1.0 ELSE CASE gold_reason WHEN 'near_miss' THEN 0.3 WHEN 'missing_fact' THEN 0.1 ELSE 0.0 END END - CASE WHEN said = 'consistent' AND gold_verdict <> 'consistent' THEN 1.0 ELSE 0.0 END END"


def _completions(spark, sf_dir):
    rows = spark.sql("SELECT * FROM " + _COMPL, lineitem=table(spark, sf_dir, "lineitem"))
    return rows.withColumn("completion", F.when(F.col("m") == 0, "no verdict line").otherwise(F.col("c1")))


@query(f"SELECT l_orderkey, l_linenumber, l_shipdate, said, CAST({_REWARD} AS DOUBLE) AS reward FROM {_SAID} s")
def q_reward(spark, sf_dir):
    c = _completions(spark, sf_dir)
    return c.select("l_orderkey", "l_linenumber", "l_shipdate", tx.parse_verdict(F.col("completion")).alias("said"), scoring.reward(F.col("completion"), F.col("gold_verdict"), F.col("gold_reason")).alias("reward"))


@query(f"""SELECT comparison_type, count(*) AS n, CAST(sum(CASE WHEN said = gold_verdict THEN 1 ELSE 0 END) AS BIGINT) AS n_right, CAST(sum(CAST(round(CAST({_REWARD} AS DOUBLE) * 10) AS BIGINT)) AS DOUBLE) / count(*) / 10 AS mean_reward,
  CAST(sum(CASE WHEN said = 'consistent' AND gold_verdict <> 'consistent' THEN 1 ELSE 0 END) AS BIGINT) AS false_consistent, count(*) FILTER (said IS NULL) AS format_failures, CAST(grouping(comparison_type) AS INT) AS total FROM {_SAID} s GROUP BY ROLLUP (comparison_type)""")
def q_eval_stratified(spark, sf_dir):
    return scoring.evaluate(_completions(spark, sf_dir))


# ---- runs ----


@query(f"SELECT run, count(*) AS steps, count(*) FILTER (kind = 'tool') AS tool_calls, count(*) FILTER (kind = 'error') AS errors, count(DISTINCT agent) AS agents, arg_min(elapsed, step) AS first_elapsed, arg_max(elapsed, step) AS last_elapsed FROM {_E} GROUP BY run")
def q_trace_summary(spark, sf_dir):
    return runs.trace_summary(build(spark, sf_dir, EVENTS))


_RUNS = f"""(
  SELECT run, count(*) FILTER (kind = 'error') < 20 AS ok, count(*) > 70 AS partial,
    count(*) FILTER (agent = 'view') AS consistent, count(*) FILTER (agent = 'signup') AS inconsistent, count(*) FILTER (agent = 'purchase') AS unverifiable,
    count(*) FILTER (kind = 'tool') AS tool_calls, count(*) FILTER (kind = 'decision') AS steps, max(elapsed) AS elapsed
  FROM {_E} GROUP BY run)"""


def _batch(spark, sf_dir):
    counts = [F.count_if(F.col("agent") == a).alias(n) for a, n in (("view", "consistent"), ("signup", "inconsistent"), ("purchase", "unverifiable"))]
    calls, steps = F.count_if(F.col("kind") == "tool").alias("tool_calls"), F.count_if(F.col("kind") == "decision").alias("steps")
    flags = (F.count_if(F.col("kind") == "error") < 20).alias("ok"), (F.count("*") > 70).alias("partial")
    return build(spark, sf_dir, EVENTS).groupBy("run").agg(*flags, *counts, calls, steps, F.max("elapsed").alias("elapsed"))


@query(f"""
WITH good AS (
  SELECT coalesce(sum(consistent), 0) AS consistent, coalesce(sum(inconsistent), 0) AS inconsistent, coalesce(sum(unverifiable), 0) AS unverifiable,
    coalesce(sum(tool_calls), 0) AS tool_calls, coalesce(sum(steps), 0) AS steps, count(*) AS ok, count(*) FILTER (partial) AS partial FROM {_RUNS} WHERE ok
), every AS (SELECT count(*) AS runs, sum(elapsed) AS elapsed FROM {_RUNS})
SELECT runs, ok, runs - ok AS failed, partial, CAST(consistent AS BIGINT) AS consistent, CAST(inconsistent AS BIGINT) AS inconsistent, CAST(unverifiable AS BIGINT) AS unverifiable,
  CAST(tool_calls AS BIGINT) AS tool_calls, CAST(steps AS BIGINT) AS steps, elapsed, CAST(consistent + inconsistent + unverifiable AS BIGINT) AS claims,
  CASE WHEN consistent + inconsistent > 0 THEN CAST(inconsistent AS DOUBLE) / (consistent + inconsistent) END AS inconsistent_rate FROM good, every""")
def q_batch_rollup(spark, sf_dir):
    return runs.batch_rollup(_batch(spark, sf_dir))


@query(f"SELECT string_agg(run, ',' ORDER BY run) FILTER (NOT ok) AS failed, string_agg(run, ',' ORDER BY run) FILTER (ok AND partial) AS partial FROM {_RUNS}")
def q_batch_lists(spark, sf_dir):
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return runs.batch_lists(_batch(spark, sf_dir)).select(joined("failed"), joined("partial"))


@query(f"SELECT run, agent, count(*) AS n FROM {_E} WHERE kind = 'tool' GROUP BY ALL")
def q_agent_calls(spark, sf_dir):
    return runs.calls_by_agent(build(spark, sf_dir, EVENTS))


@query(f"SELECT gold_verdict, gold_reason_code, count(*) AS n FROM ({ORACLES['q_examples']}) GROUP BY ALL")
def q_label_counts(spark, sf_dir):
    return dataset.label_counts(QUERIES["q_examples"](spark, sf_dir))


@query(rf"SELECT doc_id, pos FROM (SELECT doc_id, CAST(pos AS INT) AS pos, length(text) AS n FROM {_LINES}) WHERE n > 400 ORDER BY doc_id, pos LIMIT 15")
def q_long_texts(spark, sf_dir):
    return filings.long_texts(_lines(spark, sf_dir), ["doc_id", "pos"]).select("doc_id", "pos")


@query(f"""
WITH b AS (SELECT run, step, kind, count(*) FILTER (kind <> 'error') OVER w AS done, count(*) OVER w AS calls, coalesce(max(elapsed) OVER w, 0) AS spent FROM {_E} WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN done >= 25 THEN 'chunks' WHEN calls >= 28 THEN 'calls' WHEN spent >= 39 THEN 'seconds' END AS why FROM b), s AS (SELECT run, min(step) AS stop, arg_min(why, step) AS reason FROM r WHERE why IS NOT NULL GROUP BY run)
SELECT r.run, r.step, coalesce(r.step < stop, true) AS processed, CASE WHEN r.step >= stop THEN s.reason END AS reason FROM r LEFT JOIN s ON r.run = s.run""")
def q_budget_cut(spark, sf_dir):
    e = build(spark, sf_dir, EVENTS).select("run", F.col("step").alias("ord"), (F.col("kind") == "error").alias("failed"), "elapsed")
    return runs.within_budget(e, 25, 28, 39.0).select("run", F.col("ord").alias("step"), "processed", "reason")


def _planned(spark, sf_dir):
    x = build(spark, sf_dir, EXTRACTED).withColumnsRenamed({"chunk_id": "accession"}).withColumn("chunk_index", F.col("claim_ord"))
    chunks = x.select(F.col("ticker").alias("run"), "accession", "chunk_index").distinct()
    chunks = chunks.withColumns({"failed": F.col("chunk_index") == 3, "elapsed": F.lit(0.0)})
    return coordinator.plan(chunks, max_chunks=12), x


@query(f"""
WITH c AS (SELECT DISTINCT ticker AS run, chunk_id AS accession, claim_ord AS chunk_index FROM {_X}),
o AS (SELECT *, count(*) FILTER (chunk_index <> 3) OVER (PARTITION BY run ORDER BY accession, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM c)
SELECT run, accession, chunk_index, CASE WHEN chunk_index = 3 THEN 'failed' ELSE 'done' END AS status FROM o WHERE coalesce(done, 0) < 12""")
def q_run_state(spark, sf_dir):
    return coordinator.state_of(_planned(spark, sf_dir)[0])


@query(f"""
WITH c AS (SELECT DISTINCT ticker AS run, chunk_id AS accession, claim_ord AS chunk_index FROM {_X}),
o AS (SELECT *, row_number() OVER w AS ord, coalesce(count(*) FILTER (chunk_index <> 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 12 AS processed FROM c WINDOW w AS (PARTITION BY run ORDER BY accession, chunk_index)),
v AS ({ORACLES["q_verify_pipeline"]}), e AS (
  SELECT run, ord, 0 AS claim, '' AS claim_id, 0 AS k, 'tool_call' AS kind, 'extraction' AS agent, 'extract' AS action, 'chunk ' || chunk_index AS detail FROM o WHERE processed
  UNION ALL SELECT run, ord, 0, '', 1, 'decision', 'coordinator', 'extraction_failed', 'chunk ' || chunk_index FROM o WHERE processed AND chunk_index = 3
  UNION ALL SELECT run, ord, 1, claim_id, 0, 'tool_call', 'verification', 'verify', metric || '=' || printf('%.2f', value) || value_unit FROM o JOIN {_X} x ON x.chunk_id = accession AND x.claim_ord = chunk_index WHERE processed AND chunk_index <> 3
  UNION ALL SELECT run, ord, 1, claim_id, 1, 'decision', 'coordinator', 'claim_verdict', metric || ' -> ' || verdict FROM o JOIN {_X} x ON x.chunk_id = accession AND x.claim_ord = chunk_index JOIN v USING (claim_id) WHERE processed AND chunk_index <> 3
  UNION ALL SELECT run, min(ord), 0, '', 0, 'decision', 'coordinator', 'budget_exceeded', 'chunks' FROM o WHERE NOT processed GROUP BY run
)
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY ord, claim, claim_id, k) AS INT) AS step, kind, agent, action, detail FROM e""")
def q_run_trace(spark, sf_dir):
    planned, x = _planned(spark, sf_dir)
    judged = cut(coordinator.verdicts(planned, x, cut(facts(spark, sf_dir), "facts"), dic.metrics(spark), dic.ratios(spark)), "judged")
    return coordinator.trace(planned, x, judged)


@query("SELECT l_orderkey AS accession, l_linenumber AS chunk_index, l_shipdate FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber AND s.l_returnflag = 'A')")
def q_resume_antijoin(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("chunk_index"), "l_shipdate", F.when(F.col("l_returnflag") == "A", "done").otherwise("failed").alias("status"))
    return runs.pending(li.drop("status"), li.select("accession", "chunk_index", "status"))


@query(f"SELECT trim(lower(metric)) AS metric, count(*) AS n FROM {_X} WHERE trim(lower(metric)) NOT IN (SELECT metric_key FROM {_DICT}) GROUP BY 1 ORDER BY n DESC, metric LIMIT 40")
def q_unresolved_topk(spark, sf_dir):
    x = build(spark, sf_dir, EXTRACTED).withColumn("metric", tx.metric_key(F.col("metric")))
    return runs.most_common(x.join(F.broadcast(dic.metrics(spark)), F.col("metric") == F.col("metric_key"), "left_anti"), "metric", 40)


@query("""
WITH m AS (SELECT avg(l_quantity) AS tin, avg(l_tax) AS tout, count(*) AS calls, count(DISTINCT l_suppkey) AS filings FROM lineitem), c AS (SELECT *, tin / 1e6 * 0.03 + tout / 1e6 * 0.13 AS per_call FROM m)
SELECT round(per_call, 14) AS per_call, round(per_call * calls / filings, 10) AS per_filing, round(per_call * calls / filings * 500, 7) AS per_batch FROM c""")
def q_cost_model(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("prompt_tokens"), F.col("l_tax").alias("completion_tokens"), F.col("l_suppkey").alias("company"))
    return runs.cost_model(li).select(F.round("per_call", 14).alias("per_call"), F.round("per_filing", 10).alias("per_filing"), F.round("per_batch", 7).alias("per_batch"))
