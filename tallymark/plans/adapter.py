"""Facts, claims and run events made from the TPC-H-like tables, in SQL that Spark and DuckDB both accept.

{orders} and the like stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

_BASE = """
base AS (
  SELECT n_nationkey AS nk, n_name AS ticker, lpad(CAST(n_nationkey AS STRING), 10, '0') AS cik,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Revenues' WHEN 'BUILDING' THEN 'RevenueFromContractWithCustomerExcludingAssessedTax'
      WHEN 'FURNITURE' THEN 'GrossProfit' WHEN 'HOUSEHOLD' THEN 'NetIncomeLoss' ELSE 'OperatingIncomeLoss' END AS concept,
    year(o_orderdate) AS y, quarter(o_orderdate) AS q,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v,
    CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18, 2)) ELSE CAST(0 AS DECIMAL(18, 2)) END) AS DOUBLE) AS va,
    count(*) AS n
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  GROUP BY n_nationkey, n_name, c_mktsegment, year(o_orderdate), quarter(o_orderdate)
), quarters AS (
  SELECT *, CAST(make_date(y, q * 3 - 2, 1) AS STRING) AS s, CAST(CAST(make_date(CASE WHEN q = 4 THEN y + 1 ELSE y END, CASE WHEN q = 4 THEN 1 ELSE q * 3 + 1 END, 1) - INTERVAL 1 DAY AS DATE) AS STRING) AS e FROM base
)"""

_ROWS = """
SELECT ticker, cik, concept, concept AS label, v AS value, 'USD' AS unit, s AS period_start, e AS period_end, y AS fiscal_year, concat('Q', q) AS fiscal_period, '10-Q' AS form,
  CAST(CAST(CAST(e AS DATE) + INTERVAL 40 DAY AS DATE) AS STRING) AS filed, concat(cik, '-', y, '-', q) AS accession_number FROM quarters
UNION ALL
SELECT ticker, cik, concept, concept, va, 'USD', s, e, y, concat('Q', q), '10-Q/A', CAST(CAST(CAST(e AS DATE) + INTERVAL 200 DAY AS DATE) AS STRING), concat(cik, '-', y, '-', q, 'A') FROM quarters WHERE nk % 3 = 0
UNION ALL
SELECT a.ticker, a.cik, a.concept, a.concept, CAST(sum(CAST(b.v AS DECIMAL(18, 2))) AS DOUBLE), 'USD', concat(a.y, '-01-01'), a.e, a.y, concat('Q', a.q), '10-Q',
  CAST(CAST(CAST(a.e AS DATE) + INTERVAL 40 DAY AS DATE) AS STRING), concat(a.cik, '-', a.y, '-', a.q) FROM quarters a JOIN quarters b ON a.ticker = b.ticker AND a.concept = b.concept AND a.y = b.y AND b.q <= a.q
  WHERE a.q IN (2, 3) GROUP BY a.ticker, a.cik, a.concept, a.y, a.q, a.e
UNION ALL
SELECT ticker, cik, concept, concept, CAST(sum(CAST(v AS DECIMAL(18, 2))) AS DOUBLE), 'USD', concat(y, '-01-01'), concat(y, '-12-31'), y, 'FY', '10-K', concat(y + 1, '-03-01'), concat(cik, '-', y, '-K') FROM quarters GROUP BY ticker, cik, concept, y
UNION ALL
SELECT ticker, cik, 'Assets', 'Assets', CAST(sum(n) AS DOUBLE), 'pure', CAST(NULL AS STRING), concat(y, '-12-31'), y, 'FY', '10-K', CASE WHEN y % 5 = 0 THEN '' ELSE concat(y + 1, '-03-01') END, concat(cik, '-', y, '-K') FROM quarters GROUP BY ticker, cik, y
"""

FACTS = f"""
WITH {_BASE}, all_rows AS ({_ROWS})
SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY concept, unit, period_end, coalesce(period_start, ''), filed, form, accession_number, value) AS BIGINT) AS fact_ord FROM all_rows
"""

CLAIMS = f"""
WITH {_BASE}, k AS (
  SELECT c.*, p.v AS pv, p.s AS ps, p.e AS pe, (c.nk + c.y + c.q) % 4 AS t, (c.nk * 7 + c.y * 3 + c.q) % 5 AS m
  FROM quarters c LEFT JOIN quarters p ON c.ticker = p.ticker AND c.concept = p.concept AND c.y = p.y + 1 AND c.q = p.q
)
SELECT concat(ticker, '/', concept, '/', y, '/', q) AS claim_id, ticker, CASE WHEN t = 3 THEN 'GrossProfit' ELSE concept END AS metric,
  CASE WHEN (nk * 5 + y + q) % 23 = 0 THEN 'ratio' WHEN t = 0 THEN 'absolute' WHEN t = 1 THEN 'growth_pct' WHEN t = 2 THEN 'absolute_change' ELSE 'bps_change' END AS comparison_type,
  CASE WHEN t = 0 THEN v * (1 + m * 0.0075) WHEN t = 1 THEN coalesce((v - pv) / pv * 100, 0) + m * 0.75 WHEN t = 2 THEN coalesce(v - pv, 0) * (1 + m * 0.004) ELSE m * 400.0 - 800 END AS claimed_value,
  e AS period_end, CASE WHEN nk % 2 = 0 THEN s END AS period_start, pe AS comparison_period_end, CASE WHEN nk % 2 = 0 THEN ps END AS comparison_period_start,
  CASE WHEN t = 3 AND m <> 1 THEN 'Revenues' END AS denominator_metric, CASE WHEN (nk + q) % 11 = 0 THEN 'EUR' ELSE 'USD' END AS unit,
  CASE WHEN m = 4 THEN CAST(0.04 AS DOUBLE) END AS tolerance,
  CASE WHEN y % 2 = 0 THEN CAST(CAST(CAST(e AS DATE) + INTERVAL 100 DAY AS DATE) AS STRING) END AS as_of
FROM k
"""

EXTRACTED = f"""
WITH {_BASE}
SELECT concat(ticker, '/', concept, '/', y, '/', q) AS claim_id, ticker, concat(ticker, '-', y) AS chunk_id, q AS claim_ord,
  CASE (nk + q) % 6 WHEN 0 THEN ' Net Sales ' WHEN 1 THEN 'total revenue' WHEN 2 THEN 'Gross Margin' WHEN 3 THEN 'net income' WHEN 4 THEN 'Total assets' ELSE 'unheard of metric' END AS metric,
  v AS value, CASE WHEN nk % 5 = 0 THEN 'percent' ELSE 'USD' END AS value_unit,
  CASE (y + q + nk) % 10 WHEN 0 THEN concat('fiscal year ', y) WHEN 1 THEN concat('FY', y) WHEN 2 THEN concat('in ', y) WHEN 3 THEN concat('third quarter of fiscal ', y) WHEN 4 THEN 'sequentially'
    WHEN 5 THEN 'a year ago' WHEN 6 THEN concat('Q', q) WHEN 7 THEN concat('fiscal years ', y) WHEN 8 THEN 'second fiscal quarter, year-over-year' ELSE '' END AS period,
  CASE WHEN nk % 4 = 1 THEN 'growth_pct' WHEN nk % 4 = 2 THEN 'bps_change' ELSE 'absolute' END AS comparison_type,
  CASE WHEN nk % 2 = 0 THEN concat(y + 1, '-06-30') END AS as_of
FROM base
"""

PROSE = f"""
WITH {_BASE}
SELECT concat(ticker, '/', concept, '/', y, '/', q) AS claim_id, concat(cik, '-', y, '-', q) AS accession,
  CASE concept WHEN 'Revenues' THEN 'Sales' WHEN 'GrossProfit' THEN 'Gross profit' WHEN 'NetIncomeLoss' THEN 'Net income' WHEN 'OperatingIncomeLoss' THEN 'operating profit' ELSE 'revenue' END AS metric,
  CASE WHEN (y + q) % 4 = 0 THEN 40.0 ELSE v * (1 + ((nk + q) % 7) * 0.01) END AS value, CASE WHEN (y + q) % 4 = 0 THEN 'percent' ELSE 'USD' END AS value_unit,
  CASE WHEN (nk + y) % 9 = 0 THEN 'growth_pct' ELSE 'absolute' END AS comparison_type
FROM base
"""

EVENTS = """
SELECT CAST(user_id AS STRING) AS run, event_id, CASE event_type WHEN 'click' THEN 'tool' WHEN 'error' THEN 'error' ELSE 'decision' END AS kind, event_type AS agent,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS step, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) * 1.5 AS elapsed, value
FROM {events}
"""


def build(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def duck(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
