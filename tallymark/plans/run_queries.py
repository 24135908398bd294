"""Registered queries of user functions, of runs that stop and go on, and of audits and tools over given tables."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionary as dic
from ..operators import audit, dataset, reconcile, resolve, userfn
from ..operators.userfn import UserFunction
from ..schema import EXTRACTED as CLAIM_LIST
from ..sources import filings
from ..storage import cut, new_path
from . import coordinator, tools
from .adapter import EXTRACTED, build
from .queries import _C, _F, _MATCH, _X, ORACLES, _matches, claims, facts, query
from .runstate import RunStore

_SENTENCE = re.compile(r"^\[([^\]]*)\] We had (.*) of (\S+) (\S+) for '(.*)', an? (\w+) figure\.$", re.M)


def read_sentences(text: str) -> list[dict]:
    """The claims of a chunk, one a sentence.  A chunk that says it is garbled cannot be read, a long-winded one takes too long."""
    if "garbled" in text:
        raise ValueError("cannot be read")
    if "long-winded" in text:
        time.sleep(30)
    return [{"metric": m, "value": float(v), "value_unit": u, "period": p, "comparison_type": k, "quote": i} for i, m, v, u, p, k in _SENTENCE.findall(text)]


EXTRACTOR = UserFunction(read_sentences, CLAIM_LIST, deadline=0.25)


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, accession, chunk_index, text, as_of: the claims made from the tables, written out; every seventh year is garbled, another one long-winded."""
    x = build(spark, sf_dir, EXTRACTED)
    year = F.split("claim_id", "/")[2].cast("int")
    sentence = F.concat(F.lit("["), "claim_id", F.lit("] We had "), "metric", F.lit(" of "), F.col("value").cast("string"), F.lit(" "), "value_unit", F.lit(" for '"), "period", F.lit("', a "), "comparison_type", F.lit(" figure."))
    chunks = x.groupBy(F.col("ticker").alias("run"), F.col("chunk_id").alias("accession")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_ord", "claim_id", sentence.alias("s")))), lambda e: e["s"]), "\n").alias("body"), F.max("as_of").alias("as_of"), F.max(year % 7).alias("year"),
    )
    ending = F.when(F.col("year") == 3, "\ngarbled").when(F.col("year") == 5, "\nlong-winded").otherwise("")
    return chunks.select("run", "accession", F.lit(0).alias("chunk_index"), F.concat("body", ending).alias("text"), "as_of")


def _extracted(spark, sf_dir) -> DataFrame:
    return coordinator.extract(chunk_texts(spark, sf_dir), EXTRACTOR)


def _claims(extracted: DataFrame) -> DataFrame:
    return coordinator.claims_of(extracted, ["run", "as_of"]).withColumnRenamed("run", "ticker").withColumns({"claim_id": F.col("quote"), "chunk_id": F.col("accession")})


@query(f"SELECT * FROM ({ORACLES['q_verify_pipeline']}) WHERE CAST(string_split(claim_id, '/')[3] AS INT) % 7 NOT IN (3, 5)")
def q_user_extractor(spark, sf_dir):
    """Texts to claims by a user's function, to verdicts; chunks that raise or take too long give none."""
    claims = resolve.number_occurrences(_claims(_extracted(spark, sf_dir)))
    return resolve.verify(claims, cut(facts(spark, sf_dir), "facts"), dic.metrics(spark), dic.ratios(spark))


@query(f"""
WITH c AS (SELECT DISTINCT ticker, chunk_id, CAST(string_split(claim_id, '/')[3] AS INT) % 7 AS y FROM {_X})
SELECT ticker AS run, count(*) AS calls, count(*) FILTER (y IN (3, 5)) AS failed, count(*) FILTER (y = 5) AS late FROM c GROUP BY ticker""")
def q_call_outcomes(spark, sf_dir):
    called = userfn.apply(chunk_texts(spark, sf_dir), EXTRACTOR, ["text"], "claims")
    return userfn.outcomes(called, ["run"], "claims").drop("seconds")


@query(f"""
WITH x AS (SELECT *, CAST(string_split(claim_id, '/')[3] AS INT) % 7 AS y FROM {_X}) SELECT chunk_id AS accession, comparison_type, count(*) AS n, sum(value) AS total, NULL AS error FROM x WHERE y NOT IN (3, 5) GROUP BY ALL
UNION ALL SELECT DISTINCT chunk_id, NULL, 1, NULL, CASE y WHEN 3 THEN 'ValueError: cannot be read' ELSE 'TimeoutError: no result within 0.25 s' END FROM x WHERE y IN (3, 5)""")
def q_user_table_function(spark, sf_dir):
    """The same function in SQL, beside each text; sums are of cents, so that their order does not matter."""
    userfn.register(spark, "read_sentences", EXTRACTOR)
    return spark.sql(
        "SELECT t.accession, c.comparison_type, count(*) AS n, CAST(sum(CAST(c.value AS DECIMAL(20, 2))) AS DOUBLE) AS total, c.error FROM {texts} t, LATERAL read_sentences(t.text) c GROUP BY ALL", texts=chunk_texts(spark, sf_dir)
    )


@query("""
WITH d AS (SELECT doc_id, length(trim(text)) AS n FROM documents)
SELECT source, count(*) AS calls, count(*) FILTER (n IS NULL OR n = 0) AS failed, sum(n) AS total FROM d JOIN documents USING (doc_id) GROUP BY source""")
def q_user_batch_function(spark, sf_dir):
    """A function of whole Arrow batches over documents; a batch with an empty text is called again row by row."""

    def lengths(texts):
        import pyarrow.compute as pc

        n = pc.utf8_length(pc.utf8_trim(texts, " "))
        if pc.any(pc.or_kleene(pc.is_null(n), pc.equal(n, 0))).as_py():
            raise ValueError("an empty text")
        return pc.cast(n, "int64")

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "text")
    called = userfn.apply(d, UserFunction(lengths, "bigint", deadline=5.0, batch=True), ["text"], "n")
    return called.groupBy("source").agg(F.count("*").alias("calls"), F.count_if(F.col("n_error").isNotNull()).alias("failed"), F.sum("n").alias("total"))


CALLS = 5
_RESUME = f"""
c AS (SELECT DISTINCT ticker AS run, chunk_id AS accession, claim_ord AS chunk_index FROM {_X}),
s1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY run ORDER BY accession, chunk_index) <= {CALLS}),
l2 AS (SELECT * FROM c EXCEPT SELECT * FROM s1 WHERE chunk_index <> 3),
s2 AS (SELECT * FROM l2 QUALIFY row_number() OVER (PARTITION BY run ORDER BY accession, chunk_index) <= {CALLS}),
s AS (SELECT 1 AS session, * FROM s1 UNION ALL SELECT 2, * FROM s2)"""


def _twice(spark, sf_dir) -> RunStore:
    """A store in which every run of several filings was stopped twice."""
    x = build(spark, sf_dir, EXTRACTED).withColumnsRenamed({"chunk_id": "accession"}).withColumn("chunk_index", F.col("claim_ord"))
    chunks = x.select(F.col("ticker").alias("run"), "accession", "chunk_index").distinct()
    chunks = chunks.withColumns({"failed": F.col("chunk_index") == 3, "elapsed": F.lit(0.0)})
    store, known = RunStore(spark, new_path(spark, "runs")), cut(facts(spark, sf_dir), "facts")
    for _ in range(2):
        coordinator.run_session(store, chunks, x, known, dic.metrics(spark), dic.ratios(spark), max_calls=CALLS)
    return store


@query(f"WITH {_RESUME} SELECT run, 1 AS epoch, session, accession, chunk_index, CASE WHEN chunk_index = 3 THEN 'failed' ELSE 'done' END AS status FROM s")
def q_run_resume(spark, sf_dir):
    """The state after two stops: nothing that was done is done again, what failed is."""
    return _twice(spark, sf_dir).latest("chunks")


@query(f"""
WITH {_RESUME}, e AS (
  SELECT run, session, -1 AS pos, 0 AS claim, '' AS claim_id, unnest([0, 1, 2, 3]) AS k, unnest(['get_chunks', 'chunks_retrieved', 'get_facts', 'facts_retrieved']) AS action FROM (SELECT DISTINCT run, session FROM s WHERE session = 1)
  UNION ALL SELECT DISTINCT run, session, -1, 0, '', 0, 'resumed' FROM s WHERE session = 2
  UNION ALL SELECT run, session, pos, 0, '', 0, 'extract' FROM (SELECT *, row_number() OVER (PARTITION BY run, session ORDER BY accession, chunk_index) AS pos FROM s)
  UNION ALL SELECT run, session, pos, 0, '', 1, 'extraction_failed' FROM (SELECT *, row_number() OVER (PARTITION BY run, session ORDER BY accession, chunk_index) AS pos FROM s) WHERE chunk_index = 3
  UNION ALL SELECT s.run, session, pos, 1, claim_id, unnest([0, 1]), unnest(['verify', 'claim_verdict'])
    FROM (SELECT *, row_number() OVER (PARTITION BY run, session ORDER BY accession, chunk_index) AS pos FROM s) s JOIN {_X} x ON x.chunk_id = s.accession AND x.claim_ord = s.chunk_index WHERE s.chunk_index <> 3
  UNION ALL SELECT DISTINCT run, session, 1000, 0, '', 0, 'budget_exceeded' FROM s
)
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY session, pos, claim, claim_id, k) AS INT) AS step, action,
  CASE WHEN action IN ('get_chunks', 'get_facts', 'extract', 'verify') THEN 'tool_call' ELSE 'decision' END AS kind FROM e""")
def q_run_log(spark, sf_dir):
    """The trace of both sessions, numbered through."""
    return _twice(spark, sf_dir).latest("trace").select("run", "step", "action", "kind")


@query(f"""
WITH {_RESUME}, v AS ({ORACLES['q_verify_pipeline']})
SELECT s.run, count(*) AS claims, count(*) FILTER (verdict = 'consistent') AS consistent, count(*) FILTER (verdict = 'inconsistent') AS inconsistent
FROM s JOIN {_X} x ON x.chunk_id = s.accession AND x.claim_ord = s.chunk_index JOIN v USING (claim_id) WHERE s.chunk_index <> 3 GROUP BY s.run""")
def q_run_verdicts(spark, sf_dir):
    """Verdicts of both sessions together."""
    v = _twice(spark, sf_dir).latest("verdicts")
    return v.groupBy("run").agg(F.count("*").alias("claims"), F.count_if(F.col("verdict") == "consistent").alias("consistent"), F.count_if(F.col("verdict") == "inconsistent").alias("inconsistent"))


# ---- audits and tools over given tables ----

_ONCE = f"(SELECT ticker, concept, period_start, period_end, min_by(value, (filed, accession_number, fact_ord)) AS value, min_by(unit, (filed, accession_number, fact_ord)) AS unit, min(filed) AS filed, min_by(fact_ord, (filed, accession_number, fact_ord)) AS fact_ord FROM {_F} GROUP BY ticker, concept, period_start, period_end HAVING min(value) = max(value))"
_PAIRED = f"""
f AS (SELECT *, row_number() OVER (PARTITION BY ticker, concept ORDER BY period_end, fact_ord) AS rn, date_diff('day', CAST(period_start AS DATE), CAST(period_end AS DATE)) AS days FROM {_ONCE} WHERE period_start IS NOT NULL),
p AS (SELECT a.ticker, a.concept, a.value AS cur, arg_max(b.value, b.rn) AS pri FROM f a JOIN f b ON a.ticker = b.ticker AND a.concept = b.concept AND b.rn < a.rn AND a.period_end <> b.period_end AND abs(a.days - b.days) <= 20 GROUP BY a.ticker, a.concept, a.fact_ord, a.value),
q AS (SELECT *, (cur - pri) / abs(pri) * 100 AS growth, cur - pri AS change FROM p WHERE cur <> 0 AND pri <> 0),
k AS (
  SELECT 'stated' AS label, 'known_good' AS category, 'consistent' AS expected, 'absolute' AS kind, cur AS v, * FROM q UNION ALL SELECT 'stated_growth', 'known_good', 'consistent', 'growth_pct', growth, * FROM q
  UNION ALL SELECT 'stated_change', 'known_good', 'consistent', 'absolute_change', change, * FROM q UNION ALL SELECT 'inflated', 'known_bad', 'inconsistent', 'absolute', cur * 1.3, * FROM q
  UNION ALL SELECT 'inflated_growth', 'known_bad', 'inconsistent', 'growth_pct', growth + 10, * FROM q UNION ALL SELECT 'flipped_growth', 'adversarial', 'inconsistent', 'growth_pct', -growth, * FROM q WHERE abs(growth) > 1
  UNION ALL SELECT 'flipped_change', 'adversarial', 'inconsistent', 'absolute_change', -change, * FROM q WHERE abs(change) / greatest(abs(cur), abs(pri)) > 0.01
  UNION ALL SELECT 'thousandth', 'adversarial', 'inconsistent', 'absolute', cur / 1000, * FROM q UNION ALL SELECT 'inside_edge', 'adversarial', 'consistent', 'absolute', cur * 1.0099, * FROM q
  UNION ALL SELECT 'outside_edge', 'adversarial', 'inconsistent', 'absolute', cur * 1.0101, * FROM q UNION ALL SELECT 'growth_as_amount', 'adversarial', 'inconsistent', 'absolute', growth, * FROM q
), v AS (
  SELECT *, CASE WHEN CASE kind WHEN 'absolute' THEN abs(cur - v) / abs(cur) <= 0.01 WHEN 'growth_pct' THEN abs(growth - v) <= 1 ELSE abs(change - v) / greatest(abs(cur), abs(pri)) <= 0.01 END THEN 'consistent' ELSE 'inconsistent' END AS verdict FROM k)"""


def _judged_cases(spark, sf_dir) -> DataFrame:
    once = dataset.one_per_period(facts(spark, sf_dir), never_restated=True).where("period_start is not null")
    pairs = dataset.adjacent_pairs(once, ("value", "unit", "period_start", "period_end", "filed"))
    return reconcile.reconcile(cut(audit.cases_from(pairs), "cases"), facts(spark, sf_dir))


@query(f"WITH {_PAIRED} SELECT label, category, count(*) AS cases, count(*) FILTER (verdict = expected) AS matched, count(*) FILTER (verdict = 'consistent' AND expected <> 'consistent') AS falsely_accepted FROM v GROUP BY ALL")
def q_audit_cases(spark, sf_dir):
    """The audit case by case over all pairs of periods: good claims, bad ones, and those made to slip through."""
    return audit.audit_by_label(_judged_cases(spark, sf_dir))


@query(f"""
WITH {_PAIRED}, n AS (SELECT count(*) AS cases, count(*) FILTER (verdict = expected) AS matched, count(*) FILTER (expected = 'consistent') AS n_good, count(*) FILTER (expected = 'consistent' AND verdict = 'consistent') AS accepted,
  count(*) FILTER (expected <> 'consistent') AS n_bad, count(*) FILTER (expected <> 'consistent' AND verdict = 'consistent') AS falsely_accepted FROM v)
SELECT *, CAST(accepted AS DOUBLE) / n_good AS recall, CAST(falsely_accepted AS DOUBLE) / n_bad AS false_positive_rate, CASE WHEN falsely_accepted = 0 THEN CAST(3.0 AS DOUBLE) / n_bad END AS false_positive_bound FROM n""")
def q_audit_rates(spark, sf_dir):
    return audit.audit(_judged_cases(spark, sf_dir).withColumn("demo", F.lit(False)))


@query(f"""
WITH {_MATCH} SELECT m.match_id, CAST(row_number() OVER (PARTITION BY m.match_id ORDER BY f.fact_ord) - 1 AS INT) AS pos, f.value, f.unit, f.filed, f.form, f.accession_number
FROM m JOIN fx f ON f.ticker = m.ticker AND f.concept = m.concept AND f.period_start IS NOT DISTINCT FROM m.period_start AND f.period_end = m.period_end""")
def q_judge_evidence(spark, sf_dir):
    """All evidence of a match, line by line."""
    m = audit.judge_inputs(_matches(spark, sf_dir), facts(spark, sf_dir))
    e = m.select("match_id", F.posexplode("evidence").alias("pos", "e"))
    return e.select("match_id", "pos", *[f"e.{c}" for c in ("value", "unit", "filed", "form", "accession_number")])


@query(f"""
WITH l AS (SELECT ticker, max(filed) AS as_of FROM {_F} GROUP BY ticker)
SELECT c.claim_id, l.as_of, count(f.fact_ord) AS n, min(f.period_end) AS first_end, max(f.period_end) AS last_end, count(DISTINCT f.accession_number) AS filings, CAST(sum(f.fact_ord) AS BIGINT) AS ords
FROM {_C} c JOIN l ON l.ticker = c.ticker LEFT JOIN {_F} f ON f.ticker = c.ticker AND (f.concept = c.metric OR f.concept = c.denominator_metric) GROUP BY c.claim_id, l.as_of""")
def q_judge_concepts(spark, sf_dir):
    """A claim's evidence by its set of concepts, as of the company's latest filing."""
    m = audit.judge_inputs_by_concept(claims(spark, sf_dir), facts(spark, sf_dir))
    each = lambda c: F.transform("evidence", lambda e: e[c])
    return m.select(
        "claim_id", "as_of", F.size("evidence").cast("long").alias("n"), F.array_min(each("period_end")).alias("first_end"), F.array_max(each("period_end")).alias("last_end"),
        F.size(F.array_distinct(each("accession_number"))).cast("long").alias("filings"), F.when(F.size("evidence") > 0, F.aggregate(each("fact_ord"), F.lit(0).cast("long"), lambda a, b: a + b)).alias("ords"),
    )


@query(f"SELECT claim_id, ticker, metric, claimed_value, computed_value FROM ({ORACLES['q_reconcile_all']}) JOIN (SELECT claim_id, ticker, metric, claimed_value FROM {_C}) USING (claim_id) WHERE verdict = 'inconsistent'")
def q_inconsistent_claims(spark, sf_dir):
    judged = reconcile.reconcile(claims(spark, sf_dir), facts(spark, sf_dir))
    return audit.of_verdict(judged, "inconsistent", "claim_id", "ticker", "metric", "claimed_value", "computed_value")


@query(f"""
SELECT n.n_name AS company, concept, count(*) AS n, max(period_end) AS last_end FROM nation n JOIN {_F} f ON f.ticker = n.n_name WHERE n.n_name = 'NATION_3' GROUP BY ALL
UNION ALL SELECT 'NATION_5', concept, 0, NULL FROM {_F} WHERE ticker = 'NATION_5' GROUP BY concept""")
def q_tools_in_sql(spark, sf_dir):
    """The tool surface from SQL."""
    known = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("ticker"))
    tools.Tools(spark, facts(spark, sf_dir), companies=known).in_sql("q_")
    return spark.sql("""
        SELECT 'NATION_3' AS company, concept, count(*) AS n, max(period_end) AS last_end FROM q_xbrl_facts(' nation_3 ') GROUP BY concept
        UNION ALL SELECT 'NATION_5', concept, 0, NULL FROM q_concepts_of('NATION_5')""")


@query(f"""
WITH h AS (SELECT s_suppkey AS ord, lpad(CAST(s_nationkey AS VARCHAR), 10, '0') AS cik, s_name AS name FROM supplier WHERE s_suppkey % 7 <> 0),
c AS (SELECT cik, arg_max(name, ord) AS name FROM h GROUP BY cik), k AS (SELECT n_name AS ticker, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik FROM nation WHERE n_nationkey % 3 <> 1),
w AS (SELECT DISTINCT f.ticker, f.accession_number, c.name FROM c JOIN k USING (cik) JOIN {_F} f ON f.ticker = k.ticker WHERE f.form = '10-K')
SELECT ticker, name, accession_number, CAST(least(60, 20 + (length(accession_number) * 7 + CAST(substr(accession_number, 12, 4) AS INT)) % 80) AS BIGINT) AS chunks FROM w""")
def q_search_to_chunks(spark, sf_dir):
    """From landed search hits to companies, to their filings, to the first chunks of these."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    ciks = F.when(F.col("s_suppkey") % 7 != 0, F.array(F.col("s_nationkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    hits = s.select(F.col("s_suppkey").alias("ord"), ciks.alias("ciks"), F.array("s_name").alias("names"), F.lit("2024-01-01").alias("file_date"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tickers = n.select(F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("cik"))
    found = filings.label_companies(filings.search_candidates(hits), tickers).withColumnRenamed("label", "ticker")
    found = filings.only_companies(found, n.where("n_nationkey % 3 <> 1").select(F.col("n_name").alias("ticker")))
    index = facts(spark, sf_dir).where("form = '10-K'").select("ticker", "accession_number").distinct()
    wanted = found.join(index, "ticker").select("ticker", "name", "accession_number")
    size = 20 + (F.length("accession_number") * 7 + F.substring("accession_number", 12, 4).cast("int")) % 80
    chunks = index.select("accession_number", F.explode(F.sequence(F.lit(0), (size - 1).cast("int"))).alias("chunk_index"))
    first = filings.original_chunks(wanted, index, chunks).groupBy("accession_number").agg(F.count("*").alias("chunks"))
    return wanted.join(first, "accession_number").select("ticker", "name", "accession_number", "chunks")
