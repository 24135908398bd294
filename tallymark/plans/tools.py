"""The tool surface over landed data: point questions about a company, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import explanation
from ..operators import reconcile
from ..schema import CLAIMS
from ..sources import filings

# The forms and the number of filings listed unless told otherwise.
LISTED_FORMS, LISTED = ("10-K", "10-Q", "8-K"), 10


class Tools:
    """Landed tables of a deployment: facts (flattened), index (ticker, cik and parallel arrays) and documents (ticker, form,
    accession_number, filing_date, html), and companies (ticker, cik), those that are known; without it they are the ones with facts, an
    index or documents.  A tool raises ValueError for a company that is not known and has an empty answer for one that has filed nothing.  Every
    answer is lazy; filters on the ticker reach the scans.  `in_sql` makes the tools table functions."""

    def __init__(self, spark: SparkSession, facts: DataFrame, index: DataFrame | None = None, documents: DataFrame | None = None, companies: DataFrame | None = None) -> None:
        self.spark, self.facts, self.index, self.documents, self.companies = spark, facts, index, documents, companies

    def _known(self, ticker: str) -> str:
        ticker = ticker.strip().upper()
        tables = [self.companies] if self.companies is not None else [t for t in (self.facts, self.index, self.documents) if t is not None]
        if all(t.where(F.upper(F.trim("ticker")) == ticker).isEmpty() for t in tables):
            raise ValueError(f"unknown ticker: {ticker}")
        return ticker

    def in_sql(self, prefix: str = "") -> None:
        """Temporary table functions, for SELECT * FROM xbrl_facts('ABC'), filings_of('ABC'), concepts_of('ABC'); an unknown ticker is an error there too."""
        known = self.companies if self.companies is not None else self.facts.select("ticker").union(self.index.select("ticker")) if self.index is not None else self.facts
        views = {"facts": self.facts, "companies": known.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()}
        if self.index is not None:
            views["filings"] = filings.with_url(filings.filing_index(self.index, list(LISTED_FORMS), None))
        for name, df in views.items():
            df.createOrReplaceTempView(f"{prefix}{name}_table")
        # the known companies are one row beside what was found, so that an unknown one is noticed where nothing was
        company = "upper(trim(company))"
        known_row = f"(SELECT collect_set(ticker) AS names FROM {prefix}companies_table) k"
        check = f"CASE WHEN array_contains(k.names, {company}) THEN t.ticker IS NOT NULL ELSE CAST(raise_error(concat('unknown ticker: ', {company})) AS BOOLEAN) END"
        of = lambda view: f"FROM {known_row} LEFT JOIN {prefix}{view}_table t ON t.ticker = {company} WHERE {check}"
        columns = lambda df: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        made = {
            "xbrl_facts": (columns(self.facts), f"SELECT t.* {of('facts')}"),
            "concepts_of": ("concept string", f"SELECT DISTINCT t.concept {of('facts')}"),
        }
        if self.index is not None:
            made["filings_of"] = (columns(views["filings"]), f"SELECT t.* {of('filings')}")
        for name, (returns, body) in made.items():
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(company STRING) RETURNS TABLE ({returns}) RETURN {body}")

    def ping(self) -> str:
        return "pong"

    def list_filings(self, ticker: str, form_types: list[str] | None = None, limit: int = LISTED) -> DataFrame:
        mine = self.index.where(F.upper(F.trim("ticker")) == self._known(ticker))
        return filings.with_url(filings.filing_index(mine, list(form_types or LISTED_FORMS), limit))

    def get_xbrl_facts(self, ticker: str, concepts: list[str] | None = None) -> DataFrame:
        mine = self.facts.where(F.col("ticker") == self._known(ticker))
        return mine.where(F.col("concept").isin(*concepts)) if concepts else mine

    def list_concepts(self, ticker: str) -> DataFrame:
        return filings.list_concepts(self.get_xbrl_facts(ticker))

    def get_mdna(self, ticker: str, form_type: str = "10-K", limit: int = 1) -> DataFrame:
        """Chunks of the newest filings' sections; a filing without the section gives an error row."""
        if form_type not in filings.SECTIONS:
            raise ValueError(f"no section is known for form {form_type}")
        mine = self.documents.where((F.upper(F.trim("ticker")) == self._known(ticker)) & (F.col("form") == form_type))
        newest = mine.orderBy(F.desc("filing_date"), "accession_number").limit(limit)
        return filings.get_section(newest, "accession_number", form_type)

    def reconcile_claim(self, ticker: str, metric: str, comparison_type: str, claimed_value: float, period_end: str, period_start: str | None = None, comparison_period_end: str | None = None, comparison_period_start: str | None = None, denominator_metric: str | None = None, unit: str = "USD", tolerance: float | None = None, as_of: str | None = None) -> DataFrame:
        ticker = ticker.strip().upper()
        row = ("claim", ticker, metric, comparison_type, float(claimed_value), period_end, period_start, comparison_period_end, comparison_period_start, denominator_metric, unit, tolerance, as_of)
        return explained(self.spark.createDataFrame([row], CLAIMS), self.get_xbrl_facts(ticker, [metric] + ([denominator_metric] if denominator_metric else [])))


def explained(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Reconciled claims with a text for readers."""
    roles = reconcile.with_roles(claims, facts)
    kept = roles.withColumn("__roles", F.struct(*reconcile.ROLES))
    out = reconcile.judge(kept)
    return out.withColumns({r: F.col(f"__roles.{r}") for r in reconcile.ROLES}).withColumn("explanation", explanation()).drop(*reconcile.ROLES, "__roles")
