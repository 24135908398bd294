"""Constants and column sets of the data model."""

from __future__ import annotations

ABSOLUTE, GROWTH, CHANGE, BPS = "absolute", "growth_pct", "absolute_change", "bps_change"
CONSISTENT, INCONSISTENT, UNVERIFIABLE = "consistent", "inconsistent", "unverifiable"

# Default tolerance of each comparison type.
DEFAULT_TOLERANCE = {ABSOLUTE: 0.01, GROWTH: 1.0, CHANGE: 0.01, BPS: 50.0}
NEAR_MISS_FACTOR = 2.0
AMENDED_FORMS = ("10-K/A", "10-Q/A")
MATERIALITY = 0.01

#: Facts are bitemporal: a period (period_start, period_end) and the date they were filed.  Dates are ISO text; a missing
#: filed date is '' and passes every cutoff.  fact_ord gives the order of ingestion, which breaks ties.
FACT_COLUMNS = ["ticker", "cik", "concept", "label", "value", "unit", "period_start", "period_end", "fiscal_year", "fiscal_period", "form", "filed", "accession_number", "fact_ord"]
FACTS = "ticker string, cik string, concept string, label string, value double, unit string, period_start string, period_end string, fiscal_year int, fiscal_period string, form string, filed string, accession_number string, fact_ord bigint"
CLAIMS = "claim_id string, ticker string, metric string, comparison_type string, claimed_value double, period_end string, period_start string, comparison_period_end string, comparison_period_start string, denominator_metric string, unit string, tolerance double, as_of string"
EXTRACTED = "array<struct<metric:string,value:double,value_unit:string,period:string,comparison_type:string,quote:string>>"
