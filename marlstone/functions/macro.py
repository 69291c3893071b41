"""Names of macro series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Friendly names of series.
SERIES = {
    "fed_funds_rate": "FEDFUNDS", "federal_funds_rate": "FEDFUNDS", "fed_funds": "FEDFUNDS", "2y_treasury": "DGS2", "10y_treasury": "DGS10", "30y_treasury": "DGS30",
    "10y_2y_spread": "T10Y2Y", "yield_curve": "T10Y2Y", "cpi": "CPIAUCSL", "core_cpi": "CPILFESL", "pce": "PCEPI", "core_pce": "PCEPILFE", "inflation_expectations": "T10YIE",
    "real_gdp": "GDPC1", "gdp": "GDP", "industrial_production": "INDPRO", "unemployment_rate": "UNRATE", "unemployment": "UNRATE", "nonfarm_payrolls": "PAYEMS", "payrolls": "PAYEMS",
    "initial_claims": "ICSA", "m2": "M2SL", "money_supply": "M2SL", "vix": "VIXCLS", "dollar_index": "DTWEXBGS", "consumer_sentiment": "UMCSENT", "housing_starts": "HOUST", "retail_sales": "RSAFS",
}
#: Tokens of a missing observation.
MISSING = (".", "")


def series_id(name: Column) -> Column:
    """The series of a friendly name, else the name as a raw id; null for what cannot be an id (a phrase, over 30 characters, blank)."""
    key = F.translate(F.lower(F.trim(name)), " -", "__")
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in SERIES.items() for x in pair)), key)
    raw = F.upper(F.trim(name))
    valid = (raw != "") & (F.length(raw) <= 30) & ~raw.rlike(r"\s")
    return F.coalesce(known, F.when(valid, raw))


def observed(value: Column) -> Column:
    """The number of an observation as text; null where it is missing or no number."""
    return F.when(~F.trim(value).isin(*MISSING), value.try_cast("double"))
