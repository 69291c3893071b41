"""Company statements and profiles: wide to long, and what was known at a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Profile labels and the fields they come from.
PROFILE = {
    "Name": "longName", "Sector": "sector", "Industry": "industry", "Market Cap": "marketCap", "PE Ratio (TTM)": "trailingPE", "Forward PE": "forwardPE", "PEG Ratio": "pegRatio",
    "Price to Book": "priceToBook", "EPS (TTM)": "trailingEps", "Forward EPS": "forwardEps", "Dividend Yield": "dividendYield", "Beta": "beta", "52 Week High": "fiftyTwoWeekHigh",
    "52 Week Low": "fiftyTwoWeekLow", "50 Day Average": "fiftyDayAverage", "200 Day Average": "twoHundredDayAverage", "Revenue (TTM)": "totalRevenue", "Gross Profit": "grossProfits",
    "EBITDA": "ebitda", "Net Income": "netIncomeToCommon", "Profit Margin": "profitMargins", "Operating Margin": "operatingMargins", "Return on Equity": "returnOnEquity",
    "Return on Assets": "returnOnAssets", "Debt to Equity": "debtToEquity", "Current Ratio": "currentRatio", "Book Value": "bookValue", "Free Cash Flow": "freeCashflow",
}


def unpivot_periods(wide: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Period columns (ISO dates as names) to rows: keys, period_end, value; cells without a value go, columns that are no date too."""
    periods = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(list(keys), periods, "period_end", "value").withColumn("period_end", F.col("period_end").try_cast("date"))
    return long.where("period_end IS NOT NULL AND value IS NOT NULL")


def known_periods(long: DataFrame, date) -> DataFrame:
    """Periods that had ended at the date (by period end, not by filing date)."""
    return long.where(F.col("period_end") <= F.lit(date).cast("date"))


def known_reports(df: DataFrame, reports: str, date, field: str = "fiscalDateEnding") -> DataFrame:
    """The same for arrays of reports: those with no date are kept."""
    return df.withColumn(reports, F.filter(reports, lambda r: F.coalesce(r[field], F.lit("")) <= F.lit(str(date))))


def report_rows(df: DataFrame, reports: str, keys: tuple[str, ...], field: str = "fiscalDateEnding") -> DataFrame:
    """Reports as maps, one row for each line item: keys, period_end, line_item, value."""
    rows = df.select(*keys, F.explode(reports).alias("_r"))
    rows = rows.select(*keys, F.try_element_at("_r", F.lit(field)).try_cast("date").alias("period_end"), F.explode("_r").alias("line_item", "_v"))
    return rows.where(F.col("line_item") != field).select(*keys, "period_end", "line_item", F.col("_v").try_cast("double").alias("value")).where("value IS NOT NULL")


def profile_rows(df: DataFrame, keys: tuple[str, ...] = ("symbol",), labels: dict[str, str] | None = None) -> DataFrame:
    """Labelled fields of a profile, one row for each that is there."""
    some = {label: c for label, c in (labels or PROFILE).items() if c in df.columns}
    pairs = F.array(*(F.struct(F.lit(label).alias("field"), F.col(c).cast("string").alias("value")) for label, c in some.items()))
    return df.select(*keys, F.inline(pairs)).where("value IS NOT NULL")
