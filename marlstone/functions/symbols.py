"""Column functions over instrument symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currencies of spot pairs.
CURRENCIES = "USD EUR GBP JPY CHF CAD AUD NZD CNY CNH HKD SGD SEK NOK DKK PLN MXN ZAR TRY INR KRW BRL RUB THB".split()
#: Crypto bases.
CRYPTO = "BTC ETH SOL XRP ADA DOGE LTC BCH DOT AVAX LINK".split()
#: Broker names of metals, energy and index contracts.
ALIASES = {
    "XAUUSD": "GC=F", "XAU": "GC=F", "GOLD": "GC=F", "XAGUSD": "SI=F", "XAG": "SI=F", "SILVER": "SI=F", "XPTUSD": "PL=F", "XPDUSD": "PA=F",
    "WTICOUSD": "CL=F", "USOIL": "CL=F", "WTI": "CL=F", "BCOUSD": "BZ=F", "UKOIL": "BZ=F", "BRENT": "BZ=F", "NATGAS": "NG=F", "XNGUSD": "NG=F", "COPPER": "HG=F", "XCUUSD": "HG=F",
    "SPX500": "^GSPC", "US500": "^GSPC", "SPX": "^GSPC", "NAS100": "^NDX", "US100": "^NDX", "USTEC": "^NDX", "US30": "^DJI", "DJI30": "^DJI", "WS30": "^DJI",
    "GER40": "^GDAXI", "GER30": "^GDAXI", "DE40": "^GDAXI", "UK100": "^FTSE", "JP225": "^N225", "JPN225": "^N225", "FRA40": "^FCHI", "EU50": "^STOXX50E", "HK50": "^HSI",
}
#: Exchange suffixes and their index, in the order of the look-up; no suffix matches last.
BENCHMARKS = {".NS": "^NSEI", ".BO": "^BSESN", ".T": "^N225", ".HK": "^HSI", ".L": "^FTSE", ".TO": "^GSPTSE", ".AX": "^AXJO", ".SS": "000001.SS", ".SZ": "399001.SZ", "": "SPY"}
#: Endings of canonical crypto symbols.
CRYPTO_ENDINGS = ("-USD", "-USDT", "-USDC", "-BTC", "-ETH")


def _mapping(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def normalize_symbol(raw: Column) -> Column:
    """The canonical symbol: alias, else crypto pair against the dollar, else spot pair, else itself. Blank stays as it is."""
    s = F.regexp_replace(F.upper(F.trim(raw)), r"\++$", "")
    base = F.regexp_extract(F.replace(s, F.lit("-"), F.lit("")), r"^(.*?)(USDT|USDC|USD)$", 1)
    pair = (F.length(s) == 6) & F.substring(s, 1, 3).isin(CURRENCIES) & F.substring(s, 4, 3).isin(CURRENCIES)
    known = F.try_element_at(_mapping(ALIASES), s)
    out = F.when(known.isNotNull(), known).when(base.isin(CRYPTO), F.concat(base, F.lit("-USD"))).when(pair, F.concat(s, F.lit("=X"))).otherwise(s)
    return F.when(raw.isNull() | (F.trim(raw) == ""), raw).otherwise(out)


def is_safe_symbol(symbol: Column) -> Column:
    return F.coalesce(symbol.rlike(r"^[A-Za-z0-9._\-^=]+$"), F.lit(False))


def is_path_safe(symbol: Column, longest: int = 32) -> Column:
    """Usable as a path component: allowed characters, not too long, not only dots."""
    return F.coalesce(symbol.rlike(r"^[A-Za-z0-9._\-^=+]+$") & (F.length(symbol) <= longest) & ~symbol.rlike(r"^\.+$"), F.lit(False))


def is_ticker_input(value: Column) -> Column:
    """What a user may type; blank is allowed."""
    v = F.trim(value)
    return F.coalesce((v == "") | (v.rlike(r"^[\p{L}\p{N}._\-^=]+$") & (F.length(v) <= 32)), F.lit(False))


def asset_class(raw: Column) -> Column:
    """``crypto`` or ``stock``, by the canonical symbol."""
    s = normalize_symbol(raw)
    crypto = F.lit(False)
    for ending in CRYPTO_ENDINGS:
        crypto = crypto | s.endswith(ending)
    return F.when(F.coalesce(crypto, F.lit(False)), "crypto").otherwise("stock")


def benchmark_of(symbol: Column, override: str | None = None, table: dict[str, str] | None = None) -> Column:
    """The index of the first suffix, in the table's order, that the symbol ends with."""
    if override:
        return F.lit(override)
    out, s = None, F.upper(symbol)
    for suffix, index in (table or BENCHMARKS).items():
        if suffix:
            out = F.when(s.endswith(suffix), index) if out is None else out.when(s.endswith(suffix), index)
    default = (table or BENCHMARKS).get("")
    return F.lit(default) if out is None else out.otherwise(default)


def thread_key(symbol: Column, date: Column) -> Column:
    """A short stable id of a symbol and a date."""
    return F.substring(F.sha2(F.concat_ws(":", F.upper(symbol), date.cast("string")), 256), 1, 16)
