"""Who an instrument is: cleaned profile fields, looked up without ever failing a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import normalize_symbol
from ..functions.text import clean_identity, identity

#: Names of identity fields and where they come from; the company's name has two sources.
FIELDS = {"sector": "sector", "industry": "industry", "exchange": "exchange", "quote_type": "quoteType"}


def identities(profiles: DataFrame, key: str = "symbol") -> DataFrame:
    """key and ``identity``, a map of the fields that are there and no placeholders. profiles: one row for each key."""
    there = set(profiles.columns)
    pick = lambda c: F.col(c) if c in there else F.lit(None).cast("string")
    values = {"company_name": identity(pick("longName"), pick("shortName")), **{name: clean_identity(pick(c)) for name, c in FIELDS.items()}}
    pairs = F.array(*(F.struct(F.lit(name).alias("key"), v.alias("value")) for name, v in values.items()))
    return profiles.select(key, F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("identity"))


def with_identity(requests: DataFrame, profiles: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Requests with the ``identity`` of their canonical symbol; a symbol that nobody knows has an empty map."""
    known = identities(profiles).select(F.col("symbol").alias("_canonical"), "identity")
    out = requests.withColumn("_canonical", normalize_symbol(F.col(symbol))).join(known, "_canonical", "left")
    return out.withColumn("identity", F.coalesce("identity", F.create_map().cast("map<string,string>"))).drop("_canonical")
