"""Several sources for one request: an ordered chain in code, or first-non-empty over tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NoData, NotConfigured, RateLimited

#: Categories and their methods.
CATEGORIES = {
    "core_stock_apis": ("get_stock_data",),
    "technical_indicators": ("get_indicators",),
    "fundamental_data": ("get_fundamentals", "get_balance_sheet", "get_cashflow", "get_income_statement"),
    "news_data": ("get_news", "get_global_news", "get_insider_transactions"),
    "macro_data": ("get_macro_indicators",),
    "prediction_markets": ("get_prediction_markets",),
}
OPTIONAL = frozenset(("macro_data", "prediction_markets"))


def category_of(method: str) -> str:
    for category, methods in CATEGORIES.items():
        if method in methods:
            return category
    raise ValueError(f"no category has the method {method!r}")


@dataclass
class Answer:
    """status: ok, no_data or unavailable; source: who answered; detail: why there is no value."""

    status: str
    value: object = None
    source: str | None = None
    detail: str = ""


@dataclass
class Router:
    """Sources by method, and who is asked in which order: a method's setting beats its category's."""

    sources: dict[str, dict[str, Callable]] = field(default_factory=dict)
    by_category: dict[str, str] = field(default_factory=dict)
    by_method: dict[str, str] = field(default_factory=dict)

    def register(self, method: str, source: str, call: Callable) -> None:
        self.sources.setdefault(method, {})[source] = call

    def chain(self, method: str) -> list[str]:
        """The sources to ask, in order. A setting is exact: unknown names drop out, and none left is an error. No setting asks all."""
        setting = self.by_method.get(method) or self.by_category.get(category_of(method), "default")
        named = [s.strip() for s in setting.split(",") if s.strip() and s.strip() != "default"]
        if method not in self.sources:
            raise ValueError(f"no source serves {method!r}")
        every = list(self.sources[method])
        found = [s for s in named if s in every] if named else every
        if not found:
            raise ValueError(f"none of {named} serves {method!r}; there are {every}")
        return found

    def ask(self, method: str, *args, **kwargs) -> Answer:
        """The first answer. If there is none: no_data if a source said so; else the first error, for optional
        categories as the status unavailable. Rate limits alone are an error in every category.
        """
        no_data, error = None, None
        for source in self.chain(method):
            try:
                return Answer("ok", self.sources[method][source](*args, **kwargs), source)
            except RateLimited:
                continue
            except NoData as e:
                no_data = e
            except Exception as e:  # noqa: BLE001 - the next source may serve it; the first error is raised below
                error = error or e
        if no_data is not None:
            return Answer("no_data", detail=str(no_data))
        if error is not None:
            if category_of(method) in OPTIONAL:
                return Answer("unavailable", detail=str(error))
            raise error
        raise RuntimeError(f"no source could serve {method!r}")


def first_nonempty(frames: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """For each key the rows of the first source, in order, that has any; with ``source``. Each source is scanned once, and rows of a key meet in one exchange."""
    out = None
    for k, (name, df) in enumerate(frames):
        df = df.withColumn("source", F.lit(name)).withColumn("_priority", F.lit(k))
        out = df if out is None else out.unionByName(df)
    best = F.min("_priority").over(W.partitionBy(*keys))
    return out.withColumn("_best", best).where("_priority = _best").drop("_priority", "_best")


#: What a source's try for a key came to.
OK, NO_DATA, RATE_LIMITED, NOT_CONFIGURED, ERROR = "ok", "no_data", "rate_limited", "not_configured", "error"


def chains(methods: DataFrame, settings: DataFrame) -> DataFrame:
    """method, source, priority and explicit: who is asked for each method, in which order, from tables.

    methods (method, source, place): the sources that serve a method, place being their usual order. settings
    (scope, sources): a list separated by commas for a method, or for its category; a method's own beats its category's, and a setting is exact: others aren't
    asked, names that don't serve the method drop out. No setting, or only ``default``, asks all. A method whose setting leaves none has one row without a source.
    """
    category = {m: c for c, names in CATEGORIES.items() for m in names}
    named = methods.select("method").distinct()
    of = F.create_map(*(F.lit(x) for pair in category.items() for x in pair))
    own = settings.select(F.col("scope").alias("method"), F.col("sources").alias("_own"))
    shared = settings.select(F.col("scope").alias("_category"), F.col("sources").alias("_shared"))
    asked = named.withColumn("_category", F.try_element_at(of, F.col("method"))).join(own, "method", "left").join(shared, "_category", "left")
    listed = F.filter(F.transform(F.split(F.coalesce("_own", "_shared", F.lit("default")), ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "default"))
    asked = asked.select("method", listed.alias("_named"))
    rows = methods.join(asked, "method").withColumn("explicit", F.size("_named") > 0)
    rows = rows.withColumn("priority", F.when(F.col("explicit"), F.array_position("_named", F.col("source")).cast("int") - 1).otherwise(F.col("place").cast("int")))
    found = rows.where("priority >= 0").select("method", "source", "priority", "explicit")
    none = rows.groupBy("method").agg(F.max("priority").alias("_p")).where("_p < 0").select("method", F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("priority"), F.lit(True).alias("explicit"))
    return found.unionByName(none)


def settled(tries: DataFrame, keys: list[str], optional: Column | None = None) -> DataFrame:
    """keys, status, source, value and detail of each key: what :meth:`Router.ask` makes of the tries of its sources, by one aggregate.

    tries: keys, priority, source, status (one of the names above), value and detail. The first source that is ok answers. Else
    no_data, with the detail of the last one to say so; else the first error (of a source that isn't configured, too), which is ``unavailable`` where optional holds. Rate limits alone are an
    error in every case. Sources after the one that answers count for nothing.
    """
    at = lambda *kinds: F.when(F.col("status").isin(*kinds), F.col("priority"))
    out = tries.withColumn("_optional", F.lit(False) if optional is None else optional).groupBy(*keys).agg(
        F.min_by(F.struct("source", "value"), at(OK)).alias("_ok"), F.max_by("detail", at(NO_DATA)).alias("_why"), F.max(at(NO_DATA)).alias("_none"),
        F.min_by("detail", at(ERROR, NOT_CONFIGURED)).alias("_error"), F.min(at(ERROR, NOT_CONFIGURED)).alias("_failed"), F.bool_or("_optional").alias("_optional"),
    )
    status = F.when(F.col("_ok").isNotNull(), OK).when(F.col("_none").isNotNull(), NO_DATA).when(F.col("_failed").isNotNull() & F.col("_optional"), "unavailable").otherwise(ERROR)
    detail = F.when(status == NO_DATA, F.col("_why")).when(F.col("_failed").isNotNull(), F.col("_error")).otherwise("no source could serve it")
    return out.select(*keys, status.alias("status"), F.col("_ok.source").alias("source"), F.col("_ok.value").alias("value"), F.when(status != OK, detail).alias("detail"))


def with_backoff(call: Callable, retries: int = 3, base: float = 2.0, sleep: Callable = time.sleep):
    """Calls again after base * 2**k seconds while the source is rate limited; the last error is raised."""
    for k in range(retries + 1):
        try:
            return call()
        except RateLimited:
            if k == retries:
                raise
            sleep(base * 2**k)


def retry_once(call: Callable, sleep: Callable = time.sleep):
    """One more try after a rate limit, when the source says or after a few seconds; a second limit is raised."""
    try:
        return call()
    except RateLimited as e:
        sleep(retry_after(e.retry_after))
        return call()


def retry_after(header: str | None, default: float = 5.0, most: float = 30.0) -> float:
    """Seconds to wait as a header asks, held to a bound."""
    try:
        return min(float(header), most) if header else default
    except ValueError:
        return default


def merge_config(base: dict, new: dict) -> dict:
    """Settings one level deep: dictionaries are merged, anything else replaced."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in base.items()}
    for k, v in new.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k].update(v)
        else:
            out[k] = v
    return out


def coerce_setting(text: str, like):
    """A setting from text, by the type of its default."""
    if isinstance(like, bool):
        low = text.strip().lower()
        if low in ("true", "1", "yes", "on"):
            return True
        if low in ("false", "0", "no", "off"):
            return False
        raise ValueError(f"not a truth value: {text!r}")
    return type(like)(text) if isinstance(like, (int, float)) else text


__all__ = ["Answer", "NotConfigured", "Router", "category_of", "chains", "coerce_setting", "first_nonempty", "settled", "merge_config", "retry_after", "retry_once", "with_backoff"]
