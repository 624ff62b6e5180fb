"""The service's functions as DataFrames: events, retrieval, density of one event, volatility, report, backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions import text as T
from hindcast.operators import forecast, retrieval

#: The rungs of the adaptive threshold.
LADDER = (0.90, 0.87, 0.85, 0.82, 0.80, 0.77, 0.75, 0.70, 0.65, 0.0)


def find_events(events: DataFrame, q: str | None = None, kind: str = "All", limit: int = 100, densities: DataFrame | None = None) -> DataFrame:
    """The newest events whose text holds q, whatever its case, of one type or all; kde_available tells of a density."""
    out = events
    if q:
        out = out.where(T.contains_all([F.col("text")], [q]))
    if kind != "All":
        out = out.where(F.col("event_type") == kind)
    out = out.orderBy(F.desc("d"), "event_id").limit(limit)
    if densities is None:
        return out.withColumn("kde_available", F.lit(False))
    known = densities.select("event_id").distinct().withColumn("__known", F.lit(True))
    return out.join(known, "event_id", "left").withColumn("kde_available", F.coalesce("__known", F.lit(False))).drop("__known")


def retrieve(corpus: DataFrame, event_id, tau: float = 0.85, k_min: int = 10, k: int = 50, as_of: bool = True) -> DataFrame:
    """The analogues of one event of the corpus, itself excepted, at the first rung at or below tau that k_min of them reach."""
    base = corpus.where(F.col("event_id") == event_id).select(F.col("event_id").alias("base_id"), "d", "emb")
    rungs = (tau, *(t for t in LADDER if t < tau))
    return retrieval.nearest(base, corpus.where(F.col("event_id") != event_id), k, rungs, k_min, earlier=as_of)


def density(points: DataFrame, key: str, event_id, most: int = 300) -> DataFrame:
    """The grid of one event, thinned to about `most` points."""
    own = points.where(F.col(key) == event_id)
    n = own.count()
    return own.where(F.col("i") % max(1, n // most) == 0).orderBy("i")


def tail(series: DataFrame, days: int = 365) -> DataFrame:
    """The last days of a series, in order."""
    return series.orderBy(F.desc("d")).limit(days).orderBy("d")


def report(forecasts: DataFrame) -> DataFrame:
    """One line of text per forecast."""
    f = forecasts
    tier = forecast.warning_tier(F.col("std"))
    line = F.concat(
        F.format_string("Median %.1f %%, 90 %% band %.1f to %.1f %% from %d analogues; ", "median", "p5", "p95", "n"),
        F.when(F.col("p_down10") > 0.2, "red flag: a fall of over 10 % is likely; ").otherwise("no red flag; "),
        F.concat(F.lit("early warning "), F.lower(tier), F.lit(".")),
    )
    return f.select("base_id", line.alias("report"))
