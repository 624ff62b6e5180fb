"""Time-series operators over a daily series (d, px), in windows.

A market has some thousands of days; where a window runs over one series it is named by `by`, so that many series are
spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(by: list[str] | None = None, day: str = "d") -> WindowSpec:
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(day)


def filled(c: str, window: WindowSpec, limit: int | None = None) -> Column:
    """The last value that isn't null, at most `limit` rows back."""
    start = Window.unboundedPreceding if limit is None else -limit
    return F.last(c, True).over(window.rowsBetween(start, 0))


def rolling(f: Column, n: int, window: WindowSpec, counted: str) -> Column:
    """A window aggregate over n rows, null until the window holds n values."""
    frame = window.rowsBetween(-(n - 1), 0)
    return F.when(F.count(counted).over(frame) == n, f.over(frame))


def indicators(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """series with sma_7, bollinger_upper and _lower (20 days, two standard deviations) and rsi_14 (simple means)."""
    w = over(by)
    mean, dev = rolling(F.avg("px"), 20, w, "px"), rolling(F.stddev_samp("px"), 20, w, "px")
    series = series.withColumn("__change", F.col("px") - F.lag("px").over(w))
    series = series.withColumns({"__gain": F.greatest("__change", F.lit(0.0)), "__loss": F.greatest(-F.col("__change"), F.lit(0.0))})
    series = series.withColumns({"__g": F.when(F.col("__change").isNotNull(), F.col("__gain")), "__l": F.when(F.col("__change").isNotNull(), F.col("__loss"))})
    gain, loss = rolling(F.avg("__g"), 14, w, "__g"), rolling(F.avg("__l"), 14, w, "__l")
    out = series.withColumns({"sma_7": rolling(F.avg("px"), 7, w, "px"), "bollinger_upper": mean + 2 * dev, "bollinger_lower": mean - 2 * dev, "rsi_14": 100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))})
    return out.drop("__change", "__gain", "__loss", "__g", "__l")


def ema(series: DataFrame, span: int = 7, by: list[str] | None = None) -> DataFrame:
    """series with ema: e(0) = x(0), e(t) = a x(t) + (1 - a) e(t-1), a = 2 / (span + 1).

    The recursion is cut where its weight falls below 1e-14, which leaves a bounded window.
    """
    a = 2 / (span + 1)
    far, weight = 0, 1.0
    while weight > 1e-14:
        far, weight = far + 1, weight * (1 - a)
    w = over(by)
    past = F.collect_list("px").over(w.rowsBetween(-far, 0))
    held = F.aggregate(F.slice(past, 2, far + 1), F.get(past, F.lit(0)), lambda e, x: (1 - a) * e + a * x)
    return series.withColumn("ema", held)


def percentile_rank(asks: DataFrame, series: DataFrame, on: str, level: str, days: int = 1825, fewest: int = 50, keys: list[str] | None = None) -> DataFrame:
    """Percent of the series in the `days` up to `on` that is below `level`; null with fewer than `fewest` values."""
    from hindcast.operators.asof import band_join

    keys = keys or asks.columns
    pairs = band_join(asks, series.select(F.col("d").alias("__d"), F.col("px").alias("__px")), on, "__d", days, 0)
    rank = F.avg((F.col("__px") < F.col(level)).cast("double")) * 100
    return pairs.groupBy(*keys).agg(F.when(F.count("__px") >= fewest, rank).alias("rank_pct"))


def year_bands(series: DataFrame) -> DataFrame:
    """(yr, q5, q20, q30, q40, q60, q80, q90): exact linear quantiles of each calendar year."""
    cuts = (5, 20, 30, 40, 60, 80, 90)
    q = F.percentile("px", F.array(*(F.lit(c / 100) for c in cuts)))
    return series.groupBy(F.year("d").alias("yr")).agg(q.alias("q")).select("yr", *(F.col("q")[k].alias(f"q{c}") for k, c in enumerate(cuts)))


#: Labels of a price band within its year.
BANDS = ("0%-5%", "5%-20%", "20%-30%", "30%-40%", "40%-60%", "60%-80%", "80%-90%", "90%-100%")


def band_of(px: Column, cuts: list[Column]) -> Column:
    """The label of the first cut above the price."""
    out = F.when(px.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, BANDS, strict=False):
        out = out.when(px < cut, label)
    return out.otherwise(BANDS[-1])


def equity(trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """trades (d, pnl in percent) with cum_sum, equity (compounded) and drawdown from the running maximum."""
    rows = over(by).rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumns({"cum_sum": F.sum("pnl").over(rows), "equity": F.exp(F.sum(F.log(1 + F.col("pnl") / 100)).over(rows))})
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(rows) - 1)
