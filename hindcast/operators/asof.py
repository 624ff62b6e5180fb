"""As-of and band joins on dates, without a shuffle of every pair.

Both sides are dealt out by a coarse bucket of their day. A row looks into the buckets that its band reaches, so the
number of candidates per row is bounded by the band, not by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _day(c: Column | str) -> Column:
    return F.datediff(F.col(c) if isinstance(c, str) else c, F.lit("1970-01-01").cast("date"))


def band_join(left: DataFrame, right: DataFrame, on: str, other: str, before: int, after: int, how: str = "inner") -> DataFrame:
    """Pairs with other between `before` days before and `after` days after left's `on`, both ends included.

    how is inner or left. Rows with a null date have no partner. Column names of the two sides must differ.
    """
    width = max(1, before + after)
    reach = F.sequence(F.floor((_day(on) - before) / width), F.floor((_day(on) + after) / width))
    spread = left.withColumn("__bucket", F.explode(F.when(F.col(on).isNotNull(), reach)) if how == "inner" else F.explode_outer(F.when(F.col(on).isNotNull(), reach)))
    if how == "left":
        keyed = left.withColumn("__row", F.monotonically_increasing_id())
        inner = band_join(keyed, right, on, other, before, after)
        return keyed.join(inner.select("__row", *right.columns), "__row", "left").drop("__row")
    found = right.withColumn("__b", F.floor(_day(other) / width))
    gap = _day(other) - _day(on)
    return spread.join(found, (F.col("__bucket") == F.col("__b")) & gap.between(-before, after)).drop("__bucket", "__b")


def overlap_join(left: DataFrame, right: DataFrame, span: tuple[str, str], other: tuple[str, str], days: int = 31) -> DataFrame:
    """Pairs of rows whose spans of days have a day in common, both ends included; spans of any length.

    A span is in every stretch of `days` that it touches, and a pair is met in the first stretch that both are in. Rows with
    a null end have no partner. Column names of the two sides must differ.
    """
    stretch = lambda c: F.floor(_day(c) / days)
    spread = lambda df, a, b, out: df.where(F.col(a) <= F.col(b)).withColumn(out, F.explode(F.sequence(stretch(a), stretch(b))))
    a, b = spread(left, *span, "__a"), spread(right, *other, "__b")
    met = (F.col("__a") == F.col("__b")) & (F.col(span[0]) <= F.col(other[1])) & (F.col(other[0]) <= F.col(span[1])) & (F.col("__a") == F.greatest(stretch(span[0]), stretch(other[0])))
    return a.join(b, met).drop("__a", "__b")


def asof(left: DataFrame, series: DataFrame, on: str, day: str, value: str, direction: str = "backward", within: int | None = None, by: list[str] | None = None) -> DataFrame:
    """left with the series' `day` and `value` that are nearest to `on`: at or before it, at or after it, or either way.

    nearest takes the earlier of two days equally far. Null values count as missing days. Without a partner both are null.
    Keys of `left` must be unique: `by` names them, by default all its columns. The backward and forward joins merge both
    sides in one sorted pass over each bucket of days; nearest needs a tolerance.
    """
    keys = by or left.columns
    known = series.where(F.col(value).isNotNull()).select(F.col(day).alias("__d"), F.col(value).alias("__v"))
    if direction == "nearest":
        if within is None:
            raise ValueError("nearest needs a tolerance")
        pairs = band_join(left.select(*keys, *([] if on in keys else [on])), known, on, "__d", within, within)
        gap = F.abs(F.datediff("__d", on))
        best = pairs.groupBy(*keys).agg(F.min_by(F.struct("__d", "__v"), F.struct(gap, F.col("__d"))).alias("__best"))
    else:
        sign = 1 if direction == "backward" else -1
        months = F.date_trunc("year", F.col("__at"))
        marks = known.select(F.col("__d").alias("__at"), "__d", "__v")
        asks = left.select(F.col(on).alias("__at")).where(F.col("__at").isNotNull()).distinct()
        # the last known day of each year goes into the next ones, so that a year's rows suffice
        ends = known.groupBy(F.date_trunc("year", "__d").alias("__year")).agg(F.max_by(F.struct("__d", "__v"), F.col("__d") if sign == 1 else -_day("__d")).alias("__last"))
        years = Window.orderBy(F.col("__year") if sign == 1 else F.col("__year").desc()).rowsBetween(Window.unboundedPreceding, -1)
        asked = asks.select(months.alias("__year")).distinct().join(ends, "__year", "full")
        carried = asked.withColumn("__carry", F.last("__last", True).over(years)).select("__year", "__carry")
        merged = marks.unionByName(asks, allowMissingColumns=True).withColumn("__year", months)
        order = Window.partitionBy("__year").orderBy(F.col("__at") if sign == 1 else F.col("__at").desc(), F.col("__d").isNull())
        seen = merged.withColumn("__seen", F.last(F.when(F.col("__d").isNotNull(), F.struct("__d", "__v")), True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        best = seen.where(F.col("__d").isNull()).join(carried, "__year", "left").select(F.col("__at").alias(on), F.coalesce("__seen", "__carry").alias("__best"))
        if within is not None:
            best = best.where(F.abs(F.datediff(F.col("__best.__d"), F.col(on))) <= within)
        keys = [on]
    return left.join(best, keys, "left").withColumns({day: F.col("__best.__d"), value: F.col("__best.__v")}).drop("__best")
