"""Densities of forward returns: weights of analogues, mixture posteriors, forecasts and their scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.numbers import normal_pdf


def ranks(sim: Column, base_pct: Column, pct: Column, far: Column, median_far: Column) -> tuple[Column, Column, Column]:
    """Similarity, closeness of the price percentiles, and closeness of the paths; a missing percentile counts a half."""
    near = F.coalesce(F.exp(-0.5 * ((base_pct - pct) / 20) ** 2), F.lit(0.5))
    path = F.exp(-far / F.when(median_far < 1e-6, 1.0).otherwise(median_far))
    return F.pow(F.greatest(sim, F.lit(0.0)), F.lit(0.5)), F.pow(near, F.lit(0.2)), F.pow(path, F.lit(0.3))


def three_rank_weight(sim: Column, base_pct: Column, pct: Column, far: Column, median_far: Column) -> Column:
    """The product of the three ranks."""
    a, b, c = ranks(sim, base_pct, pct, far, median_far)
    return a * b * c


def prior_spread(path: Column) -> Column:
    """The spread of an analogue's prior: the population deviation of its path's steps, one percent at least; null without steps."""
    steps = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda k: F.get(path, k) - F.get(path, k - 1))
    n = F.size(path) - 1
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = add(steps) / n
    return F.when(n > 0, F.greatest(F.sqrt(add(F.transform(steps, lambda x: (x - mean) * (x - mean))) / n), F.lit(1.0)))


def kernel_parts(points: DataFrame, key: str) -> DataFrame:
    """points (key, mu, w) with sigma: Scott's bandwidth of a weighted kernel density, on the effective number of points.

    Points without weight, and keys whose points don't spread, are left out.
    """
    of = Window.partitionBy(key)
    p = points.where("w > 0").withColumns({"__s": F.sum("w").over(of), "__q": F.sum(F.col("w") * F.col("w")).over(of), "__m": F.sum(F.col("w") * F.col("mu")).over(of)})
    off = F.col("mu") - F.col("__m") / F.col("__s")
    p = p.withColumn("__d", F.sqrt(F.sum(F.col("w") * off * off).over(of) / (F.col("__s") - F.col("__q") / F.col("__s"))))
    return p.where("__d > 1e-6").withColumn("sigma", F.col("__d") * F.pow(F.col("__s") * F.col("__s") / F.col("__q"), F.lit(-0.2))).drop("__s", "__q", "__m", "__d")


def mixture(parts: DataFrame, key: str, grid: int = 1000) -> DataFrame:
    """(key, i, x, dens, cdf) of Gaussian mixtures given as rows (key, mu, sigma, w); weights are scaled to one.

    A mixture's grid runs from min(mu - 3 sigma) - 5 to max(mu + 3 sigma) + 5; its points are summed in place, so that what
    is shuffled is one array of parts per key.
    """
    total = parts.groupBy(key).agg(F.collect_list(F.struct("mu", "sigma", "w")).alias("parts"), F.sum("w").alias("sum"), F.min(F.col("mu") - 3 * F.col("sigma")).alias("lo"), F.max(F.col("mu") + 3 * F.col("sigma")).alias("hi"))
    points = total.withColumn("step", (F.col("hi") - F.col("lo") + 10) / (grid - 1)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    points = points.withColumn("x", F.col("lo") - 5 + F.col("i") * F.col("step"))
    dens = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["w"] * normal_pdf(F.col("x"), p["mu"], p["sigma"])) / F.col("sum")
    points = points.select(key, "i", "x", "step", dens.alias("dens"))
    w = Window.partitionBy(key)
    so_far = F.sum("dens").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return points.withColumn("cdf", so_far / F.sum("dens").over(w))


def statistics(points: DataFrame, key: str) -> DataFrame:
    """Quantiles (first grid point that reaches the level), tail probabilities, mean and spread, and number of modes."""
    w = Window.partitionBy(key).orderBy("i")
    rising = F.signum(F.col("dens") - F.lag("dens").over(w))
    points = points.withColumn("top", ((rising > 0) & (F.lead("dens").over(w) <= F.col("dens"))).cast("int"))
    q = [F.min(F.when(F.col("cdf") >= p, F.col("x"))).alias(name) for p, name in ((0.05, "p5"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"))]
    mass = F.col("dens") * F.col("step")
    out = points.groupBy(key).agg(*q, F.sum(F.when(F.col("x") <= -10, mass).otherwise(0.0)).alias("p_down10"), F.sum(F.when(F.col("x") >= 10, mass).otherwise(0.0)).alias("p_up10"), F.sum(F.col("x") * mass).alias("mean"), F.sum(F.col("x") * F.col("x") * mass).alias("second"), F.sum("top").alias("n_modes"))
    return out.withColumn("std", F.sqrt(F.col("second") - F.col("mean") ** 2)).drop("second")


def signal(median: Column, p5: Column, p95: Column, up: float = 2.0, far: float = 5.0) -> Column:
    return F.when((median > up) & (p5 > -far), "LONG").when((median < -up) & (p95 < far), "SHORT").otherwise("NEUTRAL")


def pinball(y: Column, q: Column, tau: float) -> Column:
    e = y - q
    return F.when(e >= 0, tau * e).otherwise((tau - 1) * e)


def red_flag_score(severity: Column, sim10: Column, p_up: Column, p10: Column, tail: Column) -> Column:
    """0 to 100 from severity (1 to 4), similarity, one-sidedness and the tails; each part is cut to a whole number."""
    base = F.when(severity == 1, 5).when(severity == 2, 12).when(severity == 3, 22).otherwise(30)
    capped = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    return base + (20 * capped((sim10 - 0.75) / 0.2)).cast("int") + (25 * F.abs(2 * p_up - 1)).cast("int") + (15 * capped(p10 / 0.3)).cast("int") + (10 * capped(tail / 0.5)).cast("int")


#: The tiers' thresholds on the spread of a 15-day density, in percent.
HIGH, WATCH = 12.221, 8.435


def warning_tier(std: Column, high: float = HIGH, watch: float = WATCH) -> Column:
    return F.when(std >= high, "HIGH").when(std >= watch, "WATCH").otherwise("NORMAL")


def as_arrays(points: DataFrame, key: str) -> DataFrame:
    """(key, xs, ds): the grids of mixture() as one row per key; a grid has a fixed number of points."""
    row = F.array_sort(F.collect_list(F.struct("i", "x", "dens")))
    return points.groupBy(key).agg(row.alias("g")).select(key, F.transform("g", lambda p: p["x"]).alias("xs"), F.transform("g", lambda p: p["dens"]).alias("ds"))


def _pieces(xs: Column, ds: Column) -> Column:
    """Neighbouring grid points as structs (x, d, wide, more): the point, the width from the one before, and the mass between them."""
    points = F.arrays_zip(xs.alias("x"), ds.alias("d"))
    n = F.size(xs)
    return F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: F.struct(b["x"].alias("x"), b["d"].alias("d"), (b["x"] - a["x"]).alias("wide"), (0.5 * (a["d"] + b["d"]) * (b["x"] - a["x"])).alias("more")))


def crps_on_grid(xs: Column, ds: Column, y: Column) -> Column:
    """The integral of (F - H(y))^2 over a stored grid by trapezoids; F is the density's own integral, scaled to end at one."""
    zero, above = F.lit(0.0), lambda x: (x >= y).cast("double")
    start = F.struct(zero.alias("cum"), above(F.get(xs, F.lit(0))).alias("h"), zero.alias("two"), zero.alias("one"), zero.alias("none"))

    def step(s: Column, p: Column) -> Column:
        """Sums of the squared integral, of the integral above y, and of what lies above y; the scale comes last."""
        cum, h, half = s["cum"] + p["more"], above(p["x"]), 0.5 * p["wide"]
        two = s["two"] + half * (s["cum"] * s["cum"] + cum * cum)
        return F.struct(cum.alias("cum"), h.alias("h"), two.alias("two"), (s["one"] + half * (s["cum"] * s["h"] + cum * h)).alias("one"), (s["none"] + half * (s["h"] + h)).alias("none"))

    finish = lambda s: F.when(s["cum"] > 0, s["two"] / (s["cum"] * s["cum"]) - 2 * s["one"] / s["cum"] + s["none"]).otherwise(s["none"])
    return F.when(y.isNotNull() & ~F.isnan(y), F.aggregate(_pieces(xs, ds), start, step, finish))


def density_at(xs: Column, ds: Column, y: Column) -> Column:
    """The density at y, linear between grid points; beyond the grid that of its end."""
    n = F.size(xs)
    k = F.greatest(F.least(F.size(F.filter(xs, lambda x: x <= y)), n - 1), F.lit(1))  # the point at or before y, from 1
    x0, x1, d0, d1 = F.get(xs, k - 1), F.get(xs, k), F.get(ds, k - 1), F.get(ds, k)
    share = F.greatest(F.least((y - x0) / (x1 - x0), F.lit(1.0)), F.lit(0.0))
    return F.when(y.isNotNull() & ~F.isnan(y), d0 + share * (d1 - d0))


def log_score_on_grid(xs: Column, ds: Column, y: Column) -> Column:
    f = density_at(xs, ds, y)
    return F.when(f <= 0, float("-inf")).otherwise(F.log(f))


def quantile_between(tau: float, stored: dict[float, str]) -> Column:
    """The quantile of a level, linear between stored ones (level to column); beyond them that of the nearest."""
    levels = sorted(stored)
    if tau <= levels[0] or tau >= levels[-1]:
        return F.col(stored[levels[0] if tau <= levels[0] else levels[-1]])
    low = max(t for t in levels if t <= tau)
    high = min(t for t in levels if t >= tau)
    a, b = F.col(stored[low]), F.col(stored[high])
    return a if low == high else a + (tau - low) / (high - low) * (b - a)


def peaks(ds: Column) -> Column:
    """Places (from 0) of the local maxima of an array, found in one fold: a flat top counts once, by its middle; ends never do."""
    n = F.size(ds)
    pairs = F.zip_with(F.slice(ds, 1, n - 1), F.slice(ds, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    steps = F.transform(pairs, lambda p, k: F.struct(p["a"].alias("a"), p["b"].alias("b"), (k + 1).alias("i")))
    none = F.lit(None).cast("int")

    def step(s: Column, p: Column) -> Column:
        top = F.floor((s["start"] + p["i"] - 1) / 2).cast("int")
        up = F.struct(p["i"].cast("int").alias("start"), s["found"].alias("found"))
        down = F.struct(none.alias("start"), F.concat(s["found"], F.array(top)).alias("found"))
        return F.when(p["b"] > p["a"], up).when((p["b"] < p["a"]) & s["start"].isNotNull(), down).otherwise(s)

    start = F.struct(none.alias("start"), F.array().cast("array<int>").alias("found"))
    return F.when(n < 3, F.array().cast("array<int>")).otherwise(F.aggregate(steps, start, step)["found"])


def prominence(ds: Column, at: Column) -> Column:
    """How far a peak stands above the higher of the two lowest points on the ways to higher ground, or to the ends."""
    high = F.get(ds, at)

    def low(way: Column) -> Column:
        start = F.struct(high.alias("low"), F.lit(True).alias("open"))
        step = lambda s, x: F.when(s["open"] & (x <= high), F.struct(F.least(s["low"], x).alias("low"), F.lit(True).alias("open"))).otherwise(F.struct(s["low"].alias("low"), F.lit(False).alias("open")))
        return F.aggregate(way, start, step)["low"]

    return high - F.greatest(low(F.reverse(F.slice(ds, F.lit(1), at))), low(F.slice(ds, at + 2, F.size(ds))))


def modes(arrays: DataFrame, least: float = 0.10) -> DataFrame:
    """arrays (xs, ds) with n_peaks, mode1_x, mode2_x, separation and balance: the peaks of a prominence of `least` of the
    highest density or more, and of the two most prominent ones their places, distance and ratio; null with fewer than two."""
    df = arrays.withColumn("__p", F.transform(peaks(F.col("ds")), lambda k: F.struct(prominence(F.col("ds"), k).alias("prom"), k.alias("at"))))
    df = df.withColumn("__p", F.array_sort(F.filter("__p", lambda p: (p["prom"] >= least * F.array_max("ds")) & (F.array_max("ds") > 0))))
    df = df.withColumns({"n_peaks": F.size("__p"), "__a": F.try_element_at("__p", F.lit(-1)), "__b": F.try_element_at("__p", F.lit(-2))})
    x = lambda p: F.get("xs", p)
    first, second = F.least("__a.at", "__b.at"), F.greatest("__a.at", "__b.at")
    two = F.col("n_peaks") >= 2
    df = df.withColumns({"mode1_x": F.when(two, x(first)), "mode2_x": F.when(two, x(second))})
    return df.withColumns({"separation": F.abs(F.col("mode2_x") - F.col("mode1_x")), "balance": F.when(two, F.col("__b.prom") / F.col("__a.prom"))}).drop("__p", "__a", "__b")


def kernels(parts: DataFrame, key: str, low: float, high: float, n: int) -> DataFrame:
    """(key, i, x, dens) of sums of normal kernels given as rows (key, mu, sigma, w), on one grid for all keys.

    Weights aren't scaled. A key's kernels meet in one row and are summed in Arrow batches; they should be a bounded number.
    """
    xs = np.linspace(low, high, n)

    @F.pandas_udf("array<double>")
    def summed(mu: pd.Series, sigma: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for m, s, v in zip(mu, sigma, w, strict=True):
            m, s, v = (np.asarray(a, float) for a in (m, s, v))
            out.append((v / (s * np.sqrt(2 * np.pi)) * np.exp(-0.5 * ((xs[:, None] - m) / s) ** 2)).sum(1))
        return pd.Series(out)

    g = parts.groupBy(key).agg(F.collect_list(F.struct("mu", "sigma", "w")).alias("p"))
    g = g.select(key, F.posexplode(summed("p.mu", "p.sigma", "p.w")).alias("i", "dens"))
    return g.select(key, "i", (low + F.col("i") * ((high - low) / (n - 1))).alias("x"), "dens")


def quantiles_of_parts(parts: DataFrame, key: str, grid: int = 1000, far: float = 10.0) -> DataFrame:
    """(key, n, p5, p25, median, p75, p95, p_down10, p_up10, n_peaks) of Gaussian mixtures given as rows (key, mu, sigma, w).

    The same grid and levels as mixture() and statistics(), summed in Arrow batches where there are too many mixtures to have
    a row for each grid point; tails are trapezoids beyond `far`, peaks stand out by a tenth of the highest density. A key's
    parts should be a bounded number; keys whose weights add up to nothing have no row.
    """
    names = ["p5", "p25", "median", "p75", "p95", "p_down10", "p_up10"]
    levels = np.array([0.05, 0.25, 0.5, 0.75, 0.95])

    def area(d: np.ndarray, x: np.ndarray) -> float:
        return float((0.5 * (d[1:] + d[:-1]) * np.diff(x)).sum()) if len(x) > 1 else 0.0

    @F.pandas_udf(", ".join(f"{c} double" for c in names) + ", n_peaks int")
    def summed(mu: pd.Series, sigma: pd.Series, w: pd.Series) -> pd.DataFrame:
        out = np.empty((len(mu), len(names) + 1))
        for k, (m, s, v) in enumerate(zip(mu, sigma, w, strict=True)):
            m, s, v = (np.asarray(a, float) for a in (m, s, v))
            x = np.linspace((m - 3 * s).min() - 5, (m + 3 * s).max() + 5, grid)
            z = x[None] - m[:, None]
            z *= (1 / (s * np.sqrt(2)))[:, None]
            np.multiply(z, z, out=z)
            np.exp(np.negative(z, out=z), out=z)
            d = (v / v.sum() / (s * np.sqrt(2 * np.pi))) @ z
            cdf = np.cumsum(d)
            down, up = np.searchsorted(x, -far, "right"), np.searchsorted(x, far)
            out[k] = *x[np.minimum(np.searchsorted(cdf / d.sum(), levels), grid - 1)], area(d[:down], x[:down]), area(d[up:], x[up:]), prominent(d)
        return pd.DataFrame(out, columns=[*names, "n_peaks"]).astype({"n_peaks": "int32"})

    g = parts.groupBy(key).agg(F.collect_list(F.struct("mu", "sigma", "w")).alias("p"), F.sum("w").alias("__sum")).where("__sum > 0")
    return g.select(key, F.size("p").cast("long").alias("n"), summed("p.mu", "p.sigma", "p.w").alias("q")).select(key, "n", *(f"q.{c}" for c in names), "q.n_peaks")


def prominent(d: np.ndarray, least: float = 0.10) -> int:
    """The number of peaks that modes() counts in a density: a flat top counts once, ends never do, and a peak stands out by
    `least` of the highest density."""
    fresh = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])  # a flat stretch is one point
    v = d[fresh]
    tops = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    found, most = 0, d.max()
    if not most > 0:
        return 0
    for k in tops[v[tops] >= least * most].tolist():
        low = []
        for way in (v[:k][::-1], v[k + 1 :]):
            higher = np.flatnonzero(way > v[k])
            low.append(way[: higher[0]].min() if len(higher) else way.min())
        found += bool(v[k] - max(low) >= least * most)
    return found


#: The least density in a divergence, and the spread of what came: a share of its amount, this many percent at least.
THIN, SHARE, NARROW = 1e-10, 0.05, 0.2


def _area(v: np.ndarray, x: np.ndarray) -> float:
    return float((0.5 * (v[1:] + v[:-1]) * np.diff(x)).sum())


def divergence(p: np.ndarray, q: np.ndarray, x: np.ndarray) -> tuple[float, float, float]:
    """Of density p from q on an even grid: relative entropy, the divergence of Jensen and Shannon, and the area between their integrals."""
    thick = lambda v: np.maximum(v, THIN)
    kl = _area(thick(p) * np.log(thick(p) / thick(q)), x)
    a, b = (thick(v / (_area(v, x) + THIN)) for v in (p, q))
    m = 0.5 * (a + b)
    js = 0.5 * _area(a * np.log(a / m), x) + 0.5 * _area(b * np.log(b / m), x)
    cdf = [np.clip(np.cumsum(v) * (x[1] - x[0]), 0, 1) for v in (p, q)]
    return kl, js, _area(np.abs(cdf[0] - cdf[1]), x)


def efficiencies(df: DataFrame, narrow: float = NARROW) -> DataFrame:
    """df (xs, ds, y, sigma) with fei_kl, fei_js, fei_w1: how much farther a normal around zero of spread sigma is from what
    came than the density on the grid; above one the density was nearer. What came is a narrow normal around y. Null without
    a positive sigma, an outcome, or a distance of the density's own."""

    @F.pandas_udf("fei_kl double, fei_js double, fei_w1 double")
    def ratios(xs: pd.Series, ds: pd.Series, y: pd.Series, sigma: pd.Series) -> pd.DataFrame:
        out = []
        for x, d, came, s in zip(xs, ds, y, sigma, strict=True):
            if x is None or d is None or len(x) < 3 or not np.isfinite(came if came is not None else np.nan) or not (s is not None and np.isfinite(s) and s > 0):
                out.append((None,) * 3)
                continue
            x, d = np.asarray(x, float), np.asarray(d, float)
            bell = lambda mu, sd: (lambda v: v / (_area(v, x) + THIN))(np.exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * np.sqrt(2 * np.pi)))  # noqa: B023, E731
            came = bell(came, max(abs(came) * SHARE, narrow))
            own, other = divergence(d / (_area(d, x) + THIN), came, x), divergence(bell(0.0, s), came, x)
            out.append(tuple(b / a if a > THIN else None for a, b in zip(own, other, strict=True)))
        return pd.DataFrame(out, columns=["fei_kl", "fei_js", "fei_w1"]).astype(float)

    return df.withColumn("__r", ratios("xs", "ds", "y", "sigma")).select(*df.columns, "__r.*")
