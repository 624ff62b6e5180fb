"""Interval benchmarks of a price series: the GARCH family, filtered history, and plain kernel densities, at any days.

Each asked day looks back over a bounded stretch of its series. Days are grouped by quarter and series, and the windows of a
group are fitted side by side: parameters of all windows and all starts are one array, over which the recursion runs once.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days that a fit looks back, fewest prices, days by which a price may miss the asked day, windows fitted at once.
BACK, FEWEST, MISS, ABREAST = 500, 100, 5, 32
#: Days and fewest prices of the rolling density, simulated paths, days of a group of asked days.
ROLLING, FEW, PATHS, GROUP = 250, 30, 200, 91
MODELS = ("garch", "egarch", "gjr")
#: Places of the coarse search, as (alpha, beta) or (alpha, gamma, beta), the starts that are refined, rounds, first steps.
COARSE = {
    "garch": list(itertools.product((0.02, 0.06, 0.12, 0.25, 0.4), (0.05, 0.3, 0.55, 0.75, 0.87, 0.94))),
    "gjr": list(itertools.product((0.02, 0.08, 0.2), (0.0, 0.1, 0.25), (0.05, 0.4, 0.7, 0.85, 0.93))),
    "egarch": list(itertools.product((-0.1, 0.05, 0.15, 0.3, 0.5), (-0.3, 0.1, 0.5, 0.75, 0.9, 0.97))),
}
STARTS, ROUNDS, STEP, SHRINK = 4, 16, 0.06, 0.7
ROOT_2_PI, ABS_Z = math.sqrt(2 * math.pi), math.sqrt(2 / math.pi)
Q5 = 1.6448536269514722


def allowed(model: str, p: np.ndarray) -> np.ndarray:
    """Where the parameters (..., k) give a variance that is positive and comes back to its mean."""
    if model == "egarch":
        return np.abs(p[..., 1]) < 0.999
    if model == "gjr":
        a, g, b = p[..., 0], p[..., 1], p[..., 2]
        return (a >= 0) & (a + g >= 0) & (b >= 0) & (a + g / 2 + b < 0.999)
    return (p[..., 0] >= 0) & (p[..., 1] >= 0) & (p[..., 0] + p[..., 1] < 0.999)


def step(model: str, p: np.ndarray, v: np.ndarray, h: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The next variance; v is the mean one, which fixes the constant."""
    if model == "egarch":
        a, b = p[..., 0], p[..., 1]
        return np.exp(np.clip((1 - b) * np.log(v) + a * (np.abs(r) / np.sqrt(h) - ABS_Z) + b * np.log(h), -60, 60))
    if model == "gjr":
        a, g, b = p[..., 0], p[..., 1], p[..., 2]
        return v * (1 - a - g / 2 - b) + (a + g * (r < 0)) * r * r + b * h
    return v * (1 - p[..., 0] - p[..., 1]) + p[..., 0] * r * r + p[..., 1] * h


def run(model: str, r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss, next variance) of parameters p (windows, lanes, k) over returns r (windows, days), whose windows end alike and
    have NaN before their start. The loss is twice the negative log likelihood without its constant."""
    known = ~np.isnan(r)
    v = np.broadcast_to(np.nanvar(r, axis=1)[:, None], p.shape[:2])
    h, loss = v.copy(), np.zeros(p.shape[:2])
    for t in range(r.shape[1]):
        on = known[:, t][:, None]
        x = np.where(on, np.nan_to_num(r[:, t])[:, None], 0.0)
        loss += np.where(on, np.log(h) + x * x / h, 0.0)
        h = np.where(on, step(model, p, v, h, x), h)
    return np.where(allowed(model, p), loss, np.inf), h


def fitted(model: str, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameters, loss, next variance) of each window: a coarse search, then its best places refined by shrinking steps.

    Nothing is random, and a window's result doesn't depend on the windows beside it.
    """
    coarse = np.array(COARSE[model])
    p = np.broadcast_to(coarse, (len(r), *coarse.shape))
    with np.errstate(all="ignore"):
        loss, _ = run(model, r, p)
        best = np.argsort(loss, axis=1, kind="stable")[:, :STARTS]
        at = np.take_along_axis(p, best[:, :, None], 1).copy()
        moves = np.array(list(itertools.product((0, -1, 1), repeat=coarse.shape[1])), float)
        for k in range(ROUNDS):
            near = at[:, :, None, :] + moves * (STEP * SHRINK**k)
            loss, _ = run(model, r, near.reshape(len(r), -1, coarse.shape[1]))
            which = loss.reshape(len(r), STARTS, -1).argmin(2)
            at = np.take_along_axis(near, which[:, :, None, None], 2)[:, :, 0]
        loss, h = run(model, r, at)
    best = loss.argmin(1)
    rows = np.arange(len(r))
    return at[rows, best], loss[rows, best], h[rows, best]


def ahead(model: str, p: np.ndarray, v: float, h: float, horizon: int, seed: str) -> float:
    """The variance of the day `horizon` days ahead: in closed form for garch, else the mean over simulated paths.

    The draws follow from the seed's text, so they repeat wherever a window is fitted.
    """
    if model == "garch":
        return v + (p[0] + p[1]) ** (horizon - 1) * (h - v)
    draw = np.random.default_rng(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little"))
    now = np.full(PATHS, h)
    for _ in range(horizon - 1):
        now = step(model, np.broadcast_to(p, (PATHS, len(p))), np.full(PATHS, v), now, np.sqrt(now) * draw.standard_normal(PATHS))
    return float(now.mean())


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def of_normal(sigma: float) -> tuple:
    return sigma, -Q5 * sigma, Q5 * sigma, normal_cdf(-10 / sigma), 1 - normal_cdf(10 / sigma)


def of_kernels(points: np.ndarray, n: int = 1000) -> tuple:
    """The same from a kernel density with Silverman's bandwidth, on a grid five beyond the points; None without spread."""
    s = points.std(ddof=1) if len(points) > 1 else 0.0
    if not np.isfinite(s) or s <= 1e-12:
        return (None,) * 5
    width = s * (len(points) * 0.75) ** -0.2
    xs = np.linspace(points.min() - 5, points.max() + 5, n)
    cdf = np.zeros(n)
    for k in range(0, len(points), 512):
        cdf += np.exp(-0.5 * ((xs[:, None] - points[k : k + 512]) / width) ** 2).sum(1)
    cdf = np.cumsum(cdf) / cdf.sum()
    at = lambda q: float(xs[min(np.searchsorted(cdf, q), n - 1)])
    below = lambda x: float(cdf[max(np.searchsorted(xs, x, "right") - 1, 0)]) if x >= xs[0] else 0.0
    return None, at(0.05), at(0.95), below(-10.0), 1 - below(10.0)


SCHEMA = "model string, sigma double, p5 double, p95 double, p_down10 double, p_up10 double"


def benchmarks(asks: DataFrame, series: DataFrame, key: str, horizon: int = 15) -> DataFrame:
    """(key, d, model, sigma, p5, p95, p_down10, p_up10): intervals of the percent return over `horizon` days from each asked day.

    asks is (key, d), series (key, d, px). Models: garch, egarch and gjr over the BACK days up to the price nearest to the
    day, fhs (the residuals of garch as a density, scaled ahead), kde_rolling and kde_all (densities of the returns over as
    many rows in ROLLING days, and since the start). Days without a price nearby, or with too few before, have no row.
    """
    kind = series.schema[key].dataType.simpleString()
    block = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / GROUP)
    asks = asks.where(F.col(key).isNotNull() & F.col("d").isNotNull()).select(key, "d").distinct().withColumn("block", block(F.col("d")))
    # a price goes to every group of days that may look back on it
    last = asks.groupBy(key).agg(F.max("block").alias("last"))
    known = series.where("d is not null and px is not null and px <> 0").select(key, "d", "px").join(F.broadcast(last), key)
    first = block(F.date_sub("d", MISS))
    known = known.where(first <= F.col("last")).select(key, "d", "px", F.explode(F.sequence(first, "last")).alias("block"))

    def found(asked: pd.DataFrame, prices: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or prices.empty:
            return pd.DataFrame(columns=[key, "d", *(x.split()[0] for x in SCHEMA.split(", "))])
        prices = prices.sort_values("d")
        days, px = pd.to_datetime(prices["d"]).to_numpy().astype("datetime64[D]").astype(int), prices["px"].to_numpy(float)
        name, jobs, rows = asked[key].iloc[0], [], []
        for day in sorted(asked["d"]):
            d = int(np.datetime64(day, "D").astype(int))
            near = np.abs(days - d).argmin()  # the earlier of two days equally far
            if abs(days[near] - d) > MISS:
                continue
            old = px[: near + 1]
            for model, since in (("kde_rolling", days[near] - ROLLING - horizon - 30), ("kde_all", days[0])):
                p = old[days[: near + 1] >= since]
                if len(p) >= FEW and len(p) > horizon + 1:
                    rows.append((name, day, model, *of_kernels(100 * (p[horizon:] - p[:-horizon]) / np.abs(p[:-horizon]))))
            p = old[days[: near + 1] >= days[near] - BACK]
            if len(p) >= FEWEST:
                r = 100 * (p[1:] / p[:-1] - 1)
                if r.var() > 0:
                    jobs.append((day, r - r.mean()))
        for k in range(0, len(jobs), ABREAST):
            part = jobs[k : k + ABREAST]
            r = np.full((len(part), max(len(x) for _, x in part)), np.nan)
            for i, (_, x) in enumerate(part):
                r[i, r.shape[1] - len(x) :] = x
            for model in MODELS:
                p, _, h = fitted(model, r)
                for i, (day, x) in enumerate(part):
                    sigma = math.sqrt(max(ahead(model, p[i], x.var(), h[i], horizon, f"{model}:{name}:{day}"), 0.0) * horizon)
                    if 0 < sigma < float("inf"):
                        rows.append((name, day, model, *of_normal(sigma)))
                    if model == "garch":
                        rows.append((name, day, "fhs", *of_kernels(residuals(x, p[i]) * math.sqrt(h[i] * horizon))))
        return pd.DataFrame(rows, columns=[key, "d", *(x.split()[0] for x in SCHEMA.split(", "))])

    return asks.groupBy(key, "block").cogroup(known.groupBy(key, "block")).applyInPandas(found, f"{key} {kind}, d date, {SCHEMA}")


def residuals(r: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Returns in units of the garch variance of their day."""
    h, out = r.var(), np.zeros(len(r))
    v = h
    for t, x in enumerate(r):
        out[t] = x / math.sqrt(h)
        h = v * (1 - p[0] - p[1]) + p[0] * x * x + p[1] * h
    return out
