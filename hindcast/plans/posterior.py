"""Posterior densities of forward returns: the whole chain from analogues over weights and mixtures to coverage and signals.

Each analogue is a normal distribution around its own 15-day return. Its spread is that of the daily steps of its price
path before the event, one percent at least; its weight has three ranks: similarity, closeness of the price percentiles of
five years, and closeness of the paths by dynamic time warping. SQL has no warping, so the queries with SQL leave the third
rank out and one more query has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators import asof, forecast, retrieval, series
from hindcast.plans.analogues import RETRIEVED, RETURNS, retrieved
from hindcast.plans.market import NEAREST, asked, forward, r6
from hindcast.sources import shared, views
from hindcast.sources.views import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
VIEWS = ("train", "test", "prices")
FEWEST, GRID, FLAG = 5, 1000, 0.2


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *VIEWS)
        return f

    return add


def percentiles(spark, sf, px: DataFrame | None = None) -> DataFrame:
    """(d, pct): the rank of the price at each day with an event in the five years before it; null with too few days."""
    px = px if px is not None else views.prices(spark, sf)
    days = asked(spark, sf).select("d").where("d is not null").distinct()
    now = asof.asof(days, px.select(F.col("d").alias("d0"), F.col("px").alias("p0")), "d", "d0", "p0", "nearest", 5)
    rank = series.percentile_rank(now.where("p0 is not null").select("d", "p0"), px, "d", "p0", keys=["d"])
    return rank.withColumnRenamed("rank_pct", "pct")


def paths(spark, sf, px: DataFrame | None = None) -> DataFrame:
    """(d, path, sigma): prices of the 15 days up to each day with an event in percent of the first, and the spread of their steps."""
    px = px if px is not None else views.prices(spark, sf)
    days = asked(spark, sf).select(F.col("d").alias("ed")).where("ed is not null").distinct()
    p = asof.band_join(days, px, "ed", "d", 15, 0)
    path = F.transform(F.array_sort(F.collect_list(F.struct("d", "px"))), lambda x: x["px"])
    p = p.groupBy("ed").agg(path.alias("px")).select(F.col("ed").alias("d"), F.transform("px", lambda x: 100 * (x / F.col("px")[0] - 1)).alias("path"))
    return p.withColumn("sigma", forecast.prior_spread(F.col("path")))


def prices(spark, sf) -> DataFrame:
    """The price of every day, summed once from the orders for all that reads it."""
    return shared.checkpointed(views.prices(spark, sf))


def parts(spark, sf, near_paths: bool = False, px: DataFrame | None = None, horizons: tuple[int, ...] = (15,)) -> DataFrame:
    """(base_id, horizon, event_id, d, sim, mu, sigma, w, w_sim, w_pct, w_path): the weighted normal distributions of each test
    event with FEWEST analogues or more; w is the product of the three ranks, of which w_path is 1 without near_paths."""
    px = px if px is not None else prices(spark, sf)
    ret = forward(spark, sf, horizons, px=px).where("r is not null").select("event_id", "d", "horizon", F.col("r").alias("mu"))
    # what depends on the day is joined by day, from tables as long as the calendar
    pct, path = percentiles(spark, sf, px), paths(spark, sf, px)
    of_day = path.join(pct, "d", "full") if near_paths else path.select("d", "sigma").join(pct, "d", "full")
    of_day = shared.checkpointed(of_day)
    a = retrieved(spark, sf).join(ret, "event_id").join(F.broadcast(of_day), "d", "left")
    a = a.join(asked(spark, sf).select(F.col("event_id").alias("base_id"), F.col("d").alias("bd")), "base_id")
    base = of_day.select(F.col("d").alias("bd"), F.col("pct").alias("base_pct"), *([F.col("path").alias("base_path")] if near_paths else []))
    a = a.join(F.broadcast(base), "bd", "left")
    per_base = Window.partitionBy("base_id", "horizon")
    if near_paths:
        a = retrieval.with_dtw(a, "base_path", "path")
        far, median = F.coalesce("dtw", F.lit(0.0)), F.coalesce(F.median("dtw").over(per_base), F.lit(1.0))
    else:
        far = median = F.lit(0.0)
    ranks = forecast.ranks(F.col("sim"), F.col("base_pct"), F.col("pct"), far, median)
    a = a.withColumns({"w": ranks[0] * ranks[1] * ranks[2], "w_sim": ranks[0], "w_pct": ranks[1], "w_path": ranks[2]})
    a = a.withColumn("n", F.count(F.lit(1)).over(per_base)).where(f"n >= {FEWEST}")
    return a.select("base_id", "horizon", "event_id", "d", "sim", "mu", F.coalesce("sigma", F.lit(1.0)).alias("sigma"), "w", "w_sim", "w_pct", "w_path")


def posterior(p: DataFrame, grid: int = GRID) -> DataFrame:
    """Statistics of the mixture of each base_id; where all weights are zero, all count alike."""
    even = F.sum("w").over(Window.partitionBy("base_id")) <= 0
    return forecast.statistics(forecast.mixture(p.withColumn("w", F.when(even, 1.0).otherwise(F.col("w"))), "base_id", grid), "base_id")


def judged(spark, sf, near_paths: bool = False) -> DataFrame:
    """Statistics with the realised return, coverage of 90 and 50 percent, red flag and signal."""
    px = prices(spark, sf)
    p = parts(spark, sf, near_paths, px)
    ret = forward(spark, sf, (15,), px=px).where("r is not null").select(F.col("event_id").alias("base_id"), F.col("r").alias("realised"))
    inside = lambda a, b: F.col("realised").between(F.col(a), F.col(b)).cast("int")
    out = posterior(p).join(ret, "base_id")
    return out.withColumns({"covers_90": inside("p5", "p95"), "covers_50": inside("p25", "p75"), "red_flag": (F.col("p_down10") > FLAG).cast("int"), "signal": forecast.signal(F.col("median"), F.col("p5"), F.col("p95"), 2.0, 60.0)})


PCT = f"""select x.event_id, case when count(*) >= 50 then 100 * avg((p.px < x.px)::int) end as pct from ({NEAREST.format(h=0, k=5)}) x join prices p on p.d between x.d - 1825 and x.d group by 1"""
SIGMA = """select event_id, greatest(stddev_pop(s), 1.0) as sigma from (select event_id, 100 * (px - lag(px) over w) / first_value(px) over w as s from (select m.event_id, p.d, p.px from memory m join prices p on p.d between m.d - 15 and m.d) window w as (partition by event_id order by d)) group by 1"""
THREE = "pow(greatest(a.sim, 0), 0.5) * pow(coalesce(exp(-0.5 * ((pb.pct - pa.pct) / 20) ** 2), 0.5), 0.2)"


def with_parts(weight: str = THREE, sigma: str = "coalesce(s.sigma, 1.0)") -> str:
    return f"""{RETRIEVED}, ret as ({RETURNS}), pct as ({PCT}), sig as ({SIGMA}), every as (select a.base_id, a.sim, r.r as mu, {sigma} as sigma, {weight} as w, count(*) over (partition by a.base_id) as n
  from analogues a join ret r on r.event_id = a.event_id and r.r is not null left join pct pa on pa.event_id = a.event_id left join pct pb on pb.event_id = a.base_id left join sig s on s.event_id = a.event_id),
p as (select * from every where n >= {FEWEST})"""


def with_statistics(grid: int = GRID) -> str:
    """From p (base_id, mu, sigma, w) to st, the statistics of each mixture."""
    return f""", t as (select base_id, sum(w) as s, min(mu - 3 * sigma) as lo, max(mu + 3 * sigma) as hi from p group by 1),
g as (select base_id, i, s, lo - 5 + i * (hi - lo + 10) / {grid - 1} as x, (hi - lo + 10) / {grid - 1} as step from t cross join (select unnest(range({grid})) as i)),
dn as (select g.base_id, i, x, step, sum(w * exp(-0.5 * ((x - mu) / sigma) ** 2) / (sigma * sqrt(2 * pi()))) / any_value(s) as dens from g join p using (base_id) group by 1, 2, 3, 4),
cd as (select *, sum(dens) over (partition by base_id order by i) / sum(dens) over (partition by base_id) as cdf from dn),
st as (select base_id, min(x) filter (where cdf >= 0.05) as p5, min(x) filter (where cdf >= 0.25) as p25, min(x) filter (where cdf >= 0.5) as median, min(x) filter (where cdf >= 0.75) as p75, min(x) filter (where cdf >= 0.95) as p95,
  coalesce(sum(dens * step) filter (where x <= -10), 0) as p_down10, sum(x * dens * step) as mean from cd group by 1)"""


SHOWN = ("p5", "median", "p95", "p_down10", "mean")
ROUNDED = ", ".join(f"round({c}, 4) as {c}" for c in SHOWN)


def rounded(df: DataFrame) -> DataFrame:
    return df.select("base_id", *(F.round(c, 4).alias(c) for c in SHOWN))


@query(f"{with_parts()} {with_statistics()} select base_id, {ROUNDED} from st")
def mixture_posterior(spark, sf):
    """The mixture of all analogues of each test event, each with its own spread."""
    return rounded(posterior(parts(spark, sf)))


SIGNAL = "case when median > 2 and p5 > -60 then 'LONG' when median < -2 and p95 < 60 then 'SHORT' else 'NEUTRAL' end"


@query(
    f"""{with_parts()} {with_statistics()} select st.base_id, {ROUNDED}, round(r.r, 6) as realised, (r.r between p5 and p95)::int as covers_90, (r.r between p25 and p75)::int as covers_50, (p_down10 > {FLAG})::int as red_flag, {SIGNAL} as signal
    from st join ret r on r.event_id = st.base_id and r.r is not null"""
)
def posterior_signals(spark, sf):
    """From analogues to coverage: percentiles, flags and signals are read from the density, not from the sample."""
    f = judged(spark, sf)
    return f.select("base_id", *(F.round(c, 4).alias(c) for c in SHOWN), r6("realised", "realised"), "covers_90", "covers_50", "red_flag", "signal")


@query()
def posterior_with_paths(spark, sf):
    """posterior_signals with all three ranks; the warping has no SQL."""
    f = judged(spark, sf, True)
    return f.select("base_id", *(F.round(c, 4).alias(c) for c in SHOWN), r6("realised", "realised"), "covers_90", "covers_50", "red_flag", "signal")


@query()
def dtw_weights(spark, sf):
    """The three-rank weights of each test event's analogues, which add up to one."""
    p = parts(spark, sf, True)
    return p.select("base_id", "event_id", r6(F.col("w") / F.sum("w").over(Window.partitionBy("base_id")), "weight"))


@query(
    f"""{with_parts()} {with_statistics()}, full_ as (select * from st), counted as (select base_id, mu, sigma, 1.0 as w from p), one as (select * from full_)
    select a.base_id, round(a.median - b.median, 4) as median_moves, round(a.p_down10 - b.p_down10, 4) as tail_moves, (abs(a.median - b.median) > 0.25)::int as differs
    from one a join (select base_id, min(x) filter (where cdf >= 0.5) as median, coalesce(sum(dens * step) filter (where x <= -10), 0) as p_down10 from
      (select *, sum(dens) over (partition by base_id order by i) / sum(dens) over (partition by base_id) as cdf from
        (select g.base_id, i, x, step, avg(exp(-0.5 * ((x - mu) / sigma) ** 2) / (sigma * sqrt(2 * pi()))) as dens from g join counted using (base_id) group by 1, 2, 3, 4)) group by 1) b using (base_id)"""
)
def config_difference(spark, sf):
    """How the weighted posterior differs from the one in which all analogues count alike, event by event."""
    p = parts(spark, sf)
    one, two = (posterior(x).select("base_id", F.col("median").alias(f"m{k}"), F.col("p_down10").alias(f"t{k}")) for k, x in enumerate((p, p.withColumn("w", F.lit(1.0)))))
    moved = F.col("m0") - F.col("m1")
    return one.join(two, "base_id").select("base_id", F.round(moved, 4).alias("median_moves"), F.round(F.col("t0") - F.col("t1"), 4).alias("tail_moves"), (F.abs(moved) > 0.25).cast("int").alias("differs"))


@query(
    f"""{with_parts("sqrt(greatest(a.sim, 0))", "1.0")}, m0 as (select base_id, mu, w, sum(w) over b as sw, sum(w * w) over b as sw2, sum(w * mu) over b / sum(w) over b as m from p where w > 0 window b as (partition by base_id)),
    m1 as (select *, sqrt(sum(w * (mu - m) ** 2) over (partition by base_id) / (sw - sw2 / sw)) as sd, pow(sw * sw / sw2, -0.2) as factor from m0), kde as (select base_id, mu, sd * factor as sigma, w from m1 where sd > 1e-6)
    {with_statistics().replace("from p ", "from kde ").replace("join p ", "join kde ")} select base_id, {ROUNDED} from st"""
)
def weighted_kde(spark, sf):
    """A weighted kernel density of the analogues' returns: Scott's bandwidth on the effective number of them."""
    p = parts(spark, sf).select("base_id", "mu", F.sqrt(F.greatest("sim", F.lit(0.0))).alias("w"))
    return rounded(posterior(forecast.kernel_parts(p, "base_id")))


@query(
    f"""{with_parts("sqrt(greatest(a.sim, 0))", "1.0")}, light as (select base_id, mu, w, greatest(0.5 * stddev_pop(mu) over (partition by base_id), 2.0) as sigma from p)
    {with_statistics(800).replace("from p ", "from light ").replace("join p ", "join light ")} select base_id, {ROUNDED} from st"""
)
def light_mixture(spark, sf):
    """The scorer's light mixture: one spread for all analogues, half that of their returns and two percent at least."""
    p = parts(spark, sf).select("base_id", "mu", F.sqrt(F.greatest("sim", F.lit(0.0))).alias("w"))
    spread = F.greatest(0.5 * F.stddev_pop("mu").over(Window.partitionBy("base_id")), F.lit(2.0))
    return rounded(posterior(p.withColumn("sigma", spread), 800))


@query(
    f"""{with_parts()} {with_statistics()} select count(*) as n_succeeded, (select count(*) from test) - count(*) as n_failed, count(*) filter (where p_down10 > {FLAG}) as n_flagged, round(avg(p95 - p5), 4) as mean_width from st"""
)
def batch_summary(spark, sf):
    """A batch's counts: events with a posterior, those without, those flagged, and the mean width."""
    s = posterior(parts(spark, sf)).agg(F.count(F.lit(1)).alias("n_succeeded"), F.count_if(F.col("p_down10") > FLAG).alias("n_flagged"), F.round(F.avg(F.col("p95") - F.col("p5")), 4).alias("mean_width"))
    asks = views.test(spark, sf).agg(F.count(F.lit(1)).alias("asked"))
    return s.join(F.broadcast(asks)).select("n_succeeded", (F.col("asked") - F.col("n_succeeded")).alias("n_failed"), "n_flagged", "mean_width")
