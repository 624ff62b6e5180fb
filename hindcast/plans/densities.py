"""What stored densities tell: scores on their grids, their modes, and the prior that the paths of analogues make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators import forecast
from hindcast.plans import cascades, posterior
from hindcast.plans.analogues import TAUS
from hindcast.plans.market import forward
from hindcast.plans.posterior import VIEWS, with_parts, with_statistics
from hindcast.sources import shared
from hindcast.sources.views import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *(names or VIEWS))
        return f

    return add


def r4(*names: str) -> list:
    return [F.round(c, 4).alias(c) for c in names]


def grids(spark, sf) -> DataFrame:
    """(base_id, i, x, dens, cdf, step) of the posterior of every test event, written once for all that reads it."""
    return shared.checkpointed(forecast.mixture(posterior.parts(spark, sf), "base_id", posterior.GRID))


def realised(spark, sf) -> DataFrame:
    return forward(spark, sf, (15,)).where("r is not null").select(F.col("event_id").alias("base_id"), F.col("r").alias("y"))


GRIDS = f"{with_parts()} {with_statistics()}, y as (select event_id as base_id, r as y from ret where r is not null)"
SCORED = f"""{GRIDS}, tr as (select base_id, i, x, dens, coalesce(0.5 * (dens + lag(dens) over w) * (x - lag(x) over w), 0) as more, x - lag(x) over w as wide from cd window w as (partition by base_id order by i)),
cm as (select *, sum(more) over (partition by base_id order by i) / sum(more) over (partition by base_id) as f from tr),
off as (select *, pow(f - (x >= y)::int, 2) as g from cm join y using (base_id)),
cr as (select base_id, any_value(y) as y, sum(area) as crps from (select base_id, y, 0.5 * (g + lag(g) over (partition by base_id order by i)) * wide as area from off) group by 1),
k as (select base_id, greatest(least(count(*) filter (where x <= y), {posterior.GRID - 1}), 1) - 1 as k from off group by 1),
lo as (select k.base_id, x as x0, dens as d0 from k join cd on cd.base_id = k.base_id and cd.i = k.k), hi as (select k.base_id, x as x1, dens as d1 from k join cd on cd.base_id = k.base_id and cd.i = k.k + 1),
sc as (select base_id, y, crps, ln(d0 + greatest(least((y - x0) / (x1 - x0), 1), 0) * (d1 - d0)) as log_score from cr join lo using (base_id) join hi using (base_id))"""


@query(f"{SCORED} select base_id, round(y, 4) as y, round(crps, 4) as crps, round(log_score, 4) as log_score from sc")
def grid_scores(spark, sf):
    """The ranked probability score and the log score of every posterior on its stored grid, not by a normal in its place."""
    a = forecast.as_arrays(grids(spark, sf), "base_id").join(realised(spark, sf), "base_id")
    xs, ds, y = F.col("xs"), F.col("ds"), F.col("y")
    out = a.select("base_id", "y", forecast.crps_on_grid(xs, ds, y).alias("crps"), forecast.log_score_on_grid(xs, ds, y).alias("log_score"))
    return out.select("base_id", *r4("y", "crps", "log_score"))


#: Levels of the curve.
LEVELS = tuple(round(0.05 * k, 2) for k in range(1, 20))


def between_sql(tau: float) -> str:
    low, high = max(t for t in TAUS if t <= tau), min(t for t in TAUS if t >= tau)
    return TAUS[low] if low == high else f"{TAUS[low]} + {(tau - low) / (high - low)!r} * ({TAUS[high]} - {TAUS[low]})"


@query(f"{GRIDS}, z as (select * from st join y using (base_id)) " + " union all ".join(f"select {t}::double as tau, count(*) as n, round(avg(case when y >= q then {t} * (y - q) else ({t} - 1) * (y - q) end), 4) as loss, round(avg((y < q)::int), 4) as below from (select y, {between_sql(t)} as q from z)" for t in LEVELS))
def pinball_curve(spark, sf):
    """Mean pinball loss at 19 levels, whose quantiles lie between the five that a posterior stores, and how often outcomes fell below."""
    st = forecast.statistics(grids(spark, sf), "base_id").join(realised(spark, sf), "base_id")
    y = F.col("y")
    rows = [F.struct(F.lit(t).alias("tau"), forecast.pinball(y, q, t).alias("loss"), (y < q).cast("int").alias("below")) for t in LEVELS for q in [forecast.quantile_between(t, TAUS)]]
    return st.select(F.explode(F.array(*rows)).alias("r")).groupBy("r.tau").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r.loss"), 4).alias("loss"), F.round(F.avg("r.below"), 4).alias("below"))


#: A peak's least part of the highest density, and the least distance of two modes.
PROMINENT, APART = 0.10, 8.0
MODES = f"""{GRIDS}, runs as (select base_id, i, x, dens, sum(fresh) over (partition by base_id order by i) as run from (select *, (dens <> lag(dens, 1, -1.0) over (partition by base_id order by i))::int as fresh from cd)),
tops as (select base_id, run, min(i) as a, max(i) as b, any_value(dens) as dens from runs group by 1, 2),
pk as (select base_id, (a + b) // 2 as i, dens from (select *, lag(dens) over w as l, lead(dens) over w as r from tops window w as (partition by base_id order by run)) where dens > l and dens > r),
lim as (select p.base_id, p.i, p.dens, coalesce(max(g.i) filter (where g.i < p.i and g.dens > p.dens), -1) as l, coalesce(min(g.i) filter (where g.i > p.i and g.dens > p.dens), {posterior.GRID}) as r from pk p join cd g on g.base_id = p.base_id group by 1, 2, 3),
prom as (select p.base_id, p.i, p.dens - greatest(min(g.dens) filter (where g.i > l and g.i < p.i), min(g.dens) filter (where g.i > p.i and g.i < r)) as prom from lim p join cd g on g.base_id = p.base_id group by 1, 2, p.dens),
kept as (select *, row_number() over (partition by base_id order by prom desc, i desc) as k, count(*) over (partition by base_id) as n_peaks from prom join (select base_id, max(dens) as most from cd group by 1) using (base_id) where prom >= {PROMINENT} * most),
two as (select base_id, any_value(n_peaks) as n_peaks, min(x) as mode1_x, max(x) as mode2_x, min(prom) / max(prom) as balance from kept join (select base_id, i, x from cd) using (base_id, i) where k <= 2 and n_peaks >= 2 group by 1),
md as (select base_id, coalesce(n.n_peaks, 0) as n_peaks, mode1_x, mode2_x, mode2_x - mode1_x as separation, balance from (select distinct base_id from cd) left join (select base_id, any_value(n_peaks) as n_peaks from kept group by 1) n using (base_id) left join two using (base_id))"""


def moded(spark, sf) -> DataFrame:
    return forecast.modes(forecast.as_arrays(grids(spark, sf), "base_id"), PROMINENT).drop("xs", "ds")


@query(f"{MODES} select base_id, cast(n_peaks as int) as n_peaks, round(mode1_x, 4) as mode1_x, round(mode2_x, 4) as mode2_x, round(separation, 4) as separation, round(balance, 4) as balance, coalesce(separation >= {APART}, false) as apart from md")
def mode_separation(spark, sf):
    """The prominent peaks of every posterior: how many, where the two most prominent are, how far apart and how even."""
    m = moded(spark, sf)
    return m.select("base_id", "n_peaks", *r4("mode1_x", "mode2_x", "separation", "balance"), F.coalesce(F.col("separation") >= APART, F.lit(False)).alias("apart"))


@query(f"{MODES} select base_id, cast(row_number() over (order by n_peaks, balance desc, separation desc, base_id) as int) as rank, cast(n_peaks as int) as n_peaks, round(separation, 4) as separation, round(balance, 4) as balance from md where separation >= {APART} qualify rank <= 10")
def cleanest_modes(spark, sf):
    """The ten clearest cases of two modes: fewest peaks, then most even, then farthest apart."""
    best = moded(spark, sf).where(F.col("separation") >= APART).orderBy("n_peaks", F.desc("balance"), F.desc("separation"), "base_id").limit(10)
    order = Window.orderBy("n_peaks", F.desc("balance"), F.desc("separation"), "base_id")  # ten rows
    return best.withColumn("rank", F.row_number().over(order)).select("base_id", "rank", "n_peaks", *r4("separation", "balance"))


@query(f"{MODES} select count(*) as n, round(avg(separation), 4) as mean, round(median(separation), 4) as median, round(min(separation), 4) as least, round(max(separation), 4) as most, round(quantile_cont(separation, 0.25), 4) as p25, round(quantile_cont(separation, 0.75), 4) as p75 from md where separation is not null")
def separation_summary(spark, sf):
    """How far apart the two modes of the posteriors that have two lie."""
    q = F.percentile("separation", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = moded(spark, sf).where("separation is not null").agg(F.count(F.lit(1)).alias("n"), F.avg("separation").alias("mean"), F.min("separation").alias("least"), F.max("separation").alias("most"), q.alias("q"))
    return s.select("n", *r4("mean", "least", "most"), *(F.round(F.col("q")[k], 4).alias(c) for k, c in enumerate(("p25", "median", "p75"))))


#: The prior's grid of daily log returns, the fewest points of a path and the least spread that make a kernel density.
LOW, HIGH, POINTS, FEWEST, NARROW = -1.0, 1.0, 401, 5, 1e-9


def path_parts(found: DataFrame, paths: DataFrame) -> DataFrame:
    """(base_id, mu, sigma, w): a kernel at every return of every analogue's path.

    found is (base_id, id, weight), paths (id, returns). Scott's bandwidth per path; paths that are too short or don't move
    are left out. Weights are scaled to one over the others; if they add up to nothing or less all count alike, and an
    analogue of a weight of zero or less adds nothing.
    """
    n, r = F.size("returns"), F.col("returns")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    p = paths.withColumns({"n": n, "mean": add(r) / n}).where(F.col("n") >= FEWEST)
    p = p.withColumn("ss", F.aggregate("returns", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))).where(F.sqrt(F.col("ss") / F.col("n")) >= NARROW)
    p = p.select("id", "returns", "n", (F.sqrt(F.col("ss") / (F.col("n") - 1)) * F.pow("n", F.lit(-0.2))).alias("sigma"))
    a = found.join(p, "id")
    of = Window.partitionBy("base_id")
    total = F.sum("weight").over(of)
    a = a.withColumn("share", F.when(total > 0, F.col("weight") / total).otherwise(1.0 / F.count(F.lit(1)).over(of))).where("share > 0")
    return a.select("base_id", "sigma", (F.col("share") / F.col("n")).alias("w"), F.explode("returns").alias("mu"))


@query(
    f"""{cascades.STAGED}, {cascades.PATH_POINTS}, best as (select base_id, id, raw * recency as weight, row_number() over (partition by base_id order by raw * recency desc, k4) as rank from s5 qualify rank <= {cascades.TOP}),
    moved as (select id, count(*) as n, stddev_samp(r) * pow(count(*), -0.2) as sigma from points group by 1 having count(*) >= {FEWEST} and stddev_pop(r) >= {NARROW}),
    scaled as (select base_id, id, n, sigma, case when sum(weight) over b > 0 then weight / sum(weight) over b else 1.0 / count(*) over b end as share from best join moved using (id) window b as (partition by base_id)),
    kern as (select base_id, sigma, share / n as w, r as mu from scaled join points using (id) where share > 0)
    select base_id, cast(i as int) as i, round({LOW} + i * {(HIGH - LOW) / (POINTS - 1)!r}, 4) as x, round(sum(w / (sigma * sqrt(2 * pi())) * exp(-0.5 * pow(({LOW} + i * {(HIGH - LOW) / (POINTS - 1)!r} - mu) / sigma, 2))), 4) as dens from kern cross join (select unnest(range({POINTS})) as i) group by base_id, i""",
    "memory", "prices",
)
def path_prior(spark, sf):
    """The density of daily returns after each query cluster: a kernel density for every analogue's path, weighted by the cascade."""
    staged, _ = cascades.cascaded(spark, sf)
    found = cascades.ranked(staged).select("base_id", "id", "weight")
    paths = cascades.return_paths(cascades.quarters(spark, sf), cascades.daily(spark, sf))
    out = forecast.kernels(path_parts(found, paths), "base_id", LOW, HIGH, POINTS)
    return out.select("base_id", "i", *r4("x", "dens"))
