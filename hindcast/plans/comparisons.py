"""Comparisons: retrieval methods against each other, stated tails against seen ones, widths against benchmarks, spread regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions import vectors as V
from hindcast.operators import asof, forecast, retrieval
from hindcast.plans import cascades, cones, inference, posterior
from hindcast.plans.analogues import FORECAST, PAIRS, forecasts
from hindcast.plans.analogues import VIEWS as SAMPLED
from hindcast.plans.market import forward, r6
from hindcast.plans.posterior import with_parts
from hindcast.sources import shared, views
from hindcast.sources.views import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names)
        return f

    return add


# Three ways to retrieve, by what they share and whose paths are nearest to what came.

TOP, TAU = 10, 0.1
METHODS = ("cosine", "flat", "hybrid")


def compared(methods: dict[str, DataFrame], paths: DataFrame, base_paths: DataFrame) -> DataFrame:
    """(base_id, n_*, overlap_* of each pair, dtw_*, winner) of lists (base_id, event_id) by method.

    dtw is the mean distance of whole paths, with absolute costs and no band; the winner has the least, the first of equals. A
    method without a result for a query has no distance; two empty lists overlap in full. paths is (event_id, path), base_paths
    (base_id, base_path).
    """
    every = None
    for name, df in methods.items():
        one = df.select(F.lit(name).alias("method"), "base_id", "event_id")
        every = one if every is None else every.unionByName(one)
    far = retrieval.with_dtw(every.join(paths, "event_id").join(base_paths, "base_id"), "path", "base_path", band=None, squared=False, increments=False)
    lists = far.groupBy("base_id").agg(*(x for m in methods for x in (F.collect_set(F.when(F.col("method") == m, F.col("event_id"))).alias(f"e_{m}"), F.avg(F.when(F.col("method") == m, F.col("dtw"))).alias(f"dtw_{m}"))))
    names = list(methods)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    mean = lambda m: F.round(f"dtw_{m}", 6)  # noqa: E731  # equal lists are equal in whatever order they were summed
    best = F.least(*(mean(m) for m in names))
    winner = F.coalesce(*(F.when(mean(m) == best, m) for m in names))
    return lists.select("base_id", *(F.size(f"e_{m}").alias(f"n_{m}") for m in names), *(V.jaccard(F.col(f"e_{a}"), F.col(f"e_{b}"), 1.0).alias(f"overlap_{a}_{b}") for a, b in pairs), *(f"dtw_{m}" for m in names), winner.alias("winner"))


@query(
    f""",, {cascades.PATHS}, {cones.FEATURED.replace('paths as', 'paths_ as')}, pairs as ({PAIRS}), jac as (select p.*, coalesce(len(list_intersect(a.bag, b.bag)) / nullif(len(list_distinct(list_concat(a.bag, b.bag))), 0), 0) as j from pairs p join feat a on a.event_id = p.base_id join feat b on b.event_id = p.event_id),
    picked as (select 'cosine' as method, base_id, event_id, cd, bd from jac where sim >= {TAU} qualify row_number() over (partition by base_id order by sim desc, event_id) <= {TOP}
      union all select 'flat', base_id, event_id, cd, bd from jac qualify row_number() over (partition by base_id order by sim desc, event_id) <= {TOP}
      union all select 'hybrid', base_id, event_id, cd, bd from jac where sim >= {TAU} qualify row_number() over (partition by base_id order by 0.60 * sim + 0.25 * j + 0.15 * (event_type = base_type)::int desc, event_id) <= {TOP}),
    held as (select k.*, a.path as x, b.path as y from picked k join paths a on a.d = k.cd join paths b on b.d = k.bd), {cascades.warping_sql('held', 'x', 'y', 7, out='far', plain=True)},
    l as (select base_id, """ + ", ".join(f"coalesce(list(event_id) filter (where method = '{m}'), []) as e_{m}, avg(dtw) filter (where method = '{m}') as dtw_{m}" for m in METHODS) + """ from far group by 1)
    select base_id, """ + ", ".join(f"len(e_{m})::int as n_{m}" for m in METHODS) + ", " + ", ".join(f"round(case when len(e_{a}) + len(e_{b}) = 0 then 1.0 else len(list_intersect(e_{a}, e_{b})) / len(list_distinct(list_concat(e_{a}, e_{b}))) end, 6) as overlap_{a}_{b}" for a, b in (("cosine", "flat"), ("cosine", "hybrid"), ("flat", "hybrid"))) + ", " + ", ".join(f"round(dtw_{m}, 4) as dtw_{m}" for m in METHODS) + ", case least(round(dtw_cosine, 6), round(dtw_flat, 6), round(dtw_hybrid, 6)) " + " ".join(f"when round(dtw_{m}, 6) then '{m}'" for m in METHODS) + " end as winner from l",
    "train", "test", "prices",
)
def method_comparison(spark, sf):
    """Similarity with a threshold, similarity alone, and the blend with words and types: overlaps, path distances, winner."""
    m = shared.checkpointed(cones.featured(spark, sf).withColumn("kind", F.col("event_type").cast("long")))
    late = F.col("d") >= F.lit(views.SPLIT).cast("date")
    base, corpus = m.where(late).withColumnRenamed("event_id", "base_id"), m.where(~late)
    found = {"cosine": retrieval.nearest(base, corpus, TOP, (TAU,), 1), "flat": retrieval.nearest(base, corpus, TOP, (-1.0,), 1), "hybrid": retrieval.blended(base, corpus, TOP, TAU)}
    of_day = shared.checkpointed(cascades.node_paths(spark, sf))
    paths = cascades.with_paths(corpus.select("event_id", "d"), of_day).select("event_id", "path")
    own = cascades.with_paths(base.select("base_id", "d"), of_day).select("base_id", F.col("path").alias("base_path"))
    out = compared(found, paths, own)
    return out.select(*(r6(c, c) if c.startswith("overlap") else F.round(c, 4).alias(c) if c.startswith("dtw") else F.col(c) for c in out.columns))


# Stated chances against what came, in bins of equal counts.

BINS, DOWN = 5, -30.0


def binned(df: DataFrame, stated: str, seen: str, bins: int) -> DataFrame:
    """(bin, low, high, n, stated, seen, gap, corr) of equal-count bins of a stated chance against an outcome of 0 or 1.

    Edges are exact quantiles; equal ones are one, so there may be fewer bins. A bin holds its upper edge, the first one its
    lower too. corr is that of all rows, null where either doesn't vary.
    """
    edges = df.agg(F.array_distinct(F.percentile(stated, F.array(*(F.lit(k / bins) for k in range(bins + 1))))).alias("e"), (F.covar_pop(stated, seen) / F.nullif(F.stddev_pop(stated) * F.stddev_pop(seen), F.lit(0.0))).alias("corr"))
    inner = F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0)))
    b = df.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(stated))) + 1)
    s = b.groupBy("bin").agg(F.first("e").alias("e"), F.count(F.lit(1)).alias("n"), F.avg(stated).alias("stated"), F.avg(seen).alias("seen"), F.first("corr").alias("corr"))
    return s.select("bin", F.get("e", F.col("bin") - 1).alias("low"), F.coalesce(F.get("e", F.col("bin")), F.get("e", F.col("bin") - 1)).alias("high"), "n", "stated", "seen", (F.col("seen") - F.col("stated")).alias("gap"), "corr")


def binned_sql(source: str, stated: str, seen: str, bins: int) -> str:
    """CTEs up to `bins_`, over a table with two columns."""
    qs = ", ".join(str(k / bins) for k in range(bins + 1))
    return f"""edges as (select list_sort(list_distinct(quantile_cont({stated}, [{qs}]))) as e, covar_pop({stated}, {seen}) / nullif(stddev_pop({stated}) * stddev_pop({seen}), 0) as corr from {source}),
    placed as (select s.*, e, corr, (len(list_filter(e[2:len(e) - 1], lambda x: x < s.{stated})) + 1)::int as bin from {source} s cross join edges),
    bins_ as (select bin, any_value(e)[bin] as low, coalesce(any_value(e)[bin + 1], any_value(e)[bin]) as high, count(*) as n, avg({stated}) as stated, avg({seen}) as seen, avg({seen}) - avg({stated}) as gap, any_value(corr) as corr from placed group by bin)"""


SHOWN = "select bin, round(low, 6) as low, round(high, 6) as high, n, round(stated, 6) as stated, round(seen, 6) as seen, round(gap, 6) as gap, round(corr, 6) as corr from bins_"


def six(df: DataFrame) -> DataFrame:
    return df.select("bin", *(r6(c, c) for c in ("low", "high")), "n", *(r6(c, c) for c in ("stated", "seen", "gap", "corr")))


@query(f"{FORECAST}, src as (select p_down10 as p, (realised < {DOWN})::int as y from fct), {binned_sql('src', 'p', 'y', BINS)} {SHOWN}", *SAMPLED)
def tail_calibration(spark, sf):
    """The stated chance of a fall against how often it came, in fifths, with their correlation."""
    f = forecasts(spark, sf).select(F.col("p_down10").alias("p"), (F.col("realised") < DOWN).cast("int").alias("y"))
    return six(binned(f, "p", "y", BINS))


FAR = 30.0


@query(
    f"""{with_parts()}, tails as (select base_id, sum(case when abs(mu) > {FAR} then w else 0 end) / sum(w) as p, sum(case when abs(mu) > {FAR} then w * mu end) / sum(case when abs(mu) > {FAR} then w end) as tail_mu from p group by 1 having sum(w) > 0),
    src as (select t.p, (sign(r.r) = sign(t.tail_mu) and abs(r.r) > {FAR})::int as y from tails t join ret r on r.event_id = t.base_id and r.r is not null where t.tail_mu is not null), {binned_sql('src', 'p', 'y', 4)} {SHOWN}""",
    *posterior.VIEWS,
)
def tail_direction_calibration(spark, sf):
    """The weight of the tails against whether a large move came on the side that the tails lean to, in quarters."""
    px = posterior.prices(spark, sf)
    far = F.abs("mu") > FAR
    t = posterior.parts(spark, sf, px=px).groupBy("base_id").agg(F.sum("w").alias("all"), F.sum(F.when(far, F.col("w")).otherwise(0.0)).alias("far"), F.sum(F.when(far, F.col("w") * F.col("mu"))).alias("moved"))
    t = t.where("all > 0 and far > 0").select("base_id", (F.col("far") / F.col("all")).alias("p"), F.signum("moved").alias("side"))
    came = forward(spark, sf, (15,), px=px).where("r is not null").select(F.col("event_id").alias("base_id"), "r")
    f = t.join(came, "base_id").select("p", ((F.signum("r") == F.col("side")) & (F.abs("r") > FAR)).cast("int").alias("y"))
    return six(binned(f, "p", "y", 4))


def width_ratios(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
    """(by, n, own, other, ratio_of_means, wider, mean_of_ratios) of two widths; rows whose own width isn't positive don't count."""
    s = df.where((F.col(own) > 0) & F.col(other).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(own).alias(own), F.avg(other).alias(other), F.avg(F.col(other) / F.col(own)).alias("mean_of_ratios"))
    ratio = F.col(other) / F.col(own)
    return s.select(by, "n", own, other, ratio.alias("ratio_of_means"), ((ratio - 1) * 100).alias("wider"), "mean_of_ratios")


@query()
def width_efficiency(spark, sf):
    """How much wider the benchmarks' 90-percent intervals are than the posterior's: the ratio of means, and the mean of ratios."""
    own = posterior.posterior(posterior.parts(spark, sf)).select("base_id", (F.col("p95") - F.col("p5")).alias("own"))
    days = views.test(spark, sf).select(F.col("event_id").alias("base_id"), "d")
    other = inference.benchmarked(spark, sf).where("p5 is not null").select("d", "model", (F.col("p95") - F.col("p5")).alias("other"))
    out = width_ratios(own.join(days, "base_id").join(F.broadcast(other), "d"), "model", "own", "other")
    return out.select("model", "n", *(F.round(c, 4).alias(c) for c in out.columns[2:]))


# The spread of the curve at each event.

NEAR, FLAT = 5, 0.10


def regime(spread: Column, flat: float = FLAT) -> Column:
    """Which way the curve slopes; unknown without a spread."""
    return F.when(spread > flat, "backwardation").when(spread < -flat, "contango").when(spread.isNotNull(), "flat").otherwise("unknown")


@query(
    f""",, days as (select distinct d from memory), near_ as (select x.d, l.leg, l.px, row_number() over (partition by x.d, l.leg order by abs(date_diff('day', x.d, l.d)), l.d) as k from days x join legs l on abs(date_diff('day', x.d, l.d)) <= {NEAR}),
    curve as (select d, max(px) filter (where leg = 'M1') as m1, max(px) filter (where leg = 'M2') as m2, max(px) filter (where leg = 'M3') as m3, max(px) filter (where leg = 'M4') as m4 from near_ where k = 1 group by 1),
    s as (select m.event_id, coalesce(m1 - m2, m3 - m4) as spread, case when m1 - m2 is not null then 'M1-M2' when m3 - m4 is not null then 'M3-M4' end as legs_used from memory m left join curve using (d))
    select event_id, round(spread, 4) as spread, legs_used, case when spread > {FLAT} then 'backwardation' when spread < -{FLAT} then 'contango' when spread is not null then 'flat' else 'unknown' end as regime from s""",
    "memory", "legs",
)
def spread_regimes(spark, sf):
    """The spread of the first two legs on the priced day nearest to each event, of the next two where one is missing, and the regime."""
    days = views.memory(spark, sf).select(F.col("d").alias("ed")).where("ed is not null").distinct()
    near = asof.band_join(days, views.legs(spark, sf).select("leg", F.col("d").alias("pd"), "px"), "ed", "pd", NEAR, NEAR)
    best = near.groupBy("ed", "leg").agg(F.min_by("px", F.struct(F.abs(F.datediff("pd", "ed")), F.col("pd"))).alias("px"))
    at = best.groupBy(F.col("ed").alias("d")).agg(*(F.max(F.when(F.col("leg") == f"M{k}", F.col("px"))).alias(f"m{k}") for k in range(1, 5)))
    first, second = F.col("m1") - F.col("m2"), F.col("m3") - F.col("m4")
    e = views.memory(spark, sf).select("event_id", "d").join(F.broadcast(at), "d", "left")
    spread = F.coalesce(first, second)
    return e.select("event_id", F.round(spread, 4).alias("spread"), F.when(first.isNotNull(), "M1-M2").when(second.isNotNull(), "M3-M4").alias("legs_used"), regime(spread).alias("regime"))


# Forecast efficiency: how far a benchmark's density is from what came, in units of the posterior's own distance.

#: The least spread of what came, for the test tables, whose grids are wide.
CAME = 5.0


@query()
def divergence_benchmarks(spark, sf):
    """Mean forecast efficiency and share of wins of the posterior against each benchmark of the GARCH family, by type of event."""
    px = posterior.prices(spark, sf)
    grids = forecast.as_arrays(forecast.mixture(posterior.parts(spark, sf, px=px), "base_id", posterior.GRID), "base_id")
    came = forward(spark, sf, (15,), px=px).where("r is not null").select(F.col("event_id").alias("base_id"), "d", F.col("r").alias("y"))
    kinds = views.memory(spark, sf).select(F.col("event_id").alias("base_id"), "event_type")
    sigmas = inference.benchmarked(spark, sf).where("sigma is not null").select("d", "model", "sigma")
    e = grids.join(came, "base_id").join(kinds, "base_id").join(F.broadcast(sigmas), "d")
    r = forecast.efficiencies(e.select("base_id", "event_type", "model", "xs", "ds", "y", "sigma"), CAME)
    metrics = ("kl", "js", "w1")
    known = lambda m: F.when(~F.isnan(f"fei_{m}"), F.col(f"fei_{m}"))
    s = r.groupBy("event_type", "model").agg(F.count(F.lit(1)).alias("n"), *(F.avg(known(m)).alias(f"fei_{m}") for m in metrics), *(F.avg((known(m) > 1).cast("int")).alias(f"wins_{m}") for m in metrics))
    return s.select("event_type", "model", "n", *(F.round(c, 4).alias(c) for c in s.columns[3:]))
