"""The day-by-day cone of every leg, distances and scores with entities and bands, event reports, and ablations by horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators import asof, forecast, nearby, retrieval
from hindcast.plans import inference, posterior
from hindcast.plans.analogues import PAIRS, bases
from hindcast.plans.market import BAND_CASE, BANDS_SQL, forward, r6, year_quantile_bands
from hindcast.plans.posterior import GRID, with_parts
from hindcast.sources import shared, views
from hindcast.sources.views import table, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names)
        return f

    return add


# The cone: what the price of each leg did on each day around the analogues.

#: Days before and after, days before that make an analogue's shape, fewest analogues of a day, percent that is a tail.
AROUND, SHAPE, FEWEST, TAIL = 15, 15, 3, 10.0


def leg_moves(events: DataFrame, legs: DataFrame) -> DataFrame:
    """(d, leg, day, r, sigma): the return of each leg on the days around each event day, from the leg's price on that day.

    sigma is the spread of the steps of the days up to it, one percent at least. A leg without a price on the event day (or
    one of zero), or on a day around it, has no row. Event days are told apart, not events: the table is as long as the calendar and the legs.
    """
    days = events.select(F.col("d").alias("ed")).where("ed is not null").distinct()
    near = asof.band_join(days, legs.select("leg", F.col("d").alias("pd"), "px"), "ed", "pd", AROUND, AROUND)
    near = near.withColumn("day", F.datediff("pd", "ed"))
    of = Window.partitionBy("ed", "leg")
    p0 = F.max(F.when(F.col("day") == 0, F.col("px"))).over(of)
    near = near.withColumn("p0", p0).where("p0 <> 0").withColumn("r", 100 * (F.col("px") - F.col("p0")) / F.abs("p0"))
    step = F.when(F.col("day") <= 0, F.col("r") - F.lag("r").over(of.orderBy("day")))
    near = near.withColumn("step", step)
    return near.withColumn("sigma", F.greatest(F.coalesce(F.stddev_pop("step").over(of), F.lit(1.0)), F.lit(1.0))).select(F.col("ed").alias("d"), "leg", "day", "r", "sigma")


def cone_parts(spark, sf) -> DataFrame:
    """(base_id, leg, day, mu, sigma, w): the weighted normals of each query, leg and day; one weight for all legs, from the price."""
    px = posterior.prices(spark, sf)
    parts = posterior.parts(spark, sf, px=px).where("w > 0").select("base_id", "d", "w")
    legs = views.legs(spark, sf).unionByName(px.select(F.lit("spot").alias("leg"), "d", "px"))
    moves = shared.checkpointed(leg_moves(views.train(spark, sf), legs))
    found = parts.join(F.broadcast(moves), "d").withColumnRenamed("r", "mu")
    n = F.count(F.lit(1)).over(Window.partitionBy("base_id", "leg", "day"))
    return found.withColumn("n", n).where(F.col("n") >= FEWEST).select("base_id", "leg", "day", "mu", "sigma", "w")


MOVES = """near_ as (select x.d as ed, l.leg, date_diff('day', x.d, l.d) as day, l.px from (select distinct d from train) x join (select * from legs union all select 'spot', d, px from prices) l on abs(date_diff('day', x.d, l.d)) <= 15),
moved as (select *, 100 * (px - p0) / abs(p0) as r from (select *, max(case when day = 0 then px end) over (partition by ed, leg) as p0 from near_) where p0 is not null),
stepped as (select *, case when day <= 0 then r - lag(r) over (partition by ed, leg order by day) end as step from moved),
moves as (select ed as d, leg, day, r, greatest(coalesce(stddev_pop(step) over (partition by ed, leg), 1.0), 1.0) as sigma from stepped)"""


@query(
    f"""{with_parts().replace('every as (select a.base_id,', 'every as (select a.base_id, a.event_id,')}, {MOVES}, pw as (select p.base_id, e.d, p.w from p join memory e using (event_id) where p.w > 0),
    cp as (select p.base_id, m.leg, m.day, m.r as mu, m.sigma, p.w, count(*) over (partition by p.base_id, m.leg, m.day) as n from pw p join moves m using (d))
    select base_id, leg, cast(day as int) as day, any_value(n) as n, round(sum(w * mu) / sum(w), 4) as mean, round(sqrt(greatest(sum(w * (mu * mu + sigma * sigma)) / sum(w) - pow(sum(w * mu) / sum(w), 2), 0)), 4) as std, round(sum(case when abs(mu) > {TAIL} then w else 0 end) / sum(w), 4) as tail_weight
    from cp where n >= {FEWEST} group by 1, 2, 3""",
    "train", "test", "prices", "legs",
)
def cone_moments(spark, sf):
    """Mean, spread and weight in the tails of the mixture of each query, leg and day, from 15 days before to 15 after."""
    w = F.sum("w")
    mean = F.sum(F.col("w") * F.col("mu")) / w
    second = F.sum(F.col("w") * (F.col("mu") * F.col("mu") + F.col("sigma") * F.col("sigma"))) / w
    s = cone_parts(spark, sf).groupBy("base_id", "leg", "day").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"), F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("std"), (F.sum(F.when(F.abs("mu") > TAIL, F.col("w")).otherwise(0.0)) / w).alias("tail_weight"))
    return s.select("base_id", "leg", "day", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "tail_weight")))


@query()
def mixture_cone(spark, sf):
    """The cone itself: quantiles, tails and peaks of the mixture of each query, leg and day."""
    parts = cone_parts(spark, sf).withColumn("key", F.struct("base_id", "leg", "day"))
    q = forecast.quantiles_of_parts(parts.select("key", "mu", "sigma", "w"), "key", far=TAIL)
    return q.select("key.*", "n", *(F.round(c, 4).alias(c) for c in ("p5", "p25", "median", "p75", "p95", "p_down10", "p_up10")), (F.col("n_peaks") >= 2).alias("bimodal"))


# Entities and bands in distances and scores.


def bags(spark, sf) -> DataFrame:
    """(event_id, bag): the different words of the text of each event; events without a text have none."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), words.alias("bag"))


def featured(spark, sf) -> DataFrame:
    """The memory with bag (empty without a text) and band, that of the day's price in its year (UNK without one)."""
    none = F.array().cast("array<string>")
    m = views.memory(spark, sf).join(bags(spark, sf), "event_id", "left").withColumn("bag", F.coalesce("bag", none))
    bands = year_quantile_bands(spark, sf).select("d", "band")
    return m.join(F.broadcast(bands), "d", "left").withColumn("band", F.coalesce("band", F.lit("UNK")))


FEATURED = f"""bagged as (select doc_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: length(w) > 3)) as bag from documents),
banded as (select d, {BAND_CASE} as band from prices join ({BANDS_SQL}) b on year(d) = yr),
feat as (select m.*, coalesce(t.bag, []) as bag, coalesce(q.band, 'UNK') as band from memory m left join bagged t on t.doc_id = m.event_id left join banded q on q.d = m.d)"""
#: Weights of vectors, words, polarity and band.
FUSED = (0.5, 0.2, 0.1, 0.2)


@query(
    f""",, {FEATURED} select a.event_id as a, b.event_id as b, round({FUSED[0]} * (1 - list_cosine_similarity(a.emb::double[], b.emb::double[])) / 2 + {FUSED[1]} * (case when len(a.bag) + len(b.bag) = 0 then 0.0 else 1 - len(list_intersect(a.bag, b.bag)) / len(list_distinct(list_concat(a.bag, b.bag))) end)
    + {FUSED[2]} * (a.polarity <> b.polarity)::int + {FUSED[3]} * (a.band <> b.band)::int, 6) as dist from feat a join feat b on a.event_id < b.event_id and abs(date_diff('day', a.d, b.d)) <= 7""",
    "memory", "prices",
)
def full_fused_distance(spark, sf):
    """The fused distance of events within a week: vectors, shared words, polarity and price band; two empty bags are alike."""
    m = shared.checkpointed(featured(spark, sf))
    return nearby.pairs(m, 7, FUSED[0], FUSED[1], {"polarity": FUSED[2], "band": FUSED[3]}).select("a", "b", r6("dist", "dist"))


@query(
    f""",, {FEATURED}, pairs as ({PAIRS}), scored as (select p.base_id, p.event_id, p.sim, coalesce(len(list_intersect(a.bag, b.bag)) / nullif(len(list_distinct(list_concat(a.bag, b.bag))), 0), 0) as jaccard, (p.event_type = p.base_type)::int as same
      from pairs p join feat a on a.event_id = p.base_id join feat b on b.event_id = p.event_id where p.sim >= 0.1),
    ranked as (select *, 0.60 * sim + 0.25 * jaccard + 0.15 * same as score, row_number() over (partition by base_id order by 0.60 * sim + 0.25 * jaccard + 0.15 * same desc, event_id) as rank from scored)
    select base_id, cast(rank as int) as rank, event_id, round(sim, 6) as sim, round(jaccard, 6) as jaccard, same, round(score, 6) as score from ranked where rank <= 10""",
    "train", "test", "prices",
)
def entity_hybrid_retrieval(spark, sf):
    """The best ten analogues by a blend of similarity, shared words and equal type."""
    m = shared.checkpointed(featured(spark, sf).withColumn("kind", F.col("event_type").cast("long")))
    late = F.col("d") >= F.lit(views.SPLIT).cast("date")
    found = retrieval.blended(m.where(late).withColumnRenamed("event_id", "base_id"), m.where(~late), 10, 0.1)
    return found.select("base_id", "rank", "event_id", r6("sim", "sim"), r6("jaccard", "jaccard"), "same", r6("score", "score"))


# Events as a whole, and what each rank of the weights does.


@query()
def event_reports(spark, sf):
    """A row for every test event: its posterior, what came, signal, and forecast efficiency (the GARCH spread over the
    posterior's); events without a posterior say why."""
    px = posterior.prices(spark, sf)
    st = posterior.posterior(posterior.parts(spark, sf, px=px))
    came = forward(spark, sf, (15,), px=px).where("r is not null").select(F.col("event_id").alias("base_id"), F.col("r").alias("realised"))
    garch = inference.benchmarked(spark, sf).where("model = 'garch'").select("d", F.col("sigma").alias("garch_sigma"))
    e = bases(spark, sf).select("base_id", "d").join(st, "base_id", "left").join(came, "base_id", "left").join(F.broadcast(garch), "d", "left")
    error = F.when(F.col("median").isNull(), f"fewer than {posterior.FEWEST} analogues with a return").when(F.col("realised").isNull(), "no price at the horizon")
    inside = lambda a, b: F.col("realised").between(F.col(a), F.col(b)).cast("int")
    out = e.withColumns({"fei": F.col("garch_sigma") / F.nullif("std", F.lit(0.0)), "covers_90": inside("p5", "p95"), "covers_50": inside("p25", "p75"), "red_flag": (F.col("p_down10") > posterior.FLAG).cast("int"), "signal": forecast.signal(F.col("median"), F.col("p5"), F.col("p95"), 2.0, 60.0), "error": error})
    out = out.withColumn("signal", F.when(F.col("median").isNotNull(), F.col("signal")))
    return out.select("base_id", "d", *(F.round(c, 4).alias(c) for c in ("p5", "median", "p95", "std", "p_down10", "realised", "garch_sigma", "fei")), "covers_90", "covers_50", "red_flag", "signal", "error")


#: Configurations: exponents of similarity and percentile rank. LARGE moves are those that the tail's coverage is about.
CONFIGS, LARGE = {"full": (1, 1), "no_similarity": (0, 1), "no_percentile": (1, 0), "uniform": (0, 0)}, 50.0


def ablated(spark, sf) -> DataFrame:
    """(config, horizon, base_id, p5, p95, n_modes, y) of the posteriors under each configuration."""
    px = posterior.prices(spark, sf)
    p = shared.checkpointed(posterior.parts(spark, sf, px=px, horizons=inference.HORIZONS))
    configs = F.explode(F.array(*(F.struct(F.lit(n).alias("config"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for n, (a, b) in CONFIGS.items())))
    p = p.withColumn("c", configs).withColumn("key", F.struct("c.config", "horizon", "base_id")).withColumn("w", F.pow("w_sim", "c.a") * F.pow("w_pct", "c.b"))
    st = forecast.statistics(forecast.mixture(p.select("key", "mu", "sigma", "w"), "key", GRID), "key").select("key.*", "p5", "p95", "n_modes")
    came = forward(spark, sf, inference.HORIZONS, px=px).where("r is not null").select(F.col("event_id").alias("base_id"), "horizon", F.col("r").alias("y"))
    return shared.checkpointed(st.join(came, ["base_id", "horizon"]))


@query()
def ablation_by_horizon(spark, sf):
    """For each configuration and horizon: events, coverage of 90 percent and its change against the full one, coverage of
    large moves, width, posteriors with two modes, and whether the intervals equal those of another configuration."""
    a = ablated(spark, sf)
    inside = F.col("y").between(F.col("p5"), F.col("p95")).cast("int")
    s = a.groupBy("config", "horizon").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(inside)).alias("coverage"), (100 * F.avg(F.when(F.abs("y") > LARGE, inside))).alias("tail_coverage"), F.avg(F.col("p95") - F.col("p5")).alias("width"), F.count_if(F.col("n_modes") >= 2).alias("n_bimodal"), F.sum(F.xxhash64("base_id", F.round("p5", 6), F.round("p95", 6)).cast("decimal(38,0)")).alias("print"))
    full = s.where("config = 'full'").select("horizon", F.col("coverage").alias("__full"))
    twins = F.count(F.lit(1)).over(Window.partitionBy("horizon", "print", "n")) > 1
    s = s.withColumn("repeated", twins).join(F.broadcast(full), "horizon", "left")
    return s.select("config", "horizon", "n", *(F.round(c, 4).alias(c) for c in ("coverage", "tail_coverage", "width")), F.round(F.col("coverage") - F.col("__full"), 4).alias("change"), "n_bimodal", "repeated")
