"""Queries on the market series: as-of joins, returns, windows, audits. Each has the SQL that must give its rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.functions.numbers import ladder
from hindcast.operators import asof, series
from hindcast.sources import views
from hindcast.sources.views import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *names: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names, recursive=recursive) if names else sql
        return f

    return add


def r6(c, name=None):
    c = F.round(c, 6)
    return c.alias(name) if name else c


def asked(spark, sf):
    return views.memory(spark, sf).select("event_id", "d")


@query("select m.event_id, m.d, p.d as price_day, p.px from memory m asof left join prices p on m.d - interval 1 day >= p.d", "memory", "prices")
def asof_backward(spark, sf):
    asks = asked(spark, sf).withColumn("ask", F.date_sub("d", 1))
    return asof.asof(asks, views.prices(spark, sf).withColumnRenamed("d", "price_day"), "ask", "price_day", "px").select("event_id", "d", "price_day", "px")


@query("select m.event_id, m.d, p.d as price_day, p.px from memory m asof left join prices p on m.d + interval 1 day <= p.d", "memory", "prices")
def asof_forward(spark, sf):
    asks = asked(spark, sf).withColumn("ask", F.date_add("d", 1))
    return asof.asof(asks, views.prices(spark, sf).withColumnRenamed("d", "price_day"), "ask", "price_day", "px", "forward").select("event_id", "d", "price_day", "px")


NEAREST = """select event_id, {h} as h, d, pd, px from (select m.event_id, m.d, p.d as pd, p.px,
  row_number() over (partition by m.event_id order by abs(date_diff('day', m.d + {h}, p.d)), p.d) as n
  from memory m join prices p on abs(date_diff('day', m.d + {h}, p.d)) <= {k}) where n = 1"""


@query(f"select m.event_id, m.d, x.pd as price_day, x.px from memory m left join ({NEAREST.format(h=2, k=5)}) x using (event_id)", "memory", "prices")
def asof_nearest_tol(spark, sf):
    asks = asked(spark, sf).withColumn("ask", F.date_add("d", 2))
    return asof.asof(asks, views.prices(spark, sf).withColumnRenamed("d", "price_day"), "ask", "price_day", "px", "nearest", 5).select("event_id", "d", "price_day", "px")


def forward(spark, sf, horizons, events=None, px=None):
    """(event_id, d, horizon, r): percent from the price nearest to the event (5 days) to that nearest to the horizon (10).

    Returns depend on the day alone, so they are worked out once a day; a table of days is as long as the calendar.
    """
    px = px if px is not None else views.prices(spark, sf)
    base = (events if events is not None else asked(spark, sf)).select("event_id", "d")
    each = F.explode(F.array(*(F.lit(h) for h in horizons)))
    days = base.select("d").where("d is not null").distinct()
    start = asof.asof(days, px.select(F.col("d").alias("d0"), F.col("px").alias("p0")), "d", "d0", "p0", "nearest", 5)
    asks = start.withColumn("horizon", each).withColumn("ask", F.date_add("d", F.col("horizon")))
    both = asof.asof(asks, px.select(F.col("d").alias("d1"), F.col("px").alias("p1")), "ask", "d1", "p1", "nearest", 10, by=["d", "horizon", "ask"])
    r = both.select("d", "horizon", (100 * (F.col("p1") - F.col("p0")) / F.abs("p0")).alias("r"))
    return base.withColumn("horizon", each).join(F.broadcast(r), ["d", "horizon"], "left").select("event_id", "d", "horizon", "r")


FORWARD_SQL = f"""select m.event_id, m.d, k.horizon, 100 * (b.px - a.px) / abs(a.px) as r
  from memory m cross join (values (7), (15), (30)) k(horizon)
  left join ({NEAREST.format(h=0, k=5)}) a on a.event_id = m.event_id
  left join ({' union all '.join(NEAREST.format(h=h, k=10) for h in (7, 15, 30))}) b on b.event_id = m.event_id and b.h = k.horizon"""


@query(f"select event_id, horizon, round(r, 6) as r from ({FORWARD_SQL})", "memory", "prices")
def forward_returns(spark, sf):
    return forward(spark, sf, (7, 15, 30)).select("event_id", "horizon", r6("r", "r"))


STEPS = (1, 3, 5, 7, 10, 15)


@query(
    """,, marks as (select distinct d from memory), firsts as (select m.d, p.d as d0, p.px as p0 from marks m asof left join prices p on m.d >= p.d),
    wide as (select f.*, k.w, d0 + k.w as target from firsts f cross join (values (1), (3), (5), (7), (10), (15)) k(w)),
    both_ as (select w.d, w.w, w.p0, p.px as p1 from wide w asof left join prices p on w.target <= p.d)
    select m.event_id, b.w as horizon, case when b.p0 > 0 and b.p1 > 0 then round(100 * (b.p1 - b.p0) / b.p0, 4) end as r from memory m join both_ b on m.d = b.d""",
    "memory", "prices",
)
def multi_horizon_returns(spark, sf):
    px = views.prices(spark, sf)
    start = asof.asof(asked(spark, sf), px.select(F.col("d").alias("d0"), F.col("px").alias("p0")), "d", "d0", "p0")
    wide = start.withColumn("horizon", F.explode(F.array(*(F.lit(h) for h in STEPS)))).withColumn("target", F.date_add("d0", F.col("horizon")))
    both = asof.asof(wide, px.select(F.col("d").alias("d1"), F.col("px").alias("p1")), "target", "d1", "p1", "forward")
    r = F.when((F.col("p0") > 0) & (F.col("p1") > 0), F.round(100 * (F.col("p1") - F.col("p0")) / F.col("p0"), 4))
    return both.select("event_id", "horizon", r.alias("r"))


@query(
    """select d, round(px, 6) as px, case when count(px) over w7 = 7 then round(avg(px) over w7, 6) end as sma_7,
    case when count(px) over w20 = 20 then round(avg(px) over w20 + 2 * stddev_samp(px) over w20, 6) end as bollinger_upper,
    case when count(px) over w20 = 20 then round(avg(px) over w20 - 2 * stddev_samp(px) over w20, 6) end as bollinger_lower,
    case when count(c) over w14 = 14 then round(100 - 100 / (1 + avg(greatest(c, 0)) over w14 / nullif(avg(greatest(-c, 0)) over w14, 0)), 6) end as rsi_14
    from (select *, px - lag(px) over (order by d) as c from prices)
    window w7 as (order by d rows 6 preceding), w20 as (order by d rows 19 preceding), w14 as (order by d rows 13 preceding)""",
    "prices",
)
def technical_indicators(spark, sf):
    out = series.indicators(views.prices(spark, sf))
    return out.select("d", *(r6(F.col(c), c) for c in ("px", "sma_7", "bollinger_upper", "bollinger_lower", "rsi_14")))


@query(
    """,, n as (select *, row_number() over (order by d) as i from prices), e(i, d, ema) as (select i, d, px from n where i = 1
    union all select n.i, n.d, 0.25 * n.px + 0.75 * e.ema from e join n on n.i = e.i + 1) select d, round(ema, 4) as ema from e""",
    "prices", recursive=True,
)
def ema(spark, sf):
    return series.ema(views.prices(spark, sf)).select("d", F.round("ema", 4).alias("ema"))


CALENDAR = "select unnest(generate_series(date '1995-01-01', date '2001-08-01', interval 1 day))::date as d"


def calendar(spark, sf):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-08-01").cast("date"))).alias("d"))
    return days.join(views.prices(spark, sf), "d", "left")


@query(
    f"""select d, round(last_value(px ignore nulls) over (order by d rows between 5 preceding and current row), 6) as px_5,
    round(last_value(px ignore nulls) over (order by d rows between unbounded preceding and current row), 6) as px_all from ({CALENDAR}) c left join prices using (d)""",
    "prices",
)
def bounded_ffill(spark, sf):
    w = series.over()
    return calendar(spark, sf).select("d", r6(series.filled("px", w, 5), "px_5"), r6(series.filled("px", w), "px_all"))


@query(
    """select d, round(px / lag(px) over w - 1, 6) as pct, round(ln(px / lag(px) over w), 6) as log_return, round(px - lag(px) over w, 6) as diff,
    round(lead(px, 5) over w / px - 1, 6) as ahead_5 from prices window w as (order by d)""",
    "prices",
)
def series_returns(spark, sf):
    w = series.over()
    before = F.lag("px").over(w)
    return views.prices(spark, sf).select("d", r6(F.col("px") / before - 1, "pct"), r6(F.log(F.col("px") / before), "log_return"), r6(F.col("px") - before, "diff"), r6(F.lead("px", 5).over(w) / F.col("px") - 1, "ahead_5"))


@query(
    """,, r as (select d, px / lag(px) over (order by d) - 1 as c from prices)
    select d, case when count(c) over w = 7 then round(sum(c) over w, 6) end as cum_7 from r window w as (order by d rows 6 preceding)""",
    "prices",
)
def rolling_cumulative_return(spark, sf):
    w = series.over()
    r = views.prices(spark, sf).withColumn("c", F.col("px") / F.lag("px").over(w) - 1)
    return r.select("d", r6(series.rolling(F.sum("c"), 7, w, "c"), "cum_7"))


@query(
    f"""select m.event_id, x.px is not null as priced, r.rank_pct from memory m left join ({NEAREST.format(h=0, k=5)}) x using (event_id)
    left join (select x.event_id, case when count(*) >= 50 then round(100 * avg((p.px < x.px)::int), 6) end as rank_pct
      from ({NEAREST.format(h=0, k=5)}) x join prices p on p.d between x.d - 1825 and x.d group by 1) r using (event_id)""",
    "memory", "prices",
)
def price_percentile_5y(spark, sf):
    px = views.prices(spark, sf)
    now = asof.asof(asked(spark, sf), px.select(F.col("d").alias("d0"), F.col("px").alias("p0")), "d", "d0", "p0", "nearest", 5)
    rank = series.percentile_rank(now.where("p0 is not null").select("event_id", "d", "p0"), px, "d", "p0", keys=["event_id"])
    return now.join(rank, "event_id", "left").select("event_id", F.col("p0").isNotNull().alias("priced"), r6("rank_pct", "rank_pct"))


BAND_CASE = "case " + " ".join(f"when px < q{c} then '{b}'" for c, b in zip((5, 20, 30, 40, 60, 80, 90), series.BANDS, strict=False)) + f" else '{series.BANDS[-1]}' end"
BANDS_SQL = "select year(d) as yr, " + ", ".join(f"quantile_cont(px, {c / 100}) as q{c}" for c in (5, 20, 30, 40, 60, 80, 90)) + " from prices group by 1"


@query(f"select d, cast(yr as int) as yr, round(q5, 6) as q5, round(q60, 6) as q60, round(q90, 6) as q90, {BAND_CASE} as band from prices join ({BANDS_SQL}) b on year(d) = yr", "prices")
def year_quantile_bands(spark, sf):
    px = views.prices(spark, sf)
    joined = px.withColumn("yr", F.year("d")).join(F.broadcast(series.year_bands(px)), "yr")
    return joined.select("d", "yr", *(r6(F.col(c), c) for c in ("q5", "q60", "q90")), series.band_of(F.col("px"), [F.col(f"q{c}") for c in (5, 20, 30, 40, 60, 80, 90)]).alias("band"))


@query(
    f"""select event_id, horizon, case when r is null then null when r < -10 then 'crash' when r < -2 then 'down' when r <= 2 then 'flat' when r <= 10 then 'up' else 'surge' end as bucket from ({FORWARD_SQL})""",
    "memory", "prices",
)
def change_buckets(spark, sf):
    r = F.col("r")
    label = F.when(r.isNull(), F.lit(None).cast("string")).when(r < -10, "crash").when(r < -2, "down").when(r <= 2, "flat").when(r <= 10, "up").otherwise("surge")
    return forward(spark, sf, (7, 15, 30)).select("event_id", "horizon", label.alias("bucket"))


SPREADS = "select d, max(px) filter (where leg = 'M1') - max(px) filter (where leg = 'M2') as s from legs group by d having count(*) filter (where leg in ('M1', 'M2')) = 2"
REGIME = "case when s > 5000 then 'Backwardation' when s < -5000 then 'Contango' else 'Flat' end"


def spreads(spark, sf):
    """(d, s): the first leg less the second, on days that both have."""
    one, two = (views.legs(spark, sf).where(F.col("leg") == x).select("d", F.col("px").alias(x)) for x in ("M1", "M2"))
    return one.join(two, "d").select("d", (F.col("M1") - F.col("M2")).alias("s"))


@query(
    f"""select {REGIME} as regime, count(*) as n, round(avg(s), 4) as mean_spread, round(100 * avg((abs(s) > 50000)::int), 4) as wide_pct
    from ({SPREADS}) group by 1""",
    "legs",
)
def regime_breakdown(spark, sf):
    regime = F.when(F.col("s") > 5000, "Backwardation").when(F.col("s") < -5000, "Contango").otherwise("Flat")
    return spreads(spark, sf).groupBy(regime.alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 4).alias("mean_spread"), F.round(100 * F.avg((F.abs("s") > 50000).cast("int")), 4).alias("wide_pct"))


@query(
    """select a.d, a.leg || '-' || b.leg as spread, round(a.px - b.px, 6) as s from legs a join legs b on a.d = b.d and cast(substr(b.leg, 2) as int) = cast(substr(a.leg, 2) as int) + 1""",
    "legs",
)
def calendar_spreads(spark, sf):
    a = views.legs(spark, sf).withColumn("k", F.substring("leg", 2, 9).cast("int"))
    b = a.select("d", (F.col("k") - 1).alias("k"), F.col("leg").alias("far"), F.col("px").alias("far_px"))
    return a.join(b, ["d", "k"]).select("d", F.concat_ws("-", "leg", "far").alias("spread"), r6(F.col("px") - F.col("far_px"), "s"))


@query("select leg, count(*) as n, min(d) as first_day, max(d) as last_day, round(avg(px), 4) as mean_px from legs where px is not null group by 1", "legs")
def futures_curve(spark, sf):
    return views.legs(spark, sf).where("px is not null").groupBy("leg").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.round(F.avg("px"), 4).alias("mean_px"))


@query(
    """select coalesce(p.d, v.d) as d, round(px, 6) as px, round(ovx, 6) as ovx from prices p full join vol v on p.d = v.d""",
    "prices", "vol",
)
def outer_merge_dates(spark, sf):
    return views.prices(spark, sf).join(views.vol(spark, sf), "d", "full").select("d", r6("px", "px"), r6("ovx", "ovx"))


@query(
    """,, spot as (select d, px from prices where d < date '2000-06-01'), future as (select d, px from legs where leg = 'M1')
    select d, round(px, 6) as px from spot union all select d, round(px, 6) from future where d > (select max(d) from spot)""",
    "prices", "legs",
)
def stitched_series(spark, sf):
    spot = views.prices(spark, sf).where(F.col("d") < F.lit("2000-06-01").cast("date"))
    last = spot.agg(F.max("d").alias("last"))
    future = views.legs(spark, sf).where("leg = 'M1'").select("d", "px").join(F.broadcast(last), F.col("d") > F.col("last")).drop("last")
    return spot.unionByName(future).select("d", r6("px", "px"))


@query(
    """,, old as (select d, px from prices where d <= date '1999-12-31'), new as (select d, px + 1 as px from prices where d >= date '1999-12-01'),
    n as (select *, row_number() over (partition by d order by src desc) as k from (select d, px, 0 as src from old union all select d, px, 1 from new))
    select d, round(px, 6) as px from n where k = 1""",
    "prices",
)
def dedupe_keep_last(spark, sf):
    px = views.prices(spark, sf)
    old = px.where(F.col("d") <= F.lit("1999-12-31").cast("date")).withColumn("src", F.lit(0))
    new = px.where(F.col("d") >= F.lit("1999-12-01").cast("date")).select("d", (F.col("px") + 1).alias("px"), F.lit(1).alias("src"))
    return old.unionByName(new).groupBy("d").agg(r6(F.max_by("px", "src"), "px"))


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1")
def dedupe_keep_first(spark, sf):
    first = F.min(F.struct("ts", "event_id")).alias("x")
    return views.table(spark, sf, "events").groupBy("user_id").agg(first).select("user_id", "x.event_id", "x.ts")


@query(
    """select m.event_id, p.d, round(p.px, 6) as px, cast(date_diff('day', m.d, p.d) as int) as rel_day from memory m join prices p on p.d between m.d - 10 and m.d + 10""",
    "memory", "prices",
)
def price_window(spark, sf):
    pairs = asof.band_join(asked(spark, sf).withColumnRenamed("d", "ed"), views.prices(spark, sf), "ed", "d", 10, 10)
    return pairs.select("event_id", "d", r6("px", "px"), F.datediff("d", "ed").alias("rel_day"))


@query(
    """,, w as (select m.event_id, p.d, ln(p.px / lag(p.px) over (partition by m.event_id order by p.d)) as r from memory m join prices p on p.d between m.d and m.d + 30)
    select event_id, count(r) as n, round(sum(r), 6) as total, round(stddev_pop(r), 6) as dev from w group by 1 having count(*) >= 2""",
    "memory", "prices",
)
def log_return_paths(spark, sf):
    pairs = asof.band_join(asked(spark, sf).withColumnRenamed("d", "ed"), views.prices(spark, sf), "ed", "d", 0, 30)
    r = pairs.withColumn("r", F.log(F.col("px") / F.lag("px").over(Window.partitionBy("event_id").orderBy("d"))))
    return r.groupBy("event_id").agg(F.count("r").alias("n"), r6(F.sum("r"), "total"), r6(F.stddev_pop("r"), "dev"), F.count(F.lit(1)).alias("all")).where("all >= 2").drop("all")


@query(
    """,, e as (select event_type, date_diff('day', date '1995-01-01', d) as day from memory), s as (select event_type, min(day) as a, max(day) as b from e group by 1),
    c as (select event_type, day, count(*) as n from e group by 1, 2),
    g as (select event_type, k.k, a + k.k * (b - a) / 20.0 as x from s cross join (select unnest(range(21)) as k) k where b > a),
    v as (select g.event_type, g.k, coalesce(l.n, 0) + (g.x - floor(g.x)) * (coalesce(h.n, 0) - coalesce(l.n, 0)) as y from g
      left join c l on l.event_type = g.event_type and l.day = cast(floor(g.x) as bigint) left join c h on h.event_type = g.event_type and h.day = cast(floor(g.x) as bigint) + 1)
    select event_type, cast(k as int) as k, round(y / nullif(sum(y) over (partition by event_type), 0), 6) as share from v""",
    "memory",
)
def propagation_profile(spark, sf):
    e = views.memory(spark, sf).select("event_type", F.datediff("d", F.lit("1995-01-01").cast("date")).alias("day"))
    span = e.groupBy("event_type").agg(F.min("day").alias("a"), F.max("day").alias("b")).where("b > a")
    counts = e.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    grid = span.select("event_type", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k")).withColumn("x", F.col("a") + F.col("k") * (F.col("b") - F.col("a")) / 20.0).withColumn("lo", F.floor("x").cast("int"))
    low = counts.select("event_type", F.col("day").alias("lo"), F.col("n").alias("ln"))
    high = counts.select("event_type", (F.col("day") - 1).alias("lo"), F.col("n").alias("hn"))
    both = grid.join(low, ["event_type", "lo"], "left").join(high, ["event_type", "lo"], "left").na.fill(0, ["ln", "hn"])
    y = both.withColumn("y", F.col("ln") + (F.col("x") - F.floor("x")) * (F.col("hn") - F.col("ln")))
    return y.select("event_type", "k", r6(F.col("y") / F.nullif(F.sum("y").over(Window.partitionBy("event_type")), F.lit(0.0)), "share"))


@query(
    """,, c as (select d, px / lag(px) over (order by d) - 1 as r from prices), s as (select event_type, year(d) as yr, month(d) as mo, min(d) as a, max(d) as b from memory group by 1, 2, 3),
    m as (select s.*, (select avg(r) from c where c.d between s.a and s.b) as span_mean from s)
    select m.event_type, cast(m.yr as int) as yr, cast(m.mo as int) as mo, round(m.span_mean, 6) as span_mean, round(avg((c.r < m.span_mean)::int), 6) as annual_rank,
      round(avg((c.r < m.span_mean)::int) filter (where month(c.d) = m.mo), 6) as monthly_rank
    from m join c on year(c.d) = m.yr and c.r is not null where m.span_mean is not null group by 1, 2, 3, m.span_mean""",
    "memory", "prices",
)
def quantile_signature(spark, sf):
    c = views.prices(spark, sf).withColumn("r", F.col("px") / F.lag("px").over(series.over()) - 1).select("d", "r")
    s = views.memory(spark, sf).groupBy("event_type", F.year("d").alias("yr"), F.month("d").alias("mo")).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    daily = c.withColumns({"yr": F.year("d"), "dm": F.month("d")})
    near = s.join(daily, "yr")
    means = near.where("d between a and b").groupBy("event_type", "yr", "mo").agg(F.avg("r").alias("span_mean"))
    below = (F.col("r") < F.col("span_mean")).cast("int")
    out = near.where("r is not null").join(means.where("span_mean is not null"), ["event_type", "yr", "mo"]).groupBy("event_type", "yr", "mo", "span_mean")
    return out.agg(r6(F.avg(below), "annual_rank"), r6(F.avg(F.when(F.col("dm") == F.col("mo"), below)), "monthly_rank")).withColumn("span_mean", r6("span_mean"))


@query(
    """select event_id, 'EVT_' || yr || '_' || lpad(n::varchar, 5, '0') as name, cast(n as int) as n from
    (select event_id, year(d) as yr, row_number() over (partition by year(d) order by d, event_id) as n from memory)""",
    "memory",
)
def event_numbering(spark, sf):
    n = F.row_number().over(Window.partitionBy(F.year("d")).orderBy("d", "event_id"))
    return views.memory(spark, sf).select("event_id", F.year("d").alias("yr"), n.alias("n")).select("event_id", F.format_string("EVT_%d_%05d", "yr", "n").alias("name"), "n")


@query(
    """select y.y as yr, count(*) filter (where year(d) < y.y) as n_train, count(*) filter (where year(d) = y.y) as n_test
    from memory cross join (select unnest(range(1996, 2002)) as y) y group by 1""",
    "memory",
)
def rolling_train_test_split(spark, sf):
    # counts per year first, so that only years are paired, never events
    per_year = views.memory(spark, sf).groupBy(F.year("d").alias("e")).agg(F.count(F.lit(1)).alias("n"))
    years = spark.range(1996, 2002).toDF("yr")
    pairs = per_year.join(F.broadcast(years), F.col("e") <= F.col("yr"))
    return pairs.groupBy("yr").agg(F.coalesce(F.sum(F.when(F.col("e") < F.col("yr"), F.col("n"))), F.lit(0)).alias("n_train"), F.coalesce(F.sum(F.when(F.col("e") == F.col("yr"), F.col("n"))), F.lit(0)).alias("n_test"))


@query(
    """,, asks as (select date '1995-01-01' + cast(k * 90 as int) as ask from (select unnest(range(27)) as k))
    select a.ask, p.d, cast(date_diff('day', p.d, a.ask) as int) as gap, date_diff('day', p.d, a.ask) > 3 as wide from asks a asof left join prices p on a.ask >= p.d""",
    "prices",
)
def gap_audit(spark, sf):
    asks = spark.range(27).select(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") * 90).cast("int")).alias("ask"))
    out = asof.asof(asks, views.prices(spark, sf), "ask", "d", "px")
    gap = F.datediff("ask", "d")
    return out.select("ask", "d", gap.alias("gap"), (gap > 3).alias("wide"))


@query(
    """select 'px' as c, count(px) as n, round(100.0 * count(px) / count(*), 4) as pct, min(d) filter (where px is not null) as first_day, max(d) filter (where px is not null) as last_day from (select coalesce(p.d, v.d) as d, px, ovx from prices p full join vol v on p.d = v.d)
    union all select 'ovx', count(ovx), round(100.0 * count(ovx) / count(*), 4), min(d) filter (where ovx is not null), max(d) filter (where ovx is not null) from (select coalesce(p.d, v.d) as d, px, ovx from prices p full join vol v on p.d = v.d)""",
    "prices", "vol",
)
def column_coverage(spark, sf):
    both = views.prices(spark, sf).join(views.vol(spark, sf), "d", "full").unpivot("d", ["px", "ovx"], "c", "v")
    held = F.when(F.col("v").isNotNull(), F.col("d"))
    return both.groupBy("c").agg(F.count("v").alias("n"), F.round(100.0 * F.count("v") / F.count(F.lit(1)), 4).alias("pct"), F.min(held).alias("first_day"), F.max(held).alias("last_day"))


@query(
    """select date_trunc('week', ts)::date as week, event_type, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by date_trunc('week', ts)), 4) as pct from events group by 1, 2, date_trunc('week', ts)"""
)
def weekly_volume(spark, sf):
    n = views.table(spark, sf, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("week")), 4))


@query(
    """select event_type, count(*) as n, min(d) as first_day, max(d) as last_day, cast(greatest(date_diff('day', min(d), max(d)), 1) as int) as span,
    case when count(*) >= 60 then 'macro' when count(*) >= 20 then 'medium' else 'micro' end as size from memory group by 1""",
    "memory",
)
def topic_lifespan(spark, sf):
    n = F.count(F.lit(1))
    size = F.when(n >= 60, "macro").when(n >= 20, "medium").otherwise("micro")
    return views.memory(spark, sf).groupBy("event_type").agg(n.alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.greatest(F.datediff(F.max("d"), F.min("d")), F.lit(1)).alias("span"), size.alias("size"))


@query(
    """,, b as (select r.*, ntile from (select event_id, r, ntile(5) over (order by r, event_id) as ntile from (select event_id, r from (%s) where horizon = 15 and r is not null)) r)
    select cast(ntile as int) as bin, count(*) as n, round(avg(r), 6) as mean_r, round(avg((r > 0)::int), 6) as up from b group by 1"""
    % FORWARD_SQL,
    "memory", "prices",
)
def return_quintiles(spark, sf):
    r = forward(spark, sf, (15,)).where("r is not null").select("event_id", "r")
    b = r.withColumn("bin", F.ntile(5).over(Window.orderBy("r", "event_id")))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r"), "mean_r"), r6(F.avg((F.col("r") > 0).cast("int")), "up"))


@query(
    """select d, round(pnl, 6) as pnl, round(sum(pnl) over w, 6) as cum_sum, round(exp(sum(ln(1 + pnl / 100)) over w), 6) as equity, round(exp(l - max(l) over w) - 1, 6) as drawdown
    from (select *, sum(ln(1 + pnl / 100)) over (order by d rows unbounded preceding) as l from (select d, greatest(least(2 * (px / lag(px) over (order by d) - 1), 2), -2) as pnl from prices) where pnl is not null) window w as (order by d rows unbounded preceding)""",
    "prices",
)
def equity_curve(spark, sf):
    # two percent of the money follow the price
    px = views.prices(spark, sf).withColumn("pnl", F.greatest(F.least(2 * (F.col("px") / F.lag("px").over(series.over()) - 1), F.lit(2.0)), F.lit(-2.0)))
    out = series.equity(px.where(F.col("pnl").isNotNull()).select("d", "pnl"))
    return out.select("d", *(r6(F.col(c), c) for c in ("pnl", "cum_sum", "equity", "drawdown")))


@query(
    """select corr(px, ovx) is not null as known, round(corr(px, ovx), 6) as pearson, round(corr(rp, rv), 6) as spearman, count(*) as n from
    (select px, ovx, avg(n1) over (partition by px) as rp, avg(n2) over (partition by ovx) as rv from (select px, ovx, row_number() over (order by px) as n1, row_number() over (order by ovx) as n2 from prices join vol using (d)))""",
    "prices", "vol",
)
def volatility_association(spark, sf):
    both = views.prices(spark, sf).join(views.vol(spark, sf), "d")
    ranked = both.withColumns({"n1": F.row_number().over(Window.orderBy("px")), "n2": F.row_number().over(Window.orderBy("ovx"))})
    ranked = ranked.withColumns({"rp": F.avg("n1").over(Window.partitionBy("px")), "rv": F.avg("n2").over(Window.partitionBy("ovx"))})
    return ranked.agg(F.corr("px", "ovx").isNotNull().alias("known"), r6(F.corr("px", "ovx"), "pearson"), r6(F.corr("rp", "rv"), "spearman"), F.count(F.lit(1)).alias("n"))


@query(
    """select event_id, age_years, round(exp(-0.05 * age_years), 6) as recency from (select event_id, round(greatest(date_diff('day', d, date '2001-08-01') / 365.25, 0), 6) as age_years from memory)""",
    "memory",
)
def recency_weights(spark, sf):
    age = F.round(F.greatest(F.datediff(F.lit("2001-08-01").cast("date"), "d") / 365.25, F.lit(0.0)), 6)
    return views.memory(spark, sf).select("event_id", age.alias("age_years"), r6(F.exp(-0.05 * age), "recency"))


@query(
    """select m.event_id, case when p.px is null then null when p.px < 100000 then 'low' when p.px < 150000 then 'mid' else 'high' end as level from memory m left join prices p on m.d = p.d""",
    "memory", "prices",
)
def price_levels(spark, sf):
    joined = views.memory(spark, sf).join(views.prices(spark, sf), "d", "left")
    return joined.select("event_id", ladder(F.col("px"), [(100000, "low"), (150000, "mid")], "high").alias("level"))
