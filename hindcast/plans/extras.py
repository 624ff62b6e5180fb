"""Smaller operators: required columns, over-fetched retrieval, label maps, stop lists, tags and recency. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.functions import text as T
from hindcast.functions.numbers import band_midpoint
from hindcast.operators import retrieval, statistics
from hindcast.plans.analogues import CLUSTERS, FORECAST, PAIRS, VIEWS, bases, clusters, forecasts
from hindcast.plans.market import BAND_CASE, BANDS_SQL, FORWARD_SQL, forward, r6, year_quantile_bands
from hindcast.sources import views
from hindcast.sources.views import table, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names) if names else sql
        return f

    return add


@query("select p.d, round(px, 6) as px, round(ovx, 6) as ovx from prices p full join vol v on p.d = v.d where px is not null and ovx is not null and not isnan(px) and not isnan(ovx)", "prices", "vol")
def required_columns(spark, sf):
    """Days on which every required column has a number: rows with a null or NaN go."""
    both = views.prices(spark, sf).join(views.vol(spark, sf), "d", "full")
    return both.na.drop(subset=["px", "ovx"]).select("d", r6("px", "px"), r6("ovx", "ovx"))


@query(
    f""",, pairs as ({PAIRS}), fetched as (select * from (select *, row_number() over (partition by base_id order by sim desc, event_id) as k from pairs) where k <= 100)
    select base_id, event_id, round(sim, 6) as sim, cast(rank as int) as rank from (select *, row_number() over (partition by base_id order by k) as rank from fetched where event_type = base_type) where rank <= 10""",
    "train", "test",
)
def overfetched_topk(spark, sf):
    """Ten times as many neighbours as wanted are fetched, then those of the base's type kept: there may be fewer than wanted."""
    kinds = views.memory(spark, sf).select("event_id", "event_type")
    near = retrieval.nearest(bases(spark, sf), views.train(spark, sf), 100, (-1.0,), 1).withColumnRenamed("rank", "k")
    same = near.join(kinds, "event_id").join(kinds.select(F.col("event_id").alias("base_id"), F.col("event_type").alias("base_type")), "base_id").where("event_type = base_type")
    ranked = same.withColumn("rank", F.row_number().over(Window.partitionBy("base_id").orderBy("k"))).where("rank <= 10")
    return ranked.select("base_id", "event_id", r6("sim", "sim"), "rank")


MIDPOINT_CASE = "case band when '0%-5%' then 2.5 when '5%-20%' then 12.5 when '20%-30%' then 25 when '30%-40%' then 35 when '40%-60%' then 50 when '60%-80%' then 70 when '80%-90%' then 85 when '90%-100%' then 95 else 50 end"


@query(f"select d, band, ({MIDPOINT_CASE})::double as midpoint, case when {MIDPOINT_CASE} < 30 then 'low' when {MIDPOINT_CASE} > 70 then 'high' else 'mid' end as part from (select d, {BAND_CASE} as band from prices join ({BANDS_SQL}) b on year(d) = yr)", "prices")
def band_midpoints(spark, sf):
    """The number and the group that a label of a price band stands for; 50 and mid for an unknown one."""
    bands = year_quantile_bands(spark, sf).select("d", "band").withColumn("midpoint", band_midpoint(F.col("band")))
    return bands.withColumn("part", F.when(F.col("midpoint") < 30, "low").when(F.col("midpoint") > 70, "high").otherwise("mid"))


@query(f"select event_type, polarity, mo, round(exp(-greatest(2001 - year(mo), 0) / 4.0), 6) as recency from ({CLUSTERS})", "memory")
def cluster_recency(spark, sf):
    """exp(-years / 4) of each cluster before a base of 2001; later ones count as now."""
    age = F.greatest(F.lit(2001) - F.year("mo"), F.lit(0))
    return clusters(spark, sf).select("event_type", "polarity", "mo", r6(F.exp(-age / 4.0), "recency"))


@query(
    f""",, c as (select event_type, polarity, mo, size, first_seen, last_seen from ({CLUSTERS}))
    select a.event_type as base_type, a.mo as base_mo, b.event_type, b.mo, b.size from c a join c b on a.polarity = 'P' and b.polarity = 'F' and b.mo between a.mo - interval 62 day and a.mo and b.size >= 2
      and (b.last_seen < a.first_seen or b.first_seen > a.last_seen) and b.event_type <> a.event_type""",
    "memory",
)
def cluster_prefilter(spark, sf):
    """Candidates of a cluster: others of another type, two months before it at most, of two events or more, without a common day."""
    c = clusters(spark, sf).select("event_type", "polarity", "mo", "size", "first_seen", "last_seen")
    base = c.where("polarity = 'P'").select(*(F.col(x).alias("b_" + x) for x in c.columns)).withColumn("mo", F.explode(F.sequence(F.add_months("b_mo", -3), F.col("b_mo"), F.expr("interval 1 month"))))
    near = base.join(c.where("polarity = 'F' and size >= 2"), "mo").where("mo >= date_sub(b_mo, 62) and event_type <> b_event_type and (last_seen < b_first_seen or first_seen > b_last_seen)")
    return near.select(F.col("b_event_type").alias("base_type"), F.col("b_mo").alias("base_mo"), "event_type", "mo", "size")


@query(r"select doc_id, len(list_filter(w, lambda x: x not in ('the', 'and', 'der', 'die', 'las', 'les'))) as kept, len(w) as n from (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')) as w from documents)")
def stop_list(spark, sf):
    """Different words of each document before and after a stop list, given as the text of an option."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))
    d = table(spark, sf, "documents").select("doc_id", words.alias("w"))
    stop = T.parsed_stop_list("the, and,der,die , las,les", [])
    return d.select("doc_id", F.size(F.filter("w", lambda x: ~x.isin(stop))).cast("long").alias("kept"), F.size("w").cast("long").alias("n"))


@query(
    r"""select page_id, md5(case when regexp_matches(html, '(?is)<title>.*?</title>') then trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) else trim(regexp_replace(html, '(?is)<script.*?</script>', '', 'g')) end) as summary_md5,
    contains(upper(html), 'NOT_RELEVANT') as irrelevant from pages"""
)
def tagged_part(spark, sf):
    """The text of a tag if it is there, else the whole without another tag; a sentinel marks what isn't relevant."""
    return table(spark, sf, "pages").select("page_id", F.md5(T.tagged(F.col("html"), "title", "script")).alias("summary_md5"), F.contains(F.upper("html"), F.lit("NOT_RELEVANT")).alias("irrelevant"))


@query(
    f"""{FORECAST}, s as (select d, base_id, case when p_down10 > 0.45 then 0 when median > 0.5 then 1 when median < -0.5 then -1 else 0 end as sig, realised from fct), p as (select d, base_id, sig, sig * realised - 0.1 * abs(sig) as pnl from s),
    c as (select *, sum(pnl) over (order by d, base_id rows unbounded preceding) as cum from p), m as (select *, greatest(max(cum) over (order by d, base_id rows unbounded preceding), 0) - cum as dd from c)
    select count(*) as n, count(*) filter (where sig <> 0) as n_trades, round(sum(pnl), 4) as total, round(avg((pnl > 0)::int) filter (where sig <> 0), 6) as win_rate, round(sqrt(252 / 15.0) * avg(pnl) filter (where sig <> 0) / nullif(stddev_samp(pnl) filter (where sig <> 0), 0), 6) as sharpe, round(max(dd), 4) as max_drawdown from m""",
    *VIEWS,
)
def backtest_summary(spark, sf):
    """Trades, total, win rate, Sharpe ratio by year and the deepest fall of the running sum."""
    f = forecasts(spark, sf)
    sig = F.when(F.col("p_down10") > 0.45, 0).when(F.col("median") > 0.5, 1).when(F.col("median") < -0.5, -1).otherwise(0)
    p = f.select("d", "base_id", sig.alias("sig"), (sig * F.col("realised") - 0.1 * F.abs(sig)).alias("pnl"))
    p = statistics.running(p, ["d", "base_id"], "pnl")
    traded = F.when(F.col("sig") != 0, F.col("pnl"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count(traded).alias("n_trades"), F.round(F.sum("pnl"), 4).alias("total"), r6(F.avg((traded > 0).cast("int")), "win_rate"), r6((252 / 15.0) ** 0.5 * F.avg(traded) / F.nullif(F.stddev_samp(traded), F.lit(0.0)), "sharpe"), F.round(F.max(F.col("peak") - F.col("sum")), 4).alias("max_drawdown"))


@query(
    f"""{FORECAST}, z as (select row_number() over (order by d, base_id) as k, abs(realised - median) - abs(realised) as x from fct), c as (select k, x - avg(x) over () as y, count(*) over () as n, avg(x) over () as m from z)
    select any_value(n) as n, round(any_value(m), 6) as mean_diff, round(any_value(m) / sqrt(nullif(greatest((sum(a.y * a.y) + 2 * sum(a.y * coalesce(b.y, 0))) / any_value(n), 0) / any_value(n), 0)), 6) as dm_biased from c a left join (select k + 1 as k, y from c) b using (k)""",
    *VIEWS,
)
def diebold_mariano_biased(spark, sf):
    """The third variance of the test: autocovariances divided by n, one lag; the lag crosses partitions by a join of places."""
    f = forecasts(spark, sf).select("d", "base_id", (F.abs(F.col("realised") - F.col("median")) - F.abs("realised")).alias("x"))
    s = statistics.numbered(f, ["d", "base_id"])
    m = s.agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    y = s.join(F.broadcast(m)).select("k", (F.col("x") - F.col("m")).alias("y"), "m", "n")
    both = y.join(y.select((F.col("k") + 1).alias("k"), F.col("y").alias("before")), "k", "left")
    n, mean = F.first("n"), F.first("m")
    var = F.greatest((F.sum(F.col("y") * F.col("y")) + 2 * F.sum(F.col("y") * F.coalesce("before", F.lit(0.0)))) / n, F.lit(0.0)) / n
    return both.agg(n.alias("n"), r6(mean, "mean_diff"), r6(mean / F.sqrt(F.nullif(var, F.lit(0.0))), "dm_biased"))


@query(
    f"""select quintile, count(*) as n, round(avg(r), 6) as mean_r, round(avg(abs(r)), 6) as mean_abs from (select r, ntile(5) over (order by r, event_id) as quintile from ({FORWARD_SQL}) where horizon = 15 and r is not null) group by 1""",
    "memory", "prices",
)
def return_fifths(spark, sf):
    """Fifths of the 15-day returns by exact ranks that are numbered in all partitions at once, with the mean absolute return."""
    r = statistics.numbered(forward(spark, sf, (15,)).where("r is not null").select("event_id", "r"), ["r", "event_id"])
    n = r.agg(F.count(F.lit(1)).alias("n"))
    size, more = F.floor(F.col("n") / 5), F.col("n") % 5
    at = F.col("k") - 1
    fifth = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    return r.join(F.broadcast(n)).withColumn("quintile", fifth.cast("int")).groupBy("quintile").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r"), "mean_r"), r6(F.avg(F.abs("r")), "mean_abs"))
