"""Ranked funnels: events reranked by their price paths, and the cascade over clusters, with what each stage leaves.

Retrieval reads the corpus in blocks and keeps a bounded pool of each query inside the tasks; everything after that ranks
those pools. Paths, bands and returns depend on days only, so they are worked out once a day or once a year and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import vectors as V
from hindcast.functions.numbers import normal_cdf_sql
from hindcast.operators import asof, retrieval, series, statistics
from hindcast.plans.analogues import LADDER, PAIRS, bases
from hindcast.plans.market import BAND_CASE, BANDS_SQL, r6, year_quantile_bands
from hindcast.sources import shared, views
from hindcast.sources.views import table, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *names: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names, recursive=recursive) if names else sql
        return f

    return add


def warping_sql(source: str, a: str, b: str, n: int, band: int | None = None, out: str = "warped", plain: bool = False) -> str:
    """CTEs from `source` to `out`, which has dtw besides: squared costs between lists a and b of length n, row after row, and
    a root of their sum; with `plain`, absolute costs and no root."""
    cell = lambda i, j: "0.0" if i == j == 0 else f"c{i}_{j}" if i and j and (band is None or abs(i - j) <= band) else None
    steps, last = [], source
    for i in range(1, n + 1):
        cells, before = [], [c for j in range(1, n + 1) if i > 1 and (c := cell(i - 1, j))]
        for j in range(1, n + 1):
            if own := cell(i, j):
                from_ = [c for c in (cell(i - 1, j), cell(i, j - 1), cell(i - 1, j - 1)) if c]
                cost = f"abs({a}[{i}] - {b}[{j}])" if plain else f"({a}[{i}] - {b}[{j}]) * ({a}[{i}] - {b}[{j}])"
                cells.append(f"{cost} + least({', '.join(from_)}) as {own}")
        steps.append(f"{out}{i} as (select *{f' exclude ({chr(44).join(before)})' if before else ''}, {', '.join(cells)} from {last})")
        last = f"{out}{i}"
    return ", ".join(steps) + f", {out} as (select *, {f'c{n}_{n}' if plain else f'sqrt(c{n}_{n})'} as dtw from {last})"


# Events: similar enough, then by path, then by how long the first move held.

#: Days around an event whose prices make its path.
NODES = (-30, -15, -7, 0, 7, 15, 30)
#: Types that don't move markets, candidates that a threshold must leave, analogues kept, decay a year, events drawn by chance.
EXCLUDED, FEWEST, KEPT, FADING, DRAWN, SEED = (3, 7), 10, 20, 0.05, 50, 42


def node_paths(spark, sf) -> DataFrame:
    """(d, path): for each day with an event, the prices nearest to its nodes in percent of the day's own; zero where there is none."""
    asks = views.memory(spark, sf).select("d").where("d is not null").distinct().withColumn("node", F.explode(F.array(*(F.lit(n) for n in NODES))))
    asks = asks.withColumn("ask", F.date_add("d", F.col("node")))
    px = views.prices(spark, sf).select(F.col("d").alias("d1"), "px")
    near = asof.asof(asks, px, "ask", "d1", "px", "nearest", 10, by=["d", "node", "ask"])
    near = near.withColumn("px", F.when((F.col("node") != 0) | (F.abs(F.datediff("d1", "ask")) <= 5), F.col("px")))
    p = near.groupBy("d").agg(F.max(F.when(F.col("node") == 0, F.col("px"))).alias("p0"), F.array_sort(F.collect_list(F.struct("node", "px"))).alias("x"))
    return p.select("d", F.transform("x", lambda x: F.coalesce(100 * (x["px"] - F.col("p0")) / F.nullif(F.abs("p0"), F.lit(0.0)), F.lit(0.0))).alias("path"))


def with_paths(events: DataFrame, paths: DataFrame) -> DataFrame:
    """events with the path of their day; a table of days is as long as the calendar, however many events there are."""
    return events.join(F.broadcast(paths), "d")


def persistence(path: Column) -> Column:
    """Of the returns after 7, 15 and 30 days, how many have the direction of the first; none if the first is zero and the others fall."""
    r = [F.get(path, F.lit(k)) for k in (4, 5, 6)]
    sign = F.when(r[0] >= 0, 1).otherwise(-1)
    return sum(((x * sign > 0).cast("int") for x in r[1:]), (r[0] * sign > 0).cast("int"))


def reranked(base: DataFrame, corpus: DataFrame, ladder=LADDER, fewest: int = FEWEST, k: int = KEPT, fading: float = FADING) -> DataFrame:
    """(base_id, tau, n_candidates, rank, event_id, sim, dtw, persistence, recency, combined, path, base_path).

    Events before the query that are as similar as its threshold: the 2k of the nearest paths, of these the k of the longest
    persistence, then the nearest path. base is (base_id, d, emb, path), corpus (event_id, d, emb, path).
    """
    tau = retrieval.reached(base, corpus, ladder, fewest)
    pool = retrieval.warped(base.join(tau.select("base_id", "tau"), "base_id"), corpus, 2 * k)
    pool = pool.join(corpus.select("event_id", "d", "path"), "event_id").join(base.select("base_id", F.col("d").alias("bd"), F.col("path").alias("base_path")), "base_id").join(tau, "base_id")
    pool = pool.withColumn("persistence", persistence(F.col("path")))
    place = F.row_number().over(Window.partitionBy("base_id").orderBy(F.desc("persistence"), "dtw", "event_id"))
    best = pool.withColumn("rank", place).where(F.col("rank") <= k)
    best = best.withColumn("recency", F.exp(-fading * F.greatest(F.datediff("bd", "d") / 365.25, F.lit(0.0)))).withColumn("combined", F.col("sim") * F.col("recency"))
    return best.select("base_id", "tau", "n_candidates", "rank", "event_id", "sim", "dtw", "persistence", "recency", "combined", "path", "base_path")


def asked(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries and the corpus without excluded types, each with paths, and the paths."""
    paths = node_paths(spark, sf)
    corpus = views.train(spark, sf).where(~F.col("event_type").isin(*EXCLUDED))
    return with_paths(bases(spark, sf), paths), with_paths(corpus, paths), paths


PATHS = f"""nodes as (select unnest([{', '.join(map(str, NODES))}]) as node), days as (select distinct d from memory),
near_ as (select d, node, px from (select x.d, n.node, p.px, row_number() over (partition by x.d, n.node order by abs(date_diff('day', x.d + n.node, p.d)), p.d) as k
  from days x cross join nodes n join prices p on abs(date_diff('day', x.d + n.node, p.d)) <= case when n.node = 0 then 5 else 10 end) where k = 1),
paths as (select x.d, list(coalesce(100 * (r.px - z.px) / abs(z.px), 0.0) order by n.node) as path from days x cross join nodes n left join near_ r on r.d = x.d and r.node = n.node left join near_ z on z.d = x.d and z.node = 0 group by 1)"""
STEPS_OF = "list_transform(range(1, 7), lambda i: {p}[i + 1] - {p}[i])"
RERANKED = f""",, {PATHS}, pairs as (select * from ({PAIRS}) where event_type not in {EXCLUDED}),
counts as (select base_id, tau, count(*) filter (where sim >= tau) as n from pairs cross join (select unnest([{', '.join(map(str, LADDER))}]) as tau) group by 1, 2),
taus as (select base_id, tau::double as tau, n as n_candidates from (select *, row_number() over (partition by base_id order by (n >= {FEWEST}) desc, case when n >= {FEWEST} then -tau else tau end) as k from counts) where k = 1),
cand as (select p.base_id, t.tau, t.n_candidates, p.event_id, p.sim, p.cd, p.bd, a.path, b.path as base_path, {STEPS_OF.format(p='a.path')} as x, {STEPS_OF.format(p='b.path')} as y
  from pairs p join taus t using (base_id) join paths a on a.d = p.cd join paths b on b.d = p.bd where p.sim >= t.tau), {warping_sql('cand', 'x', 'y', 6, 2)},
pool as (select *, case when path[5] >= 0 then 1 else -1 end as sgn from (select *, row_number() over (partition by base_id order by dtw, event_id) as place from warped) where place <= {2 * KEPT}),
held as (select *, (path[5] * sgn > 0)::int + (path[6] * sgn > 0)::int + (path[7] * sgn > 0)::int as persistence from pool),
best as (select * from (select *, row_number() over (partition by base_id order by persistence desc, dtw, event_id) as rank from held) where rank <= {KEPT}),
final as (select *, exp(-{FADING} * greatest(date_diff('day', cd, bd) / 365.25, 0)) as recency from best)"""
REVIEWED = ("train", "test", "prices")


@query(f"{RERANKED} select base_id, cast(rank as int) as rank, event_id, tau, round(sim, 6) as sim, round(dtw, 4) as dtw, persistence, round(recency, 6) as recency, round(sim * recency, 6) as combined from final", *REVIEWED)
def reranked_retrieval(spark, sf):
    """Analogues of every query: by threshold, nearest paths, persistence, and their recency."""
    base, corpus, _ = asked(spark, sf)
    return reranked(base, corpus).select("base_id", "rank", "event_id", "tau", r6("sim", "sim"), F.round("dtw", 4).alias("dtw"), "persistence", r6("recency", "recency"), r6("combined", "combined"))


def drawn(corpus: DataFrame, n: int = DRAWN, seed: int = SEED) -> list:
    """The paths of n corpus events in the order of a hash of seed and id: the same ones whatever the partitions."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("event_id").cast("string")).cast("binary"))
    return [list(r["path"]) for r in corpus.select("event_id", "path", order.alias("o")).orderBy("o", "event_id").limit(n).collect()]


def against_chance(found: DataFrame, base: DataFrame, corpus: DataFrame, n: int = DRAWN, seed: int = SEED) -> DataFrame:
    """Per query: mean distance of its analogues' paths and of n events drawn by chance, and signed ranks of the pairs by place.

    The same n events are drawn for all queries; their paths travel as one literal. The test needs ten analogues.
    """
    paths = drawn(corpus, n, seed)
    if not paths:
        return found.sparkSession.createDataFrame([], "base_id long, tau double, n_candidates long, n_analogues long, own_dtw double, random_dtw double, n_pairs long, w_plus double, w_minus double, z double, p double")
    lit = F.array(*(F.array(*(F.lit(float(x)) for x in path)) for path in paths))
    chance = retrieval.with_dtw(base.select("base_id", F.col("path").alias("base_path"), F.posexplode(lit).alias("pos", "path")), "path", "base_path", "random_dtw")
    chance = chance.select("base_id", (F.col("pos") + 1).alias("rank"), "random_dtw")
    own = found.groupBy("base_id").agg(F.first("tau").alias("tau"), F.first("n_candidates").alias("n_candidates"), F.count(F.lit(1)).alias("n_analogues"), F.avg("dtw").alias("own_dtw"))
    mean = chance.groupBy("base_id").agg(F.avg("random_dtw").alias("random_dtw"))
    paired = found.select("base_id", "rank", "dtw").join(chance, ["base_id", "rank"]).join(own.where("n_analogues >= 10").select("base_id"), "base_id", "left_semi")
    tested = statistics.signed_ranks(paired, "base_id", "dtw", "random_dtw").withColumnRenamed("n", "n_pairs")
    return own.join(mean, "base_id").join(tested, "base_id", "left")


Z_SQL = "((w_plus - n_pairs * (n_pairs + 1) / 4.0) / sqrt(nullif(n_pairs * (n_pairs + 1) * (2 * n_pairs + 1) / 24.0 - ties / 48.0, 0)))"


@query(
    f"""{RERANKED}, own as (select base_id, any_value(tau) as tau, any_value(n_candidates) as n_candidates, count(*) as n_analogues, avg(dtw) as own_dtw from final group by 1),
    chosen as (select row_number() over (order by md5('{SEED}:' || t.event_id), t.event_id) as rank, {STEPS_OF.format(p='a.path')} as x from train t join paths a using (d) where event_type not in {EXCLUDED} qualify rank <= {DRAWN}),
    crossed as (select t.event_id as base_id, c.rank, c.x, {STEPS_OF.format(p='b.path')} as y from test t join paths b using (d) cross join chosen c), {warping_sql('crossed', 'x', 'y', 6, 2, 'chance')},
    ranks as (select base_id, f.dtw - c.dtw as d, row_number() over (partition by base_id order by abs(f.dtw - c.dtw)) as k from final f join chance c using (base_id, rank) join own using (base_id) where n_analogues >= 10 and f.dtw <> c.dtw),
    shared as (select *, avg(k) over (partition by base_id, abs(d)) as r, count(*) over (partition by base_id, abs(d)) as t from ranks),
    sums as (select base_id, count(*) as n_pairs, sum(case when d > 0 then r else 0 end)::double as w_plus, sum(case when d < 0 then r else 0 end)::double as w_minus, sum(t * t - 1) as ties from shared group by 1),
    tested as (select *, {Z_SQL} as z from sums)
    select base_id, tau, n_candidates, n_analogues, round(own_dtw, 4) as own_dtw, round(random_dtw, 4) as random_dtw, n_pairs, w_plus, w_minus, round(z, 4) as z, round(2 * (1 - {normal_cdf_sql('abs(z)')}), 4) as p
    from own join (select base_id, avg(dtw) as random_dtw from chance group by 1) using (base_id) left join tested using (base_id)""",
    *REVIEWED,
)
def rerank_against_chance(spark, sf):
    """Are the analogues' paths nearer than those of events drawn by chance? Means and signed ranks of every query."""
    base, corpus, _ = asked(spark, sf)
    out = against_chance(reranked(base, corpus), base, corpus)
    r4 = lambda c: F.round(c, 4).alias(c)
    return out.select("base_id", "tau", "n_candidates", "n_analogues", r4("own_dtw"), r4("random_dtw"), "n_pairs", "w_plus", "w_minus", r4("z"), r4("p"))


@query(
    f"""{RERANKED} select base_id, band, count(*) as n, round(count(*) / sum(count(*)) over (partition by base_id), 6) as share
    from cand join (select d, {BAND_CASE} as band from prices join ({BANDS_SQL}) b on year(d) = yr) q on q.d = cand.cd group by 1, 2""",
    *REVIEWED,
)
def candidate_bands(spark, sf):
    """In which price band of its year the candidates of each query happened; those on days without a price are left out."""
    base, corpus, _ = asked(spark, sf)
    tau = retrieval.reached(base, corpus, LADDER, FEWEST)
    bands = year_quantile_bands(spark, sf).select("d", F.col("band").alias("stratum"))
    n = retrieval.strata(base.join(tau, "base_id"), corpus.join(F.broadcast(bands), "d"))
    return n.select("base_id", F.col("stratum").alias("band"), "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy("base_id")), "share"))


# Clusters: the bundle of each, and the cascade over them.

#: Labels of the bands of a signature, and the shares below which each of them ends.
SIGNATURE = ("0-5%", "5-20%", "20-40%", "40-60%", "60-80%", "80-95%", "95-100%")
CUTS = (0.05, 0.20, 0.40, 0.60, 0.80, 0.95)
UNKNOWN, KEYS = "UNK", ("annual", "monthly", "cum_7d", "cum_15d", "cum_30d")
SPANS = {7: "cum_7d", 15: "cum_15d", 30: "cum_30d"}
#: Points of a propagation profile, days of a return path after the span, words of a bag.
GRID, AFTER, WORDS = 21, 15, 30


def quarters(spark, sf) -> DataFrame:
    """Clusters, here the events of one type in a quarter: (id, event_type, size, first_seen, last_seen, spread_days, yr)."""
    m = with_id(spark, sf)
    c = m.groupBy("id", "event_type").agg(F.count(F.lit(1)).alias("size"), F.min("d").alias("first_seen"), F.max("d").alias("last_seen"))
    return c.withColumns({"spread_days": F.datediff("last_seen", "first_seen"), "yr": F.year("first_seen")})


def with_id(spark, sf) -> DataFrame:
    return views.memory(spark, sf).withColumn("id", (F.col("event_type") * 1000 + (F.year("d") - 1990) * 4 + F.quarter("d")).cast("long"))


WITH_ID = "members as (select *, (event_type * 1000 + (year(d) - 1990) * 4 + quarter(d))::bigint as id from memory)"
QUARTERS = f"{WITH_ID}, c as (select id, event_type, count(*) as size, min(d) as first_seen, max(d) as last_seen, cast(date_diff('day', min(d), max(d)) as int) as spread_days, year(min(d)) as yr from members group by 1, 2)"


def daily(spark, sf) -> DataFrame:
    """(d, px, before, r): each day's price, the priced day before it and the return since."""
    w = series.over()
    return views.prices(spark, sf).withColumns({"before": F.lag("d").over(w), "r": F.col("px") / F.lag("px").over(w) - 1})


DAILY = "daily as (select d, px, lag(d) over (order by d) as before, px / lag(px) over (order by d) - 1 as r from prices)"


def band_in(v: Column, sorted_: Column) -> Column:
    """The band of a value among the values of an array: the first whose cut is above the share of smaller ones."""
    share = F.size(F.filter(sorted_, lambda x: x < v)) / F.size(sorted_)
    out = F.when(v.isNull() | sorted_.isNull() | (F.size(sorted_) == 0), UNKNOWN)
    for cut, label in zip(CUTS, SIGNATURE, strict=False):
        out = out.when(share < cut, label)
    return out.otherwise(SIGNATURE[-1])


def signatures(c: DataFrame, days: DataFrame) -> DataFrame:
    """(id, annual, monthly, cum_7d, cum_15d, cum_30d) of clusters (id, first_seen, last_seen) over daily(): how the market moved.

    The mean daily return of the span stands among those of its year and month, the move of the 7, 15 and 30 days from its
    start among all sums of as many returns in that year. Years and months are arrays of at most 366 returns, one row each,
    so a cluster reads one row and not its year's days; only the days from its start are joined.
    """
    year = Window.partitionBy("yr").orderBy("d")
    own = days.withColumns({"yr": F.year("d"), "mo": F.month("d")})
    own = own.withColumn("ry", F.when(F.year("before") == F.col("yr"), F.col("r"))).withColumn("rm", F.when(F.date_trunc("month", "before") == F.date_trunc("month", "d"), F.col("r")))
    for n in SPANS:
        frame = year.rowsBetween(1 - n, 0)
        own = own.withColumn(f"s{n}", F.when(F.count("ry").over(frame) == n, F.sum("ry").over(frame)))
    years = own.groupBy("yr").agg(F.collect_list("ry").alias("in_year"), *(F.collect_list(f"s{n}").alias(f"in_{n}") for n in SPANS))
    months = own.groupBy("yr", "mo").agg(F.collect_list("rm").alias("in_month"))
    reach = F.sequence(F.col("first_seen"), F.greatest("last_seen", F.date_add("first_seen", max(SPANS))))
    near = c.select("id", "first_seen", "last_seen", F.explode(reach).alias("d")).join(F.broadcast(days), "d")
    gap = F.datediff("d", "first_seen")
    mean = F.avg(F.when((F.col("d") <= F.col("last_seen")) & (F.col("before") >= F.col("first_seen")), F.col("r")))
    moves = [F.when(F.count(F.when(gap <= n, 1)) >= 2, F.max_by(F.when(gap <= n, F.col("px")), F.when(gap <= n, F.col("d"))) / F.min_by("px", "d") - 1).alias(f"m{n}") for n in SPANS]
    moved = near.groupBy("id", "first_seen").agg(mean.alias("mean"), *moves, F.count(F.when(F.col("d") <= F.col("last_seen"), 1)).alias("priced"))
    both = moved.withColumns({"yr": F.year("first_seen"), "mo": F.month("first_seen")}).join(F.broadcast(years), "yr", "left").join(F.broadcast(months), ["yr", "mo"], "left")
    # without a price in the span nothing is known, not even of the days after it
    known = lambda x: F.when(F.col("priced") > 0, x).otherwise(UNKNOWN)
    found = both.select("id", known(band_in(F.col("mean"), F.col("in_year"))).alias("annual"), known(band_in(F.col("mean"), F.col("in_month"))).alias("monthly"), *(known(band_in(F.col(f"m{n}"), F.col(f"in_{n}"))).alias(name) for n, name in SPANS.items()))
    return c.select("id").join(found, "id", "left").na.fill(UNKNOWN, list(KEYS))


def band_sql(share: str) -> str:
    return "case when {s} is null then 'UNK' ".format(s=share) + " ".join(f"when {share} < {c} then '{b}'" for c, b in zip(CUTS, SIGNATURE, strict=False)) + f" else '{SIGNATURE[-1]}' end"


SIGNATURES = f"""{DAILY}, ry as (select year(d) as yr, month(d) as mo, d, r, date_trunc('month', before) = date_trunc('month', d) as same from daily where year(before) = year(d)),
rolled as (select yr, """ + ", ".join(f"case when count(*) over w{n} = {n} then sum(r) over w{n} end as s{n}" for n in SPANS) + " from ry window " + ", ".join(f"w{n} as (partition by yr order by d rows {n - 1} preceding)" for n in SPANS) + """),
means as (select c.id, c.yr, month(c.first_seen) as mo, count(*) as priced, avg(y.r) filter (where y.before >= c.first_seen) as mean from c join daily y on y.d between c.first_seen and c.last_seen group by 1, 2, 3),
moves as (select c.id, """ + ", ".join(f"case when count(*) filter (where y.d <= c.first_seen + {n}) >= 2 then (arg_max(y.px, y.d) filter (where y.d <= c.first_seen + {n})) / arg_min(y.px, y.d) - 1 end as m{n}" for n in SPANS) + " from c join daily y on y.d between c.first_seen and greatest(c.last_seen, c.first_seen + 30) group by 1),\nshares as (select m.id, case when mean is not null then (select avg((r < m.mean)::int) from ry where ry.yr = m.yr) end as a, case when mean is not null then (select avg((r < m.mean)::int) from ry where ry.yr = m.yr and ry.mo = m.mo and same) end as b, " + ", ".join(f"case when v.m{n} is not null then (select avg((s{n} < v.m{n})::int) from rolled where rolled.yr = m.yr and s{n} is not null) end as s{n}" for n in SPANS) + " from means m join moves v using (id)),\nsigned as (select c.id, " + ", ".join(f"{band_sql(s)} as {k}" for s, k in zip(("a", "b", "s7", "s15", "s30"), KEYS, strict=True)) + " from c left join shares using (id))"


@query(f",, {QUARTERS}, {SIGNATURES} select * from signed", "memory", "prices")
def cluster_signature(spark, sf):
    """The five bands of every cluster."""
    return signatures(quarters(spark, sf), daily(spark, sf))


def distance_of_bands(a: Column, b: Column) -> Column:
    """Share of the five bands that differ, of those that are known on either side; 1 if none is. a and b are structs of KEYS."""
    known = sum(((a[k] != UNKNOWN) | (b[k] != UNKNOWN)).cast("int") for k in KEYS[1:]) + ((a[KEYS[0]] != UNKNOWN) | (b[KEYS[0]] != UNKNOWN)).cast("int")
    differ = sum((a[k] != b[k]).cast("int") for k in KEYS[1:]) + (a[KEYS[0]] != b[KEYS[0]]).cast("int")
    return F.when(known == 0, 1.0).otherwise(differ / known)


def profiles(members: DataFrame, c: DataFrame) -> DataFrame:
    """(id, profile): events a day over a cluster's span, read at GRID even places between whose days it is linear, adding up to 1.

    Events are counted per day before days are gathered. A span of one day counts as two, the second without events.
    """
    days = members.join(c.select("id", "first_seen", "spread_days"), "id").groupBy("id", "spread_days", F.datediff("d", "first_seen").alias("at")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    p = days.groupBy("id", "spread_days").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("on"))
    wide = F.greatest("spread_days", F.lit(1)).cast("double")
    on = lambda k: F.coalesce(F.col("on")[k.cast("int")], F.lit(0.0))
    places = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda k: k * wide / (GRID - 1))
    p = p.withColumn("y", F.transform(places, lambda x: on(F.floor(x)) + (x - F.floor(x)) * (on(F.floor(x) + 1) - on(F.floor(x)))))
    total = F.aggregate("y", F.lit(0.0), lambda s, x: s + x)
    return p.select("id", F.when(total > 0, F.transform("y", lambda x: x / total)).otherwise(F.col("y")).alias("profile"))


PROFILES = f"""ats as (select m.id, date_diff('day', c.first_seen, m.d) as at, count(*) as n from members m join c using (id) group by 1, 2),
places as (select c.id, k, k * greatest(c.spread_days, 1)::double / {GRID - 1} as x from c cross join (select unnest(range({GRID})) as k)),
reads as (select p.id, p.k, coalesce(l.n, 0)::double + (x - floor(x)) * (coalesce(h.n, 0)::double - coalesce(l.n, 0)::double) as y from places p left join ats l on l.id = p.id and l.at = floor(x)::bigint left join ats h on h.id = p.id and h.at = floor(x)::bigint + 1),
profiled as (select id, k, case when sum(y) over (partition by id) > 0 then y / sum(y) over (partition by id) else y end as share from reads)"""


@query(f",, {QUARTERS}, {PROFILES} select id, cast(k as int) as k, round(share, 6) as share from profiled", "memory")
def cluster_profile(spark, sf):
    """The propagation profile of every cluster, point by point."""
    p = profiles(with_id(spark, sf).select("id", "d"), quarters(spark, sf)).select("id", F.posexplode("profile").alias("k", "share"))
    return p.select("id", "k", r6("share", "share"))


def return_paths(c: DataFrame, days: DataFrame, after: int = AFTER) -> DataFrame:
    """(id, returns): the daily log returns from a cluster's first day to `after` days past its last; empty with fewer than two prices."""
    near = c.select("id", "first_seen", F.explode(F.sequence(F.col("first_seen"), F.date_add("last_seen", after))).alias("d")).join(F.broadcast(days), "d")
    inside = near.where("before >= first_seen").select("id", F.struct("d", F.log1p("r").alias("r")).alias("x"))
    found = inside.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("returns"))
    return c.select("id").join(found, "id", "left").select("id", F.coalesce("returns", F.array().cast("array<double>")).alias("returns"))


PATH_POINTS = f"points as (select c.id, y.d, row_number() over (partition by c.id order by y.d) - 1 as k, ln(1 + y.r) as r from c join daily y on y.d between c.first_seen and c.last_seen + {AFTER} and y.before >= c.first_seen)"


@query(f",, {QUARTERS}, {DAILY}, {PATH_POINTS} select id, cast(k as int) as k, round(r, 6) as r from points", "memory", "prices")
def cluster_return_path(spark, sf):
    """What the price did from each cluster's first day on, day by day."""
    return return_paths(quarters(spark, sf), daily(spark, sf)).select("id", F.posexplode("returns").alias("k", "r")).select("id", "k", r6("r", "r"))


def bags(spark, sf, most: int = WORDS, stop: tuple[str, ...] = ()) -> DataFrame:
    """(id, bag): the commonest words of the texts of each cluster's events, without those of a stop list."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), "text")
    words = with_id(spark, sf).select("event_id", "id").join(texts, "event_id").select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    n = words.where("length(w) > 2").groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "w"))).where(F.col("k") <= most)
    return top.where(~F.col("w").isin(*stop) if stop else F.lit(True)).groupBy("id").agg(F.array_sort(F.collect_list("w")).alias("bag"))


STOP = ("the", "and", "der", "die", "las", "les")
BAGS = f"""worded as (select m.id, unnest(regexp_extract_all(lower(t.text), '[a-z]+')) as w from members m join documents t on t.doc_id = m.event_id),
bags as (select id, list(w order by w) as bag from (select id, w, row_number() over (partition by id order by count(*) desc, w) as k from worded where length(w) > 2 group by 1, 2) where k <= {WORDS} and w not in {STOP} group by 1)"""


def dominances(c: DataFrame) -> DataFrame:
    """(id, share, concurrent, larger): a cluster's part of all events of the clusters that overlap it, their number, and how many are larger."""
    other = c.select(*(F.col(x).alias("o_" + x) for x in ("id", "size", "first_seen", "last_seen")))
    met = asof.overlap_join(c.select("id", "size", "first_seen", "last_seen"), other, ("first_seen", "last_seen"), ("o_first_seen", "o_last_seen"), days=92).where("id <> o_id")
    sums = met.groupBy("id").agg(F.sum("o_size").alias("s"), F.count(F.lit(1)).alias("concurrent"), F.count_if(F.col("o_size") > F.col("size")).alias("larger"))
    both = c.select("id", "size").join(sums, "id", "left").na.fill(0, ["s", "concurrent", "larger"])
    return both.select("id", (F.col("size") / (F.col("size") + F.col("s"))).alias("dominance"), "concurrent", "larger")


def centroids(members: DataFrame) -> DataFrame:
    """(id, emb): the mean vector of each cluster, summed place by place."""
    x = members.select("id", F.posexplode("emb").alias("k", "x")).groupBy("id", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return x.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda y: y["x"]).alias("emb"))


#: Thresholds and pools of the stages, weights of meaning, propagation and bands, penalties, analogues kept, decay in years.
TAU_S, TAU_ETA, TAU_Q, POOLS, BETA, GAMMA, LESS, TOP, FADE = 0.05, 0.1, 0.9, (200, 60, 30), (0.5, 0.3, 0.2), 0.5, 0.3, 10, 4.0
#: Queries of the cascade are the clusters from this day on.
ASKED_FROM = views.SPLIT


def staged(queries: DataFrame, index: DataFrame, fade: float | None = FADE, least: int = 1, tau=(TAU_S, TAU_ETA, TAU_Q), pools=POOLS, top: int = TOP, beta=BETA, gamma: float = GAMMA, less: float = LESS, years: tuple[int | None, int | None] = (None, None), roles: tuple[str, ...] = ()) -> DataFrame:
    """One row for each candidate that a query's first stage leaves, with the scores, stage (1 to 4: the last that it passed) and weight.

    index is (id, first_seen, last_seen, size, role, emb, bag, bands, profile, dominance, concurrent, larger); candidates end
    before the query begins, have `least` events and, if given, a first year within `years` and one of `roles`. Stages: the
    pools[0] most similar (faded by age), of a similarity of tau[0]; the pools[1] of the most shared words, a share of tau[1];
    the pools[2] of the nearest bands, tau[2] at most; the 2 * top of the nearest propagation. Ties keep the order before.
    """
    candidates = index.where(F.col("size") >= least)
    for bound, fits in ((years[0], F.year("first_seen") >= years[0]), (years[1], F.year("first_seen") <= years[1])):
        candidates = candidates if bound is None else candidates.where(fits)
    candidates = candidates.where(F.col("role").isin(*roles)) if roles else candidates
    near = retrieval.faded(queries.select(F.col("id").alias("base_id"), F.col("first_seen").alias("d"), "emb"), candidates.select(F.col("id").alias("event_id"), F.col("last_seen").alias("d"), "emb"), pools[0], tau[0], fade)
    q = queries.select(F.col("id").alias("base_id"), F.col("bag").alias("b_bag"), F.col("bands").alias("b_bands"), F.col("profile").alias("b_profile"), F.year("first_seen").alias("b_yr"))
    p = near.withColumnRenamed("event_id", "id").join(index.drop("emb"), "id").join(q, "base_id")
    none = F.array().cast("array<string>")
    p = p.withColumns({"jaccard": V.jaccard(F.coalesce("b_bag", none), F.coalesce("bag", none)), "d_qtl": distance_of_bands(F.col("b_bands"), F.col("bands"))})
    place = lambda on, *order: F.when(on, F.row_number().over(Window.partitionBy("base_id", on).orderBy(*order)))
    two = F.col("jaccard") >= tau[1]
    p = p.withColumn("k2", place(two, F.desc("jaccard"), F.desc("score"), "id")).withColumn("two", F.coalesce(F.col("k2") <= pools[1], F.lit(False)))
    three = F.col("two") & (F.col("d_qtl") <= tau[2])
    p = p.withColumn("k3", place(three, "d_qtl", "k2")).withColumn("three", F.coalesce(F.col("k3") <= pools[2], F.lit(False)))
    p = p.withColumns({"__a": F.when(F.col("three"), F.col("b_profile")), "__b": F.when(F.col("three"), F.col("profile"))})
    p = retrieval.with_dtw(p, "__a", "__b", band=None, increments=False).drop("__a", "__b")
    p = p.withColumn("k4", place(F.col("dtw").isNotNull(), "dtw", "k3")).withColumn("four", F.coalesce(F.col("k4") <= 2 * top, F.lit(False)))
    longest = F.max("dtw").over(Window.partitionBy("base_id"))
    p = p.withColumn("s_prop", F.when(longest > 0, 1 - F.col("dtw") / longest).otherwise(F.when(F.col("dtw").isNotNull(), 0.0)))
    c_t, age = (F.col("larger") > 0).cast("int"), F.greatest(F.col("b_yr") - F.year("first_seen"), F.lit(0))
    raw = beta[0] * F.col("sim") + beta[1] * F.col("s_prop") + beta[2] * (1 - F.col("d_qtl")) - gamma * c_t - (1 - F.col("dominance")) * less
    p = p.withColumns({"c_t": c_t, "age": age, "recency": F.exp(-age / fade) if fade else F.lit(1.0), "raw": F.when(F.col("four"), raw)})
    stage = F.lit(1) + F.col("two").cast("int") + F.col("three").cast("int") + F.col("four").cast("int")
    return p.withColumns({"stage": stage, "weight": F.col("raw") * F.col("recency")})


def ranked(p: DataFrame, top: int = TOP, per_era: int | None = None, era_years: int = 5) -> DataFrame:
    """The `top` candidates of the last stage by weight, with their rank; of each era of years at most per_era."""
    best = p.where("stage = 4")
    if per_era:
        era = F.floor(F.year("first_seen") / era_years)
        best = best.withColumn("__e", F.row_number().over(Window.partitionBy("base_id", era).orderBy(F.desc("weight"), "k4"))).where(F.col("__e") <= per_era)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("base_id").orderBy(F.desc("weight"), "k4"))).where(F.col("rank") <= top)


REASONS = ("no candidate passed the semantic stage", "no candidate passed the entity stage", "no candidate passed the quantile stage")


def funnel(p: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(base_id, n_semantic, n_entity, n_quantile, n_propagation, n_ranked, reason): what each stage left of every query; the reason of an empty result."""
    n = p.groupBy("base_id").agg(F.count(F.lit(1)).alias("n_semantic"), *(F.count_if(F.col("stage") >= k).alias(c) for k, c in ((2, "n_entity"), (3, "n_quantile"), (4, "n_propagation"))))
    names = ["n_semantic", "n_entity", "n_quantile", "n_propagation"]
    every = queries.select(F.col("id").alias("base_id")).join(n, "base_id", "left").na.fill(0, names)
    reason = F.when(F.col("n_semantic") == 0, REASONS[0]).when(F.col("n_entity") == 0, REASONS[1]).when(F.col("n_quantile") == 0, REASONS[2])
    return every.withColumns({"n_ranked": F.least("n_propagation", F.lit(top)), "reason": reason})


def index_of(spark, sf) -> DataFrame:
    """The bundle of every cluster that the cascade reads."""
    c, days, m = quarters(spark, sf), daily(spark, sf), with_id(spark, sf)
    size, spread = F.col("size"), F.col("spread_days")
    role = F.when(size <= 1, "NOVEL").when(spread <= 2, "REPEAT").when((size >= 3) & (spread >= 7), "REGIME-MARKER").otherwise("CONTINUATION")
    bands = signatures(c, days).select("id", F.struct(*KEYS).alias("bands"))
    parts = (centroids(m), bags(spark, sf, stop=STOP), bands, profiles(m.select("id", "d"), c), dominances(c))
    out = c.withColumn("role", role)
    for part in parts:
        out = out.join(part, "id", "left")
    return out


def cascaded(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The candidates of all queries with their stages, and the queries."""
    index = shared.checkpointed(index_of(spark, sf))
    asks = index.where(F.col("first_seen") >= F.lit(ASKED_FROM).cast("date"))
    return staged(asks, index, least=1), asks


UNLIKE = "(case when {known} = 0 then 1.0 else ({differ})::double / ({known}) end)".format(known=" + ".join(f"(not (a.{k} = 'UNK' and b.{k} = 'UNK'))::int" for k in KEYS), differ=" + ".join(f"(a.{k} <> b.{k})::int" for k in KEYS))
STAGED = f""",, {QUARTERS}, {SIGNATURES}, {PROFILES}, {BAGS}, prof as (select id, list(share order by k) as profile from profiled group by 1),
vecs as (select id, list(x order by k) as emb from (select id, k, avg(x) as x from (select id, unnest(emb)::double as x, generate_subscripts(emb, 1) as k from members) group by 1, 2) group by 1),
dom as (select a.id, a.size / (a.size + coalesce(sum(b.size), 0)) as dominance, count(b.id) as concurrent, count(*) filter (where b.size > a.size) as larger from c a left join c b on a.id <> b.id and b.first_seen <= a.last_seen and b.last_seen >= a.first_seen group by a.id, a.size),
idx as (select c.*, v.emb, coalesce(bags.bag, []) as bag, prof.profile, dom.* exclude (id), signed.* exclude (id) from c join vecs v using (id) left join bags using (id) join prof using (id) join dom using (id) join signed using (id)),
asks as (select * from idx where first_seen >= date '{ASKED_FROM}'),
s0 as (select a.id as base_id, b.id, list_cosine_similarity(a.emb, b.emb) as sim, list_cosine_similarity(a.emb, b.emb) * exp(-greatest(a.yr - b.yr, 0) / {FADE}) as score, coalesce(len(list_intersect(a.bag, b.bag)) / nullif(len(list_distinct(list_concat(a.bag, b.bag))), 0), 0) as jaccard, {UNLIKE} as d_qtl,
  a.profile as pa, b.profile as pb, greatest(a.yr - b.yr, 0) as age, b.dominance, b.concurrent, b.larger, b.yr from asks a join idx b on b.last_seen < a.first_seen),
s1 as (select * from (select *, row_number() over (partition by base_id order by score desc, id) as k1 from s0 where sim >= {TAU_S}) where k1 <= {POOLS[0]}),
s2 as (select * from (select *, row_number() over (partition by base_id order by jaccard desc, score desc, id) as k2 from s1 where jaccard >= {TAU_ETA}) where k2 <= {POOLS[1]}),
s3 as (select * from (select *, row_number() over (partition by base_id order by d_qtl, k2) as k3 from s2 where d_qtl <= {TAU_Q}) where k3 <= {POOLS[2]}), {warping_sql('s3', 'pa', 'pb', GRID)},
s4 as (select *, case when max(dtw) over (partition by base_id) > 0 then 1 - dtw / max(dtw) over (partition by base_id) else 0 end as s_prop, row_number() over (partition by base_id order by dtw, k3) as k4 from warped qualify k4 <= {2 * TOP}),
s5 as (select *, (larger > 0)::int as c_t, exp(-age / {FADE}) as recency, {BETA[0]} * sim + {BETA[1]} * s_prop + {BETA[2]} * (1 - d_qtl) - {GAMMA} * (larger > 0)::int - (1 - dominance) * {LESS} as raw from s4)"""
SCORES = ("sim", "jaccard", "d_qtl", "dtw", "s_prop", "dominance", "recency", "raw", "weight")
SCORES_SQL = ", ".join(f"round({'raw * recency' if c == 'weight' else c}, 4) as {c}" for c in SCORES)


def shown(p: DataFrame) -> DataFrame:
    return p.select("base_id", "rank", "id", *(F.round(c, 4).alias(c) for c in SCORES), "concurrent", "c_t", "age")


@query(f"{STAGED} select base_id, cast(row_number() over (partition by base_id order by raw * recency desc, k4) as int) as rank, id, {SCORES_SQL}, concurrent, c_t, age from s5 qualify rank <= {TOP}", "memory", "prices")
def cluster_cascade(spark, sf):
    """Analogues of every cluster from ASKED_FROM on through all stages, with all scores and the composite weight."""
    return shown(ranked(cascaded(spark, sf)[0]))


@query(
    f"""{STAGED}, e as (select *, row_number() over (partition by base_id, yr // 5 order by raw * recency desc, k4) as in_era from s5)
    select base_id, cast(row_number() over (partition by base_id order by raw * recency desc, k4) as int) as rank, id, {SCORES_SQL}, concurrent, c_t, age from e where in_era <= 3 qualify rank <= {TOP}""",
    "memory", "prices",
)
def cluster_cascade_by_era(spark, sf):
    """The same with at most three analogues of each era of five years."""
    return shown(ranked(cascaded(spark, sf)[0], per_era=3))


@query(
    f"""{STAGED}, n as (select a.id as base_id, """ + ", ".join(f"(select count(*) from {s} where {s}.base_id = a.id) as {c}" for s, c in (("s1", "n_semantic"), ("s2", "n_entity"), ("s3", "n_quantile"), ("s4", "n_propagation"))) + f""" from asks a)
    select *, least(n_propagation, {TOP}) as n_ranked, case when n_semantic = 0 then '{REASONS[0]}' when n_entity = 0 then '{REASONS[1]}' when n_quantile = 0 then '{REASONS[2]}' end as reason from n""",
    "memory", "prices",
)
def cascade_funnel(spark, sf):
    """How many candidates each stage of the cascade leaves of every query, and why none is left."""
    return funnel(*cascaded(spark, sf))
