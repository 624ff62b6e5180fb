"""Queries on analogues: retrieval, clusters, densities, scores, tests and backtests.

Thresholds suit the test tables, whose random vectors are far apart and whose prices jump; all are parameters.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.functions import vectors as V
from hindcast.functions.numbers import normal_cdf, normal_cdf_sql
from hindcast.operators import asof, forecast, nearby, retrieval, statistics
from hindcast.plans.market import FORWARD_SQL, forward, r6
from hindcast.sources import views
from hindcast.sources.views import table, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
LADDER, K, K_MIN = (0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10, 0.05, 0.0), 25, 25


def query(sql: str = "", *names: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names, recursive=recursive) if names else sql
        return f

    return add


def bases(spark, sf):
    return views.test(spark, sf).withColumnRenamed("event_id", "base_id")


def retrieved(spark, sf, k=K, k_min=K_MIN):
    return retrieval.nearest(bases(spark, sf), views.train(spark, sf), k, LADDER, k_min)


PAIRS = "select t.event_id as base_id, c.event_id, c.event_type, c.d as cd, t.d as bd, t.event_type as base_type, list_cosine_similarity(t.emb::double[], c.emb::double[]) as sim from test t join train c on c.d < t.d"
RETRIEVED = f""",, pairs as ({PAIRS}), counts as (select base_id, tau, count(*) filter (where sim >= tau) as n from pairs cross join (select unnest([{', '.join(map(str, LADDER))}]) as tau) group by 1, 2),
taus as (select base_id, coalesce(max(tau) filter (where n >= {K_MIN}), 0.0)::double as tau from counts group by 1),
analogues as (select * from (select base_id, tau, event_id, event_type, sim, cast(row_number() over (partition by base_id order by sim desc, event_id) as int) as rank from pairs join taus using (base_id)) where rank <= {K} and sim >= tau)"""


@query(f"{RETRIEVED} select base_id, tau, rank, event_id, round(sim, 6) as sim from analogues", "train", "test")
def adaptive_tau(spark, sf):
    return retrieved(spark, sf).withColumn("sim", r6("sim"))


@query(
    f",, pairs as ({PAIRS}) select base_id, event_id, round(sim, 6) as sim, cast(rank as int) as rank from (select *, row_number() over (partition by base_id order by sim desc, event_id) as rank from pairs) where rank <= 10",
    "train", "test",
)
def topk_cosine(spark, sf):
    return retrieval.nearest(bases(spark, sf), views.train(spark, sf), 10, (-1.0,), 1).select("base_id", "event_id", r6("sim", "sim"), "rank")


@query(
    f",, pairs as ({PAIRS}) select base_id, event_id, round(h, 6) as hybrid, cast(rank as int) as rank from (select *, row_number() over (partition by base_id order by h desc, event_id) as rank from (select *, 0.6 * sim + 0.4 * (event_type = base_type)::int as h from pairs where sim >= 0.1)) where rank <= 10",
    "train", "test",
)
def hybrid_retrieval(spark, sf):
    plain = lambda df: df.withColumns({"kind": F.col("event_type"), "bag": F.array().cast("array<string>")})
    ranked = retrieval.blended(plain(bases(spark, sf)), plain(views.train(spark, sf)), 10, 0.1, (0.6, 0.0, 0.4), untyped=True)
    return ranked.select("base_id", "event_id", r6("score", "hybrid"), "rank")


@query(
    f""",, pairs as ({PAIRS}), a as (select base_id, list(event_id) as x from (select base_id, event_id, row_number() over (partition by base_id order by sim desc, event_id) as k from pairs) where k <= 10 group by 1),
    b as (select base_id, list(event_id) as y from (select base_id, event_id, row_number() over (partition by base_id order by 0.6 * sim + 0.4 * (event_type = base_type)::int desc, event_id) as k from pairs where sim >= 0.1) where k <= 10 group by 1)
    select base_id, cast(len(list_intersect(x, y)) as int) as common, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as overlap from a join b using (base_id)""",
    "train", "test",
)
def method_overlap(spark, sf):
    a = topk_cosine(spark, sf).groupBy("base_id").agg(F.collect_list("event_id").alias("x"))
    b = hybrid_retrieval(spark, sf).groupBy("base_id").agg(F.collect_list("event_id").alias("y"))
    return a.join(b, "base_id").select("base_id", F.size(F.array_intersect("x", "y")).alias("common"), r6(V.jaccard(F.col("x"), F.col("y"), 1.0), "overlap"))


@query(f"{RETRIEVED} select count(*) filter (where m.d >= t.d) as leaks, count(*) as n from analogues a join memory m using (event_id) join memory t on t.event_id = a.base_id", "train", "test")
def leakage_audit(spark, sf):
    m = views.memory(spark, sf).select("event_id", "d")
    found = retrieved(spark, sf).join(m, "event_id").join(m.select(F.col("event_id").alias("base_id"), F.col("d").alias("bd")), "base_id")
    return found.agg(F.count_if(F.col("d") >= F.col("bd")).alias("leaks"), F.count(F.lit(1)).alias("n"))


@query(
    """select base_id, event_id, cast(y // 2 * 2 as int) as era, round(sim, 6) as sim, cast(row_number() over (partition by base_id order by sim desc, event_id) as int) as rank
    from (select *, year(cd) as y, row_number() over (partition by base_id, year(cd) // 2 order by sim desc, event_id) as k from (%s)) where k <= 3"""
    % PAIRS,
    "train", "test",
)
def era_stratified_topk(spark, sf):
    corpus = views.train(spark, sf).withColumn("era", (F.floor(F.year("d") / 2) * 2).cast("long"))
    out = retrieval.nearest_by(bases(spark, sf), corpus, "era", 3)
    rank = F.row_number().over(Window.partitionBy("base_id").orderBy(F.desc("sim"), "event_id"))
    return out.select("base_id", "event_id", F.col("era").cast("int").alias("era"), r6("sim", "sim"), rank.alias("rank"))


@query(
    "select a.event_id as a, b.event_id as b, cast(date_diff('day', a.d, b.d) as int) as gap from memory a join memory b on a.event_id <> b.event_id and abs(date_diff('day', a.d, b.d)) <= 7",
    "memory",
)
def band_self_join(spark, sf):
    m = views.memory(spark, sf)
    pairs = asof.band_join(m.select(F.col("event_id").alias("a"), F.col("d").alias("ad")), m.select(F.col("event_id").alias("b"), F.col("d").alias("bd")), "ad", "bd", 7, 7)
    return pairs.where("a <> b").select("a", "b", F.datediff("bd", "ad").alias("gap"))


def fused_pairs(spark, sf):
    """(a, b, cos, dist): the fused distance of events within a week."""
    m = views.memory(spark, sf)
    one, two = (m.select(*(F.col(c).alias(x + c) for c in ("event_id", "d", "emb", "polarity", "event_type"))) for x in "ab")
    pairs = asof.band_join(one, two, "ad", "bd", 7, 7).where("aevent_id < bevent_id")
    cos = V.cosine(F.col("aemb"), F.col("bemb"))
    dist = 0.6 * (1 - cos) / 2 + 0.2 * (F.col("apolarity") != F.col("bpolarity")).cast("int") + 0.2 * (F.col("aevent_type") != F.col("bevent_type")).cast("int")
    return pairs.select(F.col("aevent_id").alias("a"), F.col("bevent_id").alias("b"), F.col("ad"), F.col("bd"), dist.alias("dist"))


FUSED = """select a.event_id as a, b.event_id as b, a.d as ad, b.d as bd, 0.6 * (1 - list_cosine_similarity(a.emb::double[], b.emb::double[])) / 2 + 0.2 * (a.polarity <> b.polarity)::int + 0.2 * (a.event_type <> b.event_type)::int as dist
  from memory a join memory b on a.event_id < b.event_id and abs(date_diff('day', a.d, b.d)) <= 7"""


@query(f"select a, b, round(dist, 6) as dist from ({FUSED})", "memory")
def fused_distance(spark, sf):
    return fused_pairs(spark, sf).select("a", "b", r6("dist", "dist"))


CLUSTERS = "select event_type, polarity, date_trunc('month', d)::date as mo, list(event_id order by event_id) as members, count(*) as size, min(d) as first_seen, max(d) as last_seen, cast(date_diff('day', min(d), max(d)) as int) as spread_days from memory group by 1, 2, 3"
ROLE = "case when size <= 1 then 'NOVEL' when spread_days <= 2 then 'REPEAT' when size >= 3 and spread_days >= 7 then 'REGIME-MARKER' else 'CONTINUATION' end"


def clusters(spark, sf):
    """Clusters: events of one type and polarity in a month."""
    m = views.memory(spark, sf).groupBy("event_type", "polarity", F.to_date(F.date_trunc("month", "d")).alias("mo"))
    out = m.agg(F.array_sort(F.collect_list("event_id")).alias("members"), F.count(F.lit(1)).alias("size"), F.min("d").alias("first_seen"), F.max("d").alias("last_seen"))
    return out.withColumn("spread_days", F.datediff("last_seen", "first_seen"))


@query(f"select event_type, polarity, mo, size, spread_days, {ROLE} as role from ({CLUSTERS})", "memory")
def role_classify(spark, sf):
    size, spread = F.col("size"), F.col("spread_days")
    role = F.when(size <= 1, "NOVEL").when(spread <= 2, "REPEAT").when((size >= 3) & (spread >= 7), "REGIME-MARKER").otherwise("CONTINUATION")
    return clusters(spark, sf).select("event_type", "polarity", "mo", "size", "spread_days", role.alias("role"))


@query(
    """,, w as (select a.event_id, list(b.event_id order by b.event_id) as members from memory a join memory b on abs(date_diff('day', a.d, b.d)) <= 3 group by 1)
    select array_to_string(members, ',') as signature, min(event_id) as creator, count(*) as n from w group by 1""",
    "memory",
)
def cluster_signature_dedupe(spark, sf):
    m = views.memory(spark, sf)
    pairs = asof.band_join(m.select(F.col("event_id").alias("a"), F.col("d").alias("ad")), m.select(F.col("event_id").alias("b"), F.col("d").alias("bd")), "ad", "bd", 3, 3)
    windows = pairs.groupBy("a").agg(F.array_join(F.array_sort(F.collect_list("b")), ",").alias("signature"))
    return windows.groupBy("signature").agg(F.min("a").alias("creator"), F.count(F.lit(1)).alias("n"))


@query("select event_type, cast(k - 1 as int) as k, round(avg(v), 6) as v from (select event_type, unnest(emb)::double as v, generate_subscripts(emb, 1) as k from memory) group by 1, 2", "memory")
def centroids(spark, sf):
    return views.memory(spark, sf).select("event_type", F.posexplode("emb").alias("k", "v")).groupBy("event_type", "k").agg(r6(F.avg(F.col("v").cast("double")), "v"))


@query(
    r"""select source, w, n, cast(k as int) as k from (select source, w, count(*) as n, row_number() over (partition by source order by count(*) desc, w) as k from (select source, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) where length(w) > 2 group by 1, 2) where k <= 30"""
)
def entity_bag_top30(spark, sf):
    words = table(spark, sf, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).where("length(w) > 2")
    n = words.groupBy("source", "w").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "w"))).where("k <= 30").select("source", "w", "n", "k")


@query(
    f""",, c as (select row_number() over (order by mo, event_type, polarity) as id, * from ({CLUSTERS}))
    select a.event_type, a.polarity, a.mo, round(a.size / (a.size + coalesce(sum(b.size), 0)), 6) as share, count(b.id) as concurrent, count(*) filter (where b.size > a.size) as larger
    from c a left join c b on a.id <> b.id and b.first_seen <= a.last_seen and b.last_seen >= a.first_seen group by 1, 2, 3, a.size""",
    "memory",
)
def dominance(spark, sf):
    c = clusters(spark, sf).select("event_type", "polarity", "mo", "size", "first_seen", "last_seen")
    other = c.select(*(F.col(x).alias("o_" + x) for x in ("event_type", "polarity", "mo", "size", "first_seen", "last_seen")))
    itself = (F.col("event_type") == F.col("o_event_type")) & (F.col("polarity") == F.col("o_polarity")) & (F.col("mo") == F.col("o_mo"))
    met = asof.overlap_join(c, other, ("first_seen", "last_seen"), ("o_first_seen", "o_last_seen")).where(~itself)
    sums = met.groupBy("event_type", "polarity", "mo").agg(F.sum("o_size").alias("s"), F.count(F.lit(1)).alias("concurrent"), F.count_if(F.col("o_size") > F.col("size")).alias("larger"))
    both = c.join(sums, ["event_type", "polarity", "mo"], "left").na.fill(0, ["s", "concurrent", "larger"])
    return both.select("event_type", "polarity", "mo", r6(F.col("size") / (F.col("size") + F.col("s")), "share"), "concurrent", "larger")


CASCADE = """,, c as (select event_type * 1000 + (year(mo) - 1990) * 12 + month(mo) as id, * from (select event_type, date_trunc('month', d)::date as mo, count(*) as size, min(d) as a, max(d) as b, list(polarity order by event_id) as pol from memory group by 1, 2)),
v as (select event_type, date_trunc('month', d)::date as mo, k, avg(x) as x from (select event_type, d, unnest(emb)::double as x, generate_subscripts(emb, 1) as k from memory) group by 1, 2, 3),
e as (select c.id, c.event_type, c.mo, c.size, c.a, c.b, list_distinct(c.pol) as pol, list(v.x order by v.k) as emb from c join v using (event_type, mo) group by all),
p1 as (select q.id as base_id, x.id as id, list_cosine_similarity(q.emb, x.emb) as sem, len(list_intersect(q.pol, x.pol)) / len(list_distinct(list_concat(q.pol, x.pol))) as jac, x.size, q.size as bs from e q join e x on x.b < q.a and year(x.mo) <= year(q.mo) - 1 where q.mo >= date '2000-01-01'),
s1 as (select * from (select *, row_number() over (partition by base_id order by sem desc, id) as k from p1 where sem >= 0.05) where k <= 60),
s2 as (select * exclude (k) from s1 where jac >= 0.3),
s3 as (select * from (select *, row_number() over (partition by base_id order by abs(size - bs), id) as k from s2) where k <= 30)
select base_id, id, round(sem, 6) as sem, round(jac, 6) as jac, cast(row_number() over (partition by base_id order by 0.6 * sem + 0.4 * jac desc, id) as int) as rank from s3 qualify rank <= 5"""


@query(CASCADE, "memory")
def cascade(spark, sf):
    m = views.memory(spark, sf).withColumn("mo", F.to_date(F.date_trunc("month", "d")))
    keys = ["event_type", "mo"]
    c = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("d").alias("a"), F.max("d").alias("b"), F.collect_set("polarity").alias("pol"))
    x = m.select(*keys, F.posexplode("emb").alias("k", "x")).groupBy(*keys, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = x.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda y: y["x"]).alias("emb"))
    c = c.join(vec, keys).withColumn("id", F.col("event_type") * 1000 + (F.year("mo") - 1990) * 12 + F.month("mo"))
    q = c.where(F.col("mo") >= F.lit("2000-01-01").cast("date"))
    # the semantic stage in blocks; whole years apart, so that a cluster of the query's year is out
    near = retrieval.above(q.select(F.col("id").cast("long").alias("base_id"), F.col("a").alias("d"), "emb"), c.select(F.col("id").cast("long").alias("event_id"), F.col("b").alias("d"), "emb"), 0.05)
    bq = q.select(F.col("id").cast("long").alias("base_id"), F.col("pol").alias("bpol"), F.col("size").alias("bs"), F.year("mo").alias("by"))
    cx = c.select(F.col("id").cast("long").alias("event_id"), "pol", "size", F.year("mo").alias("cy"))
    p = near.join(bq, "base_id").join(cx, "event_id").where("cy <= by - 1").withColumn("jac", V.jaccard(F.col("bpol"), F.col("pol")))
    top = lambda df, n, *order: df.withColumn("k", F.row_number().over(Window.partitionBy("base_id").orderBy(*order))).where(f"k <= {n}").drop("k")
    s = top(top(p, 60, F.desc("sim"), "event_id").where("jac >= 0.3"), 30, F.abs(F.col("size") - F.col("bs")), "event_id")
    rank = F.row_number().over(Window.partitionBy("base_id").orderBy(F.desc(0.6 * F.col("sim") + 0.4 * F.col("jac")), "event_id"))
    return s.withColumn("rank", rank).where("rank <= 5").select("base_id", F.col("event_id").alias("id"), r6("sim", "sem"), r6("jac", "jac"), "rank")


@query("select count(*) as n, round(avg(norm), 6) as mean_norm, round(min(norm), 6) as min_norm, round(max(norm), 6) as max_norm, count(*) filter (where norm < 1e-9) as zeros, count(*) filter (where abs(norm - 1) > 0.1) as off from (select sqrt(list_dot_product(emb::double[], emb::double[])) as norm from memory)", "memory")
def embedding_diagnostics(spark, sf):
    n = views.memory(spark, sf).select(V.norm(F.col("emb")).alias("norm"))
    return n.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("norm"), "mean_norm"), r6(F.min("norm"), "min_norm"), r6(F.max("norm"), "max_norm"), F.count_if(F.col("norm") < 1e-9).alias("zeros"), F.count_if(F.abs(F.col("norm") - 1) > 0.1).alias("off"))


RETURNS = f"select event_id, r from ({FORWARD_SQL}) where horizon = 15"
FORECAST = f"""{RETRIEVED}, ret as ({RETURNS}), fc as (select a.base_id, count(r.r) as n, avg(r.r) as mean, stddev_pop(r.r) as std, quantile_cont(r.r, 0.05) as p5, quantile_cont(r.r, 0.25) as p25, quantile_cont(r.r, 0.5) as median, quantile_cont(r.r, 0.75) as p75, quantile_cont(r.r, 0.95) as p95,
  avg((r.r < -10)::int) as p_down10, avg((r.r > 0)::int) as p_up, avg(a.sim) as sim from analogues a join ret r on r.event_id = a.event_id and r.r is not null group by 1 having count(r.r) >= 5),
fct as (select fc.*, y.r as realised, m.d, m.event_type from fc join memory m on m.event_id = fc.base_id join ret y on y.event_id = fc.base_id where y.r is not null)"""


def forecasts(spark, sf):
    """One row per test event with five analogues or more: statistics of their 15-day returns, and the realised one."""
    ret = forward(spark, sf, (15,)).where("r is not null").select("event_id", "r")
    found = retrieved(spark, sf).join(ret, "event_id")
    q = F.percentile("r", F.array(*(F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95))))
    fc = found.groupBy("base_id").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), q.alias("q"), F.avg((F.col("r") < -10).cast("int")).alias("p_down10"), F.avg((F.col("r") > 0).cast("int")).alias("p_up"), F.avg("sim").alias("sim")).where("n >= 5")
    fc = fc.select("*", *(F.col("q")[k].alias(c) for k, c in enumerate(("p5", "p25", "median", "p75", "p95")))).drop("q")
    m = views.memory(spark, sf).select(F.col("event_id").alias("base_id"), "d", "event_type")
    return fc.join(m, "base_id").join(ret.select(F.col("event_id").alias("base_id"), F.col("r").alias("realised")), "base_id")


VIEWS = ("train", "test", "prices")
SIGNAL = "case when median > 2 and p5 > -60 then 'LONG' when median < -2 and p95 < 60 then 'SHORT' else 'NEUTRAL' end"


@query(
    f"""{FORECAST} select base_id, n, round(mean, 6) as mean, round(std, 6) as std, round(p5, 6) as p5, round(median, 6) as median, round(p95, 6) as p95, round(realised, 6) as realised,
    (realised between p5 and p95)::int as covers_90, (realised between p25 and p75)::int as covers_50, (p_down10 > 0.4)::int as red_flag, {SIGNAL} as signal from fct""",
    *VIEWS,
)
def forecast_signals(spark, sf):
    f = forecasts(spark, sf)
    inside = lambda a, b: F.col("realised").between(F.col(a), F.col(b)).cast("int")
    return f.select("base_id", "n", *(r6(c, c) for c in ("mean", "std", "p5", "median", "p95", "realised")), inside("p5", "p95").alias("covers_90"), inside("p25", "p75").alias("covers_50"), (F.col("p_down10") > 0.4).cast("int").alias("red_flag"), forecast.signal(F.col("median"), F.col("p5"), F.col("p95"), 2.0, 60.0).alias("signal"))


@query(
    f"{FORECAST} select event_type, count(*) as n, round(100 * avg((realised between p5 and p95)::int), 4) as coverage, round(avg(p95 - p5), 4) as width, round(avg((p95 - p5) / (3.29 * std)), 6) as ratio from fct where std > 0 group by 1",
    *VIEWS,
)
def coverage_table(spark, sf):
    f = forecasts(spark, sf).where("std > 0")
    return f.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(F.col("realised").between(F.col("p5"), F.col("p95")).cast("int")), 4).alias("coverage"), F.round(F.avg(F.col("p95") - F.col("p5")), 4).alias("width"), r6(F.avg((F.col("p95") - F.col("p5")) / (3.29 * F.col("std"))), "ratio"))


TAUS = {0.05: "p5", 0.25: "p25", 0.5: "median", 0.75: "p75", 0.95: "p95"}


@query(
    f"{FORECAST} " + " union all ".join(f"select {t}::double as tau, round(avg(case when realised >= {c} then {t} * (realised - {c}) else ({t} - 1) * (realised - {c}) end), 6) as loss, count(*) as n from fct" for t, c in TAUS.items()),
    *VIEWS,
)
def pinball(spark, sf):
    f = forecasts(spark, sf)
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("tau"), forecast.pinball(F.col("realised"), F.col(c), t).alias("l")) for t, c in TAUS.items())))
    return f.select(rows.alias("x")).groupBy("x.tau").agg(r6(F.avg("x.l"), "loss"), F.count(F.lit(1)).alias("n"))


@query(
    f"""{FORECAST}, z as (select base_id, row_number() over (order by d, base_id) as k, abs(realised - median) - abs(realised - 0) as diff from fct), l as (select diff, lag(diff) over (order by k) as before from z)
    select count(*) as n, round(avg(diff), 6) as mean_diff, round(avg(diff) / sqrt(var_samp(diff) / count(*)), 6) as dm_iid, round(avg(diff) / sqrt(nullif(greatest(var_samp(diff) / count(*) + 2 * covar_samp(diff, before) / count(*), 0), 0)), 6) as dm_lag from l""",
    *VIEWS,
)
def diebold_mariano(spark, sf):
    f = forecasts(spark, sf).withColumn("diff", F.abs(F.col("realised") - F.col("median")) - F.abs("realised"))
    f = f.withColumn("before", F.lag("diff").over(Window.orderBy("d", "base_id")))
    n = F.count(F.lit(1))
    lagged = F.nullif(F.greatest(F.var_samp("diff") / n + 2 * F.covar_samp("diff", "before") / n, F.lit(0.0)), F.lit(0.0))
    return f.agg(n.alias("n"), r6(F.avg("diff"), "mean_diff"), r6(F.avg("diff") / F.sqrt(F.var_samp("diff") / n), "dm_iid"), r6(F.avg("diff") / F.sqrt(lagged), "dm_lag"))


Z = "((realised - mean) / std)"


@query(
    f"{FORECAST} select base_id, round(std * ({Z} * (2 * {normal_cdf_sql(Z)} - 1) + 2 * exp(-0.5 * {Z} * {Z}) / sqrt(2 * pi()) - 1 / sqrt(pi())), 4) as crps, round(-0.5 * {Z} * {Z} - ln(std * sqrt(2 * pi())), 6) as log_score from fct where std > 0",
    *VIEWS,
)
def crps_gaussian(spark, sf):
    f = forecasts(spark, sf).where("std > 0").withColumn("z", (F.col("realised") - F.col("mean")) / F.col("std"))
    z = F.col("z")
    crps = F.col("std") * (z * (2 * normal_cdf(z) - 1) + 2 * F.exp(-0.5 * z * z) / F.sqrt(2 * F.pi()) - 1 / F.sqrt(F.pi()))
    return f.select("base_id", F.round(crps, 4).alias("crps"), r6(-0.5 * z * z - F.log(F.col("std") * F.sqrt(2 * F.pi())), "log_score"))


NOMINAL = {0.5: 0.6744897501960817, 0.8: 1.2815515655446004, 0.9: 1.6448536269514722, 0.95: 1.959963984540054}


@query(f"{FORECAST} " + " union all ".join(f"select {p}::double as level, round(avg((abs(realised - mean) <= {z} * std)::int), 6) as covered, count(*) as n from fct" for p, z in NOMINAL.items()), *VIEWS)
def reliability_curve(spark, sf):
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("level"), (F.abs(F.col("realised") - F.col("mean")) <= z * F.col("std")).cast("int").alias("c")) for p, z in NOMINAL.items())))
    return forecasts(spark, sf).select(rows.alias("x")).groupBy("x.level").agg(r6(F.avg("x.c"), "covered"), F.count(F.lit(1)).alias("n"))


@query(
    f"""{FORECAST}, e as (select quantile_cont(p_up, [0.2, 0.4, 0.6, 0.8]) as q from fct), b as (select p_up, (realised > 0)::int as y, (p_up > q[1])::int + (p_up > q[2])::int + (p_up > q[3])::int + (p_up > q[4])::int as bin from fct cross join e)
    select bin, count(*) as n, round(avg(p_up), 6) as stated, round(avg(y), 6) as seen, round(avg(y) - avg(p_up), 6) as gap from b group by 1""",
    *VIEWS,
)
def calibration_qcut(spark, sf):
    f = forecasts(spark, sf).select("p_up", (F.col("realised") > 0).cast("int").alias("y"))
    edges = f.agg(F.percentile("p_up", F.array(*(F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)))).alias("q"))
    b = f.join(F.broadcast(edges)).withColumn("bin", sum(((F.col("p_up") > F.col("q")[k]).cast("int") for k in range(1, 4)), (F.col("p_up") > F.col("q")[0]).cast("int")))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p_up"), "stated"), r6(F.avg("y"), "seen"), r6(F.avg("y") - F.avg("p_up"), "gap"))


@query(
    f"""{FORECAST}, z as (select (p_down10 > 0.4)::int as flag, (realised < -10)::int as y from fct), s as (select count(*) filter (where flag = 1 and y = 1) as tp, count(*) filter (where flag = 1 and y = 0) as fp, count(*) filter (where flag = 0 and y = 1) as fn from z)
    select tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision_, round(tp / nullif(tp + fn, 0), 6) as recall from s""",
    *VIEWS,
)
def precision_recall(spark, sf):
    f = forecasts(spark, sf).select((F.col("p_down10") > 0.4).alias("flag"), (F.col("realised") < -10).alias("y"))
    s = f.agg(F.count_if(F.col("flag") & F.col("y")).alias("tp"), F.count_if(F.col("flag") & ~F.col("y")).alias("fp"), F.count_if(~F.col("flag") & F.col("y")).alias("fn"))
    return s.select("tp", "fp", "fn", r6(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), "precision_"), r6(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), "recall"))


AUC = "select x, y from (select std as x, (abs(realised) > 30)::int as y from fct)"


@query(
    f"""{FORECAST}, o as ({AUC}), r as (select y, avg(k) over (partition by x) as rk from (select *, row_number() over (order by x) as k from o))
    select round((sum(rk) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) as auc, count(*) as n, sum(y)::bigint as positives from r""",
    *VIEWS,
)
def roc_auc_rank(spark, sf):
    return statistics.auc(forecasts(spark, sf).select(F.col("std").alias("x"), (F.abs("realised") > 30).cast("int").alias("y")))


@query(
    f"""{FORECAST}, o as ({AUC}), c as (select x, sum(y) as p, count(*) - sum(y) as q from o group by 1), t as (select x, sum(p) over (order by x desc) as tp, sum(q) over (order by x desc) as fp, sum(p) over () as np, sum(q) over () as nq from c)
    select round(x, 6) as threshold, round(tp / np - fp / nq, 6) as j from t order by tp / np - fp / nq desc, x desc limit 1""",
    *VIEWS,
)
def youden(spark, sf):
    return statistics.youden(forecasts(spark, sf).select(F.col("std").alias("x"), (F.abs("realised") > 30).cast("int").alias("y"))).select(r6("threshold", "threshold"), r6("j", "j"))


@query(
    f"{FORECAST} select base_id, case when std >= 45 then 'HIGH' when std >= 35 then 'WATCH' else 'NORMAL' end as tier from fct",
    *VIEWS,
)
def early_warning_tier(spark, sf):
    return forecasts(spark, sf).select("base_id", forecast.warning_tier(F.col("std"), 45, 35).alias("tier"))


CLAMP = "greatest(least({}, 1.0), 0.0)"


@query(
    f"""{FORECAST} select base_id, cast(case event_type % 4 when 0 then 5 when 1 then 12 when 2 then 22 else 30 end + trunc(20 * {CLAMP.format('(sim - 0.1) / 0.2')}) + trunc(25 * abs(2 * p_up - 1)) + trunc(15 * {CLAMP.format('p_down10 / 0.3')}) + trunc(10 * {CLAMP.format('p_down10 / 0.5')}) as int) as score from fct""",
    *VIEWS,
)
def red_flag_score(spark, sf):
    f = forecasts(spark, sf)
    return f.select("base_id", forecast.red_flag_score(F.col("event_type") % 4 + 1, F.col("sim") + 0.65, F.col("p_up"), F.col("p_down10"), F.col("p_down10")).alias("score"))


CONFIGS = "(values ('full', 0.5, 1.0), ('no_sim', 0.0, 1.0), ('no_age', 0.5, 0.0), ('uniform', 0.0, 0.0)) k(config, ps, pa)"


@query(
    f"""{RETRIEVED}, ret as ({RETURNS}), w as (select a.base_id, config, r.r, pow(greatest(a.sim, 0), ps) * exp(-0.05 * pa * date_diff('day', m.d, t.d) / 365.25) as w
      from analogues a join ret r on r.event_id = a.event_id and r.r is not null join memory m on m.event_id = a.event_id join memory t on t.event_id = a.base_id cross join {CONFIGS}),
    f as (select base_id, config, sum(w * r) / sum(w) as mu from w group by 1, 2)
    select config, count(*) as n, round(avg(abs(y.r - mu)), 6) as mae from f join ret y on y.event_id = f.base_id and y.r is not null group by 1""",
    *VIEWS,
)
def ablation_grid(spark, sf):
    ret = forward(spark, sf, (15,)).where("r is not null").select("event_id", "r")
    m = views.memory(spark, sf).select("event_id", "d")
    a = retrieved(spark, sf).join(ret, "event_id").join(m, "event_id").join(m.select(F.col("event_id").alias("base_id"), F.col("d").alias("bd")), "base_id")
    configs = F.explode(F.array(*(F.struct(F.lit(n).alias("config"), F.lit(s).alias("ps"), F.lit(g).alias("pa")) for n, s, g in (("full", 0.5, 1.0), ("no_sim", 0.0, 1.0), ("no_age", 0.5, 0.0), ("uniform", 0.0, 0.0)))))
    a = a.withColumn("k", configs)
    w = F.pow(F.greatest("sim", F.lit(0.0)), F.col("k.ps")) * F.exp(-0.05 * F.col("k.pa") * F.datediff("bd", "d") / 365.25)
    f = a.groupBy("base_id", "k.config").agg((F.sum(w * F.col("r")) / F.sum(w)).alias("mu"))
    y = ret.select(F.col("event_id").alias("base_id"), F.col("r").alias("y"))
    return f.join(y, "base_id").groupBy("config").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("mu"))), "mae"))


@query(
    f"""{FORECAST}, s as (select base_id, d, realised, case when p_down10 > 0.45 then 0 when median > 0.5 then 1 when median < -0.5 then -1 else 0 end as sig from fct), p as (select *, sig * realised - 0.1 * abs(sig) as pnl from s)
    select base_id, d, sig, round(pnl, 6) as pnl, round(sum(pnl) over (order by d, base_id rows unbounded preceding), 6) as cum from p""",
    *VIEWS,
)
def simple_backtest(spark, sf):
    f = forecasts(spark, sf)
    sig = F.when(F.col("p_down10") > 0.45, 0).when(F.col("median") > 0.5, 1).when(F.col("median") < -0.5, -1).otherwise(0)
    p = f.select("base_id", "d", "realised", sig.alias("sig")).withColumn("pnl", F.col("sig") * F.col("realised") - 0.1 * F.abs("sig"))
    return p.select("base_id", "d", "sig", r6("pnl", "pnl"), r6(F.sum("pnl").over(Window.orderBy("d", "base_id").rowsBetween(Window.unboundedPreceding, 0)), "cum"))


@query(
    """,, p as (select m.event_id, date_diff('day', m.d, p.d) as k, p.px, first_value(p.px) over (partition by m.event_id order by p.d) as p0 from memory m join prices p on p.d between m.d and m.d + 15)
    select event_id, cast(k as int) as k, round(100 * (px / p0 - 1), 6) as r from p""",
    "memory", "prices",
)
def relative_paths(spark, sf):
    pairs = asof.band_join(views.memory(spark, sf).select("event_id", F.col("d").alias("ed")), views.prices(spark, sf), "ed", "d", 0, 15)
    p0 = F.first("px").over(Window.partitionBy("event_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    return pairs.select("event_id", F.datediff("d", "ed").alias("k"), r6(100 * (F.col("px") / p0 - 1), "r"))


@query(
    f"""{RETRIEVED}, p as (select m.event_id, date_diff('day', m.d, p.d) as k, 100 * (p.px / first_value(p.px) over (partition by m.event_id order by p.d) - 1) as r from memory m join prices p on p.d between m.d and m.d + 15)
    select a.base_id, cast(p.k as int) as k, count(*) as n, round(avg(r), 6) as mean, round(quantile_cont(r, 0.05), 6) as p5, round(quantile_cont(r, 0.95), 6) as p95 from analogues a join p on p.event_id = a.event_id where k > 0 group by 1, 2 having count(*) >= 3""",
    *VIEWS,
)
def cone(spark, sf):
    p = asof.band_join(views.memory(spark, sf).select("event_id", F.col("d").alias("ed")), views.prices(spark, sf), "ed", "d", 0, 15)
    p = p.withColumn("r", 100 * (F.col("px") / F.first("px").over(Window.partitionBy("event_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)) - 1)).select("event_id", F.datediff("d", "ed").alias("k"), "r").where("k > 0")
    q = F.percentile("r", F.array(F.lit(0.05), F.lit(0.95)))
    c = retrieved(spark, sf).join(p, "event_id").groupBy("base_id", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), q.alias("q")).where("n >= 3")
    return c.select("base_id", "k", "n", r6("mean", "mean"), r6(F.col("q")[0], "p5"), r6(F.col("q")[1], "p95"))


@query(
    f"""{RETRIEVED}, l as (select d, ln(px / lag(px) over (order by d)) as r from prices), ch as (select m.event_id, l.d, sum(l.r) over (partition by m.event_id order by l.d rows between current row and 4 following) as s, count(*) over (partition by m.event_id order by l.d rows between current row and 4 following) as c
      from memory m join l on l.d between m.d and m.d + 30), o as (select a.base_id, ch.s from analogues a join ch on ch.event_id = a.event_id where c = 5), v as (select base_id, quantile_cont(s, 0.05) as q from o group by 1)
    select base_id, round(-q, 6) as var_95, round(-avg(s), 6) as es_95 from o join v using (base_id) where s <= q group by 1, 2""",
    *VIEWS,
)
def chunk_var_es(spark, sf):
    px = views.prices(spark, sf)
    l = px.withColumn("r", F.log(F.col("px") / F.lag("px").over(Window.orderBy("d")))).select("d", "r")  # noqa: E741
    p = asof.band_join(views.memory(spark, sf).select("event_id", F.col("d").alias("ed")), l, "ed", "d", 0, 30)
    w = Window.partitionBy("event_id").orderBy("d").rowsBetween(0, 4)
    ch = p.select("event_id", F.sum("r").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("c")).where("c = 5")
    o = retrieved(spark, sf).join(ch, "event_id").select("base_id", "s")
    v = o.groupBy("base_id").agg(F.percentile("s", F.lit(0.05)).alias("q"))
    return o.join(v, "base_id").where("s <= q").groupBy("base_id", "q").agg(F.avg("s").alias("m")).select("base_id", r6(-F.col("q"), "var_95"), r6(-F.col("m"), "es_95"))


def logit_glm(spark, sf):
    """Logit of a large return on the spread of the forecast: coefficients, errors and p-values."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    f = VectorAssembler(inputCols=["std", "p_up"], outputCol="features").transform(forecasts(spark, sf).withColumn("y", (F.abs("realised") > 30).cast("double")))
    s = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y").fit(f)
    names, t = ["std", "p_up", "intercept"], s.summary
    return spark.createDataFrame([(n, float(c), float(e), float(p)) for n, c, e, p in zip(names, [*s.coefficients, s.intercept], t.coefficientStandardErrors, t.pValues, strict=True)], "term string, coef double, se double, p double")


def firth(spark, sf):
    return statistics.firth(forecasts(spark, sf).select("std", "p_up", (F.abs("realised") > 30).cast("int").alias("y")), ["std", "p_up"], "y")


def kmeans(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = views.memory(spark, sf).select("event_id", array_to_vector("emb").alias("features"))
    return KMeans(k=10, seed=42, maxIter=20).fit(v).transform(v).select("event_id", F.col("prediction").alias("cluster"))


def pca3(spark, sf):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = views.memory(spark, sf).select("event_id", array_to_vector("emb").alias("features"))
    p = vector_to_array(F.col("out"))
    return PCA(k=3, inputCol="features", outputCol="out").fit(v).transform(v).select("event_id", *(F.round(p[k], 6).alias(c) for k, c in enumerate("xyz")))


def garch11(spark, sf):
    return statistics.garch(views.legs(spark, sf), "leg")


def kelly_backtest(spark, sf):
    """One book for each type of event."""
    return statistics.kelly_backtest(forecasts(spark, sf).select(F.col("event_type").cast("string").alias("book"), "base_id", "d", "median", "p5", "p95", "p_down10", "realised"), "book")


def hdbscan_local(spark, sf):
    """The density cluster of each event among those within a week, by the fused distance."""
    return nearby.local_clusters(views.memory(spark, sf), 7, 0.6, {"polarity": 0.2, "event_type": 0.2})


QUERIES |= {f.__name__: f for f in (logit_glm, firth, kmeans, pca3, garch11, kelly_backtest, hdbscan_local)}
