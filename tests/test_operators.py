"""Operators on hand-made rows: ties, gaps, nulls, empty tables, against NumPy."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from hindcast.functions import text as T
from hindcast.functions import vectors as V
from hindcast.operators import asof, forecast, retrieval, series, statistics


def day(n):
    return datetime.date(2000, 1, 1) + datetime.timedelta(n)


def test_asof_ties_and_gaps(spark):
    px = spark.createDataFrame([(day(0), 1.0), (day(4), 2.0), (day(6), None), (day(800), 3.0)], "pd date, px double")
    asks = spark.createDataFrame([(1, day(2)), (2, day(6)), (3, day(500)), (4, day(-1)), (5, None)], "id int, d date")
    got = {r["id"]: r["px"] for r in asof.asof(asks, px, "d", "pd", "px", "nearest", 5).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None, 4: 1.0, 5: None}
    back = {r["id"]: r["px"] for r in asof.asof(asks, px, "d", "pd", "px").collect()}
    assert back == {1: 1.0, 2: 2.0, 3: 2.0, 4: None, 5: None}
    ahead = {r["id"]: r["px"] for r in asof.asof(asks, px, "d", "pd", "px", "forward").collect()}
    assert ahead == {1: 2.0, 2: 3.0, 3: 3.0, 4: 1.0, 5: None}


def test_band_join_left_keeps_rows(spark):
    a = spark.createDataFrame([(1, day(0)), (2, day(50)), (3, None)], "id int, d date")
    b = spark.createDataFrame([(day(1), "x"), (day(3), "y")], "e date, v string")
    got = sorted((r["id"], r["v"] or "") for r in asof.band_join(a, b, "d", "e", 0, 3, "left").collect())
    assert got == [(1, "x"), (1, "y"), (2, ""), (3, "")]


def test_fill_stops_after_limit(spark):
    df = spark.createDataFrame([(k, 1.0 if k == 0 else None) for k in range(8)], "d int, px double")
    got = [r["f"] for r in df.select("d", series.filled("px", series.over(), 5).alias("f")).orderBy("d").collect()]
    assert got == [1.0] * 6 + [None] * 2


def test_ema_equals_recursion(spark):
    x = np.random.default_rng(0).random(60)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "d int, px double")
    want, e = [], x[0]
    for v in x:
        e = v if not want else 0.75 * e + 0.25 * v
        want.append(e)
    assert np.allclose([r["ema"] for r in series.ema(df).orderBy("d").collect()], want)


def test_retrieval_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vec = rng.normal(size=(40, 8))
    rows = [(k, day(int(rng.integers(0, 9))), vec[k].tolist()) for k in range(40)]
    corpus = spark.createDataFrame(rows, "event_id long, d date, emb array<double>")
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    got = retrieval.nearest(corpus.withColumnRenamed("event_id", "base_id"), corpus, 5, (0.5, 0.2, -1.0), 3).collect()
    for base in range(40):
        sims = [(-float(unit[base] @ unit[k]), k) for k in range(40) if rows[k][1] < rows[base][1]]
        tau = next((t for t in (0.5, 0.2) if sum(-s >= t for s, _ in sims) >= 3), -1.0)
        want = [k for s, k in sorted(sims)[:5] if -s >= tau]
        assert [r["event_id"] for r in sorted((r for r in got if r["base_id"] == base), key=lambda r: r["rank"])] == want
    empty = corpus.where("event_id < 0")
    assert retrieval.nearest(empty.withColumnRenamed("event_id", "base_id"), corpus, 5, (0.5,), 3).count() == 0
    assert retrieval.nearest(corpus.withColumnRenamed("event_id", "base_id"), empty, 5, (0.5,), 3).count() == 0


def test_dtw(spark):
    a = np.array([[0.0, 1, 2, 3], [0, 0, 1, 2]])
    assert np.allclose(retrieval.dtw(a, a), 0)
    assert np.isclose(retrieval.dtw(a[:1], a[1:], squared=False, band=None)[0], 1)
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [1.0, 2.0, 4.0]), ([1.0, None], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r["dtw"] for r in retrieval.with_dtw(df, "a", "b").collect()] == [0.0, None, None]


def test_mixture(spark):
    parts = spark.createDataFrame([("one", 0.0, 1.0, 2.0), ("two", -20.0, 2.0, 1.0), ("two", 20.0, 2.0, 1.0)], "k string, mu double, sigma double, w double")
    points = forecast.mixture(parts, "k", 400)
    assert points.groupBy("k").agg((F.sum(F.col("dens") * F.col("step"))).alias("m")).where("abs(m - 1) > 0.01").count() == 0
    s = {r["k"]: r for r in forecast.statistics(points, "k").collect()}
    assert s["one"]["n_modes"] == 1 and s["two"]["n_modes"] == 2
    assert abs(s["one"]["median"]) < 0.1 and s["two"]["p5"] < s["two"]["median"] < s["two"]["p95"]
    assert abs(s["two"]["p_down10"] - 0.5) < 0.02


def test_firth_is_finite_when_separated(spark):
    df = spark.createDataFrame([(float(k), int(k > 4)) for k in range(10)], "x double, y int")
    got = {r["term"]: r["coef"] for r in statistics.firth(df, ["x"], "y").collect()}
    assert 0 < got["x"] < 5


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)], "x double, y int")
    assert statistics.auc(df).first()["auc"] == 0.875
    assert statistics.youden(df).first()["j"] == 0.5


def test_density_clusters():
    x = np.array([0, 0.1, 0.2, 5, 5.1, 5.2, 20])
    labels = statistics.density_clusters(np.abs(x[:, None] - x[None]), 3)
    assert len(set(labels[:3])) == 1 and len(set(labels[3:6])) == 1 and labels[0] != labels[3] and labels[6] == -1


def test_vectors(spark):
    df = spark.createDataFrame([("[0.5 \x1b[31m-1e-1, x 2]", [3.0, 4.0], [])], "t string, v array<double>, e array<double>")
    r = df.select(V.parsed(F.col("t")).alias("p"), V.norm(F.col("v")).alias("n"), V.fitted(F.col("v"), 3).alias("f"), V.jaccard(F.col("e"), F.col("e"), 1.0).alias("j"), V.std_pop(F.col("v")).alias("s"), V.differences(F.col("v")).alias("d")).first()
    assert r["p"] == [0.5, -0.1, 2.0] and r["n"] == 5 and r["f"] == [3.0, 4.0, 0.0] and r["j"] == 1 and r["s"] == 0.5 and r["d"] == [1.0]


def test_text(spark):
    df = spark.createDataFrame([("a -> b -> c",), ("",), (None,), ("x;y",)], "t string")
    assert [r[0] for r in df.select(T.chain_length(F.col("t"))).collect()] == [3, 0, 0, 2]
    raw = spark.createDataFrame([('```json\n{"k": 1}\n```',), ('{"k": 2}',), ("none",), (None,)], "t string")
    assert [r[0] for r in raw.select(T.parsed_json(F.col("t"), "k int")["k"]).collect()] == [1, 2, None, None]


def test_overlap_join_of_spans_of_any_length(spark):
    day = lambda n: datetime.date(2001, 1, 1) + datetime.timedelta(n)
    rng = random.Random(5)
    spans = [(k, a := rng.randrange(400), a + rng.choice([0, 1, 5, 40, 200, -3])) for k in range(60)]
    left = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in spans[:30]] + [(99, None, day(3))], "k int, a date, b date")
    right = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in spans[30:]] + [(98, day(1), None)], "o int, c date, d date")
    want = sorted((k, o) for k, a, b in spans[:30] for o, c, d in spans[30:] if a <= b and c <= d and a <= d and c <= b)
    assert sorted((r["k"], r["o"]) for r in asof.overlap_join(left, right, ("a", "b"), ("c", "d"), 31).collect()) == want


def test_posterior_chain_in_numpy(spark):
    """Weights of three ranks, priors' spreads and the mixture's statistics, beside a plain computation."""
    rows = [("x", 0.49, 40.0, 60.0, 2.0, 5.0, [0.0, 3.0, -2.0, 4.0]), ("x", 0.25, None, 10.0, 4.0, -12.0, [0.0, 0.1]), ("x", -0.1, 40.0, 40.0, 1.0, 3.0, [0.0]), ("x", 0.81, 40.0, 40.0, 0.5, 30.0, None)]
    df = spark.createDataFrame(rows, "k string, sim double, pb double, pa double, dtw double, mu double, path array<double>")
    w = forecast.three_rank_weight(F.col("sim"), F.col("pb"), F.col("pa"), F.col("dtw"), F.lit(1.5))
    parts = df.withColumn("w", w).withColumn("sigma", F.coalesce(forecast.prior_spread(F.col("path")), F.lit(1.0)))
    got = parts.orderBy("mu").collect()
    mu, sigma, weight = [], [], []
    for _, sim, pb, pa, dtw, m, path in sorted(rows, key=lambda r: r[5]):
        near = 0.5 if pb is None else np.exp(-0.5 * ((pb - pa) / 20) ** 2)
        mu.append(m)
        weight.append(max(sim, 0) ** 0.5 * near**0.2 * np.exp(-dtw / 1.5) ** 0.3)
        sigma.append(max(np.std(np.diff(path)), 1.0) if path and len(path) > 1 else 1.0)
    assert np.allclose([r["w"] for r in got], weight) and np.allclose([r["sigma"] for r in got], sigma)
    mu, sigma, weight = map(np.array, (mu, sigma, weight))
    x = np.linspace((mu - 3 * sigma).min() - 5, (mu + 3 * sigma).max() + 5, 1000)
    dens = (weight / weight.sum() / (sigma * np.sqrt(2 * np.pi)) * np.exp(-0.5 * ((x[:, None] - mu) / sigma) ** 2)).sum(1)
    cdf = np.cumsum(dens) / dens.sum()
    s = forecast.statistics(forecast.mixture(parts.select("k", "mu", "sigma", "w"), "k", 1000), "k").first()
    for name, p in (("p5", 0.05), ("median", 0.5), ("p95", 0.95)):
        assert abs(s[name] - x[np.searchsorted(cdf, p)]) < 1e-9
    step = x[1] - x[0]
    assert abs(s["p_down10"] - dens[x <= -10].sum() * step) < 1e-9 and abs(s["mean"] - (x * dens).sum() * step) < 1e-9


def test_numbered_and_running_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(statistics, "STRETCHES", 7)
    rows = [(k * 37 % 101, k, float((k * 13) % 11 - 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, v double")
    order = sorted(rows)
    assert {(r["a"], r["b"]): r["k"] for r in statistics.numbered(df, ["a", "b"]).collect()} == {(a, b): n for n, (a, b, _) in enumerate(order, 1)}
    total, peak, want = 0.0, 0.0, {}
    for a, b, v in order:
        total += v
        peak = max(peak, total)
        want[a, b] = (total, peak)
    assert {(r["a"], r["b"]): (r["sum"], r["peak"]) for r in statistics.running(df, ["a", "b"], "v").collect()} == want
    assert statistics.numbered(df.where("a < 0"), ["a", "b"]).count() == 0
