"""Ranked funnels, grids, regressions, volatility and topics against plain definitions, with nulls, ties and empty tables."""

import datetime
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import forecast, inference, retrieval, statistics, topics, volatility
from hindcast.plans import cascades

DAY = datetime.date(2000, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=int(k))


@pytest.fixture(scope="module")
def world():
    """Queries and events with vectors, days, paths and strata; some of them alike, some with nulls."""
    r = np.random.default_rng(5)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(r.standard_normal((n, 4)))
    q, e = unit(7), unit(60)
    e[10] = e[11]
    return {"q": q, "e": e, "qd": r.integers(300, 900, 7), "ed": r.integers(0, 900, 60), "qp": r.standard_normal((7, 5)), "ep": np.concatenate([r.standard_normal((58, 5)), np.ones((2, 5))]), "s": r.integers(0, 3, 60)}


def tables(spark, w):
    base = [(k, day(w["qd"][k]), w["q"][k].tolist(), 0.1 * (k % 3), w["qp"][k].tolist()) for k in range(7)] + [(90, None, [1.0] * 4, 0.0, [0.0] * 5), (91, day(3), None, 0.0, [0.0] * 5)]
    corpus = [(k, day(w["ed"][k]), w["e"][k].tolist(), w["ep"][k].tolist(), "abc"[w["s"][k]]) for k in range(60)] + [(None, day(1), [1.0] * 4, [0.0] * 5, "a"), (99, None, [1.0] * 4, [0.0] * 5, None)]
    return spark.createDataFrame(base, "base_id long, d date, emb array<double>, tau double, path array<double>"), spark.createDataFrame(corpus, "event_id long, d date, emb array<double>, path array<double>, stratum string").repartition(3)


def plain_dtw(a, b, band):
    a, b = np.diff(a), np.diff(b)
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        if abs(i - j) <= band:
            d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return math.sqrt(d[-1, -1])


@pytest.mark.parametrize("block", [20_000, 3])
def test_retrieval_funnels(spark, world, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "PAIRS", 11)
    w = world
    base, corpus = tables(spark, w)
    sim = w["q"] @ w["e"].T
    early = w["ed"][None] < w["qd"][:, None]
    got = {r["base_id"]: (r["tau"], r["n_candidates"]) for r in retrieval.reached(base, corpus, (0.9, 0.5, 0.0), 8).collect()}
    for k in range(7):
        n = [int((early[k] & (sim[k] >= t)).sum()) for t in (0.9, 0.5, 0.0)]
        at = next((i for i, m in enumerate(n) if m >= 8), 2)
        assert got[k] == ((0.9, 0.5, 0.0)[at], n[at])
    warped = retrieval.warped(base, corpus, 4).collect()
    faded = retrieval.faded(base, corpus, 5, 0.2, 2.0).collect()
    strata = {(r["base_id"], r["stratum"]): r["n"] for r in retrieval.strata(base, corpus).collect()}
    year = lambda k: day(k).year
    for k in range(7):
        near = [j for j in range(60) if early[k, j] and sim[k, j] >= 0.1 * (k % 3)]
        far = {j: plain_dtw(w["ep"][j], w["qp"][k], 2) for j in near}
        best = sorted(near, key=lambda j: (round(far[j], 12), j))[:4]
        own = {r["event_id"]: r["dtw"] for r in warped if r["base_id"] == k}
        assert sorted(own) == sorted(best) and all(abs(own[j] - far[j]) < 1e-9 for j in best)
        assert {s: n for (b, s), n in strata.items() if b == k} == {s: n for s in "abc" if (n := sum("abc"[w["s"][j]] == s for j in near))}
        score = {j: sim[k, j] * math.exp(-max(year(w["qd"][k]) - year(w["ed"][j]), 0) / 2.0) for j in range(60) if early[k, j] and sim[k, j] >= 0.2}
        want = sorted(score, key=lambda j: (round(-score[j], 12), j))[:5]
        assert sorted(r["event_id"] for r in faded if r["base_id"] == k) == sorted(want)
    for f in (lambda b, c: retrieval.reached(b, c, (0.5,), 1), lambda b, c: retrieval.warped(b, c, 2), lambda b, c: retrieval.faded(b, c, 2, 0.0), retrieval.strata):
        assert f(base.where("1 = 0"), corpus).count() == 0
    assert retrieval.warped(base, corpus.where("1 = 0"), 2).count() == 0


def test_rerank_is_by_persistence_then_path(spark, world):
    base, corpus = tables(spark, {**world, "qp": np.pad(world["qp"], ((0, 0), (0, 2))), "ep": np.pad(world["ep"], ((0, 0), (0, 2)), mode="edge")})
    got = cascades.reranked(base.drop("tau"), corpus, (0.0,), 1, 3).collect()
    for k in {r["base_id"] for r in got}:
        own = sorted((r for r in got if r["base_id"] == k), key=lambda r: r["rank"])
        assert [(-r["persistence"], r["dtw"]) for r in own] == sorted((-r["persistence"], r["dtw"]) for r in own) and len(own) <= 3
        assert all(abs(r["combined"] - r["sim"] * r["recency"]) < 1e-12 and r["persistence"] == sum(x * (1 if r["path"][4] >= 0 else -1) > 0 for x in r["path"][4:7]) for r in own)


def test_signed_ranks(spark):
    rows = {1: [(1.0, 2.0), (3.0, 1.0), (5.0, 5.0), (2.0, 3.0), (9.0, 1.0)], 2: [(1.0, 1.0)], 3: [(k + 1.0, 0.0) for k in range(12)]}
    df = spark.createDataFrame([(k, a, b) for k, ps in rows.items() for a, b in ps], "key long, a double, b double")
    got = {r["key"]: r for r in statistics.signed_ranks(df, "key", "a", "b").collect()}
    assert 2 not in got and (got[1]["n"], got[1]["w_plus"], got[1]["w_minus"]) == (4, 7.0, 3.0)
    var = 4 * 5 * 9 / 24 - (2**3 - 2) / 48
    assert abs(got[1]["z"] - (7 - 5) / math.sqrt(var)) < 1e-9
    assert got[3]["w_minus"] == 0 and abs(got[3]["p"] - math.erfc(got[3]["z"] / math.sqrt(2))) < 1e-6


def test_bands_signatures_and_profiles(spark):
    bands = lambda *b: dict(zip(cascades.KEYS, b, strict=True))
    u = "UNK"
    rows = [(bands(u, u, u, u, u), bands(u, u, u, u, u), 1.0), (bands("a", u, u, u, u), bands("a", u, u, u, u), 0.0), (bands("a", "b", u, u, u), bands("a", u, "c", u, u), 2 / 3)]
    kind = "struct<" + ",".join(f"{k}:string" for k in cascades.KEYS) + ">"
    df = spark.createDataFrame([(tuple(a.values()), tuple(b.values()), x) for a, b, x in rows], f"a {kind}, b {kind}, x double")
    assert all(abs(r["got"] - r["x"]) < 1e-12 for r in df.withColumn("got", cascades.distance_of_bands(F.col("a"), F.col("b"))).collect())
    c = spark.createDataFrame([(1, day(0), day(0), 0), (2, day(10), day(14), 4), (3, day(5000), day(5001), 1)], "id long, first_seen date, last_seen date, spread_days int")
    px = spark.createDataFrame([(day(k), 100.0 + (k * 7) % 13) for k in range(0, 400) if k % 5], "d date, px double")
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy(F.lit(0)).orderBy("d")
    days = px.withColumns({"before": F.lag("d").over(w), "r": F.col("px") / F.lag("px").over(w) - 1})
    got = {r["id"]: r for r in cascades.signatures(c, days).collect()}
    assert set(got[3].asDict().values()) == {3, "UNK"} and got[1]["annual"] == "UNK" and got[2]["annual"] in cascades.SIGNATURE
    members = spark.createDataFrame([(1, day(0)), (1, day(0)), (2, day(10)), (2, day(11)), (2, day(14))], "id long, d date")
    p = {r["id"]: r["profile"] for r in cascades.profiles(members, c).collect()}
    for k, counts in ((1, [2, 0]), (2, [1, 1, 0, 0, 1])):
        want = np.interp(np.linspace(0, 1, 21), np.linspace(0, 1, len(counts)), counts)
        assert np.allclose(p[k], want / want.sum())
    paths = {r["id"]: r["returns"] for r in cascades.return_paths(c, days).collect()}
    assert paths[3] == [] and len(paths[2]) == sum(1 for k in range(10, 30) if k % 5) - 1


def cluster_index(spark, n=40):
    r = np.random.default_rng(2)
    words = list("abcdefgh")
    rows = []
    for k in range(n):
        first = day(30 * k)
        rows.append((k, first, first + datetime.timedelta(days=20), int(r.integers(1, 6)), 20, "NOVEL" if k % 2 else "REPEAT", r.standard_normal(3).tolist(), [] if k == 5 else sorted(set(r.choice(words, 4).tolist())), tuple(r.choice(["x", "y", "UNK"], 5).tolist()), r.random(21).tolist(), float(r.random()), 1, int(r.integers(0, 2))))
    kind = "struct<" + ",".join(f"{k}:string" for k in cascades.KEYS) + ">"
    return spark.createDataFrame(rows, f"id long, first_seen date, last_seen date, size long, spread_days int, role string, emb array<double>, bag array<string>, bands {kind}, profile array<double>, dominance double, concurrent long, larger long")


def test_cascade_stages(spark):
    index = cluster_index(spark)
    asks = index.where("id >= 30 or id = 0")
    p = cascades.staged(asks, index, fade=3.0, least=2, tau=(-0.5, 0.3, 0.7), pools=(12, 8, 5), top=2, years=(2000, 2002), roles=("NOVEL",))
    rows = {(r["base_id"], r["id"]): r for r in p.collect()}
    every = {r["id"]: r for r in index.collect()}
    for b in [x for x in every if x >= 30]:
        q = every[b]
        sim = lambda c: float(np.dot(q["emb"], c["emb"]) / np.linalg.norm(q["emb"]) / np.linalg.norm(c["emb"]))  # noqa: B023, E731
        score = lambda c: sim(c) * math.exp(-max(q["first_seen"].year - c["first_seen"].year, 0) / 3.0)  # noqa: B023, E731
        one = sorted((c for c in every.values() if c["last_seen"] < q["first_seen"] and c["size"] >= 2 and c["first_seen"].year <= 2002 and c["role"] == "NOVEL" and sim(c) >= -0.5), key=lambda c: (-score(c), c["id"]))[:12]
        jac = lambda c: len(set(q["bag"]) & set(c["bag"])) / max(len(set(q["bag"]) | set(c["bag"])), 1)  # noqa: B023, E731
        two = sorted((c for c in one if jac(c) >= 0.3), key=lambda c: (-jac(c), -score(c), c["id"]))[:8]

        def unlike(c):
            known = [k for k in cascades.KEYS if q["bands"][k] != "UNK" or c["bands"][k] != "UNK"]  # noqa: B023
            return sum(q["bands"][k] != c["bands"][k] for k in known) / len(known) if known else 1.0  # noqa: B023

        three = sorted((c for c in two if unlike(c) <= 0.7), key=lambda c: (unlike(c), two.index(c)))[:5]
        far = {c["id"]: float(retrieval.dtw(np.array([q["profile"]]), np.array([c["profile"]]), None)[0]) for c in three}
        four = sorted(three, key=lambda c: far[c["id"]])[:4]
        own = {i: r for (x, i), r in rows.items() if x == b}
        assert sorted(own) == sorted(c["id"] for c in one)
        assert {i: r["stage"] for i, r in own.items()} == {c["id"]: 1 + (c in two) + (c in three) + (c in four) for c in one}
        for c in four:
            r, prop = own[c["id"]], 1 - far[c["id"]] / max(far.values())
            raw = 0.5 * sim(c) + 0.3 * prop + 0.2 * (1 - unlike(c)) - 0.5 * (c["larger"] > 0) - 0.3 * (1 - c["dominance"])
            assert abs(r["weight"] - raw * math.exp(-max(q["first_seen"].year - c["first_seen"].year, 0) / 3.0)) < 1e-9
    n = {r["base_id"]: r for r in cascades.funnel(p, asks, 2).collect()}
    assert n[0]["n_semantic"] == 0 and n[0]["reason"] == cascades.REASONS[0] and n[0]["n_ranked"] == 0
    assert all(n[b]["n_semantic"] == sum(x == b for x, _ in rows) and n[b]["n_propagation"] == sum(x == b and r["stage"] == 4 for (x, _), r in rows.items()) for b in n)
    per_era = cascades.ranked(p, 2, per_era=1, era_years=1).groupBy("base_id", F.year("first_seen")).count().collect()
    assert all(r["count"] == 1 for r in per_era)


def test_scores_on_grids(spark):
    r = np.random.default_rng(0)
    rows = []
    for k, y in enumerate((-9.0, -1.0, 0.0, 0.37, 2.5, 99.0, None, float("nan"))):
        xs = np.sort(r.uniform(-3, 3, 40)) if k % 2 else np.linspace(-3, 3, 61)
        ds = np.abs(r.standard_normal(len(xs))) if k else np.zeros(len(xs))
        rows.append((k, xs.tolist(), ds.tolist(), y))
    df = spark.createDataFrame(rows, "k long, xs array<double>, ds array<double>, y double")
    xs, ds, y = F.col("xs"), F.col("ds"), F.col("y")
    for got in df.select("*", forecast.crps_on_grid(xs, ds, y).alias("c"), forecast.density_at(xs, ds, y).alias("f"), forecast.log_score_on_grid(xs, ds, y).alias("l")).collect():
        if got["y"] is None or math.isnan(got["y"]):
            assert got["c"] is None and got["f"] is None and got["l"] is None
            continue
        x, d = np.array(got["xs"]), np.array(got["ds"])
        cdf = np.concatenate([[0], np.cumsum(0.5 * (d[1:] + d[:-1]) * np.diff(x))])
        cdf = cdf / cdf[-1] if cdf[-1] > 0 else cdf
        g = (cdf - (x >= got["y"])) ** 2
        assert abs(got["c"] - (0.5 * (g[1:] + g[:-1]) * np.diff(x)).sum()) < 1e-9
        f = np.interp(got["y"], x, d)
        assert abs(got["f"] - f) < 1e-12 and (got["l"] == float("-inf") if f <= 0 else abs(got["l"] - math.log(f)) < 1e-9)
    q = spark.createDataFrame([(1.0, 2.0, 4.0, 7.0, 11.0)], "a double, b double, c double, d double, e double")
    at, names = (0.05, 0.25, 0.5, 0.75, 0.95), "abcde"
    for t in (0.01, 0.05, 0.1, 0.25, 0.6, 0.95, 0.99):
        assert abs(q.select(forecast.quantile_between(t, dict(zip(at, names, strict=True)))).first()[0] - np.interp(t, at, [1, 2, 4, 7, 11])) < 1e-12


def plain_peaks(d):
    found, i = [], 1
    while i < len(d) - 1:
        j = i
        while j < len(d) - 1 and d[j + 1] == d[i]:
            j += 1
        if d[i - 1] < d[i] and j < len(d) - 1 and d[j + 1] < d[i]:
            found.append((i + j) // 2)
        i = j + 1
    out = []
    for p in found:
        low = []
        for way in (range(p - 1, -1, -1), range(p + 1, len(d))):
            least = d[p]
            for k in way:
                if d[k] > d[p]:
                    break
                least = min(least, d[k])
            low.append(least)
        out.append((p, d[p] - max(low)))
    return out


def test_modes(spark):
    r = np.random.default_rng(1)
    grids = [r.integers(0, 5, 30).astype(float).tolist() for _ in range(40)] + [[0.0] * 9, [1.0, 2.0, 3.0], [0.0, 2.0, 2.0, 0.0, 5.0, 5.0, 5.0, 1.0], [1.0], [0.0, 1.0, 0.0]]
    df = spark.createDataFrame([(k, [0.5 * i for i in range(len(g))], g) for k, g in enumerate(grids)], "k long, xs array<double>, ds array<double>")
    for got in forecast.modes(df, 0.25).collect():
        d = got["ds"]
        kept = sorted((prom, p) for p, prom in plain_peaks(d) if prom >= 0.25 * max(d) and max(d) > 0)
        assert got["n_peaks"] == len(kept)
        if len(kept) < 2:
            assert got["mode1_x"] is None and got["separation"] is None and got["balance"] is None
        else:
            (b, i), (a, j) = kept[-2:]
            assert (got["mode1_x"], got["mode2_x"]) == tuple(sorted((0.5 * i, 0.5 * j))) and got["separation"] == abs(i - j) / 2 and abs(got["balance"] - b / a) < 1e-12


def test_kernels(spark):
    parts = [(1, 0.5, 0.2, 2.0), (1, -0.5, 0.1, 1.0), (2, 0.0, 1.0, 1.0)]
    got = {(r["key"], r["i"]): (r["x"], r["dens"]) for r in forecast.kernels(spark.createDataFrame(parts, "key long, mu double, sigma double, w double"), "key", -1.0, 1.0, 5).collect()}
    for (key, i), (x, dens) in got.items():
        assert abs(x - (-1 + 0.5 * i)) < 1e-12
        assert abs(dens - sum(w / (s * math.sqrt(2 * math.pi)) * math.exp(-0.5 * ((x - m) / s) ** 2) for k, m, s, w in parts if k == key)) < 1e-12
    assert len(got) == 10


def regression_rows(spark):
    r = np.random.default_rng(3)
    x = np.column_stack([np.ones(300), 100 * r.standard_normal(300), r.integers(0, 2, 300)])
    y = (r.random(300) < 1 / (1 + np.exp(-(0.3 + 0.01 * x[:, 1] - 0.8 * x[:, 2])))).astype(float)
    grp = r.integers(0, 30, 300)
    rows = [(cell, x[k].tolist(), float(y[k]), f"g{grp[k]}") for k in range(300) for cell in ("logit", "probit")] + [("apart", [1.0, float(k)], float(k > 5), "g") for k in range(12)] + [("logit", [1.0, None, 1.0], 1.0, "g"), ("logit", [1.0, 2.0, 1.0], None, "g"), ("unknown", [1.0], 1.0, "g")]
    return spark.createDataFrame(rows, "cell string, x array<double>, y double, grp string").repartition(4), x, y, grp


def test_regressions(spark):
    rows, x, y, grp = regression_rows(spark)
    names = {"logit": ["const", "std", "flag"], "probit": ["const", "std", "flag"], "apart": ["const", "std"], "none": ["const"]}
    models = inference.fit(rows, names, {"probit": "probit"})
    assert set(models) == {"logit", "probit", "apart"} and not models["apart"].rested and models["logit"].rested and models["probit"].rested
    erf = np.vectorize(math.erf)
    ll = {"logit": lambda b: float(-np.logaddexp(0, np.where(y > 0, -(x @ b), x @ b)).sum()), "probit": lambda b: float(np.log(0.5 * (1 + erf(np.where(y > 0, x @ b, -(x @ b)) / math.sqrt(2)))).sum())}
    for cell, f in ll.items():
        m = models[cell]
        assert m.n == 300 and m.ones == int(y.sum()) and abs(m.ll - f(m.beta)) < 1e-6
        h = 1e-4 / np.array([1, 100, 1])
        e = np.diag(h)
        assert all(abs(f(m.beta + e[j]) - f(m.beta - e[j])) / (2 * h[j]) < 1e-3 * (100 if j == 1 else 1) for j in range(3))
        second = np.array([[(f(m.beta + 10 * (e[a] + e[b])) - f(m.beta + 10 * (e[a] - e[b])) - f(m.beta - 10 * (e[a] - e[b])) + f(m.beta - 10 * (e[a] + e[b]))) / (400 * h[a] * h[b]) for b in range(3)] for a in range(3)])
        assert np.allclose(np.linalg.inv(-second), m.cov, rtol=0.02, atol=1e-9)
    m = models["logit"]
    p = 1 / (1 + np.exp(-(x @ m.beta)))
    s = np.stack([(x * (y - p)[:, None])[grp == g].sum(0) for g in np.unique(grp)])
    g = len(s)
    want = g / (g - 1) * 299 / 297 * m.cov @ (s.T @ s) @ m.cov
    got = inference.clustered(rows, {"logit": m})["logit"]
    assert np.allclose(got, want)
    effect, error = inference.marginal_effects(rows, {"logit": m}, "flag")["logit"]
    ame = lambda b: float((lambda q: (q * (1 - q)).mean() * b[2])(1 / (1 + np.exp(-(x @ b)))))
    slope = np.array([(ame(m.beta + d) - ame(m.beta - d)) / (2 * d.sum()) for d in np.diag([1e-5, 1e-7, 1e-5])])
    assert abs(effect - ame(m.beta)) < 1e-9 and abs(error - math.sqrt(slope @ m.cov @ slope)) < 1e-6
    assert abs(inference.chi_square_tail(3.841458820694124) - 0.05) < 1e-9 and abs(inference.normal_tail(1.959963984540054) - 0.05) < 1e-9


def test_curves_and_folds(spark):
    r = np.random.default_rng(4)
    x, y = np.round(r.standard_normal(200), 1), (r.random(200) < 0.3).astype(int)
    rows = [("a", float(a), int(b)) for a, b in zip(x, y, strict=True)] + [("ones", 1.0, 1), ("a", None, 1)]
    curve = statistics.roc(spark.createDataFrame(rows, "by string, x double, y int").repartition(3), ["by"])
    auc = {r["by"]: r["auc"] for r in statistics.auc_by(curve, ["by"]).collect()}
    pairs = [(a > b) + (a == b) / 2 for a in x[y == 1] for b in x[y == 0]]
    assert abs(auc["a"] - np.mean(pairs)) < 1e-12 and auc["ones"] is None
    best = {r["by"]: (r["threshold"], r["j"]) for r in statistics.best_cut(curve, ["by"]).collect()}
    j = {t: (x[y == 1] >= t).mean() - (x[y == 0] >= t).mean() for t in set(x.tolist())}
    assert set(best) == {"a"} and abs(best["a"][1] - max(j.values())) < 1e-12 and best["a"][0] == max(t for t in j if abs(j[t] - max(j.values())) < 1e-12)
    df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)] + [(999, None)], "id long, y int")
    folds = [(r["id"], r["y"], r["fold"]) for r in statistics.folded(df, "id", "y", 5, 42).collect()]
    again = [(r["id"], r["y"], r["fold"]) for r in statistics.folded(df.repartition(7), "id", "y", 5, 42).collect()]
    assert sorted(folds) == sorted(again) and len(folds) == 200
    for v in (0, 1):
        n = [sum(f == k and w == v for _, w, f in folds) for k in range(1, 6)]
        assert max(n) - min(n) <= 1


def plain_run(model, r, p):
    v, h, loss = r.var(), r.var(), 0.0
    for x in r:
        loss += math.log(h) + x * x / h
        if model == "garch":
            h = v * (1 - p[0] - p[1]) + p[0] * x * x + p[1] * h
        elif model == "gjr":
            h = v * (1 - p[0] - p[1] / 2 - p[2]) + (p[0] + p[1] * (x < 0)) * x * x + p[2] * h
        else:
            h = math.exp(min(max((1 - p[1]) * math.log(v) + p[0] * (abs(x) / math.sqrt(h) - math.sqrt(2 / math.pi)) + p[1] * math.log(h), -60), 60))
    return loss, h


def shocks(n, seed):
    """Returns of a GARCH process."""
    r = np.random.default_rng(seed)
    h, out = 1.0, []
    for _ in range(n):
        out.append(math.sqrt(h) * r.standard_normal())
        h = 0.05 + 0.15 * out[-1] ** 2 + 0.8 * h
    return np.array(out) - np.mean(out)


@pytest.mark.parametrize("model", volatility.MODELS)
def test_volatility_recursions(model):
    series = [shocks(200, 1), shocks(160, 2)]
    r = np.full((2, 200), np.nan)
    for k, s in enumerate(series):
        r[k, 200 - len(s) :] = s
    p = np.array(volatility.COARSE[model][7])
    loss, h = volatility.run(model, r, np.broadcast_to(p, (2, 1, len(p))))
    for k, s in enumerate(series):
        want = plain_run(model, s, p)
        assert abs(loss[k, 0] - want[0]) < 1e-8 and abs(h[k, 0] - want[1]) < 1e-8
    best, loss, h = volatility.fitted(model, r)
    for k, s in enumerate(series):
        assert abs(plain_run(model, s, best[k])[0] - loss[k]) < 1e-8 and loss[k] <= min(plain_run(model, s, c)[0] for c in volatility.COARSE[model] if volatility.allowed(model, np.array(c)))
        steps = itertools.product((-0.02, 0, 0.02), repeat=len(best[k]))
        near = [best[k] + np.array(d) for d in steps]
        assert loss[k] <= min(plain_run(model, s, c)[0] for c in near if volatility.allowed(model, c)) + 0.05
        alone = volatility.fitted(model, s[None])
        assert np.allclose(alone[0][0], best[k]) and np.allclose(alone[2][0], h[k])
    one = volatility.ahead(model, best[0], series[0].var(), h[0], 10, "seed")
    assert one == volatility.ahead(model, best[0], series[0].var(), h[0], 10, "seed") and one > 0
    assert abs(volatility.ahead(model, best[0], series[0].var(), h[0], 1, "x") - h[0]) < 1e-9


def test_volatility_benchmarks(spark):
    r = np.random.default_rng(9)
    px = 100 * np.exp(np.cumsum(0.01 * r.standard_normal(700)))
    rows = [("s", day(k), float(px[k])) for k in range(700) if k % 3] + [("s", day(5), None), ("short", day(1), 5.0)]
    asks = [("s", day(k)) for k in (3, 100, 450, 451, 699, 640, 2000)] + [("s", None), ("short", day(1)), (None, day(450)), ("s", day(450))]
    out = volatility.benchmarks(spark.createDataFrame(asks, "key string, d date"), spark.createDataFrame(rows, "key string, d date, px double"), "key")
    got = {(r["d"], r["model"]): r for r in out.collect()}
    assert {d for d, _ in got} == {day(k) for k in (100, 450, 451, 640, 699)}
    assert {m for d, m in got if d == day(100)} == {"kde_rolling", "kde_all"} and len([1 for d, _ in got if d == day(450)]) == 6
    g = got[day(450), "garch"]
    assert abs(g["p95"] - 1.6448536269514722 * g["sigma"]) < 1e-9 and all(v["p5"] < v["p95"] and 0 <= v["p_down10"] <= 1 for v in got.values())
    known = np.array([p for _, d, p in rows[:-2] if d <= day(449)])  # day 450 has none: the earlier of its neighbours
    points = 100 * (known[15:] / known[:-15] - 1)
    assert abs(got[day(450), "kde_all"]["p5"] - volatility.of_kernels(points)[1]) < 1e-9
    assert volatility.of_kernels(np.ones(5)) == (None,) * 5


TEXTS = ["oil supply falls in the gulf", "oil supply rises", "oil supply oil supply", None, "", "bank rates rise again", "bank rates fall", "bank rates bank", "x", "gulf"]


def test_topic_weights_and_decomposition(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "oil supply")], "doc_id long, text string")
    counts = topics.counted(docs, ("the", "in"))
    n = {}
    for k, t in enumerate(TEXTS):
        words = [w for w in __import__("re").findall("[a-zà-ÿ]{3,}", (t or "").lower()) if w not in ("the", "in")]
        for term in words + [f"{a} {b}" for a, b in itertools.pairwise(words)]:
            n[k, term] = n.get((k, term), 0) + 1
    assert {(r["doc_id"], r["term"]): r["tf"] for r in counts.collect()} == n
    v = topics.vocabulary(counts, 10, fewest=2, most=0.75)
    df = {t: sum(t == x for _, x in n) for _, t in n}
    idf = {r["term"]: (r["at"], r["idf"]) for r in v.collect()}
    assert set(idf) == {t for t, m in df.items() if 2 <= m <= 7.5} and all(abs(x - (math.log(11 / (1 + df[t])) + 1)) < 1e-12 for t, (_, x) in idf.items())
    dense = np.zeros((10, len(idf)))
    for (k, t), m in n.items():
        if t in idf:
            dense[k, idf[t][0]] = (1 + math.log(m)) * idf[t][1]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    rows = topics.weighted(counts, v)
    for r in rows.collect():
        assert np.allclose(dense[r["doc_id"], r["at"]], r["w"]) and abs(np.linalg.norm(r["w"]) - 1) < 1e-12
    space, values = topics.decomposed(rows, len(idf), 3)
    u, s, vt = np.linalg.svd(dense)
    assert np.allclose(values, s[:3]) and np.allclose(np.abs(np.diag(space.T @ vt[:3].T)), 1, atol=1e-6)
    x = {r["doc_id"]: r["x"] for r in topics.embedded(rows, space).collect()}
    for k, row in x.items():
        want = dense[k] @ space
        assert np.allclose(row, want / np.linalg.norm(want))


def test_topic_labels_and_merges(spark):
    into = topics.merges({-1: "outlier", 0: "oil · supply · gulf", 1: "bank · rates", 2: "gulf · oil · supply", 3: "supply · oil · gulf · sea"}, 0.75)
    assert into[2] == 0 and 1 not in into and set(into.values()) <= {0}
    assert topics.merges({}) == {} and topics.merges({-1: "outlier", 4: "one"}) == {}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["oil supply gulf tanker"] * 7 + ["bank rates money loan"] * 7 + ["unique words here"])] + [(99, None), (None, "oil")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in topics.topics(docs, dimensions=5, least=3).collect()}
    assert len(out) == 16 and len({out[k]["topic"] for k in range(7)}) == 1 and len({out[k]["topic"] for k in range(7, 14)}) == 1
    assert out[0]["topic"] != out[7]["topic"] and "oil" in out[0]["label"] and "bank" in out[7]["label"] and out[99]["label"] == topics.OUTLIER and out[99]["topic"] == -1
    assert out[0]["oversized"] and not out[99]["oversized"]
    assert topics.topics(docs.where("1 = 0")).count() == 0


def test_clusters_reach_texts_that_were_not_fitted(spark):
    r = np.random.default_rng(6)
    at = lambda c: (lambda v: (v / np.linalg.norm(v)).tolist())(np.eye(4)[c] + 0.05 * r.standard_normal(4))
    rows = [(k, at(k % 2)) for k in range(200)] + [(1000, np.eye(4)[3].tolist())]
    v = spark.createDataFrame(rows, "doc_id long, x array<double>")
    few = {r["doc_id"]: r["topic"] for r in topics.clustered(v, fitted=40, least=5).collect()}
    assert len(few) == 201 and few[1000] == -1
    for c in (0, 1):
        assert sum(few[k] >= 0 for k in range(c, 200, 2)) >= 50
    pairs = [(few[a], few[b]) for a, b in itertools.combinations(range(200), 2) if few[a] >= 0 and few[b] >= 0 and a % 2 != b % 2]
    assert all(a != b for a, b in pairs)


def test_quantiles_of_parts_are_those_of_the_grid(spark):
    parts = [(1, 0.0, 1.0, 2.0), (1, 30.0, 2.0, 1.0), (2, -15.0, 3.0, 0.5), (3, 1.0, 1.0, 0.0), (4, 5.0, 1.0, 1e-3)]
    df = spark.createDataFrame(parts, "key long, mu double, sigma double, w double")
    got = {r["key"]: r for r in forecast.quantiles_of_parts(df, "key").collect()}
    want = {r["key"]: r for r in forecast.statistics(forecast.mixture(df.where("w > 0"), "key", 1000), "key").collect()}
    assert set(got) == {1, 2, 4} and (got[1]["n"], got[1]["n_peaks"], got[2]["n_peaks"]) == (2, 2, 1)
    for k, g in got.items():
        # a level that lies on a grid point may fall to either side of it by rounding
        assert all(abs(g[c] - want[k][c]) < 0.06 for c in ("p5", "p25", "median", "p75", "p95"))
        assert all(abs(g[c] - want[k][c]) < 5e-3 for c in ("p_down10", "p_up10"))


@pytest.mark.parametrize("block", [20_000, 2])
def test_blended_retrieval(spark, world, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    r, w = np.random.default_rng(8), world
    bag = lambda: sorted(set(r.choice(list("abcdef"), int(r.integers(0, 5))).tolist()))
    qs = [(k, day(w["qd"][k]), w["q"][k].tolist(), int(k % 2), bag()) for k in range(7)]
    es = [(k, day(w["ed"][k]), w["e"][k].tolist(), int(k % 3), bag()) for k in range(60)]
    base = spark.createDataFrame([*qs, (80, day(900), [1.0] * 4, 0, None)], "base_id long, d date, emb array<double>, kind long, bag array<string>")
    corpus = spark.createDataFrame([*es, (98, day(1), None, 0, []), (99, day(1), [1.0] * 4, None, [])], "event_id long, d date, emb array<double>, kind long, bag array<string>").repartition(3)
    got = retrieval.blended(base, corpus, 4, 0.1).collect()
    sim = w["q"] @ w["e"].T
    for k, d, _, kind, own in qs:
        score = {}
        for j, ed, _, other, theirs in es:
            if ed < d and sim[k, j] >= 0.1:
                either = set(own) | set(theirs)
                score[j] = 0.6 * sim[k, j] + 0.25 * (len(set(own) & set(theirs)) / len(either) if either else 0) + 0.15 * (kind == other)
        want = sorted(score, key=lambda j: (round(-score[j], 12), j))[:4]
        assert [r["event_id"] for r in sorted((r for r in got if r["base_id"] == k), key=lambda r: r["rank"])] == want
    assert retrieval.blended(base.where("1 = 0"), corpus, 4, 0.1).count() == 0


def test_leg_moves(spark):
    from hindcast.plans import cones

    prices = {("a", k): 100.0 + k * k for k in range(0, 40) if k % 4 != 1} | {("b", k): 50.0 - k for k in range(10, 20)}
    legs = spark.createDataFrame([(leg, day(k), p) for (leg, k), p in prices.items()], "leg string, d date, px double")
    asked = [12, 13, 30]
    events = spark.createDataFrame([(day(k),) for k in [*asked, *asked]] + [(None,)], "d date")
    got = {((r["d"] - DAY).days, r["leg"], r["day"]): (r["r"], r["sigma"]) for r in cones.leg_moves(events, legs).collect()}
    want = {}
    for d, leg in itertools.product(asked, "ab"):
        if (leg, d) in prices:
            own = {k - d: 100 * (p - prices[leg, d]) / prices[leg, d] for (x, k), p in prices.items() if x == leg and abs(k - d) <= 15}
            before = [own[k] for k in sorted(own) if k <= 0]
            sigma = max(float(np.std(np.diff(before))), 1.0) if len(before) > 1 else 1.0
            want |= {(d, leg, k): (r, sigma) for k, r in own.items()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_calibration_bins_and_width_ratios(spark):
    from hindcast.plans import comparisons

    r = np.random.default_rng(11)
    p, y = np.round(r.random(80), 1), r.integers(0, 2, 80)
    for stated in (p, np.full(80, 0.5)):
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(stated, y, strict=True)], "p double, y int")
        got = {r["bin"]: r for r in comparisons.binned(df, "p", "y", 5).collect()}
        edges = np.unique(np.percentile(stated, [0, 20, 40, 60, 80, 100]))
        at = np.maximum(np.searchsorted(edges, stated, "left"), 1)
        assert set(got) == set(at.tolist())
        for k, g in got.items():
            own = at == k
            assert g["n"] == own.sum() and abs(g["stated"] - stated[own].mean()) < 1e-9 and abs(g["seen"] - y[own].mean()) < 1e-9
    w = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", 0.0, 9.0), ("a", 1.0, None), ("b", 2.0, 1.0)], "m string, own double, other double")
    got = {r["m"]: r for r in comparisons.width_ratios(w, "m", "own", "other").collect()}
    assert (got["a"]["n"], got["a"]["ratio_of_means"], got["a"]["mean_of_ratios"], got["b"]["wider"]) == (2, 1.25, 1.5, -50.0)


def test_comparison_of_methods(spark):
    from hindcast.plans import comparisons

    lists = {"x": [(1, 10), (1, 11), (2, 10)], "y": [(1, 11), (1, 12)], "z": [(1, 10), (1, 11)]}
    paths = spark.createDataFrame([(10, [0.0, 1.0, 2.0]), (11, [0.0, 0.0, 0.0]), (12, [0.0, 5.0, 9.0])], "event_id long, path array<double>")
    base = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [0.0, 0.0, 1.0])], "base_id long, base_path array<double>")
    got = {r["base_id"]: r for r in comparisons.compared({m: spark.createDataFrame(rows, "base_id long, event_id long") for m, rows in lists.items()}, paths, base).collect()}
    one = got[1]
    assert (one["n_x"], one["n_y"], one["n_z"], one["overlap_x_z"], one["winner"]) == (2, 2, 2, 1.0, "x") and abs(one["overlap_x_y"] - 1 / 3) < 1e-12
    assert one["dtw_x"] == (0 + 3) / 2 and one["dtw_y"] == (3 + 11) / 2
    assert got[2]["n_y"] == 0 and got[2]["dtw_y"] is None and got[2]["winner"] == "x"


def test_forecast_efficiency(spark):
    x = np.linspace(-40, 40, 401)
    norm = lambda m, s: np.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi))
    rows = [(1, norm(5, 4), 6.0, 10.0), (2, norm(0, 8), 20.0, 3.0), (3, norm(0, 8), None, 3.0), (4, norm(0, 8), 1.0, None), (5, norm(0, 8), 1.0, 0.0), (6, norm(0, 8), 1.0, float("nan"))]
    df = spark.createDataFrame([(k, x.tolist(), d.tolist(), y, s) for k, d, y, s in rows], "k long, xs array<double>, ds array<double>, y double, sigma double")
    got = {r["k"]: r for r in forecast.efficiencies(df).collect()}
    area = lambda v: sum((v[i] + v[i + 1]) / 2 * (x[i + 1] - x[i]) for i in range(400))
    for k, d, y, s in rows[:2]:
        came = norm(y, max(abs(y) * 0.05, 0.2))
        came, other, own = came / area(came), norm(0, s) / area(norm(0, s)), d / area(d)
        kl = lambda p: area([max(a, 1e-10) * math.log(max(a, 1e-10) / max(b, 1e-10)) for a, b in zip(p, came, strict=True)])  # noqa: B023, E731
        w1 = lambda p: area(np.abs(np.clip(np.cumsum(p) * 0.2, 0, 1) - np.clip(np.cumsum(came) * 0.2, 0, 1)))  # noqa: B023, E731
        assert abs(got[k]["fei_kl"] - kl(other) / kl(own)) < 1e-6 and abs(got[k]["fei_w1"] - w1(other) / w1(own)) < 1e-6
    assert got[1]["fei_js"] > 1 and all(got[k][c] is None or math.isnan(got[k][c]) for k in (3, 4, 5, 6) for c in ("fei_kl", "fei_js", "fei_w1"))
