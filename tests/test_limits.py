"""What the queries do at their limits: outcomes of one kind, equal vectors, more rows than fit at once."""

import datetime
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare
from pyspark.sql import functions as F

from hindcast.operators import forecast, nearby, retrieval, statistics
from hindcast.plans import measures, registry

SF = "/root/testdata/sf0.01"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def calm(spark, tmp_path_factory):
    """Tables whose prices hardly move: no return is large, but for `moved`, whose one week is dear."""
    out = {}
    for name, dear in (("calm", "false"), ("moved", "o_orderdate between '2000-06-01' and '2000-06-07'")):
        path = tmp_path_factory.mktemp(name)
        orders = spark.read.parquet(f"{SF}/orders.parquet")
        orders.withColumn("o_totalprice", F.expr(f"1000 + o_orderkey % 97 + if({dear}, 900, 0)").cast("double")).coalesce(1).write.parquet(f"{path}/x")
        next(p for p in (path / "x").iterdir() if p.suffix == ".parquet").rename(path / "orders.parquet")
        for t in ("region nation customer supplier part lineitem events documents embeddings pages benchmark labels conversations").split():
            (path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
        out[name] = str(path)
    return out


@pytest.mark.parametrize("name", ["calm", "moved"])
def test_warnings_without_large_moves(spark, calm, name):
    assert compare(spark, QUERIES["early_warning_folds"], SQL["early_warning_folds"], calm[name]) == 15


def test_youden_without_large_moves(spark, calm):
    assert compare(spark, QUERIES["youden"], SQL["youden"], calm["calm"]) == 1
    alike = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, y int")
    assert statistics.youden(alike).first()["threshold"] == 2.0
    assert statistics.youden(alike.where("1 = 0")).count() == 0


@pytest.fixture
def peaks(monkeypatch):
    """MB at most that each function mapped over Arrow batches held, run in this process over batches of 10,000 rows."""
    held = []

    def here(self, f, schema, *_, **__):
        batches = self.toArrow().combine_chunks().to_batches(10_000)
        tracemalloc.start()
        found = list(f(iter(batches)))
        held.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        names = [x.split()[0] for x in schema.split(", ")]
        return self.sparkSession.createDataFrame(pa.Table.from_batches(found).select(names)) if found else self.sparkSession.createDataFrame([], schema)

    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "mapInArrow", here)
    return held


def vectors(spark, n, seed, name):
    r = np.random.default_rng(seed)
    m = r.standard_normal((n, 8)).astype(np.float32)
    m[n // 2 :] = m[: n - n // 2]  # all occur twice
    day = lambda k: datetime.date(2000, 1, 1) + datetime.timedelta(days=k % 7 + (20 if name == "base_id" else 0))
    rows = [(k, day(k), m[k].tolist(), k % 3, [f"w{k % 5}"]) for k in range(n)]
    return m.astype(float), spark.createDataFrame(rows, f"{name} long, d date, emb array<float>, kind long, bag array<string>")


@pytest.mark.parametrize("words", [0.25, 0.0])
def test_blends_in_bounded_memory(spark, peaks, words):
    (q, base), (e, corpus) = vectors(spark, 3000, 1, "base_id"), vectors(spark, 4000, 2, "event_id")
    got = retrieval.blended(base, corpus, 3, 0.1, (0.6, words, 0.15)).where("base_id < 40").orderBy("base_id", "rank").collect()
    assert max(peaks) < 100
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = unit(q[:40]) @ unit(e).T
    at, to = np.arange(40)[:, None], np.arange(4000)[None]
    score = np.where(sim >= 0.1, 0.6 * sim + words * (at % 5 == to % 5) + 0.15 * (at % 3 == to % 3), -9).round(9)
    for k in range(40):
        assert [r["event_id"] for r in got if r["base_id"] == k] == np.lexsort((to[0], -score[k]))[:3].tolist()


def test_nearest_in_bounded_memory(spark, peaks):
    (q, base), (e, corpus) = vectors(spark, 3000, 1, "base_id"), vectors(spark, 4000, 2, "event_id")
    got = retrieval.nearest(base, corpus, 5, (0.9, 0.5), 4).where("base_id < 40").orderBy("base_id", "rank").collect()
    assert max(peaks) < 100
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = (unit(q[:40]) @ unit(e).T).round(9)
    for k in range(40):
        tau = 0.9 if (sim[k] >= 0.9).sum() >= 4 else 0.5
        best = [j for j in np.lexsort((np.arange(4000), -sim[k]))[:5].tolist() if sim[k, j] >= tau]
        assert [(r["event_id"], r["tau"]) for r in got if r["base_id"] == k] == [(j, tau) for j in best]


def test_events_without_a_type_come_last(spark):
    """h is null where either type is: SQL ranks these rows after all others."""
    day = datetime.date(2000, 1, 1)
    base = spark.createDataFrame([(1, datetime.date(2001, 1, 1), [1.0, 0.0], 1, []), (2, datetime.date(2001, 1, 1), [1.0, 0.0], None, [])], "base_id long, d date, emb array<double>, kind long, bag array<string>")
    corpus = spark.createDataFrame([(5, day, [1.0, 0.0], None, []), (6, day, [1.0, 1.0], 2, []), (7, day, [1.0, 1.0], 1, [])], "event_id long, d date, emb array<double>, kind long, bag array<string>")
    got = [(r["base_id"], r["event_id"], r["score"] is None) for r in retrieval.blended(base, corpus, 3, 0.1, (0.6, 0.0, 0.4), untyped=True).orderBy("base_id", "rank").collect()]
    assert got == [(1, 7, False), (1, 6, False), (1, 5, True), (2, 5, True), (2, 6, True), (2, 7, True)]


def test_firth_reads_its_rows_once(spark):
    """The steps read written rows, not the plan behind them, and come to what plain steps come to."""
    r = np.random.default_rng(3)
    x = np.column_stack([r.standard_normal((60, 2)), np.ones(60)])
    y = (x[:, 0] + r.standard_normal(60) > 0.8).astype(int)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b, _), c in zip(x, y, strict=True)], "a double, b double, y int").mapInArrow(counted, "a double, b double, y int")
    got = {r["term"]: (r["coef"], r["se"]) for r in statistics.firth(df, ["a", "b"], "y").collect()}
    assert seen.value == 60
    beta = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        w = p * (1 - p)
        inverse = np.linalg.inv(x.T @ (x * w[:, None]))
        hat = w * np.einsum("ij,jk,ik->i", x, inverse, x)
        beta = beta + inverse @ (x.T @ (y - p + hat * (0.5 - p)))
    want = dict(zip(("a", "b", "intercept"), zip(beta, np.sqrt(np.diag(inverse)), strict=True), strict=True))
    assert all(np.allclose(got[t], want[t], atol=1e-5) for t in want)


def test_peaks_are_those_of_modes(spark):
    r = np.random.default_rng(6)
    grids = [np.round(r.random(30), 1) for _ in range(200)] + [np.zeros(9), np.ones(9), np.arange(9.0), np.array([0, 1, 1, 0, 0.95, 0, 1.0]), np.array([0.0, 1, 0.95, 1, 0])]
    df = spark.createDataFrame([(k, [float(i) for i in range(len(d))], d.astype(float).tolist()) for k, d in enumerate(grids)], "k int, xs array<double>, ds array<double>")
    want = {r["k"]: r["n_peaks"] for r in forecast.modes(df).select("k", "n_peaks").collect()}
    assert {k: forecast.prominent(d) for k, d in enumerate(grids)} == want


def test_grids_stay_in_the_task(spark):
    """A cone has a mixture for every query, leg and day: no grid of theirs leaves the batch that sums it."""
    parts = spark.createDataFrame([(1, 0.0, 1.0, 1.0)], "key long, mu double, sigma double, w double")
    plan = forecast.quantiles_of_parts(parts, "key")._jdf.queryExecution().analyzed().toString()
    assert "ds#" not in plan and "xs#" not in plan


def odd_events(spark):
    r = np.random.default_rng(9)
    rows = [(int(k), datetime.date(1969, 11, 1) + datetime.timedelta(days=int(r.integers(0, 90))), r.standard_normal(4).tolist(), "FOP"[int(r.integers(0, 3))], int(r.integers(0, 2)), sorted(set(r.choice(list("abcdefg"), int(r.integers(0, 4))).tolist()))) for k in range(120)]
    rows[3] = (3, rows[3][1], None, "F", 1, ["a"])
    rows[4] = (4, rows[4][1], rows[5][2], None, 1, [])
    rows[6] = (6, None, rows[5][2], "F", 1, [])
    return rows, spark.createDataFrame(rows, "event_id long, d date, emb array<double>, polarity string, event_type int, bag array<string>").repartition(3)


def plain_distance(a, b, words):
    if a[2] is None or b[2] is None or a[3] is None or b[3] is None:
        return None
    x, y, s, t = np.array(a[2]), np.array(b[2]), set(a[5]), set(b[5])
    jaccard = len(s & t) / len(s | t) if s | t else 1.0
    return 0.5 * (1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) / 2 + words * (1 - jaccard) + 0.1 * (a[3] != b[3]) + 0.2 * (a[4] != b[4])


@pytest.mark.parametrize(("held", "cells"), [(2000, 1 << 21), (3, 7)])
def test_near_pairs(spark, monkeypatch, held, cells):
    monkeypatch.setattr(nearby, "HELD", held)
    monkeypatch.setattr(nearby, "CELLS", cells)
    rows, events = odd_events(spark)
    got = {(r["a"], r["b"]): r["dist"] for r in nearby.pairs(events, 7, 0.5, 0.2, {"polarity": 0.1, "event_type": 0.2}).collect()}
    want = {(a[0], b[0]): plain_distance(a, b, 0.2) for a in rows for b in rows if a[0] < b[0] and a[1] and b[1] and abs((a[1] - b[1]).days) <= 7}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (w is None) and (w is None or abs(got[k] - w) < 1e-12) for k, w in want.items())


def test_local_clusters(spark):
    rows, events = odd_events(spark)
    events = events.where("emb is not null and polarity is not null")
    rows = [r for r in rows if r[2] is not None and r[3] is not None]
    got = {r["event_id"]: (r["size"], round(r["cohesion"], 9), r["role"]) for r in nearby.local_clusters(events, 7, 0.5, {"polarity": 0.1, "event_type": 0.2}).collect()}
    assert got[6] == (1, 1.0, "NOVEL") and len(got) == len(rows)
    for e in rows:
        if e[1] is None:
            continue
        w = [x for x in rows if x[1] and abs((x[1] - e[1]).days) <= 7]
        d = np.array([[0 if a is b else plain_distance(a, b, 0) if abs((a[1] - b[1]).days) <= 7 else 1 for b in w] for a in w], float)
        labels, me = statistics.density_clusters(d, 3), w.index(e)
        mine = np.flatnonzero(labels == labels[me]) if labels[me] >= 0 else np.array([me])
        upper = d[np.ix_(mine, mine)][np.triu_indices(len(mine), 1)]
        assert got[e[0]][:2] == (len(mine), round(float(1 - upper.mean()), 9) if len(upper) else 1.0)


def test_no_joins_of_pairs(spark):
    """Neither the clusters nor the distances join pairs, whose number is the square of the events of a week."""
    for name in ("hdbscan_local", "full_fused_distance"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
        assert "gap" not in plan and "__bucket" not in plan and "zip_with" not in plan


@pytest.mark.parametrize(("block", "at_once"), [(2000, 1 << 18), (2, 3)])
def test_word_distances_are_counted_in_tasks(spark, tmp_path, monkeypatch, block, at_once):
    monkeypatch.setattr(measures, "BLOCK", block)
    monkeypatch.setattr(measures, "AT_ONCE", at_once)
    texts = {0: "alpha bravo charlie alpha", 50: None, 100: "", 150: "alpha zulus", 7: "bravo charlie delta", 8: "xx yy", 9: "Alpha"}
    spark.createDataFrame([*texts.items(), (None, "alpha")], "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    df = measures.jaccard_distances(spark, str(tmp_path))
    bags = {k: {w for w in (t or "").lower().split() if len(w) >= 5} for k, t in texts.items()}
    want = {(a, b): round(1 - len(bags[a] & bags[b]) / len(bags[a] | bags[b]), 6) if bags[a] | bags[b] else 1.0 for a in texts if a % 50 == 0 for b in texts if a != b}
    assert {(r["a"], r["b"]): r["dist"] for r in df.collect()} == want
    assert "array_union" not in df._jdf.queryExecution().analyzed().toString()
