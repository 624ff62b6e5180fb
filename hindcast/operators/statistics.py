"""Statistics on forecasts, and the few algorithms that are sequential inside a bounded group."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.numbers import normal_cdf
from hindcast.sources.shared import checkpointed

#: Stretches of an order that are numbered or summed side by side.
STRETCHES = 200


def stretched(df: DataFrame, first: str) -> DataFrame:
    """df with __at, the stretch of the order by `first` that a row is in: between approximate quantiles, which are a bounded list."""
    v = (F.unix_date(first) if df.schema[first].dataType.typeName() == "date" else F.col(first)).cast("double")
    cuts = df.agg(F.percentile_approx(v, F.array(*(F.lit(k / STRETCHES) for k in range(1, STRETCHES))))).first()[0]
    cuts = sorted(set(cuts or []))

    def below(low: int, high: int) -> Column:
        """How many cuts are below v, of which `low` are known to be and the rest from `high` on are not: a search by halves."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(v <= cuts[mid], below(low, mid)).otherwise(below(mid + 1, high))

    return df.withColumn("__at", F.when(v.isNull(), 0).otherwise(below(0, len(cuts))))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with k, the place of each row in the order, from 1; each stretch is sorted in a task of its own."""
    df = stretched(df, order[0])
    n = df.groupBy("__at").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__at").orderBy(*order))
    return df.withColumn("__k", place).join(F.broadcast(n.select("__at", before.alias("__before"))), "__at").withColumn("k", F.col("__before") + F.col("__k")).drop("__at", "__k", "__before")


def running(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """df with sum, the running sum of a value in the order, and peak, the largest so far, 0 at least."""
    df = stretched(df, order[0])
    within = Window.partitionBy("__at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__s", F.sum(value).over(within)).withColumn("__p", F.max("__s").over(within))
    so_far = Window.partitionBy(F.lit(0)).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    each = df.groupBy("__at").agg(F.sum(value).alias("__t"), F.max("__p").alias("__m")).withColumn("__base", F.coalesce(F.sum("__t").over(so_far), F.lit(0.0)))
    each = each.withColumn("__high", F.greatest(F.coalesce(F.max(F.col("__base") + F.col("__m")).over(so_far), F.lit(0.0)), F.lit(0.0))).select("__at", "__base", "__high")
    out = df.join(F.broadcast(each), "__at").withColumns({"sum": F.col("__base") + F.col("__s"), "peak": F.greatest("__high", F.col("__base") + F.col("__p"))})
    return out.drop("__at", "__s", "__p", "__base", "__high")


def auc(df: DataFrame) -> DataFrame:
    """(auc, n, positives) of a score x for outcomes y: counts per distinct score first, so ties share their mean rank."""
    c = df.groupBy("x").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("rk", before + (F.col("m") + 1) / 2)
    s = c.agg(F.sum(F.col("rk") * F.col("p")).alias("r"), F.sum("p").alias("positives"), F.sum("m").alias("n"))
    p, n = F.col("positives"), F.col("n")
    return s.select(F.round((F.col("r") - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0)), 6).alias("auc"), "n", "positives")


def youden(df: DataFrame) -> DataFrame:
    """(threshold, j): where the true positive rate less the false positive rate is largest, the highest of equals."""
    c = df.groupBy("x").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    down = Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.join(F.broadcast(c.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))))
    # without ones or without zeros a rate is 0 / 0, not a number, as in SQL; then the highest score stands
    share = lambda part, whole: F.when(F.col(whole) > 0, F.sum(part).over(down) / F.nullif(F.col(whole), F.lit(0))).otherwise(F.lit(float("nan")))
    j = share("p", "np") - share("q", "nq")
    return c.select(F.col("x").alias("threshold"), j.alias("j")).orderBy(F.desc("j"), F.desc("threshold")).limit(1)


def firth(df: DataFrame, features: list[str], y: str, rounds: int = 50, tol: float = 1e-6) -> DataFrame:
    """(term, coef, se) of a logistic regression with Firth's penalty, for separated outcomes.

    The rows are written once. Each Newton step is one pass over them: Spark sums the information, the score, and the third
    moments that the penalty is made of, so only sums by columns come back. Rows with a null don't count.
    """
    names = [*features, "intercept"]
    x = F.array(*(F.col(f).cast("double") for f in features), F.lit(1.0))
    rows = checkpointed(df.select(x.alias("x"), F.col(y).cast("double").alias("y")))
    k, beta = len(names), np.zeros(len(names))
    at = lambda n: F.col("x")[n]
    pairs, triples = ([*itertools.combinations_with_replacement(range(k), n)] for n in (2, 3))
    for _ in range(rounds):
        eta = sum((float(beta[n]) * at(n) for n in range(1, k)), float(beta[0]) * at(0))
        each = rows.withColumn("p", 1 / (1 + F.exp(-eta))).withColumn("w", F.col("p") * (1 - F.col("p")))
        info = [F.sum(F.col("w") * at(a) * at(b)) for a, b in pairs]
        bent = [F.sum(F.col("w") * (0.5 - F.col("p")) * at(a) * at(b) * at(c)) for a, b, c in triples]
        score = [F.sum((F.col("y") - F.col("p")) * at(a)) for a in range(k)]
        sums = iter(each.agg(*(c.alias(f"s{n}") for n, c in enumerate(info + bent + score))).first())
        info, bent = ({key: next(sums) for key in keys} for keys in (pairs, triples))
        inverse = np.linalg.inv(np.array([[info[min(a, b), max(a, b)] for b in range(k)] for a in range(k)]))
        # a row's leverage is w x' inverse x: summed with (0.5 - p) x, the third moments times the inverse
        penalty = [sum(inverse[b, c] * bent[tuple(sorted((a, b, c)))] for b in range(k) for c in range(k)) for a in range(k)]
        step = inverse @ (np.array(list(sums)) + penalty)
        beta = beta + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < tol:
            break
    se = np.sqrt(np.diag(inverse))
    return df.sparkSession.createDataFrame([(n, float(b), float(s)) for n, b, s in zip(names, beta, se, strict=True)], "term string, coef double, se double")


def fit_garch(r: np.ndarray) -> tuple[float, float, float, float]:
    """(omega, alpha, beta, next variance) of a GARCH(1,1) by a grid that is refined, with the variance targeted."""
    r = r - r.mean()
    v = r.var()

    def loss(a: float, b: float) -> tuple[float, float]:
        h, total, w = v, 0.0, v * (1 - a - b)
        for x in r:
            total += np.log(h) + x * x / h
            h = w + a * x * x + b * h
        return total, h

    best = (np.inf, 0.05, 0.9, v)
    span_a, span_b, centre = 0.3, 0.5, (0.15, 0.6)
    for _ in range(4):
        for a in np.linspace(max(0.001, centre[0] - span_a / 2), centre[0] + span_a / 2, 6):
            for b in np.linspace(max(0.0, centre[1] - span_b / 2), centre[1] + span_b / 2, 6):
                if a + b < 0.999:
                    value, h = loss(a, b)
                    if value < best[0]:
                        best = (value, a, b, h)
        centre, span_a, span_b = best[1:3], span_a / 3, span_b / 3
    _, a, b, h = best
    return v * (1 - a - b), a, b, h


def garch(series: DataFrame, key: str, days: int = 400, horizon: int = 15) -> DataFrame:
    """(key, n, omega, alpha, beta, sigma_h) of the last `days` percent returns of each series; null parameters below 100."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        px = pdf.sort_values("d")["px"].to_numpy(float)[-days - 1 :]
        r = 100 * (px[1:] / px[:-1] - 1)
        out = (None,) * 4 if len(r) < 100 or r.var() == 0 else fit_garch(r)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(r)], "omega": [out[0]], "alpha": [out[1]], "beta": [out[2]], "sigma_h": [None if out[3] is None else float(np.sqrt(out[3] * horizon))]}).astype({"omega": float, "alpha": float, "beta": float, "sigma_h": float})

    kind = series.schema[key].dataType.simpleString()
    # only the last days of a series are needed, so a group is bounded
    last = series.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("d")))).where(f"__k <= {days + 1}").drop("__k")
    return last.groupBy(key).applyInPandas(fit, f"{key} {kind}, n long, omega double, alpha double, beta double, sigma_h double")


def kelly_backtest(forecasts: DataFrame, book: str, cooldown: int = 15, band: float = 0.5) -> DataFrame:
    """Trades of each book in order of day: stake by expanding quarter Kelly and conviction, no trade within the cooldown.

    Sequential inside a book; books run side by side.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, past, last, equity = [], [], None, 1.0
        for x in pdf.sort_values(["d", "base_id"]).itertuples():
            if abs(x.median) <= band or (last is not None and (x.d - last).days < cooldown):
                continue
            half = max((x.p95 - x.p5) / 2, 1e-9)
            conviction = min(abs(x.median) / half, 1.0)
            stake = 0.02
            if len(past) >= 20:
                wins, losses = [p for p in past if p > 0], [-p for p in past if p <= 0]
                if wins and losses:
                    odds, rate = np.mean(wins) / max(np.mean(losses), 1e-9), len(wins) / len(past)
                    stake = min(max(0.25 * (rate - (1 - rate) / odds), 0.0), 0.25)
            stake *= conviction * max(0.3, 1 - x.p_down10)
            pnl = float(np.sign(x.median) * x.realised / 100)
            past.append(pnl)
            last, equity = x.d, equity * max(1 + stake * pnl, 0.0)
            rows.append((getattr(x, book), x.base_id, x.d, float(np.sign(x.median)), float(stake), pnl, equity))
        return pd.DataFrame(rows, columns=[book, "base_id", "d", "side", "stake", "pnl", "equity"])

    return forecasts.groupBy(book).applyInPandas(run, f"{book} string, base_id long, d date, side double, stake double, pnl double, equity double")


def density_clusters(d: np.ndarray, least: int) -> np.ndarray:
    """Labels of density clusters of a distance matrix, -1 for noise: single linkage, condensed to clusters of at least
    `least` points, chosen by excess of mass; one cluster of everything is allowed."""
    return density_tree(d, least)[0]


def density_tree(d: np.ndarray, least: int, leaves: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(labels, reach) as in density_clusters(), or with `leaves` of the clusters that split no further; reach is the
    distance at which each cluster parted from its sibling, infinite for one cluster of everything."""
    n = len(d)
    if n < least:
        return np.full(n, -1), np.zeros(0)
    if n == 1:
        return np.zeros(1, int), np.full(1, np.inf)
    # minimum spanning tree
    near, frm, inside, edges = d[0].copy(), np.zeros(n, int), np.zeros(n, bool), []
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, near).argmin())
        edges.append((near[j], int(frm[j]), j))
        inside[j] = True
        closer = d[j] < near
        near[closer], frm[closer] = d[j][closer], j
    edges.sort()
    parent, members, tree = list(range(n)), {k: [k] for k in range(n)}, {}

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    made, top = {k: k for k in range(n)}, n
    for w, a, b in edges:
        a, b = root(a), root(b)
        tree[top] = (w, made[a], made[b])
        members[top] = members[made[a]] + members[made[b]]
        parent[b], made[a] = a, top
        top += 1
    birth, mass, children, todo = {top - 1: 0.0}, {top - 1: 0.0}, {top - 1: []}, [(top - 1, top - 1)]
    while todo:
        node, cluster = todo.pop()
        w, a, b = tree[node]
        density = 1 / max(w, 1e-12)
        big = [x for x in (a, b) if len(members[x]) >= least]
        for x in (a, b):
            if x not in big:
                mass[cluster] += len(members[x]) * (density - birth[cluster])
        if len(big) == 2:
            for x in big:
                mass[cluster] += len(members[x]) * (density - birth[cluster])
                birth[x], mass[x], children[x] = density, 0.0, []
                children[cluster].append(x)
                if x in tree:
                    todo.append((x, x))
        elif big and big[0] in tree:
            todo.append((big[0], cluster))
        elif big:
            mass[cluster] += len(members[big[0]]) * (density - birth[cluster])
    labels, chosen = np.full(n, -1), []

    def best(c: int) -> tuple[float, list[int]]:
        below = [best(x) for x in children[c]]
        total = sum(m for m, _ in below)
        return (mass[c], [c]) if not below or mass[c] >= total else (total, [x for _, xs in below for x in xs])

    chosen = sorted([c for c in children if not children[c]] if leaves else best(top - 1)[1], key=lambda c: min(members[c]))
    for k, c in enumerate(chosen):
        labels[members[c]] = k
    return labels, np.array([1 / birth[c] if birth[c] else np.inf for c in chosen])


def signed_ranks(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, n, w_plus, w_minus, z, p): Wilcoxon's test of the paired values of each key, in the normal approximation.

    Equal pairs don't count, equal differences share their mean rank, for which the variance is corrected. z and p are null
    where no pair differs. A key's pairs are ranked in one task, so a key should be a stated, bounded set.
    """
    d = pairs.where(F.col(a) != F.col(b)).select(key, (F.col(a) - F.col(b)).alias("__d")).withColumn("__x", F.abs("__d"))
    d = d.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy("__x")))
    tied = Window.partitionBy(key, "__x")
    d = d.withColumns({"__r": F.avg("__k").over(tied), "__t": F.count(F.lit(1)).over(tied)})
    n, up = F.count(F.lit(1)), F.sum(F.when(F.col("__d") > 0, F.col("__r")).otherwise(0.0))
    # every member of a tie of t adds t^2 - 1, all of them t^3 - t
    s = d.groupBy(key).agg(n.alias("n"), up.alias("w_plus"), F.sum(F.when(F.col("__d") < 0, F.col("__r")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("__t") * F.col("__t") - 1).alias("__ties"))
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("__ties") / 48.0
    z = (F.col("w_plus") - F.col("n") * (F.col("n") + 1) / 4.0) / F.sqrt(F.nullif(var, F.lit(0.0)))
    return s.withColumn("z", z).withColumn("p", 2 * (1 - normal_cdf(F.abs("z")))).select(key, "n", "w_plus", "w_minus", "z", "p")


def roc(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, p, q, tp, fp, np, nq) of each distinct score x: the ones and zeros at it, at it or above it, and in all.

    df is (by, x, y) with few values of `by`. Scores are counted first, then summed in stretches between approximate
    quantiles, so no task orders all of them.
    """
    c = stretched(df.where("x is not null and y is not null"), "x").groupBy(*by, "__at", "x").agg(F.sum("y").alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    sums = c.groupBy(*by, "__at").agg(F.sum("p").alias("__p"), F.sum("q").alias("__q"))
    above = Window.partitionBy(*by).orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    none = lambda x: F.coalesce(x, F.lit(0))
    sums = sums.select(*by, "__at", none(F.sum("__p").over(above)).alias("__pa"), none(F.sum("__q").over(above)).alias("__qa"), F.sum("__p").over(every).alias("np"), F.sum("__q").over(every).alias("nq"))
    down = Window.partitionBy(*by, "__at").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    both = c.join(F.broadcast(sums), [*by, "__at"])
    return both.select(*by, "x", "p", "q", (F.col("__pa") + F.sum("p").over(down)).alias("tp"), (F.col("__qa") + F.sum("q").over(down)).alias("fp"), "np", "nq")


def auc_by(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc) from roc(): the chance that a one has the higher score, ties count a half; null without ones or zeros."""
    won = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2))
    return curve.groupBy(*by).agg((won / F.nullif(F.first("np") * F.first("nq"), F.lit(0))).alias("auc"))


def best_cut(curve: DataFrame, by: list[str], undecided: bool = False) -> DataFrame:
    """(by, threshold, j) from roc(): the highest score whose share of ones less that of zeros, at it or above, is largest.

    Without ones or without zeros there is no j: no row, or with `undecided` the highest score and a null.
    """
    j = F.col("tp") / F.nullif("np", F.lit(0)) - F.col("fp") / F.nullif("nq", F.lit(0))
    best = F.max(F.struct(j.alias("j"), F.col("x").alias("threshold"))).alias("b")
    return (curve if undecided else curve.where("np > 0 and nq > 0")).groupBy(*by).agg(best).select(*by, "b.threshold", "b.j")


def folded(df: DataFrame, key: str, y: str, folds: int, seed: int) -> DataFrame:
    """df with fold, 1 to folds: rows of each outcome are dealt out in turn in the order of a hash of seed and key, so every
    fold has the same share of ones, whatever the partitions. Null outcomes are left out; a column named k goes."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    df = df.withColumn("__h", h)
    parts = [numbered(df.where(F.col(y) == v), ["__h", key]).withColumn("fold", ((F.col("k") - 1) % folds + 1).cast("int")) for v in (0, 1)]
    return parts[0].unionByName(parts[1]).drop("__h", "k", "__at", "__n")
