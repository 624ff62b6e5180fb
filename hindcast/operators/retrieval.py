"""Retrieval of analogues: similarity of every query vector with every corpus vector, in blocks.

The queries' unit vectors are broadcast in blocks and multiplied with each batch of the corpus in tiles of a fixed number of
cells. A task keeps the best k of each query or counts per threshold, so what is shuffled is bounded by queries, not by pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.sources.shared import checkpointed

#: Query vectors that are multiplied at once; more of them take several passes over the corpus.
BLOCK = 20_000
#: Pairs that are worked on at once.
PAIRS = 1 << 17


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    m = flat.reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _rows(column) -> np.ndarray:
    """Arrays of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _days(column) -> np.ndarray:
    return column.cast(pa.int32()).to_numpy(zero_copy_only=False)


def _blocks(base: DataFrame, *more: str):
    """The queries as (ids, days, vectors) and the columns `more`, in blocks; vectors of one length, without nulls."""
    known = checkpointed(base.where(" and ".join(f"{c} is not null" for c in ("base_id", "d", "emb", *more))).select("base_id", "d", "emb", *more))
    passes = max(1, -(-known.count() // BLOCK))
    for n in range(passes):
        t = (known.where(F.pmod(F.xxhash64("base_id"), F.lit(passes)) == n) if passes > 1 else known).toArrow()
        if t.num_rows:
            yield t["base_id"].to_numpy(), _days(t["d"]), _matrix(t["emb"]), *(t[c].combine_chunks() for c in more)


#: Similarities that are held at once, candidates that wait until they are ranked, and files of a corpus, whose readers each
#: send the best k of every query.
CELLS, WAITING, FILES = 1 << 21, 1 << 18, 24


def _corpus(corpus: DataFrame, *more: str) -> DataFrame:
    """The corpus (event_id, d, emb and the columns `more`), written once for all blocks of queries, in a bounded number of files."""
    known = corpus.where("event_id is not null and d is not null and emb is not null").select("event_id", "d", "emb", *more)
    return checkpointed(known.repartition(max(FILES, corpus.sparkSession.sparkContext.defaultParallelism)))


class _Best:
    """The best k of each of n queries so far: by falling score, then the smaller event_id. New ones wait until they are many."""

    def __init__(self, n: int, k: int):
        self.k, self.last, self.new, self.waiting = k, np.full(n, -np.inf), [], 0

    def add(self, q: np.ndarray, score: np.ndarray, events: np.ndarray, *more: np.ndarray) -> None:
        self.new.append((q, score, events, *more))
        self.waiting += len(q)
        if self.waiting > WAITING:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """The best as columns (q, score, events, more); last is the score of the k-th, minus infinity with fewer."""
        if self.new:
            q, score, events, *more = (np.concatenate(x) for x in zip(*self.new, strict=True))
            order = np.lexsort((events, -score, q))
            columns = [x[order] for x in (q, score, events, *more)]
            place = np.arange(len(q)) - np.searchsorted(columns[0], columns[0])
            columns = tuple(x[place < self.k] for x in columns)
            full = place == self.k - 1
            self.last[q[order][full]] = score[order][full]
            self.new, self.waiting = [columns], 0
        return self.new[0] if self.new else (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))


def _near(days: np.ndarray, small: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, floor, earlier: bool):
    """(q, c, sim, margin) of queries and the events of a batch, tile by tile: all pairs of a similarity of floor(queries) or
    more, but with k perhaps not those that k others of the batch exceed for certain.

    Similarities are in single precision; margin is wider than their error, and what passes includes it.
    """
    margin = 2.0**-22 * (least.shape[1] + 8)
    tall = max(1, CELLS // len(least))
    for first in range(0, len(small), tall):
        rows = slice(first, first + tall)
        sims = small[rows] @ least.T
        if earlier and own.max() >= days[rows].min():
            sims[own[None] >= days[rows, None]] = -np.inf
        hit = sims >= np.maximum(floor(rows) - margin, -2).astype(np.float32)[:, None]
        if k and len(least) > k and np.count_nonzero(hit) > 4 * k * len(sims):
            hit &= sims >= (np.partition(sims, len(least) - k, 1)[:, len(least) - k] - 2 * margin).astype(np.float32)[:, None]
        at = np.flatnonzero(hit)
        for j in range(0, len(at), PAIRS):
            q, c = np.divmod(at[j : j + PAIRS], len(least))
            yield q + first, c, sims[q, c], margin


def _products(vectors: np.ndarray, m: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Similarities pair by pair in double precision: equal vectors are equally similar wherever they stand."""
    out = np.zeros(len(q))
    for j in range(0, len(q), PAIRS // 8):
        part = slice(j, j + PAIRS // 8)
        out[part] = np.einsum("ij,ij->i", vectors[q[part]], m[c[part]])
    return out


def nearest(base: DataFrame, corpus: DataFrame, k: int, ladder: Sequence[float], k_min: int, earlier: bool = True) -> DataFrame:
    """(base_id, tau, rank, event_id, sim): the k most similar corpus events of each query at the query's own threshold.

    tau is the first rung of the falling ladder that k_min events reach, else the last. base has (base_id, d, emb), corpus
    (event_id, d, emb); with `earlier` only events before the query's day count. Ties go to the smaller event_id. Whether
    k_min events reach a rung is known from the best k_min, so nothing else is counted.
    """
    rungs, out, kept, written = list(ladder), None, max(k, k_min), None
    for ids, days, vectors in _blocks(base):
        written = written if written is not None else _corpus(corpus)
        shared = base.sparkSession.sparkContext.broadcast((ids, days, vectors))

        def run(batches, shared=shared):
            ids, days, vectors = shared.value
            best, small = _Best(len(ids), kept), vectors.astype(np.float32)
            for batch in batches:
                if batch.num_rows:
                    events, m = batch.column(0).to_numpy(), _matrix(batch.column(2))
                    for q, c, _, _ in _near(days, small, _days(batch.column(1)), m.astype(np.float32), kept, lambda rows: best.last[rows], earlier):
                        s = _products(vectors, m, q, c)
                        on = s >= best.last[q]
                        best.add(q[on], s[on], events[c[on]])
            q, s, e = best.settle()
            for j in range(0, len(q), PAIRS):
                part = slice(j, j + PAIRS)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[part]]), pa.array(e[part], pa.int64()), pa.array(s[part])], names=["base_id", "event_id", "sim"])

        found = written.mapInArrow(run, "base_id long, event_id long, sim double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return base.sparkSession.createDataFrame([], "base_id long, tau double, rank int, event_id long, sim double")
    # sort_array's order is ascending: the most similar first, then the smaller id
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "event_id"))), 1, kept).alias("top")
    per_base = out.groupBy("base_id").agg(top)
    far = F.get("top", F.lit(k_min - 1))["far"]
    tau = F.coalesce(*(F.when(-far >= t, F.lit(float(t))) for t in rungs), F.lit(float(rungs[-1])))
    ranked = per_base.select("base_id", tau.alias("tau"), F.posexplode(F.slice("top", 1, k)).alias("pos", "x"))
    return ranked.select("base_id", "tau", (F.col("pos") + 1).alias("rank"), "x.event_id", (-F.col("x.far")).alias("sim")).where("sim >= tau")


def nearest_by(base: DataFrame, corpus: DataFrame, stratum: str, k: int, earlier: bool = True) -> DataFrame:
    """(base_id, stratum, event_id, sim): the k most similar corpus events of each query in each stratum, in one pass.

    stratum is a whole-number column of the corpus, such as an era; a task keeps k of each query and stratum that it meets.
    """
    out = None
    for ids, days, vectors in _blocks(base):
        shared = base.sparkSession.sparkContext.broadcast((ids, days, vectors))

        def run(batches, shared=shared):
            ids, days, vectors = shared.value
            held: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                events, sims, strata = batch.column(0).to_numpy(), vectors @ _matrix(batch.column(2)).T, batch.column(3).to_numpy()
                if earlier:
                    sims[_days(batch.column(1))[None] >= days[:, None]] = -np.inf
                for which in np.unique(strata).tolist():
                    own = strata == which
                    part = sims[:, own]
                    if part.shape[1] > k:
                        part = np.where(part >= np.partition(part, part.shape[1] - k, 1)[:, -k:].min(1)[:, None], part, -np.inf)
                    at, column = np.nonzero(np.isfinite(part))
                    new = (at, part[at, column], events[own][column])
                    q, s, e = (np.concatenate(x) for x in zip(held[which], new, strict=True)) if which in held else new
                    order = np.lexsort((e, -s, q))
                    q, s, e = q[order], s[order], e[order]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < k
                    held[which] = q[best], s[best], e[best]
            for which, (q, s, e) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(np.full(len(q), which)), pa.array(e, pa.int64()), pa.array(s)], names=["base_id", stratum, "event_id", "sim"])

        known = corpus.where(f"event_id is not null and d is not null and emb is not null and {stratum} is not null")
        found = known.select("event_id", "d", "emb", F.col(stratum).cast("long")).mapInArrow(run, f"base_id long, {stratum} long, event_id long, sim double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return base.sparkSession.createDataFrame([], f"base_id long, {stratum} long, event_id long, sim double")
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "event_id"))), 1, k)
    return out.groupBy("base_id", stratum).agg(top.alias("top")).withColumn("x", F.explode("top")).select("base_id", stratum, "x.event_id", (-F.col("x.far")).alias("sim"))


def above(base: DataFrame, corpus: DataFrame, tau: float, earlier: bool = True) -> DataFrame:
    """(base_id, event_id, sim): all pairs of a similarity of tau or more."""
    out = None
    for ids, days, vectors in _blocks(base):
        shared = base.sparkSession.sparkContext.broadcast((ids, days, vectors))

        def run(batches, shared=shared):
            ids, days, vectors = shared.value
            for batch in batches:
                if batch.num_rows:
                    sims = vectors @ _matrix(batch.column(2)).T
                    hit = sims >= tau
                    if earlier:
                        hit &= _days(batch.column(1))[None] < days[:, None]
                    q, e = np.nonzero(hit)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(batch.column(0).to_numpy()[e]), pa.array(sims[q, e])], names=["base_id", "event_id", "sim"])

        found = corpus.where("event_id is not null and d is not null and emb is not null").select("event_id", "d", "emb").mapInArrow(run, "base_id long, event_id long, sim double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else base.sparkSession.createDataFrame([], "base_id long, event_id long, sim double")


def reached(base: DataFrame, corpus: DataFrame, ladder: Sequence[float], k_min: int, earlier: bool = True) -> DataFrame:
    """(base_id, tau, n_candidates) of every query: the first rung of the falling ladder that k_min corpus events reach, else
    the last, and how many reach it. Only counts per task are shuffled. Other columns are as in nearest()."""
    rungs, out = list(ladder), None
    for block in _blocks(base):
        shared = base.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            ids, days, vectors = shared.value
            counts = np.zeros((len(rungs), len(ids)), np.int64)
            for batch in batches:
                if batch.num_rows:
                    sims = vectors @ _matrix(batch.column(2)).T
                    if earlier:
                        sims[_days(batch.column(1))[None] >= days[:, None]] = -np.inf
                    counts += np.stack([(sims >= tau).sum(1) for tau in rungs])
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c) for c in counts)], names=["base_id", *(f"n{r}" for r in range(len(rungs)))])

        found = corpus.where("event_id is not null and d is not null and emb is not null").select("event_id", "d", "emb").mapInArrow(run, "base_id long, " + ", ".join(f"n{r} long" for r in range(len(rungs))))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return base.sparkSession.createDataFrame([], "base_id long, tau double, n_candidates long")
    sums = out.groupBy("base_id").agg(*(F.sum(f"n{r}").alias(f"n{r}") for r in range(len(rungs))))
    last = len(rungs) - 1
    first = F.coalesce(*(F.when(F.col(f"n{r}") >= k_min, F.struct(F.lit(float(t)).alias("tau"), F.col(f"n{r}").alias("n"))) for r, t in enumerate(rungs)), F.struct(F.lit(float(rungs[last])).alias("tau"), F.col(f"n{last}").alias("n")))
    return sums.withColumn("x", first).select("base_id", "x.tau", F.col("x.n").alias("n_candidates"))


def strata(base: DataFrame, corpus: DataFrame, earlier: bool = True) -> DataFrame:
    """(base_id, stratum, n): of the corpus events as similar to a query as its own tau or more, how many are in each stratum.

    base is (base_id, d, emb, tau), corpus (event_id, d, emb, stratum), a text of few values. Only counts are shuffled.
    """
    out = None
    for ids, days, vectors, taus in _blocks(base, "tau"):
        shared = base.sparkSession.sparkContext.broadcast((ids, days, vectors, taus.to_numpy()))

        def run(batches, shared=shared):
            ids, days, vectors, taus = shared.value
            counts: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                near, which = vectors @ _matrix(batch.column(2)).T >= taus[:, None], np.array(batch.column(3).to_pylist())
                if earlier:
                    near &= _days(batch.column(1))[None] < days[:, None]
                for name in set(which):
                    counts[name] = counts.get(name, 0) + near[:, which == name].sum(1)
            for name, n in counts.items():
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([name] * int(some.sum()), pa.string()), pa.array(n[some].astype(np.int64))], names=["base_id", "stratum", "n"])

        known = corpus.where("event_id is not null and d is not null and emb is not null and stratum is not null")
        found = known.select("event_id", "d", "emb", "stratum").mapInArrow(run, "base_id long, stratum string, n long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return base.sparkSession.createDataFrame([], "base_id long, stratum string, n long")
    return out.groupBy("base_id", "stratum").agg(F.sum("n").alias("n"))


def warped(base: DataFrame, corpus: DataFrame, pool: int, band: int | None = 2, earlier: bool = True) -> DataFrame:
    """(base_id, event_id, sim, dtw): of the corpus events as similar to a query as its own tau or more, the `pool` whose paths
    are nearest to its path. Ties go to the smaller event_id.

    base is (base_id, d, emb, tau, path), corpus (event_id, d, emb, path); paths are arrays of one length without nulls, and
    their increments are compared. Every candidate is warped inside the task that reads it, which keeps `pool` of each query.
    """
    out = None
    for ids, days, vectors, taus, paths in _blocks(base, "tau", "path"):
        block = ids, days, vectors, taus.to_numpy(), np.diff(_rows(paths), axis=1)
        shared = base.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            ids, days, vectors, taus, steps = shared.value
            held, last = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)), np.full(len(ids), np.inf)
            for batch in batches:
                if not batch.num_rows:
                    continue
                events, sims = batch.column(0).to_numpy(), vectors @ _matrix(batch.column(2)).T
                near = sims >= taus[:, None]
                if earlier:
                    near &= _days(batch.column(1))[None] < days[:, None]
                own = np.diff(_rows(batch.column(3)), axis=1)
                at, column = np.nonzero(near)
                for k in range(0, len(at), PAIRS):
                    q, c = at[k : k + PAIRS], column[k : k + PAIRS]
                    far = dtw(own[c], steps[q], band)
                    kept = far <= last[q]
                    new = q[kept], events[c[kept]], sims[q[kept], c[kept]], far[kept]
                    q, e, s, far = (np.concatenate(x) for x in zip(held, new, strict=True))
                    order = np.lexsort((e, far, q))
                    q, e, s, far = q[order], e[order], s[order], far[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    last[q[place == pool - 1]] = far[place == pool - 1]
                    held = tuple(x[place < pool] for x in (q, e, s, far))
            q, e, s, far = held
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(e), pa.array(s), pa.array(far)], names=["base_id", "event_id", "sim", "dtw"])

        known = corpus.where("event_id is not null and d is not null and emb is not null and path is not null")
        found = known.select("event_id", "d", "emb", "path").mapInArrow(run, "base_id long, event_id long, sim double, dtw double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return base.sparkSession.createDataFrame([], "base_id long, event_id long, sim double, dtw double")
    place = F.row_number().over(Window.partitionBy("base_id").orderBy("dtw", "event_id"))
    return out.withColumn("__k", place).where(F.col("__k") <= pool).drop("__k")


def faded(base: DataFrame, corpus: DataFrame, k: int, tau: float, fade: float | None = None, earlier: bool = True) -> DataFrame:
    """(base_id, event_id, sim, score): of the corpus events of a similarity of tau or more the k of the highest score.

    score is the similarity, with `fade` times exp(-years / fade) for the calendar years that the event is before the query's
    day. A task keeps k of each query. Ties go to the smaller event_id; columns are as in nearest().
    """
    out = None
    for block in _blocks(base):
        shared = base.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            ids, days, vectors = shared.value
            year = lambda d: d.astype("datetime64[D]").astype("datetime64[Y]").astype(int)
            held = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            for batch in batches:
                if not batch.num_rows:
                    continue
                events, own, sims = batch.column(0).to_numpy(), _days(batch.column(1)), vectors @ _matrix(batch.column(2)).T
                near = sims >= tau
                if earlier:
                    near &= own[None] < days[:, None]
                at, column = np.nonzero(near)
                s = sims[at, column]
                score = s if fade is None else s * np.exp(-np.maximum(year(days)[at] - year(own)[column], 0) / fade)
                q, e, s, score = (np.concatenate(x) for x in zip(held, (at, events[column], s, score), strict=True))
                order = np.lexsort((e, -score, q))
                q, e, s, score = q[order], e[order], s[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                held = q[best], e[best], s[best], score[best]
            q, e, s, score = held
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(e), pa.array(s), pa.array(score)], names=["base_id", "event_id", "sim", "score"])

        found = corpus.where("event_id is not null and d is not null and emb is not null").select("event_id", "d", "emb").mapInArrow(run, "base_id long, event_id long, sim double, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return base.sparkSession.createDataFrame([], "base_id long, event_id long, sim double, score double")
    place = F.row_number().over(Window.partitionBy("base_id").orderBy(F.desc("score"), "event_id"))
    return out.withColumn("__k", place).where(F.col("__k") <= k).drop("__k")


def _words(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of whole numbers as one array, and the length of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _common(starts: np.ndarray, words: np.ndarray, lists: np.ndarray, held: np.ndarray, own: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many of the words `own` each of the queries q has: by the queries' words or by the words' queries, whichever are fewer.

    words are those of all queries, query after query from starts; held the queries of all words, word after word from lists.
    """
    n, m = starts[q + 1] - starts[q], lists[own + 1] - lists[own]
    spread = lambda first, count: np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    if n.sum() > m.sum():
        return np.bincount(held[spread(lists[own], m)], minlength=len(starts) - 1)[q]
    mark = np.zeros(len(lists) - 1, bool)
    mark[own] = True
    so_far = np.concatenate([[0], np.cumsum(mark[words[spread(starts[q], n)]])])
    ends = np.cumsum(n)
    return so_far[ends] - so_far[ends - n]


#: Events that are scored before the queries' k-th scores are taken anew.
ROUND = 1024


def blended(base: DataFrame, corpus: DataFrame, k: int, tau: float, weights: tuple[float, float, float] = (0.60, 0.25, 0.15), earlier: bool = True, untyped: bool = False) -> DataFrame:
    """(base_id, event_id, sim, jaccard, same, score): of the corpus events of a similarity of tau or more, the k of the best
    blend of similarity, shared words and equal type. Ties go to the smaller event_id.

    base is (base_id, d, emb, kind, bag), corpus (event_id, d, emb, kind, bag): a whole number and an array of different
    words, which meet by 64-bit hashes. Both parts are worked out inside the task that reads an event, which keeps k of each
    query; two empty bags share nothing. Words are only counted where a query could reach its k-th score so far if the smaller
    bag were in the larger. Rows without a kind are left out, or with `untyped` have no score and come last.
    """
    typed = lambda df: df.where("bag is not null" if untyped else "kind is not null and bag is not null").withColumns({"kind": F.col("kind").cast("long"), "bag": F.transform("bag", lambda w: F.xxhash64(w))})
    base = typed(base).select("base_id", "d", "emb", F.coalesce("kind", F.lit(0)).alias("kind"), F.col("kind").isNull().alias("none"), "bag")
    out, written = None, None
    for ids, days, vectors, kinds, none, bags in _blocks(base, "kind", "none", "bag"):
        written = written if written is not None else _corpus(typed(corpus), "kind", "bag")
        flat, sizes = _words(bags)
        known, words = np.unique(flat, return_inverse=True)
        words, starts = words.astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
        held = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[np.argsort(words, kind="stable")]
        lists = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(known)))])
        block = ids, days, vectors, kinds.to_numpy(), none.to_numpy(zero_copy_only=False), sizes, known, starts, words, lists, held
        shared = base.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            ids, days, vectors, kinds, none, sizes, known, starts, words, lists, held = shared.value
            best, small = _Best(len(ids), k), vectors.astype(np.float32)
            floor = lambda rows: np.maximum(tau, (best.last[rows] - weights[1] - weights[2]) / weights[0])

            def scored(batch) -> None:
                events, own, m, kind = batch.column(0).to_numpy(), _days(batch.column(1)), _matrix(batch.column(2)), batch.column(3).fill_null(0).to_numpy()
                unknown = batch.column(3).is_null().to_numpy(zero_copy_only=False)
                flat, n = _words(batch.column(4))
                place = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
                met = known[place] == flat if len(known) else np.zeros(len(flat), bool)
                ends = np.cumsum(n)
                open_ = []
                for q, c, s, margin in _near(days, small, own, m.astype(np.float32), 0, floor, earlier):
                    least = np.where(none[q] | unknown[c], -np.inf, weights[0] * s + weights[2] * (kinds[q] == kind[c]))
                    a, b = sizes[q], n[c]
                    most = least + weights[1] * np.minimum(a, b) / np.maximum(np.maximum(a, b), 1)
                    on = most >= best.last[q] - margin
                    q, c, least, most = q[on], c[on], np.where(s >= tau + margin, least, -np.inf)[on], most[on]
                    # k pairs of a query that reach a score whatever their words also bound it
                    order = np.lexsort((-least, q))
                    at = np.arange(len(q)) - np.searchsorted(q, q) == k - 1
                    bound = np.full(len(ids), -np.inf)
                    bound[q[at]] = least[order][at]
                    on = most >= bound[q] - 2 * margin
                    open_.append((q[on], c[on]))
                if not open_:
                    return
                q, c = (np.concatenate(x) for x in zip(*open_, strict=True))
                s = _products(vectors, m, q, c)
                order = np.flatnonzero(s >= tau)
                order = order[np.argsort(c[order], kind="stable")]
                q, c, s = q[order], c[order], s[order]
                both = np.zeros(len(q))
                if weights[1]:
                    for col, a, b in zip(*(lambda x: (c[x], x, np.append(x[1:], len(c))))(np.flatnonzero(np.diff(c, prepend=-1))), strict=True):
                        of = slice(ends[col] - n[col], ends[col])
                        both[a:b] = _common(starts, words, lists, held, place[of][met[of]], q[a:b])
                jaccard = both / np.maximum(sizes[q] + n[c] - both, 1)
                same = (kinds[q] == kind[c]) & ~none[q] & ~unknown[c]
                score = np.where(none[q] | unknown[c], -np.inf, weights[0] * s + weights[1] * jaccard + weights[2] * same)
                on = score >= best.last[q]
                best.add(*(x[on] for x in (q, score, events[c], s, jaccard, same)))
                best.settle()

            for batch in batches:
                for j in range(0, batch.num_rows, ROUND):
                    scored(batch.slice(j, ROUND))
            columns = best.settle()
            if len(columns) > 3:
                q, b, e, s, jac, t = columns
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(e), pa.array(s), pa.array(jac), pa.array(t.astype(np.int32)), pa.array(b, mask=np.isinf(b))], names=["base_id", "event_id", "sim", "jaccard", "same", "score"])

        found = written.mapInArrow(run, "base_id long, event_id long, sim double, jaccard double, same int, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return base.sparkSession.createDataFrame([], "base_id long, event_id long, sim double, jaccard double, same int, score double, rank int")
    place = F.row_number().over(Window.partitionBy("base_id").orderBy(F.desc("score"), "event_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k)


def dtw(a: np.ndarray, b: np.ndarray, band: int | None = 2, squared: bool = True) -> np.ndarray:
    """Dynamic time warping of each row of a with the same row of b: squared costs and a root, or absolute costs."""
    n, m = a.shape[1], b.shape[1]
    cost = np.full((len(a), n + 1, m + 1), np.inf)
    cost[:, 0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if band is None or abs(i - j) <= max(band, abs(n - m)):
                d = a[:, i - 1] - b[:, j - 1]
                cost[:, i, j] = (d * d if squared else np.abs(d)) + np.minimum(np.minimum(cost[:, i - 1, j], cost[:, i, j - 1]), cost[:, i - 1, j - 1])
    return np.sqrt(cost[:, n, m]) if squared else cost[:, n, m]


def with_dtw(df: DataFrame, a: str, b: str, out: str = "dtw", band: int | None = 2, squared: bool = True, increments: bool = True) -> DataFrame:
    """df with the distance of the paths in array columns a and b, over whole batches; null where a path is null or has gaps."""

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        result = pd.Series([None] * len(x), dtype="float64")
        usable: dict = {}
        for k, (u, v) in enumerate(zip(x, y, strict=True)):
            if u is not None and v is not None and len(u) > increments and len(v) > increments and np.isfinite(np.asarray(u, float)).all() and np.isfinite(np.asarray(v, float)).all():
                usable.setdefault((len(u), len(v)), []).append(k)
        for rows in usable.values():
            u, v = (np.stack([np.asarray(s[k], float) for k in rows]) for s in (x, y))
            result.iloc[rows] = dtw(*((np.diff(u), np.diff(v)) if increments else (u, v)), band, squared)
        return result

    return df.withColumn(out, distance(a, b))
