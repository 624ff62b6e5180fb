"""Topics of texts: term weights of words and word pairs, a truncated decomposition, density clusters, labels, merging.

The vocabulary is bounded, texts are not. Weights are sparse rows of a text; the decomposition passes over them a few times
and brings back one dense row for each term. Density clusters are fitted on a bounded, documented sample, whose members then
claim the texts within their cluster's reach; all counts, weights and labels cover every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators import statistics
from hindcast.sources import shared

#: Terms at most, texts that a term is in at least and the share of them at most, dimensions and those to spare, passes, seed.
TERMS, FEWEST, MOST, DIMENSIONS, SPARE, PASSES, SEED = 10_000, 2, 0.75, 50, 10, 4, 42
#: Texts that clusters are fitted on, those of the least hash; fewest members; words of a label; likeness of labels that are one.
FITTED, LEAST, LABEL, ALIKE, LARGE = 2_000, 5, 5, 0.75, 0.30
OUTLIER = "outlier"


def terms_of(text: Column, stop: tuple[str, ...] = (), shortest: int = 3) -> Column:
    """The words of a text and the pairs of neighbours among them, after a stop list."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-zà-ÿ]{{{shortest},}}"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))


def counted(docs: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, term, tf) of docs (doc_id, text); rows of one doc_id are one text, null ids are left out."""
    return docs.where("doc_id is not null").select("doc_id", F.explode(terms_of(F.col("text"), stop)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, terms: int = TERMS, fewest: int = FEWEST, most: float = MOST) -> DataFrame:
    """(term, at, idf): of the terms that are neither in too few texts nor in too many, the `terms` that occur most, numbered by name."""
    v = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")).where((F.col("df") >= fewest) & (F.col("df") <= most * n_docs))
    v = v.orderBy(F.desc("n"), "term").limit(terms)
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1  # a bounded table
    return v.select("term", at.alias("at"), (F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(counts: DataFrame, v: DataFrame) -> DataFrame:
    """(doc_id, at, w): sparse rows of length one, of (1 + log tf) * idf, at ascending; texts without a known term have none."""
    w = counts.join(F.broadcast(v), "term").select("doc_id", F.struct("at", ((1 + F.log("tf")) * F.col("idf")).alias("w")).alias("p"))
    rows = w.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    return rows.withColumn("__n", norm).select("doc_id", F.transform("p", lambda x: x["at"]).alias("at"), F.transform("p", lambda x: x["w"] / F.col("__n")).alias("w"))


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, w) of all entries of a batch of rows."""
    at, w = batch.column(batch.schema.get_field_index("at")), batch.column(batch.schema.get_field_index("w"))
    return np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy(), w.flatten().to_numpy()


def _times(row: np.ndarray, at: np.ndarray, w: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """The sparse rows times a dense matrix."""
    out = np.zeros((n, m.shape[1]))
    for k in range(0, len(row), 1 << 16):
        np.add.at(out, row[k : k + (1 << 16)], w[k : k + (1 << 16), None] * m[at[k : k + (1 << 16)]])
    return out


def decomposed(rows: DataFrame, n_terms: int, dimensions: int = DIMENSIONS, spare: int = SPARE, passes: int = PASSES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(V, s): the leading right singular vectors (terms x dimensions) and singular values of sparse rows, by a randomised
    subspace that each pass multiplies with the rows and their transpose.

    A task adds up one dense row for each term that it has met; Spark sums them, and terms x (dimensions + spare) numbers
    come back. rows should be written, as every pass reads them.
    """
    width = min(dimensions + spare, n_terms)
    if not width:
        return np.zeros((0, 0)), np.zeros(0)
    spark = rows.sparkSession
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]
    for _ in range(passes):
        y = _passed(rows, spark.sparkContext.broadcast(q), n_terms)
        top = q.T @ y  # the rows' square in the subspace before this pass
        q_before, (q, _) = q, np.linalg.qr(y)
    values, inner = np.linalg.eigh((top + top.T) / 2)
    order = np.argsort(values)[::-1][: min(dimensions, width)]
    return q_before @ inner[:, order], np.sqrt(np.maximum(values[order], 0))


def _passed(rows: DataFrame, shared_q, n_terms: int) -> np.ndarray:
    """The transposed rows times (the rows times q)."""
    width = shared_q.value.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, out, met = shared_q.value, np.zeros((n_terms, width)), np.zeros(n_terms, bool)
        for batch in batches:
            row, at, w = _sparse(batch)
            here = _times(row, at, w, q, batch.num_rows)
            for k in range(0, len(row), 1 << 16):
                np.add.at(out, at[k : k + (1 << 16)], w[k : k + (1 << 16), None] * here[row[k : k + (1 << 16)]])
            met[at] = True
        some = np.flatnonzero(met).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(out[some, c]) for c in range(width))], names=["at", *(f"c{c}" for c in range(width))])

    names = [f"c{c}" for c in range(width)]
    sums = rows.select("at", "w").mapInArrow(run, "at int, " + ", ".join(f"{c} double" for c in names)).groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    y = np.zeros((n_terms, width))
    y[sums["at"].to_numpy()] = np.stack([sums[c].to_numpy() for c in names], axis=1) if sums.num_rows else 0
    return y


def embedded(rows: DataFrame, v: np.ndarray) -> DataFrame:
    """(doc_id, x): every row in the decomposition's dimensions, of length one; a row that is nothing there stays zero."""
    shared_v = rows.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, w = _sparse(batch)
            x = _times(row, at, w, shared_v.value, batch.num_rows)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.select("doc_id", "at", "w").mapInArrow(run, "doc_id long, x array<double>")


def clustered(vectors: DataFrame, fitted: int = FITTED, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(doc_id, topic): density clusters of vectors (doc_id, x), -1 for what no cluster reaches.

    The clusters that split no further are found among the `fitted` texts of the least hash (all, if there are no more).
    Another text joins the cluster of the nearest of these if it is within the distance at which that cluster parted.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"))
    sample = vectors.select("doc_id", "x", h.alias("h")).orderBy("h", "doc_id").limit(fitted).collect()  # a bounded number
    if not sample:
        return vectors.select("doc_id", F.lit(-1).alias("topic"))
    points = np.array([r["x"] for r in sample])
    d = np.sqrt(np.maximum(2 - 2 * np.clip(points @ points.T, -1, 1), 0))
    np.fill_diagonal(d, 0)
    labels, reach = statistics.density_tree(d, least, leaves=True)
    ids = np.array([r["doc_id"] for r in sample])
    spark = vectors.sparkSession
    shared_fit = spark.sparkContext.broadcast((ids, points, labels, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, labels, reach = shared_fit.value
        own = dict(zip(ids.tolist(), labels.tolist(), strict=True))
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            near = x @ points.T
            at = near.argmax(1)
            far = np.sqrt(np.maximum(2 - 2 * np.clip(near[np.arange(len(x)), at], -1, 1), 0))
            topic = np.where((labels[at] >= 0) & (far <= np.append(reach, 0.0)[labels[at]]), labels[at], -1)
            topic = [own.get(i, int(t)) for i, t in zip(batch.column(0).to_pylist(), topic, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(topic, pa.int32())], names=["doc_id", "topic"])

    return vectors.select("doc_id", "x").mapInArrow(run, "doc_id long, topic int")


def labelled(counts: DataFrame, topics: DataFrame, v: DataFrame, words: int = LABEL) -> DataFrame:
    """(topic, label): the terms that most tell a topic from the others, joined by dots; outliers have a label of their own.

    A topic's texts are one: the root of a term's share of it times log(1 + mean words of a topic / occurrences in all).
    """
    of = counts.join(F.broadcast(v.select("term")), "term").join(topics, "doc_id").groupBy("topic", "term").agg(F.sum("tf").alias("tf"))
    every = F.sum("tf").over(Window.partitionBy("topic"))
    all_ = of.groupBy("term").agg(F.sum("tf").alias("f"))
    mean = of.groupBy("topic").agg(F.sum("tf").alias("n")).agg(F.avg("n").alias("a"))
    scored = of.withColumn("n", every).join(all_, "term").join(F.broadcast(mean)).withColumn("score", F.sqrt(F.col("tf") / F.col("n")) * F.log(1 + F.col("a") / F.col("f")))
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "term"))).where(F.col("k") <= words)
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), " · ")
    return best.groupBy("topic").agg(label.alias("label")).withColumn("label", F.when(F.col("topic") == -1, OUTLIER).otherwise(F.col("label")))


def merges(labels: dict[int, str], alike: float = ALIKE) -> dict[int, int]:
    """Which topics go into which earlier one: labels whose words have a cosine above `alike`, by term weights among labels.

    Topics are as few as the fitted texts allow. A topic that has gone into another takes no further ones.
    """
    ids = sorted(t for t in labels if t != -1)
    words = [[w for w in labels[t].replace(" · ", " ").split() if len(w) > 1] for t in ids]
    terms = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
    m = np.zeros((len(ids), len(terms)))
    for k, ws in enumerate(words):
        for w in ws:
            m[k, terms[w]] += 1
    m *= np.log((1 + len(ids)) / (1 + (m > 0).sum(0))) + 1 if len(terms) else 1
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    near, into = m @ m.T, {}
    for a in range(len(ids)):
        if ids[a] not in into:
            into |= {ids[b]: ids[a] for b in range(a + 1, len(ids)) if ids[b] not in into and near[a, b] > alike}
    return into


def topics(docs: DataFrame, stop: tuple[str, ...] = (), dimensions: int = DIMENSIONS, fitted: int = FITTED, least: int = LEAST, alike: float = ALIKE, large: float = LARGE) -> DataFrame:
    """(doc_id, first_topic, topic, label, oversized) of every document (doc_id, text).

    topic is first_topic after topics of like labels are one. oversized marks topics of more than `large` of all texts. A
    text without a known term is an outlier. Rows of one doc_id are one text; null ids have no row; no rows give none.
    """
    spark = docs.sparkSession
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    n_docs = ids.count()
    counts = shared.checkpointed(counted(docs, stop))
    v = shared.checkpointed(vocabulary(counts, n_docs))
    rows = shared.checkpointed(weighted(counts, v))
    n_terms = v.count()
    space, _ = decomposed(rows, n_terms, dimensions)
    found = clustered(shared.checkpointed(embedded(rows, space)), fitted, least) if n_terms else spark.createDataFrame([], "doc_id long, topic int")
    found = shared.checkpointed(ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("topic", F.lit(-1)).alias("first_topic")))
    labels = {r["topic"]: r["label"] for r in labelled(counts, found.select("doc_id", F.col("first_topic").alias("topic")), v).collect()}
    into = merges(labels, alike)
    known = [(t, into.get(t, t), OUTLIER if t == -1 else labels.get(into.get(t, t))) for t in {*labels, -1}]
    out = found.join(F.broadcast(spark.createDataFrame(known, "first_topic int, topic int, label string")), "first_topic", "left")
    sizes = out.groupBy("topic").agg((F.count(F.lit(1)) > large * n_docs).alias("oversized"))
    return out.join(F.broadcast(sizes), "topic").select("doc_id", "first_topic", "topic", "label", "oversized")
