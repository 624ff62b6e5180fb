"""Regressions of yes-or-no outcomes: many models fitted side by side, each round one pass over the rows.

A model is a cell. Tasks sum scores and information of every cell over their rows in NumPy, Spark adds the sums up by cell
and place, and only these few numbers reach the driver, which makes one Newton step for all cells. Cells are a stated list;
rows may be as many as they like.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, TOLERANCE = 40, 1e-9


def normal_tail(z: float) -> float:
    """The chance of a standard normal beyond |z|, either way."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_square_tail(x: float) -> float:
    """The chance of more than x with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


_erf = np.vectorize(math.erf, otypes=[float])


def _terms(link: str, eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, its derivative by eta and minus its second derivative, row by row."""
    if link == "logit":
        p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        return -np.logaddexp(0, np.where(y > 0.5, -eta, eta)), y - p, p * (1 - p)
    q = np.where(y > 0.5, 1.0, -1.0)
    z = np.clip(q * eta, -37, None)
    below = np.maximum(0.5 * (1 + _erf(z / math.sqrt(2))), 1e-300)
    ratio = q * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / below
    return np.log(below), ratio, ratio * (ratio + eta)


@dataclass
class Model:
    """A fitted cell: coefficients and their covariance, log likelihood, rows, and whether the steps came to rest."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    ll: float
    n: int
    ones: int
    rested: bool

    def se(self, name: str) -> float:
        return math.sqrt(max(self.cov[self.names.index(name), self.names.index(name)], 0.0))

    def coef(self, name: str) -> float:
        return float(self.beta[self.names.index(name)])


def _summed(rows: DataFrame, per_cell: Callable[[str, np.ndarray, np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    """The sum over all rows of what per_cell(cell, x, y) gives for the rows of a cell in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            cells = np.array(batch.column(0).to_pylist(), dtype=object)
            for cell in set(cells):
                own = batch.filter(pa.array(cells == cell))
                x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                found = per_cell(cell, x, own.column(2).to_numpy(zero_copy_only=False))
                held[cell] = held[cell] + found if cell in held else found
        for cell, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([cell] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v.astype(float))], names=["cell", "at", "v"])

    sums = rows.select("cell", "x", "y").mapInArrow(run, "cell string, at int, v double").groupBy("cell", "at").agg(F.sum("v").alias("v")).collect()
    out: dict[str, dict[int, float]] = {}
    for r in sums:
        out.setdefault(r["cell"], {})[r["at"]] = r["v"]
    return {cell: np.array([v[k] for k in range(len(v))]) for cell, v in out.items()}


def fit(rows: DataFrame, names: dict[str, list[str]], link: dict[str, str] | None = None) -> dict[str, Model]:
    """A model for each cell by maximum likelihood, in Newton steps that all cells make at once.

    rows are (cell, x, y): an array of numbers in the order of the cell's names, the constant among them, and 0 or 1; they
    should be written, as each round reads them. Rows of an unknown cell or with a null are left out. Where the outcomes are
    separated the steps don't come to rest, which the model says; cells without rows aren't in the result.
    """
    link = link or {}
    rows = rows.where(F.col("cell").isin(*names) & F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    beta = {c: np.zeros(len(n)) for c, n in names.items()}
    models: dict[str, Model] = {}
    open_ = set(names)
    for _ in range(ROUNDS):
        now = {c: beta[c] for c in open_}

        def per_cell(cell: str, x: np.ndarray, y: np.ndarray, now=now) -> np.ndarray:
            ll, score, weight = _terms(link.get(cell, "logit"), x @ now[cell], y)
            return np.concatenate([[ll.sum(), len(y), y.sum()], x.T @ score, (x.T @ (x * weight[:, None])).ravel()])

        for cell, v in _summed(rows.where(F.col("cell").isin(*open_)), per_cell).items():
            k = len(names[cell])
            score, info = v[3 : 3 + k], v[3 + k :].reshape(k, k)
            size = np.sqrt(np.maximum(np.diag(info), 1e-300))  # columns of very different size are solved alike
            inverse = np.linalg.pinv(info / np.outer(size, size)) / np.outer(size, size)
            step = inverse @ score
            models[cell] = Model(names[cell], beta[cell], inverse, float(v[0]), int(v[1]), int(v[2]), bool((np.abs(step) * size).max() < TOLERANCE * math.sqrt(v[1])))
            beta[cell] = beta[cell] + step * min(1.0, 8.0 / max(float((np.abs(step) * size).max() / math.sqrt(v[1])), 1e-12))
        open_ = {c for c in open_ if c in models and not models[c].rested}
        if not open_:
            break
    return models


def clustered(rows: DataFrame, models: dict[str, Model], link: dict[str, str] | None = None) -> dict[str, np.ndarray]:
    """The covariance of each model's coefficients when rows of one group depend on each other.

    rows are (cell, x, y, grp). Scores are added up by group, in tasks first, and their outer products by cell; with the
    usual correction for few groups and rows. A cell with one group has no such covariance and isn't in the result.
    """
    link = link or {}

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.array(batch.column(0).to_pylist(), dtype=object)
            for cell in set(cells):
                own = batch.filter(pa.array(cells == cell))
                x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                _, score, _ = _terms(link.get(cell, "logit"), x @ models[cell].beta, own.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(3), pa.array((x * score[:, None]).tolist(), pa.list_(pa.float64()))], names=["cell", "grp", "s"])

    known = rows.where(F.col("cell").isin(*models) & F.col("y").isNotNull() & F.col("grp").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    s = known.select("cell", "x", "y", "grp").mapInArrow(scores, "cell string, grp string, s array<double>")
    s = s.select("cell", "grp", F.posexplode("s").alias("at", "v")).groupBy("cell", "grp", "at").agg(F.sum("v").alias("v"))
    vectors = s.groupBy("cell", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("x")).withColumn("y", F.lit(1.0))
    products = _summed(vectors, lambda cell, x, y: np.concatenate([[len(y)], (x.T @ x).ravel()]))
    out = {}
    for cell, v in products.items():
        m, groups = models[cell], v[0]
        if groups > 1:
            k = len(m.names)
            out[cell] = (groups / (groups - 1)) * ((m.n - 1) / (m.n - k)) * m.cov @ v[1:].reshape(k, k) @ m.cov
    return out


def marginal_effects(rows: DataFrame, models: dict[str, Model], of: str, cov: dict[str, np.ndarray] | None = None) -> dict[str, tuple[float, float]]:
    """The mean change of the chance by one more of a feature, over all rows of each logit, and its error by the delta method."""
    cov = cov or {}
    with_of = {c: m for c, m in models.items() if of in m.names}

    def per_cell(cell: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x @ with_of[cell].beta, -700, 700)))
        w = p * (1 - p)
        return np.concatenate([[len(y), w.sum()], x.T @ (w * (1 - 2 * p))])

    known = rows.where(F.col("cell").isin(*with_of) & F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    out = {}
    for cell, v in _summed(known, per_cell).items():
        m = with_of[cell]
        j, n = m.names.index(of), v[0]
        slope = m.beta[j] * v[2:] / n
        slope[j] += v[1] / n
        out[cell] = float(m.beta[j] * v[1] / n), math.sqrt(max(float(slope @ cov.get(cell, m.cov) @ slope), 0.0))
    return out
