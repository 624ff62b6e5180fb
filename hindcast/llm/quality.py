"""Quality classifier: Bradley-Terry preferences between labelled documents.

A document's merit is a linear score of measures of its whole text. For a pair of a good and a poor document the
probability that the good one is preferred is the logistic function of the difference of their merits; the weights
minimise the logistic loss over pairs, on differences of the measures. Documents are then accepted if their merit is
above a quantile of the merits of the labelled documents: the quantile is the one that parts the labels best.

The weights are fitted on at most MOST_LABELLED labelled rows (those of the least hash of their id) and PAIRS pairs;
scores cover all documents.

A null or blank text has no measure but that it is empty, and is scored. Several labels of a document are as many rows of
training, as are rows of one doc_id; labels other than 0 and 1 and null ids or labels are not used. Equal texts have equal
scores, whatever their ids and batches. Extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from hindcast.llm.common import in_fold, texts, with_arrow

MOST_LABELLED, PAIRS, THRESHOLD = 20_000, 100_000, 0.3
NAMES = ("log_bytes", "log_words", "word_bytes", "upper", "lower", "digits", "marks", "bars", "exclaims", "stops", "commas", "other", "newlines", "distinct", "top_word", "repeats", "shouted", "marked_words", "bare_words", "digit_words", "line_words", "same_lines", "empty")
_BYTES = np.arange(256)
_CLASSES = np.array(
    [
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 97) & (_BYTES <= 122),
        (_BYTES >= 48) & (_BYTES <= 57),
        np.isin(_BYTES, list(b"#$%&*@^~<>{}[]\\/=+_")),
        _BYTES == ord("|"),
        np.isin(_BYTES, list(b"!?")),
        _BYTES == ord("."),
        np.isin(_BYTES, list(b",;:'\"()-")),
        _BYTES >= 128,
        _BYTES == ord("\n"),
    ],
    float,
)
_MARKED = re.compile(r"\w[#$%&*@^~]")


def measures(text: str) -> list[float]:
    """The measures in NAMES of one text; all zero but the last for a text without words."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    if not words:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    shares = (_CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)).tolist()
    n, found, lines = len(words), Counter(words), text.split("\n")
    return [
        np.log1p(len(raw)),
        np.log1p(n),
        min(len(raw) / n, 40.0),
        *shares,
        len(found) / n,
        max(found.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(map(str.isupper, words)) / n,
        len(_MARKED.findall(text)) / n,
        found.get("|", 0) / n,
        sum(map(str.isdigit, words)) / n,
        np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        0.0,
    ]


def measured(df: DataFrame, text_col: str = "text", out: str = "measures") -> DataFrame:
    """df with the measures of each whole text; null is the empty text."""
    return with_arrow(df, lambda batch: [pa.array([measures(t) for t in texts(batch, text_col)], pa.list_(pa.float64()))], [StructField(out, ArrayType(DoubleType()))])


@dataclass(frozen=True)
class Ranking:
    """A fitted model: merit = weights . (measures - mean) / spread; the threshold is a merit, too."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def merit(self, x: np.ndarray) -> np.ndarray:
        """Added up measure by measure, so that a text's merit is the same to the last bit in any batch."""
        z, out = np.clip((x - self.mean) / self.spread, -8, 8), np.zeros(len(x))
        for k, w in enumerate(self.weights):
            out += z[:, k] * w
        return out

    def score(self, x: np.ndarray, at: float = THRESHOLD) -> np.ndarray:
        """0 to 1, and at least `at` exactly where the merit is at or above the threshold."""
        over = self.merit(x) - self.threshold
        with np.errstate(over="ignore"):
            s = 1 / (1 + np.exp(-(over * self.scale + np.log(at / (1 - at)))))
        return np.where(over >= 0, np.maximum(s, at), np.minimum(s, np.nextafter(at, 0)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> Ranking:
    """Bradley-Terry weights by Newton's method on pairs drawn with a fixed seed, then the quantile threshold.

    With no row, or labels of one kind only, the weights are zero and everything is accepted.
    """
    x, y = np.asarray(x, float).reshape(-1, len(NAMES)), np.asarray(y, int)
    if not len(x) or y.min() == y.max():
        return Ranking(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)), 0.0, 1.0)
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(y == 1), pairs)] - z[rng.choice(np.flatnonzero(y == 0), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    merit = Ranking(mean, spread, w, 0.0, 1.0).merit(x)
    levels = np.unique(np.concatenate([np.linspace(0, 1, 401), [(y == 0).mean()]]))
    cuts = np.quantile(merit, levels)
    order = np.argsort(merit)
    ranked = merit[order]
    below = np.searchsorted(ranked, cuts)
    poor, good = np.concatenate([[0], np.cumsum(1 - y[order])]), np.concatenate([[0], np.cumsum(y[order])])
    # balanced errors: poor rows accepted and good rows rejected
    errors = (poor[-1] - poor[below]) / poor[-1] + good[below] / good[-1]
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    # midway between the neighbours of the middle one of the best quantiles, so that no training row lies on the threshold
    at = below[best[len(best) // 2]]
    threshold = float(ranked[0] - 1 if at == 0 else (ranked[at - 1] + ranked[at]) / 2)
    scales = np.geomspace(0.1, 10, 41)
    s = 1 / (1 + np.exp(-np.clip(np.outer(scales, merit - threshold) + np.log(THRESHOLD / (1 - THRESHOLD)), -500, 500)))
    loss = -(np.log(np.clip(np.where(y == 1, s, 1 - s), 1e-12, 1))).mean(1)
    return Ranking(mean, spread, w, threshold, float(scales[loss.argmin()]))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Ranking:
    """The model of the labelled rows outside the held-out fold; at most `most` rows, their number bounds what the driver gets."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold("doc_id", 5, 0))
    chosen = usable.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__label")).orderBy(F.xxhash64("__id"), "__id", "__label").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "__label")
    found = measured(rows).select("measures", "__label").collect()
    return fit(np.array([r["measures"] for r in found]), np.array([r["__label"] for r in found]))


def score(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """docs with score and predicted for each whole text (null is the empty text); columns of these names are replaced.

    One pass without a shuffle; rows and other columns stay.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        s = model.score(np.array([measures(t) for t in texts(batch, text_col)]))
        return [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())]

    return with_arrow(docs, run, [StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")
