"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text gives a vector of statistics (shares of symbols, capitals, repeats and so
on), each transformed to be closer to normal. A class covariance is shrunk towards the
pooled one and towards a multiple of the identity, and its Cholesky factor is cached; a
document's raw score is the difference of the classes' log-densities from Mahalanobis
distances. A logistic map, fitted on rows that the densities have not seen, turns it
into a probability.

Training takes at most ``SAMPLE`` labelled rows, by smallest hash of doc_id; only their
statistics reach the driver. Labels, lang, source and doc_id are not inputs of a score.

Edge cases: null, empty and blank texts have the statistics of an empty text and a score
like any other. A doc_id with contradictory labels is not trained on. Without both classes
in training every score is the share of label 1, or 0.5 without labels. Repeated rows are
scored each; tables without rows give no rows; further columns are kept by ``keep_good``
and ignored by ``score``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvale.llm.common import binary_column, each_batch, held_out, table

#: Labelled rows that are trained on at most.
SAMPLE = 20_000
FOLDS, OUT_FOLD = 5, 0
CUT = 0.3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_STOPS = b".,;:?"
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOPS)
STATISTICS = ("words", "word_length", "upper", "lower", "digits", "stops", "symbols", "high", "adjacent", "distinct", "lines", "line_repeats", "symbol_words", "longest")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text in UTF-8."""
    size = max(1, len(text))
    share = lambda some: math.sqrt((len(text) - len(text.translate(None, some))) / size)
    words = text.split()
    n = max(1, len(words))
    lines = text.split(b"\n")
    symbols = text.translate(None, _UPPER + _LOWER + _DIGIT + _STOPS + _HIGH)
    distinct = len(set(words))
    return [
        math.log1p(len(words)),
        math.log1p(len(text) / n),
        share(_UPPER),
        share(_LOWER),
        share(_DIGIT),
        share(_STOPS),
        share(_SYMBOL),
        share(_HIGH),
        math.sqrt(sum(map(eq, words, words[1:])) / n),
        math.log1p(distinct) / math.log1p(n),
        math.log1p(len(lines)) / math.log(2 + n),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(len(symbols.split()) / n),
        math.log1p(max(map(len, words), default=0)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors and log-priors of the two classes, and the logistic map of their difference."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        """log-density of class 1 minus that of class 0."""
        z = (x - self.centre) / self.scale
        density = []
        for mean, factor in zip(self.means, self.factors):
            solved = forward(factor, (z - mean).T)
            density.append(-0.5 * (solved**2).sum(0) - np.log(np.diag(factor)).sum())
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(self.raw(x)) + self.shift, -40, 40)))


def forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a lower triangular system, row by row, for many right sides."""
    out = np.empty_like(right, dtype=np.float64)
    for i in range(len(factor)):
        out[i] = (right[i] - factor[i, :i] @ out[:i]) / factor[i, i]
    return out


def squash(raw: np.ndarray) -> np.ndarray:
    """Signed square root: density differences have long tails."""
    return np.sign(raw) * np.sqrt(np.abs(raw))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a lightly penalised one-variable logistic regression, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (y - p) - 1e-2 * (w - [1.0, 0.0]))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(x: np.ndarray, y: np.ndarray, pooled: float = 0.1, ridge: float = 0.05) -> Discriminant:
    """The discriminant of rows x with labels y; a fifth of the rows is kept for the logistic map."""
    width = x.shape[1] if x.ndim == 2 else len(STATISTICS)
    if len(y) < 10 or min(y.sum(), len(y) - y.sum()) < 2:
        none = np.zeros(width)
        return Discriminant(none, none + 1, np.zeros((2, width)), np.stack([np.eye(width)] * 2), constant=float(y.mean()) if len(y) else 0.5)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale

    def classes(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        means = np.stack([z[y == k].mean(0) for k in (0, 1)])
        own = [np.cov(z[y == k].T, bias=True).reshape(width, width) for k in (0, 1)]
        shared = sum(c * np.mean(y == k) for k, c in enumerate(own))
        mixed = [(1 - pooled) * c + pooled * shared for c in own]
        mixed = [(1 - ridge) * c + ridge * np.trace(c) / width * np.eye(width) for c in mixed]
        return means, np.stack([np.linalg.cholesky(c + 1e-9 * np.eye(width)) for c in mixed])

    part = np.arange(len(y)) % 5 == 0
    if min(y[part].sum(), (1 - y[part]).sum(), y[~part].sum(), (1 - y[~part]).sum()) < 2:
        part = np.zeros(len(y), dtype=bool)
    model = Discriminant(centre, scale, *classes(z[~part], y[~part]))
    fitted = part if part.any() else ~part
    slope, shift = logistic(squash(model.raw(x[fitted])), y[fitted])
    return Discriminant(centre, scale, *classes(z, y), slope, shift)


def labelled(labels: DataFrame, column: str, usable: Column, sample: int) -> DataFrame:
    """(doc_id, label): at most sample rows, by smallest hash, of doc_ids whose labels agree."""
    label = F.col(column).cast("int")
    agreed = labels.where(usable & label.isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    return agreed.select("doc_id", "label", F.xxhash64("doc_id").alias("draw")).orderBy("draw", "doc_id").limit(sample).select("doc_id", "label")


def _columns(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, usable: Column | None = None) -> Discriminant:
    """Fits on labelled documents outside the held-out fold."""
    usable = ~held_out(FOLDS, OUT_FOLD) if usable is None else usable
    some = labelled(labels, "quality", usable, sample)
    known = _columns(docs).join(F.broadcast(some), "doc_id")

    def work(rows: pa.Table) -> pa.Table:
        x = np.array([statistics(t) for t in binary_column(rows, "text")])
        return pa.table({"doc_id": rows["doc_id"], "label": rows["label"], "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    got = each_batch(known.select("doc_id", "text", "label"), work, "doc_id long, label int, x array<double>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    order = np.argsort((np.array(got["doc_id"].to_pylist(), dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), kind="stable")
    return fit(x[order], got["label"].to_numpy()[order])


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def work(rows: pa.Table) -> pa.Table:
        x = np.array([statistics(t) for t in binary_column(rows, "text")])
        return pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": pa.array(model.score(x), pa.float64())})

    rows = _columns(docs).withColumn("held_out", F.coalesce(held_out(FOLDS, OUT_FOLD), F.lit(False)))
    return each_batch(rows, work, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    model = train(docs, labels)
    names = docs.columns

    def work(rows: pa.Table) -> pa.Table:
        good = model.score(np.array([statistics(t) for t in binary_column(rows, "text")])) >= CUT
        return rows.filter(pa.array(good)).select(names)

    return each_batch(docs, work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
