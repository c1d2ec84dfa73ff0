"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of the whole word and of its first four and five
letters, so that inflected forms share what is learned. Filters of one, two and three
words run over the text; each filter's largest activation, with a bias for filters that
find nothing, goes into a logistic layer. Embeddings, filters and weights are trained
together with Adam on whole texts; one coordinate of the embeddings starts from the
log-odds of a bucket's documents, the rest near zero. A logistic map fitted on unseen
rows turns the output into a probability.

Thresholds are calibrated by language on the scores of every labelled row outside the
held-out fold that the classifier was not fitted on: a language's threshold is the middle of
the gap between its clean rows' 0.99 quantile and its toxic rows' 0.02 quantile, both to
``STEPS`` steps, held within ``THRESHOLDS``; languages with under ``LEAST`` rows of either
class take the one over all. They come as further columns (threshold, flagged); lang is not
an input of the score. Languages are told apart by ``LANGUAGES`` hash values, which bounds
the table of thresholds; two that share one are calibrated together.

Training takes at most ``SAMPLE`` labelled rows, by smallest hash of doc_id, toxic and
clean ones counted apart, and of either class, in the same order, those that keep the words
within ``WORDS``; the driver sees their hashed words only, so rows and bytes are bounded.

Edge cases: null, empty and blank texts have no words and score as clean. A doc_id with
contradictory labels is not trained on. Without both classes in training every score is
the share of label 1, or 0 without labels. A null lang takes the threshold over all.
Repeated rows are scored each; tables without rows give no rows; further columns are kept
by ``keep_clean`` and ignored by ``score``. A table without a column lang counts as null there.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corvale.llm.common import binary_column, each_batch, held_out, offsets_of, table, written
from corvale.llm.quality import labelled, logistic

#: Labelled rows of either class that are trained on at most.
SAMPLE = 3_000
#: Words of those of either class; a text that would go beyond is left out of the training, whole.
WORDS = 700_000
FOLDS, OUT_FOLD = 4, 2
CUT = 0.3
THRESHOLDS = (0.2, 0.5)
LANGUAGES = 1 << 16
STEPS = 1_000
LEAST = 5

BUCKETS = 1 << 18
SIZE = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PARTS = 3
_EDGES = b"".join(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())


def word_buckets(word: bytes) -> tuple[int, int, int]:
    """Buckets of a word in UTF-8: the whole of it, its first five and its first four letters, lower-cased, without marks at its ends."""
    bare = word.strip(_EDGES).decode("utf-8", "replace").lower()
    h = zlib.crc32
    return (h(b"w" + bare.encode()) % BUCKETS, h(b"5" + bare[:5].encode()) % BUCKETS, h(b"4" + bare[:4].encode()) % BUCKETS)


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each different word, each position's word number, positions per text)."""
    split = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    for words in split:
        for w in words:
            if w not in number:
                number[w] = len(number)
    lengths = np.array([len(words) for words in split], dtype=np.int64)
    which = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), dtype=np.int32, count=int(lengths.sum()))
    buckets = np.array([word_buckets(w) for w in number], dtype=np.int32).reshape(-1, PARTS)
    return buckets, which, lengths


@dataclass
class Convolution:
    """The trained classifier."""

    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, SIZE, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    shift: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[int | None, float] = field(default_factory=dict)
    constant: float | None = None
    fitted: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def pooled(self, words: np.ndarray, which: np.ndarray, lengths: np.ndarray, want_places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(texts × filters) largest activations over a text's positions, and their positions (if wanted); -1 where the bias is larger."""
        starts = offsets_of(lengths)
        full = np.flatnonzero(lengths > 0)
        values = np.tile(self.bias, (len(lengths), 1))
        places = np.full(values.shape, -1, dtype=np.int64)
        for k, (width, f) in enumerate(zip(WIDTHS, self.filters)):
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            act = (words @ f[0])[which]
            for o in range(1, width):
                after = (words @ f[o])[which[o:]]
                act[:-o] += after
                last = np.unique(np.concatenate([starts[full + 1] - 1 - j for j in range(o)])) if len(full) else full
                inside = last[(last >= 0) & (last < len(act) - o)]
                act[inside] -= after[inside]  # the next text's words do not count
            if not len(full):
                continue
            top = np.maximum.reduceat(act, starts[full], axis=0)
            found = values[full, columns] < top
            values[full, columns] = np.where(found, top, values[full, columns])
            if want_places:
                owner = np.repeat(np.arange(len(full)), lengths[full])
                hit = act == top[owner]
                row, col = np.nonzero(hit)
                first = np.full(top.shape, len(act), dtype=np.int64)
                np.minimum.at(first, (owner[row], col), row)
                places[full, columns] = np.where(found, first, -1)
        return values, places

    def raw(self, texts: list[bytes]) -> np.ndarray:
        buckets, which, lengths = batch_words(texts)
        words = self.embedding[buckets].sum(1) if len(buckets) else np.zeros((0, SIZE), dtype=np.float32)
        values, _ = self.pooled(words, which, lengths)
        return values @ self.weights + self.shift

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.calibrated(self.raw(texts))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw.astype(np.float64) + self.offset, -40, 40)))

    def threshold(self, lang: str | None) -> float:
        number = None if lang is None else zlib.crc32(lang.encode()) % LANGUAGES
        return self.thresholds.get(number, self.thresholds.get(None, CUT))


def _adam(state: dict, name: str, value: np.ndarray, grad: np.ndarray, rate: float, step: int) -> None:
    m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
    m += 0.1 * (grad - m)
    v += 0.01 * (grad * grad - v)
    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def fit(docs: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.02, seed: int = 7) -> Convolution:
    """The classifier of texts given as (words × 3) buckets, with labels y; its fitted are the texts' numbers that it has learned from."""
    rng = np.random.default_rng(seed)
    none = Convolution(np.zeros((BUCKETS, SIZE), dtype=np.float32), [np.zeros((w, SIZE, FILTERS), dtype=np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), dtype=np.float32), np.zeros(FILTERS * len(WIDTHS)))
    if len(y) < 10 or min(y.sum(), len(y) - y.sum()) < 2:
        none.constant = float(y.mean()) if len(y) else 0.0
        return none
    unseen = np.arange(len(y)) % 5 == 0
    if min(y[unseen].sum(), (1 - y[unseen]).sum(), y[~unseen].sum(), (1 - y[~unseen]).sum()) < 2:
        unseen[:] = False
    rows = np.flatnonzero(~unseen)
    seen = np.zeros((2, BUCKETS), dtype=np.int32)
    for i in rows:
        seen[y[i], np.unique(docs[i])] += 1
    count = np.bincount(y[rows], minlength=2)
    odds = np.log((seen[1] + 0.5) / (count[1] + 1)) - np.log((seen[0] + 0.5) / (count[0] + 1))
    often = seen.sum(0) >= 3
    model = none
    model.embedding[:, 0] = np.where(often, np.clip(odds, -3, 3) / 3, 0)
    model.embedding[often, 1:] = rng.normal(0, 0.05, (int(often.sum()), SIZE - 1))
    for f in model.filters:
        f[:] = rng.normal(0, 0.3, f.shape)
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.2
    model.weights = rng.uniform(0.2, 0.6, FILTERS * len(WIDTHS)).astype(np.float32)
    model.shift = float(np.log(count[1] / count[0]))
    state: dict = {}
    step = 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            step += 1
            buckets = np.concatenate([docs[i] for i in some])
            lengths = np.array([len(docs[i]) for i in some], dtype=np.int64)
            words = model.embedding[buckets].sum(1)
            values, places = model.pooled(words, np.arange(len(words)), lengths, want_places=True)
            p = 1 / (1 + np.exp(-np.clip(values @ model.weights + model.shift, -30, 30)))
            error = ((p - y[some]) / len(some)).astype(np.float32)
            back = error[:, None] * model.weights[None, :]
            used: list[np.ndarray] = []
            grads: list[np.ndarray] = []
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                text, col = np.nonzero(places[:, cols] >= 0)
                at_word, g = places[text, k * FILTERS + col], back[text, k * FILTERS + col]
                ends = offsets_of(lengths)[text + 1]
                df = np.zeros_like(model.filters[k])
                for o in range(width):
                    ok = at_word + o < ends
                    here = at_word[ok] + o
                    np.add.at(df[o].T, col[ok], g[ok, None] * words[here])
                    used.append(here)
                    grads.append(g[ok, None] * model.filters[k][o].T[col[ok]])
                _adam(state, f"f{k}", model.filters[k], df + 1e-4 * model.filters[k], rate, step)
            _adam(state, "w", model.weights, (error @ values + 1e-4 * model.weights).astype(np.float32), rate, step)
            _adam(state, "b", model.bias, (back * (places < 0)).sum(0).astype(np.float32), rate, step)
            model.shift -= 0.5 * float(error.sum())
            places_used, g_words = np.concatenate(used), np.concatenate(grads)
            hit, inverse = np.unique(buckets[places_used], return_inverse=True)
            total = np.zeros((len(hit), SIZE), dtype=np.float32)
            inverse = inverse.reshape(-1, PARTS)
            for j in range(PARTS):
                np.add.at(total, inverse[:, j], g_words)
            model.embedding[hit] -= np.where(often[hit, None], np.clip(5.0 * total, -0.1, 0.1), 0)
    fitted = np.flatnonzero(unseen) if unseen.any() else rows

    def raw(i: int) -> float:
        words = model.embedding[docs[i]].sum(1)
        return float(model.pooled(words, np.arange(len(words)), np.array([len(words)]))[0][0] @ model.weights + model.shift)

    outs = np.array([raw(i) for i in fitted])
    model.slope, model.offset = logistic(outs, y[fitted])
    model.fitted = np.flatnonzero(~unseen) if unseen.any() else model.fitted
    return model


def _language(docs: DataFrame) -> Column:
    """The hash value of a row's lang, null without one."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return (F.crc32(lang.cast("binary")) % LANGUAGES).cast("int")


def _usable(usable: Column | None) -> Column:
    return ~held_out(FOLDS, OUT_FOLD) if usable is None else usable


def within(sizes: list[tuple[int, int, int]], words: int) -> set[int]:
    """The doc_ids, of rows (doc_id, label, words) in order, that keep either class within so many words."""
    left = {0: words, 1: words}
    kept = set()
    for doc_id, label, size in sizes:
        if size <= left[label]:
            left[label] -= size
            kept.add(doc_id)
    return kept


def fit_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, usable: Column | None = None, most_words: int = WORDS) -> Convolution:
    """Fits on the sample of labelled documents outside the held-out fold; without thresholds. Its fitted are doc_ids."""
    usable = _usable(usable)
    some = labelled(labels.where("toxic = 1"), "toxic", usable, sample).unionByName(labelled(labels.where("toxic = 0"), "toxic", usable, sample))
    some = some.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", "label")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(some), "doc_id")

    def work(rows: pa.Table) -> pa.Table:
        buckets, which, lengths = batch_words(binary_column(rows, "text"))
        flat, starts = buckets[which].astype("<i4"), offsets_of(lengths)
        return pa.table({"doc_id": rows["doc_id"], "label": rows["label"], "n": pa.array(lengths), "words": pa.array([flat[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary())})

    found = written(each_batch(known, work, "doc_id long, label int, n long, words binary"), "words")
    sizes = found.groupBy("doc_id", "label").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # a row for each of the sample
    kept = within([tuple(r) for r in sizes], most_words)
    got = found.where(F.col("doc_id").isin(*kept)).drop("n").toArrow() if kept else found.limit(0).drop("n").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("words", "ascending")])
    order = np.argsort((np.array(got["doc_id"].to_pylist(), dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), kind="stable")
    words = [np.frombuffer(w, dtype="<i4").reshape(-1, PARTS) for w in got["words"].to_pylist()]
    model = fit([words[i] for i in order], got["label"].to_numpy()[order].astype(int))
    model.fitted = got["doc_id"].to_numpy()[order][model.fitted]
    return model


def calibrate(model: Convolution, scores: DataFrame, labels: DataFrame, usable: Column | None = None) -> Convolution:
    """Sets the thresholds from scores (doc_id, language, score) of all usable labelled rows that the model was not fitted on."""
    if model.constant is not None:
        return model
    agreed = labels.where(_usable(usable) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("label"), F.max("toxic").alias("most"))
    learned = scores.sparkSession.createDataFrame([(int(i),) for i in model.fitted], "doc_id long")
    known = agreed.where("label = most").select("doc_id", F.col("label").cast("int").alias("label")).join(F.broadcast(learned), "doc_id", "left_anti")
    step = F.floor(F.col("score") * STEPS).cast("int").alias("step")
    met = scores.groupBy("doc_id", "language", step).agg(F.count(F.lit(1)).alias("n")).join(known, "doc_id")
    own = met.groupBy("language", "label", "step").agg(F.sum("n").alias("n"))
    every = own.groupBy("label", "step").agg(F.sum("n").alias("n")).withColumn("language", F.lit(None).cast("int"))
    counts = own.where("language IS NOT NULL").unionByName(every)
    group = Window.partitionBy("language", "label")
    ranked = counts.withColumns({"upto": F.sum("n").over(group.orderBy("step")), "total": F.sum("n").over(group)})
    clean, toxic = F.col("label") == 0, F.col("label") == 1
    quantiles = ranked.groupBy("language").agg(
        F.min(F.when(clean & (F.col("upto") >= 0.99 * F.col("total")), F.col("step"))).alias("low"),
        F.min(F.when(toxic & (F.col("upto") >= 0.02 * F.col("total")), F.col("step"))).alias("high"),
        F.max(F.when(clean, F.col("total"))).alias("clean"),
        F.max(F.when(toxic, F.col("total"))).alias("toxic"),
    )
    rows = quantiles.where((F.col("clean") >= LEAST) & (F.col("toxic") >= LEAST)).collect()  # a row for each of LANGUAGES at most
    model.thresholds = {r["language"]: float(np.clip((r["low"] + r["high"] + 1) / 2 / STEPS, *THRESHOLDS)) for r in rows}
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, usable: Column | None = None, most_words: int = WORDS) -> Convolution:
    """The classifier with its thresholds, from labelled documents outside the held-out fold."""
    model = fit_sample(docs, labels, sample, usable, most_words)
    return calibrate(model, _scores(docs, model), labels, usable)


def _scores(docs: DataFrame, model: Convolution) -> DataFrame:
    """doc_id, held_out, language, score of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(rows: pa.Table) -> pa.Table:
        found = shipped.value.score(binary_column(rows, "text"))
        return rows.drop_columns("text").append_column("score", pa.array(found, pa.float64()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(FOLDS, OUT_FOLD), F.lit(False)).alias("held_out"), _language(docs).alias("language"), F.col("text").cast("binary").alias("text"))
    return each_batch(rows, work, "doc_id long, held_out boolean, language int, score double", 4 << 20)


def _with_threshold(rows: DataFrame, model: Convolution, language: str, threshold: str) -> DataFrame:
    """rows with the threshold of their language; the table of thresholds has at most LANGUAGES rows."""
    own = [(k, v) for k, v in model.thresholds.items() if k is not None]
    limits = rows.sparkSession.createDataFrame(own, f"`{language}` int, `{threshold}` double")
    return rows.join(F.broadcast(limits), language, "left").withColumn(threshold, F.coalesce(F.col(threshold), F.lit(model.threshold(None))))


def _flagged(scores: DataFrame, model: Convolution) -> DataFrame:
    out = _with_threshold(scores, model, "language", "threshold")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def score(docs: DataFrame, model: Convolution) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, flagged of every row."""
    return _flagged(_scores(docs, model), model)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not flagged, with all their columns. Each text is scored once: rows wait in the shared folder for the thresholds."""
    model = fit_sample(docs, labels)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    more = {n: n for n in ("score", "language", "threshold")}
    while set(more.values()) & {n.lower() for n in names}:
        more = {n: f"_{v}" for n, v in more.items()}

    def work(rows: pa.Table) -> pa.Table:
        return rows.append_column(more["score"], pa.array(shipped.value.score(binary_column(rows, "text")), pa.float64()))

    rows = docs.withColumn(more["language"], _language(docs))
    schema = StructType([*rows.schema.fields, StructField(more["score"], DoubleType())])
    found = written(each_batch(rows, work, schema, 4 << 20), "scored")
    calibrate(model, found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(more["language"]).alias("language"), F.col(more["score"]).alias("score")), labels)
    return _with_threshold(found, model, more["language"], more["threshold"]).where(F.col(more["score"]) < F.col(more["threshold"])).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_sample(docs, labels)
    scores = written(_scores(docs, model), "scores")
    return _flagged(scores, calibrate(model, scores, labels))
