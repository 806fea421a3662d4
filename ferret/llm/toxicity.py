"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters (code points,
hashed to 32 bits). Each feature is scaled by its log ratio of document frequencies in
toxic and clean training texts, and a logistic regression is trained on the scaled features.

Training fits on a bounded sample (``MAX_PER_CLASS`` labelled rows of either class, those
with the least key hash; the class shares of all labelled rows set the intercept). Spark
counts its features and selects the ``MAX_FEATURES`` that tell the classes apart best; the
driver holds those and, for each sampled text, the places of the ones it has. Scoring
runs over all rows in one pass without a shuffle; the model (at most ``MAX_FEATURES``
hashes and weights) is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, prepare

#: n-gram lengths in characters.
ORDERS = (4, 5, 6, 8)
MAX_PER_CLASS = 1500
MAX_FEATURES = 30_000
#: A feature occurs in so many sampled texts at least.
MIN_TEXTS = 4
CUT = 0.3
FOLDS, HELD_OUT = 4, 2
BASE = np.uint32(0x01000193)
GAP = "\0" * max(ORDERS)
CHUNK = 1 << 18


def ngram_hashes(text: str) -> list[np.ndarray]:
    """For each order the hash of the n-gram that starts at each character."""
    b = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out, h = [], np.zeros(len(b), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            break
        h = h[:len(b) - n + 1] * BASE + b[n - 1:] + np.uint32(1)
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
            out.append(x ^ (x >> np.uint32(15)))
    return out


def normal(text: str) -> str:
    """Lower-cased, white space as one space, one space on either side."""
    return f" {' '.join(text.lower().split())} "


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float
    #: Log odds of label 1 among all labelled rows: what a text without any feature gets.
    prior: float

    def __post_init__(self):
        self.flags = np.zeros(1 << 20, np.bool_)  # passes few other hashes to the exact search
        self.flags[self.features >> np.uint32(12)] = True

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text; texts are read in runs of about CHUNK characters."""
        total, seen = np.full(len(texts), self.intercept), np.zeros(len(texts), bool)
        run, starts, first, size = [], [], 0, 0
        for i, t in enumerate(texts):
            data = normal(t)
            run.append(data)
            starts.append(size)
            size += len(data) + len(GAP)
            if size >= CHUNK or i == len(texts) - 1:
                self._add(GAP.join(run), np.array(starts), total[first:i + 1], seen[first:i + 1])
                run, starts, first, size = [], [], i + 1, 0
        return 1 / (1 + np.exp(-np.clip(np.where(seen, total, self.prior), -40, 40)))

    def _add(self, data, starts, total, seen):
        docs, found = [], []
        for h in ngram_hashes(data):
            at = np.flatnonzero(self.flags[h >> np.uint32(12)])
            x = h[at]
            f = np.minimum(np.searchsorted(self.features, x), len(self.features) - 1)
            hit = self.features[f] == x
            docs.append(np.searchsorted(starts, at[hit], side="right") - 1)
            found.append(f[hit])
        if docs:
            pairs = np.unique(np.concatenate(docs) * np.int64(len(self.features)) + np.concatenate(found))
            np.add.at(total, pairs // len(self.features), self.weights[pairs % len(self.features)])
            seen[pairs // len(self.features)] = True


def _distinct(text: str) -> np.ndarray:
    h = ngram_hashes(normal(text))
    return np.unique(np.concatenate(h)) if h else np.zeros(0, np.uint32)


def _frequencies(batches):
    """Per feature the texts of a task that have it, by label."""
    found: dict = {0: [], 1: []}
    for b in batches:
        for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
            found[label].append(_distinct(text))
    for label, sets in found.items():
        if sets:
            f, n = np.unique(np.concatenate(sets), return_counts=True)
            for lo in range(0, len(f), 100_000):
                part = n[lo:lo + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f[lo:lo + 100_000].astype(np.int64)), pa.array(part * label), pa.array(part * (1 - label))], ["f", "pos", "neg"])


def _present(features):
    """The places in ``features`` of those that each text has."""
    def run(batches):
        for b in batches:
            places = []
            for text in b.column("text").to_pylist():
                s = _distinct(text)
                at = np.minimum(np.searchsorted(features, s), len(features) - 1)
                places.append(at[features[at] == s].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(places, pa.binary())], ["label", "places"])
    return run


def fit(features: np.ndarray, ratio: np.ndarray, places: list[np.ndarray], labels: np.ndarray, share: float, steps: int = 300, l2: float = 1e-3) -> Model:
    """Logistic regression on scaled features. places: for each sampled text the features it
    has; share: of label 1 among all labelled rows."""
    pos = int(labels.sum())
    neg = len(labels) - pos
    prior = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if not len(features) or not pos or not neg:  # nothing to tell the classes apart
        return Model(np.zeros(1, np.uint32), np.zeros(1), float(prior), float(prior))
    row, col = np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate(places)
    w, b = np.zeros(len(features)), 0.0
    m, s = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for step in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(row, (w * ratio)[col], len(labels)) + b
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        g = np.append(np.bincount(col, e[row], len(features)) * ratio / len(labels) + l2 * w, e.mean())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        d = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    return Model(features, w * ratio, float(b + prior - np.log(pos / neg)), float(prior))


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out. A null id counts as the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled documents outside the held-out fold. Null labels and ids without a
    document are left out; a document with several labels counts as toxic if one says so."""
    prepare(docs.sparkSession)
    marked = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")) \
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("id")) != HELD_OUT)) \
        .groupBy("id").agg(F.max("label").alias("label"))
    of = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (of.get(1, 0) + 0.5) / (sum(of.values()) + 1)
    order = F.xxhash64("id")
    chosen = marked.where("label = 1").orderBy(order, "id").limit(MAX_PER_CLASS).unionByName(
        marked.where("label = 0").orderBy(order, "id").limit(MAX_PER_CLASS))
    sample = materialise(id_text(docs, id_col, text_col).join(F.broadcast(chosen), "id").groupBy("id").agg(
        F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text"), "sample")
    of_sample = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = of_sample.get(1, 0), of_sample.get(0, 0)
    counts = sample.mapInArrow(_frequencies, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # How much of the classes' difference a feature tells: its log ratio times its frequency difference.
    ratio = F.log((F.col("pos") + 1) / F.lit(pos + 2.0)) - F.log((F.col("neg") + 1) / F.lit(neg + 2.0))
    best = counts.where(F.col("pos") + F.col("neg") >= MIN_TEXTS).withColumn("ratio", ratio).orderBy(
        F.desc(F.col("ratio") * (F.col("pos") / F.lit(max(pos, 1)) - F.col("neg") / F.lit(max(neg, 1)))), "f").limit(MAX_FEATURES).select("f", "ratio").toArrow()
    order = np.argsort(best.column("f").to_numpy())
    features = best.column("f").to_numpy()[order].astype(np.uint32)
    if not len(features) or not pos or not neg:
        return fit(features, np.zeros(0), [], np.zeros(0), share)
    rows = sample.mapInArrow(_present(features), "label int, places binary").toArrow()
    places = [np.frombuffer(p, np.int32) for p in rows.column("places").to_pylist()]
    return fit(features, best.column("ratio").to_numpy()[order], places, np.array(rows.column("label").to_pylist(), np.float64), share)


def scorer(spark, model: Model):
    """A column function from text to score in 0 to 1; null texts are scored as empty ones."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(text.fillna("").tolist()))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= cut), a row per input row.

    Only the text decides a score. Null, empty and other texts without any of the model's features get the share of
    label 1 among the labelled rows as their score, repeated rows the same score each; an empty table gives no rows, and without labels of
    both classes every row has the same low score.
    """
    score = scorer(docs.sparkSession, train(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == HELD_OUT).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = CUT) -> DataFrame:
    """The documents with a score below ``cut``, with all their columns, in one pass."""
    score = scorer(docs.sparkSession, train(docs, labels, id_col, text_col, label_col))
    return docs.where(score(F.col(text_col)) < cut)
