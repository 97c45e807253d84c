"""Quality by ordinal cumulative-link regression on hashed text.

Ratings are grades 0 to K - 1. One weight vector over hashed features of a
text gives a position on a line, ordered thresholds cut the line into grades:
P(grade > k) = sigmoid(position - threshold[k]). A text's expected grade is the
sum of these tail probabilities, and one of them selects texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import STATS, text_stats
from .runtime import bounded_batches
from .words import column, doc_slices, hash_words, mix

_U = np.uint64


def _features(texts: pa.Array, bits: int):
    """Yield (number of documents, document, feature, value) of slices: shares of byte triples and words, and levels of statistics, hashed."""
    data, offs = column(texts)
    stats = text_stats(texts)
    n = np.maximum(stats["n_words"], 1)
    levels = [np.floor(np.log2(stats["n_words"] + 1))] + [np.ceil(12 * np.sqrt(stats[k] / n)) for k in STATS[2:]] + [np.floor(stats["word_chars"] / n)]
    for i, j in doc_slices(offs, 2 << 20):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        doc, key, value = [], [], []
        size = np.diff(o)
        if len(d) > 2:
            x = d.astype(_U)
            h = x[:-2] << _U(16) | x[1:-1] << _U(8) | x[2:]
            owner = np.repeat(np.arange(j - i), size)[:-2]
            ok = np.arange(len(h)) + 3 <= o[1:][owner]
            k, c = np.unique(owner[ok].astype(_U) << _U(32) | mix(h[ok]) >> _U(64 - bits), return_counts=True)
            doc.append((k >> _U(32)).astype(np.int64))
            key.append((k & _U(0xFFFFFFFF)).astype(np.int64))
            value.append(10 * c / np.maximum(size - 2, 1)[doc[-1]])
        w, _, _, first = hash_words(d, o)
        if len(w):
            owner = np.repeat(np.arange(j - i), np.diff(first))
            k, c = np.unique(owner.astype(_U) << _U(32) | w >> _U(64 - bits), return_counts=True)
            doc.append((k >> _U(32)).astype(np.int64))
            key.append((k & _U(0xFFFFFFFF)).astype(np.int64) + (1 << bits))
            value.append(5 * c / np.diff(first)[doc[-1]])
        for s, level in enumerate(levels):
            doc.append(np.arange(j - i))
            key.append((2 << bits) + s * 64 + np.clip(level[i:j], 0, 63).astype(np.int64))
            value.append(np.ones(j - i))
        yield j - i, np.concatenate(doc), np.concatenate(key), np.concatenate(value)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def positions(self, texts: pa.Array) -> np.ndarray:
        parts = [np.bincount(doc, self.weights[key] * value, n) for n, doc, key, value in _features(texts, self.bits)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def tails(self, positions: np.ndarray) -> np.ndarray:
        """P(grade > k) of each text, k from 0; falling in k as thresholds rise."""
        return 1 / (1 + np.exp(-np.clip(positions[:, None] - self.thresholds, -40, 40)))


def fit(texts: list[str | None], grades: list[int], n_grades: int, bits: int = 15, steps: int = 150, rate: float = 0.05, l2: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood by full-batch Adam; thresholds are a first one plus positive gaps, so they stay in order.

    Grades weigh by the inverse root of their counts. Without texts the model gives grade tails of one half and less.
    """
    y = np.array(grades, int)
    size = (2 << bits) + 64 * (len(STATS) - 2 + 2)
    w, first, gaps = np.zeros(size), 0.0, np.zeros(n_grades - 2)
    if not len(y):
        return OrdinalModel(w, np.arange(n_grades - 1, dtype=float), bits)
    doc, key, value, at = [], [], [], 0
    for n, d, k, v in _features(pa.array(texts, pa.string()), bits):
        doc.append(d + at)
        key.append(k)
        value.append(v)
        at += n
    doc, key, value = np.concatenate(doc), np.concatenate(key), np.concatenate(value)
    count = np.bincount(y, minlength=n_grades)
    weight = (1 / np.sqrt(np.maximum(count, 1)))[y]
    weight /= weight.sum()
    state = [np.zeros(size + 1 + len(gaps)) for _ in range(2)]
    theta = np.concatenate((w, [first], gaps))
    for t in range(1, steps + 1):
        cut = np.concatenate(([theta[size]], theta[size] + np.cumsum(np.exp(theta[size + 1 :]))))
        x = np.bincount(doc, theta[:size][key] * value, len(y))
        tail = 1 / (1 + np.exp(-np.clip(x[:, None] - cut, -40, 40)))
        full = np.hstack((np.ones((len(y), 1)), tail, np.zeros((len(y), 1))))
        p = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-9)
        slope = full * (1 - full)
        up, down = slope[np.arange(len(y)), y], slope[np.arange(len(y)), y + 1]
        gx = -weight * (up - down) / p
        g = np.zeros_like(theta)
        g[:size] = np.bincount(key, gx[doc] * value, size) + l2 * theta[:size]
        gc = np.zeros(n_grades + 1)
        np.add.at(gc, y, weight * up / p)
        np.add.at(gc, y + 1, -weight * down / p)
        gc = gc[1:n_grades]
        g[size] = gc.sum()
        for k in range(len(gaps)):
            g[size + 1 + k] = gc[k + 1 :].sum() * np.exp(theta[size + 1 + k])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        theta -= rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
    cut = np.concatenate(([theta[size]], theta[size] + np.cumsum(np.exp(theta[size + 1 :]))))
    return OrdinalModel(theta[:size].astype(np.float32), cut, bits)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 for quality 0, 1 for quality 1 with toxic 1, 2 for quality 1 without."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, max_rated: int = 6000) -> OrdinalModel:
    """A model from a bounded sample: the ``max_rated`` rated documents that come first by a hash of ``doc_id``, held-out ones left out; of repeated ratings the least."""
    known = ratings.where("doc_id is not null and grade is not null").where(~held_out()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = [(r["text"], r["grade"]) for r in texts.join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").toLocalIterator()]
    return fit([t for t, _ in rows], [y for _, y in rows], n_grades)


def rate(docs: DataFrame, model: OrdinalModel, least_grade: int = 1, selected: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, tail, kept`` of each row (``doc_id, text`` are read).

    ``tail``: probability of at least ``least_grade``; ``kept`` where it is at
    least ``selected``. Null texts count as empty.
    """
    bounded_batches(docs.sparkSession)
    b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            tails = b.value.tails(b.value.positions(batch.column(1)))
            tail = tails[:, least_grade - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= selected)], ["doc_id", "expected_grade", "tail", "kept"])

    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*kept).mapInArrow(run, "doc_id long, expected_grade double, tail double, kept boolean")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rate(docs, model).select("doc_id", held_out().alias("held_out"), "expected_grade", "tail", "kept")
