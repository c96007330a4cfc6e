"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk of a linear model on text measures.

The loss is the square of the distance from 1 or -1, so the risk follows from the means of the measures and of their
products over the trusted positives and over all documents. Those are two aggregations; nothing is sampled, and label 0
is never looked at. The class prior is estimated from the scores: the share of documents above a threshold over that of
positives above it is no smaller than the prior, and the smallest such quotient is taken for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _columnar as C
from tidemark.llm._session import cut
from tidemark.runtime import ship

THRESHOLD = 0.3
FOLDS = 5
#: Rounds of fitting and estimating the prior, from this prior on; weight of the penalty on weights.
ROUNDS, FIRST_PRIOR, PENALTY = 3, 0.5, 1e-3
#: Scores are counted in so many bins from -REACH to REACH.
BINS, REACH = 4_096, 4.0

_BYTES = np.arange(256)
_KINDS = np.stack(
    [
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 97) & (_BYTES <= 122),
        (_BYTES >= 48) & (_BYTES <= 57),
        _BYTES == 10,
        np.isin(_BYTES, list(b"!")),
        np.isin(_BYTES, list(b"|")),
        np.isin(_BYTES, list(b"*#$%&@~^=_+\\/<>{}[]")),
        np.isin(_BYTES, list(b".,;:?'\"()-")),
        _BYTES >= 128,
    ]
).astype(np.float64)
MEASURES = 18


def measure(text: bytes) -> np.ndarray:
    """What the model sees of a text: shares of kinds of bytes, repetition of words and lines, lengths."""
    out = np.zeros(MEASURES)
    words = text.split()
    if not words:
        return out
    shares = _KINDS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text)
    n, lines = len(words), [x for x in text.split(b"\n") if x.strip()]
    kinds, lengths = len(set(words)), np.fromiter(map(len, words), np.int64, n)
    out[: len(shares)] = np.log(shares + 0.002)
    out[9] = np.log(sum(map(eq, words, words[1:])) / n + 0.005)
    out[10] = np.log(sum(map(eq, words, words[2:])) / n + 0.005)
    out[11] = np.log(kinds / n)
    out[12] = np.log(kinds / n**0.85)
    out[13] = np.log(1 - len(set(lines)) / len(lines) + 0.02)
    out[14] = np.log(lengths.mean())
    out[15] = np.log((lengths > 25).mean() + 0.01)
    out[16] = np.log1p(n)
    out[17] = sum(map(eq, words, words[1:])) / n
    return out


@dataclass(frozen=True)
class Model:
    """score = (1 + terms of the standardised measures @ weights) / 2, kept within 0 and 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def terms(self, measures: np.ndarray) -> np.ndarray:
        z = np.clip((measures - self.mean) / self.scale, -8, 8)
        return np.hstack([z, z * z / 8, np.ones((len(z), 1))])

    def margin(self, measures: np.ndarray) -> np.ndarray:
        return self.terms(measures) @ self.weights

    def score(self, measures: np.ndarray) -> np.ndarray:
        return np.clip((1 + self.margin(measures)) / 2, 0, 1)


def _totals(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over rows of what ``of`` makes of a batch's measures, always as many numbers; tasks add up before they send."""
    size = len(of(np.zeros((0, MEASURES))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(_matrix(batch.column(0)))
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["k", "v"])

    found = rows.select("m").mapInArrow(task, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[found["k"].to_numpy()] = found["v"].to_numpy()
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in chunks)])
    return flat.reshape(-1, MEASURES).astype(np.float64)


def minimise(positive: tuple[np.ndarray, np.ndarray], every: tuple[np.ndarray, np.ndarray], prior: float) -> np.ndarray:
    """The weights that minimise prior * R+(positive) + max(0, R-(every) - prior * R-(positive)) under the square loss.

    positive, every: the means of the terms' products and of the terms. Where the second part would fall below zero, its
    weight is lowered until it is zero.
    """
    (mp, ap), (mu, au) = positive, every
    penalty = np.full(len(ap), PENALTY)
    penalty[-1] = 1e-9

    def at(share: float) -> np.ndarray:
        matrix = prior * mp + share * (mu - prior * mp) + np.diag(penalty)
        return np.linalg.solve(matrix, prior * ap - share * (au - prior * ap))

    def rest(w: np.ndarray) -> float:
        return float(1 + 2 * au @ w + w @ mu @ w - prior * (1 + 2 * ap @ w + w @ mp @ w))

    w, low, high = at(1.0), 0.0, 1.0
    if rest(w) >= 0:
        return w
    for _ in range(30):
        share = (low + high) / 2
        low, high = (share, high) if rest(at(share)) >= 0 else (low, share)
    return at(low)


def estimate_prior(positive: np.ndarray, every: np.ndarray) -> float:
    """The least share of all scores above a threshold over that of the positives' scores, from counts by bin.

    Thresholds that leave under two fifths of the positives are too rough to count.
    """
    above = lambda n: np.cumsum(n[::-1])[::-1] / max(n.sum(), 1)
    of_positive, of_every = above(positive), above(every)
    some = of_positive >= 0.4
    return float(np.clip((of_every[some] / of_positive[some]).min(), 0.05, 0.99))


def fit_pu(positives: DataFrame, every: DataFrame) -> Model | None:
    """The model for measures (m) of trusted positives and of all documents; None where either has no rows."""
    n_u, n_p = every.count(), positives.count()
    if not n_u or not n_p:
        return None
    sums = _totals(every, lambda x: np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)])) / n_u
    mean = sums[:MEASURES]
    scale = np.sqrt(np.maximum(sums[MEASURES:] - mean * mean, 0))
    scale[scale < 1e-6] = 1.0
    bare = Model(mean, scale, np.zeros(0))

    def moments(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        def of(x: np.ndarray) -> np.ndarray:
            t = bare.terms(x)
            return np.concatenate([(t.T @ t).ravel(), t.sum(axis=0)])

        total = _totals(rows, of) / n
        return total[: -2 * MEASURES - 1].reshape(2 * MEASURES + 1, -1), total[-2 * MEASURES - 1 :]

    def counts(rows: DataFrame, model: Model) -> np.ndarray:
        return _totals(rows, lambda x: np.histogram(np.clip(model.margin(x), -REACH, REACH), BINS, (-REACH, REACH))[0].astype(float))

    of_positive, of_every, prior = moments(positives, n_p), moments(every, n_u), FIRST_PRIOR
    for _ in range(ROUNDS):
        model = Model(mean, scale, minimise(of_positive, of_every, prior))
        prior = estimate_prior(counts(positives, model), counts(every, model))
    return Model(mean, scale, minimise(of_positive, of_every, prior))


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept from learning: crc32 of its id as text leaves no rest by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def measures(text: Column) -> Column:
    ship(SparkSession.active())

    @F.arrow_udf("array<float>")
    def of(texts: pa.Array) -> pa.Array:
        rows = [measure(t.as_buffer().to_pybytes()).astype(np.float32) for t in C.binary(texts)]
        flat = np.concatenate([np.zeros(0, np.float32), *rows])
        C.release()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * MEASURES), pa.array(flat))

    return of(text)


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out and the measures m of each row, kept in the shared folder: 80 bytes a document."""
    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), measures(F.col(text_col)).alias("m")))


def fit_quality(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """Learn from all documents that aren't held out, and from which of them have label 1; None where none has."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).dropna()
    good = known.groupBy("doc_id").agg(F.avg("label").alias("label")).filter("label >= 0.5")
    learning = measured.filter("NOT held_out")
    return fit_pu(cut(learning.join(good, "doc_id", "left_semi").select("m")), learning)


def quality_score(text: Column, model: Model | None) -> Column:
    """The model's score of a text, 0 to 1; without a model 0.5."""
    ship(SparkSession.active())
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        rows = [measure(t.as_buffer().to_pybytes()) for t in C.binary(texts)]
        C.release()
        return pa.array(model.score(np.array(rows).reshape(len(rows), MEASURES).astype(np.float32).astype(float)))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs' ids with held_out, score and predicted (1 where the score is THRESHOLD or more).

    A null or empty text has the score that the model gives a text without words; texts may be as long as a cell; a null
    id isn't held out and has no label; several labels of an id count by their mean, null ones not at all; rows that
    share an id, or are the same, each get a row. With no labels of kind 1 every score is 0.5; an empty table gives none.
    Other columns are never read, whatever their names.
    """
    rows = _measured(docs, id_col, text_col)
    model = fit_quality(rows, labels, id_col, label_col)
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def score(m: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(m)))

    scored = rows.select("doc_id", "held_out", (F.lit(0.5) if model is None else score("m")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their own columns.

    Nulls, empty and long texts, repeated rows and ids count as in ``score_quality``; without labels of kind 1 all rows
    stay; an empty table gives none.
    """
    model = fit_quality(_measured(docs, id_col, text_col), labels, id_col)
    return docs.filter(quality_score(F.col(text_col), model) >= THRESHOLD)
