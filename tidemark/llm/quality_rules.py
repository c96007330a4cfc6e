"""Quality rules: counts with fixed limits, then the length-normalised log-likelihood ratio of hashed n-grams.

Two multinomials over hashed byte n-grams are counted: one over all documents, one over trusted ones. A document's score
is the mean over its n-grams of the logarithm of the trusted probability over the raw one. Trusted documents are scored
with their own counts taken out, so that their scores are like those of unseen text; the score that all but a small share
of them reach is the threshold for every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _columnar as C
from tidemark.llm._session import cut, partitions
from tidemark.llm.quality import held_out

#: Lengths of the n-grams in bytes, white space being one byte of its kind; the hash keeps so many bits.
LENGTHS, BITS = (2, 3, 4), 16
#: What is added to the raw count of every bucket, and in proportion to the trusted counts.
PSEUDO = 1.0
#: Up to so many ids of trusted documents are broadcast; more are joined by a shuffle.
TRUSTED = 200_000
#: The share of trusted documents that the threshold may lose.
LOSS = 0.005
#: Scores are counted in bins of this width, from -REACH to REACH.
WIDTH, REACH = 1 / 1024, 24.0
#: The rules: fewer words than this, or more than this share of words in repeated windows of three, fail.
LEAST_WORDS, MOST_REPEATED, REPEATED_RUN = 50, 0.5, 3
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CONTINUED = (np.arange(256) & 0xC0) == 0x80
_ODD = C.U64(0x9E3779B97F4A7C15)


def buckets(text: np.ndarray, lengths: tuple[int, ...] = LENGTHS, bits: int = BITS) -> np.ndarray:
    """The bucket of each n-gram of a text's bytes."""
    x = np.where(C.SPACE[text], np.uint8(32), text).astype(np.uint64)
    out = []
    for n in lengths:
        k = np.full(max(0, len(x) - n + 1), n, np.uint64)
        for i in range(n):
            k = (k << C.U64(8)) | x[i : i + len(k)]
        out.append(((k * _ODD) >> C.U64(64 - bits)).astype(np.int64))
    return np.concatenate(out)


@dataclass(frozen=True)
class Ratio:
    """Counts by bucket; what a document scores."""

    trusted: np.ndarray
    raw: np.ndarray

    def _logs(self, counts: np.ndarray, pseudo: float) -> np.ndarray:
        return np.log(counts + pseudo) - np.log(max(counts.sum(), 1) + pseudo * len(counts))

    @property
    def share(self) -> float:
        return PSEUDO * self.trusted.sum() / max(self.raw.sum(), 1)

    def table(self) -> np.ndarray:
        """The ratio of each bucket; nothing is known of any without trusted n-grams."""
        if not self.trusted.any():
            return np.zeros(len(self.raw))
        return self._logs(self.trusted, self.share) - self._logs(self.raw, PSEUDO)

    def score(self, found: np.ndarray, table: np.ndarray, own: bool) -> float:
        """The mean ratio of the buckets found; own: their counts are taken out of the trusted ones first."""
        if not len(found):
            return 0.0
        if not own:
            return float(table[found].sum() / len(found))
        at, n = np.unique(found, return_counts=True)
        share, total = self.share, self.trusted.sum()
        left = np.log(np.maximum(self.trusted[at] - n, 0) + share) - np.log(max(total - len(found), 1) + share * len(self.raw))
        was = np.log(self.trusted[at] + share) - np.log(max(total, 1) + share * len(self.raw))
        return float(((table[at] - was + left) * n).sum() / len(found))


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of a batch; null is empty."""
    for text in C.binary(column):
        yield np.frombuffer(text.as_buffer(), np.uint8)


def measure(text: np.ndarray) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, duplicate lines, words in repeated windows) of a text's bytes."""
    start, end, counts = C.words(text, np.array([len(text)]))
    n = len(start)
    chars = int((~C.SPACE[text] & ~_CONTINUED[text]).sum())
    symbols = int(_SYMBOLS[text].sum())
    repeated = 0
    if n >= REPEATED_RUN:
        runs = C.Rolling(C.word_codes(text, start, end)).grams(REPEATED_RUN)
        _, back, times = np.unique(runs, return_inverse=True, return_counts=True)
        flags = np.zeros(n, bool)
        flags[: len(runs)] = times[back] > 1
        repeated = int(C.spread(flags, REPEATED_RUN).sum())
    seen: set[bytes] = set()
    duplicates = 0
    for line in text.tobytes().split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            duplicates += line in seen
            seen.add(line)
    return n, chars, symbols, duplicates, repeated


def trusted_ids(labels: DataFrame, most: int | None = None, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The ids whose labels are 1 on the whole and that aren't held out; where a caller asks for so many at ``most``, those with the smallest hashes."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).dropna()
    good = cut(known.groupBy("doc_id").agg(F.avg("label").alias("label")).filter("label >= 0.5").filter(~held_out(F.col("doc_id"))).select("doc_id"))
    if most is None:
        return good
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    n, chosen, share = good.count(), good, 1.0
    while n > most:
        share *= 0.99 * most / n
        chosen = good.filter(unit < share)
        n = chosen.count()
    return chosen


def count_ngrams(docs: DataFrame, bits: int = BITS) -> Ratio:
    """Both multinomials over docs (text, trusted); tasks add up before they send, the driver gets a number a bucket."""
    size = 1 << bits

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for text, trusted in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(buckets(text, bits=bits), minlength=size)
                total[1] += n
                if trusted:
                    total[0] += n
            C.release()
        at = np.flatnonzero(total.ravel())
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["k", "v"])

    found = docs.select("text", "trusted").mapInArrow(task, "k int, v bigint").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(2 * size)
    out[found["k"].to_numpy()] = found["v"].to_numpy()
    return Ratio(out[:size], out[size:])


_ROW = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, score double, trusted boolean"


def _measured(docs: DataFrame, ratio: Ratio) -> DataFrame:
    names = [x.split()[0] for x in _ROW.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.table()
        for batch in batches:
            trusted = batch.column(2).to_pylist()
            texts = list(_texts(batch.column(1)))
            counts = np.array([measure(t) for t in texts], np.int64).reshape(-1, 5)
            scores = [ratio.score(buckets(t), table, own) for t, own in zip(texts, trusted, strict=True)]
            yield pa.record_batch([batch.column(0), *(pa.array(c) for c in counts.T), pa.array(scores, pa.float64()), batch.column(2)], names=names)
            C.release()

    return docs.select("doc_id", "text", "trusted").mapInArrow(task, _ROW)


def threshold(rows: DataFrame, loss: float = LOSS) -> float | None:
    """The lower edge of the bin up to which ``loss`` of the trusted documents that pass the rules lie; None without any."""
    at = F.floor(F.least(F.greatest(F.col("score"), F.lit(-REACH)), F.lit(REACH)) / WIDTH).cast("long")
    counted = rows.filter("trusted AND NOT base_failed").groupBy(at.alias("at")).count().orderBy("at").collect()
    left = loss * sum(r["count"] for r in counted)
    for r in counted:
        if r["count"] > left:
            return r["at"] * WIDTH
        left -= r["count"]
    return None


def apply_rules(docs: DataFrame, labels: DataFrame, loss: float = LOSS, most: int = TRUSTED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, threshold and kept of every row.

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED of the words in windows of three words found
    twice or more. kept: not base_failed, and a score of the threshold or more. Trusted are documents with label 1 that
    aren't held out; all of them are counted. Up to ``most`` ids are broadcast; beyond that the texts are shuffled to them.

    A null or empty text has no words and score 0; a text may be as long as a cell, and is worked on whole; a null id is
    never trusted; several labels of an id count by their mean; rows that share an id, or are the same, each get a row;
    a score equal to the threshold is kept; without trusted n-grams every score is 0, and with no trusted document that
    passes the rules there is no threshold (null) and the rules alone decide; an empty table gives none. Other columns are never read, whatever their names.
    """
    partitions(docs.sparkSession)
    trusted = trusted_ids(labels, label_col=label_col).select(F.col("doc_id").alias("trusted_id"))
    trusted = F.broadcast(trusted) if trusted.count() <= most else trusted
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(trusted, F.col("doc_id") == F.col("trusted_id"), "left").select("doc_id", "text", F.col("trusted_id").isNotNull().alias("trusted"))
    found = _measured(rows, count_ngrams(rows))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = cut(found.withColumn("base_failed", failed))
    limit = threshold(found, loss)
    kept = F.lit(True) if limit is None else F.col("score") >= limit
    return found.withColumn("threshold", F.lit(limit).cast("double")).withColumn("kept", ~F.col("base_failed") & kept)
