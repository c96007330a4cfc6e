"""Stupid-backoff language-model scores: n-gram counts dealt out by hash, joined to each document's n-grams, summed.

The corpus is the model: a document is scored with the counts of all other documents. Documents are dealt into chunks;
a chunk sends each of its distinct n-grams with its count to the n-gram's bucket, a bucket adds up and answers every
chunk with the totals of what it sent, in the order sent; the chunk joins them to its n-grams, takes each document's own
counts off and sums the scores. A frequent n-gram is one entry a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _columnar as C
from tidemark.llm._session import partitions

U64 = np.uint64
ORDER = 3
BACKOFF = 0.4
FAR = U64(2**32 - 1)
#: Bits of a hash within its bucket, which takes some more: at 100 buckets a GB one n-gram in twenty million shares its key.
KEY_BITS = 46
_KEY = U64((1 << KEY_BITS) - 1)
#: Stands for "any word": its count is the number of words.
_ANY = U64(0x5A17C0FFEE15600D)

_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("near", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])
_SENT_DDL = "bucket int, chunk int, near boolean, keys binary, counts binary"
_TOTALS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary())])
_TOTALS_DDL = "chunk int, bucket int, counts binary"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])
_SCORES_DDL = "doc_id long, n_words long, log_score double"


def _grams(texts: pa.ChunkedArray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For n from 1 to order, the hash of the n-gram that ends at each word (of fewer words at a row's start), words by row."""
    parts, counts = [[] for _ in range(order)], []
    for _, buf, ends in C.batches(texts):
        start, end, n_words = C.words(buf, ends)
        codes = C.word_codes(buf, start, end)
        roll, at = C.Rolling(codes), np.arange(len(codes))
        place = at - np.repeat(np.cumsum(n_words) - n_words, n_words)
        for n in range(1, order + 1):
            size = np.minimum(place + 1, n)
            parts[n - 1].append(C.mix(roll.runs(at + 1 - size, at + 1) + size.astype(np.uint64)))
        counts.append(n_words)
    return [C.joined(p, np.uint64) for p in parts], C.joined(counts, np.int64)


def _spots(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U64(KEY_BITS)) % U64(buckets)) << U64(KEY_BITS) | (hashes & _KEY)


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, after how many of their bytes the largest fills; high bytes are mostly zero and compress."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(planes: np.ndarray) -> np.ndarray:
    width = int(planes[0])
    out = np.zeros(((len(planes) - 1) // width, 8), np.uint8)
    out[:, :width] = planes[1:].reshape(width, -1).T
    return out.view(np.uint64).ravel()


def _packed(keys: np.ndarray) -> tuple[bool, bytes]:
    """Sorted keys: by their distances in four bytes each where most are short enough, else six bytes each."""
    steps = np.diff(keys, prepend=U64(0))
    more = steps // FAR
    if more.sum() * 4 > len(keys):
        return False, np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    # A far step is split: FAR stands for "go on".
    out = np.full(len(keys) + int(more.sum()), FAR, np.uint64)
    out[np.arange(len(keys)) + np.cumsum(more).astype(np.int64)] = steps % FAR
    return True, out.astype(np.uint32).tobytes()


def _unpacked(near: bool, data: np.ndarray) -> np.ndarray:
    if near:
        steps = data.view(np.uint32).astype(np.uint64)
        return np.cumsum(steps)[steps != FAR]
    keys = np.zeros((len(data) // 6, 8), np.uint8)
    keys[:, :6] = data.reshape(-1, 6)
    return keys.view(np.uint64).ravel()


def _distinct(grams: list[np.ndarray], counts: np.ndarray, buckets: int):
    """Distinct n-grams of a chunk by bucket, how often each occurs, and which one stands at each word by n.

    Takes grams apart as it goes, so that no more than one length of n-gram is sorted at a time.
    """
    words = int(counts.sum())
    place = np.arange(words) - np.repeat(np.cumsum(counts) - counts, counts)
    spots, times, which, before = [], [], [], 0
    for n in range(len(grams)):
        # At a row's start the n-gram is the shorter one that stands there already.
        whole = np.flatnonzero(place >= n)
        kinds, back, often = np.unique(_spots(grams[n][whole], buckets), return_inverse=True, return_counts=True)
        grams[n] = None
        at = which[-1].copy() if n else np.zeros(words, np.int32)
        at[whole] = back + before
        before += len(kinds)
        spots.append(kinds)
        times.append(often)
        which.append(at)
    every = np.concatenate([*spots, _spots(np.array([_ANY]), buckets)])
    times = np.concatenate([*times, [words]])
    order = np.argsort(every, kind="stable")
    rank = np.empty(len(every), np.int32)
    rank[order] = np.arange(len(every), dtype=np.int32)
    return every[order], times[order], [rank[at] for at in which], int(rank[-1]), place


def _send(order: int, buckets: int):
    def task(docs: pa.Table) -> pa.Table:
        grams, counts = _grams(docs["text"], order)
        spots, times, _, _, _ = _distinct(grams, counts, buckets)
        chunk, rows = docs["chunk"][0].as_py(), []
        for b, at in C.split_by(spots >> U64(KEY_BITS), buckets):
            rows.append((b, chunk, *_packed(spots[at] & _KEY), _planes(times[at])))
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SENT, strict=True)], schema=_SENT)

    return task


def _add_up(table: pa.Table) -> pa.Table:
    near = table["near"].to_pylist()
    each = [_unpacked(n, x) for n, x in zip(near, C.unpack(table["keys"], np.uint8), strict=True)]
    keys = np.concatenate(each)
    counts = np.concatenate([_numbers(x) for x in C.unpack(table["counts"], np.uint8)])
    _, which = np.unique(keys, return_inverse=True)
    totals = np.bincount(which, weights=counts)[which].astype(np.uint64)
    edges = np.cumsum([0, *map(len, each)])
    packed = [_planes(totals[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return pa.table([table["chunk"], table["bucket"], pa.array(packed, pa.binary())], schema=_TOTALS)


def _score(order: int, buckets: int, backoff: float):
    def task(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return _SCORES.empty_table()
        grams, counts = _grams(docs["text"], order)
        _, times, which, any_word, place = _distinct(grams, counts, buckets)
        # By bucket the answers are in the order in which their keys stand here.
        order_sent = np.argsort(answers["bucket"].to_numpy(), kind="stable")
        packed = C.unpack(answers["counts"], np.uint8)
        totals = np.concatenate([_numbers(packed[k]) for k in order_sent]).astype(np.float64)
        row = np.repeat(np.arange(len(counts)), counts)
        others = []
        for n in range(order):
            # Of a document's own n-grams, those of whole length alone were counted.
            pairs, back, own = np.unique(row << 32 | which[n], return_inverse=True, return_counts=True)
            if n:
                own = own - np.bincount(back[place < n], minlength=len(pairs))
            others.append(np.maximum(totals[which[n]] - own[back], 0))
        words = max(totals[any_word], 1.0)
        score = np.maximum(others[0], 1.0) / words * np.where(others[0] > 0, 1.0, backoff)
        for n in range(1, order):
            # The context is the (n)-gram that ends one word earlier; its count is that of the other documents too.
            context = np.zeros(len(row))
            context[1:] = others[n - 1][:-1]
            seen = (place >= n) & (others[n] > 0) & (context > 0)
            backed = np.where(place >= n, backoff * score, score)
            score = np.where(seen, others[n] / np.maximum(context, 1.0), backed)
        logs = np.bincount(row, weights=np.log10(score), minlength=len(counts))
        return pa.table([docs["doc_id"], pa.array(counts), pa.array(logs)], schema=_SCORES)

    return task


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's stupid-backoff score under the n-gram counts of all other documents.

    docs: a row per document. Words are runs of characters other than space and tab to carriage return. A word's score
    is the count of the n-gram that ends there over the count of its context, where other documents hold both, else
    ``backoff`` times the score with one word less; at the end stands the word's count over the number of words of all
    documents, where a word that no other document has counts as one and backs off once more. A context cut by the
    start of the document is shorter and costs nothing. Returns, for each row of docs, doc_id, n_words and log_score
    (the sum of the words' log10 scores). A null or empty text has 0 words and score 0; a copy of a document is another
    document; equal ids stay rows of their own; an empty table gives none. Other columns are not read.
    """
    n = partitions(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2 * n)).cast("int")).repartition(n, "chunk")
    chunks = dealt.groupBy("chunk")
    sent = chunks.applyInArrow(C.lean(_send(order, n)), _SENT_DDL)
    totals = sent.groupBy("bucket").applyInArrow(C.lean(_add_up), _TOTALS_DDL)
    return chunks.cogroup(totals.groupBy("chunk")).applyInArrow(C.lean(_score(order, n, backoff)), _SCORES_DDL)
