"""Removal of word runs that repeat anywhere in a corpus: fixed-block anchors.

Any window of ``window`` words covers one whole block of ``block = (window + 1) // 2`` words whose start is a multiple
of ``block`` in its document. So the non-overlapping blocks of every document form the index, every rolling window of
``block`` words of every document probes it, and each hit is extended to the windows around it, which are then compared
whole. Every step deals packed arrays: documents are dealt into chunks once, a chunk sends each distinct hash once per
bucket, and a bucket answers each chunk. So a passage that a third of all documents share costs one entry a chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import _columnar as C
from tidemark.llm._session import partitions

U64, U32 = np.uint64, np.uint32
KEY_BITS = 30
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
_SENT_DDL = "bucket int, chunk int, once binary, more binary"
_HITS = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary())])
_HITS_DDL = "chunk int, kind int, hashes binary"


def _gram_hashes(buf: np.ndarray, ends: np.ndarray, n: int):
    """Word codes rolled into n-grams: (hash by start, which starts stay in their row, place in the row, words by row)."""
    start, end, counts = C.words(buf, ends)
    codes = C.word_codes(buf, start, end)
    roll = C.Rolling(codes)
    inside = C.in_one_row(counts, n)
    hashes = np.zeros(len(codes), dtype=np.uint64)
    grams = roll.grams(n)
    hashes[: len(grams)] = grams
    place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    return hashes, inside, place, counts, roll


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and key of a probe in one number; a clash only makes a candidate that the extension rejects."""
    return ((hashes >> U64(64 - KEY_BITS)) % U64(buckets)) << U64(KEY_BITS) | (hashes & U64((1 << KEY_BITS) - 1))


def _rows(parts: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*parts, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _probe(window: int, block: int, buckets: int):
    """A chunk's distinct rolling probes by bucket: key << 2 | indexed here << 1 | more than once here."""

    def task(table: pa.Table) -> pa.Table:
        probes, index = [], []
        for _, buf, ends in C.batches(table["text"]):
            hashes, inside, place, counts, _ = _gram_hashes(buf, ends, block)
            inside &= np.repeat(counts >= window, counts)
            keys = _keys(hashes[inside], buckets)
            probes.append(keys)
            index.append(keys[place[inside] % block == 0])
        keys, times = np.unique(C.joined(probes, np.uint64), return_counts=True)
        indexed = C.member(keys, np.unique(C.joined(index, np.uint64)))
        sent = ((keys & U64((1 << KEY_BITS) - 1)) << U64(2)).astype(np.uint32) | (indexed.astype(np.uint32) << U32(1)) | (times > 1).astype(np.uint32)
        chunk = table["chunk"][0].as_py()
        parts = [(b, chunk, sent[at].tobytes(), None) for b, at in C.split_by(keys >> U64(KEY_BITS), buckets)]
        return _rows(parts, _SENT)

    return task


def _index_lookup(table: pa.Table) -> pa.Table:
    """For each chunk the keys that are indexed somewhere and occur more than once."""
    arrays = C.unpack(table["once"], np.uint32)
    chunks, bucket = table["chunk"].to_pylist(), U64(table["bucket"][0].as_py())
    every = C.joined(arrays, np.uint32)
    keys, group = np.unique(every >> U32(2), return_inverse=True)
    times = np.bincount(group) + np.bincount(group[(every & U32(1)) > 0], minlength=len(keys))
    indexed = np.zeros(len(keys), dtype=bool)
    indexed[group[(every & U32(2)) > 0]] = True
    hit = ((times > 1) & indexed)[group]
    parts, at = [], 0
    for chunk, array in zip(chunks, arrays, strict=True):
        found = (array >> U32(2))[hit[at : at + len(array)]]
        at += len(array)
        if len(found):
            parts.append((chunk, 0, (bucket << U64(KEY_BITS) | found.astype(np.uint64)).tobytes()))
    return _rows(parts, _HITS)


def _extend(window: int, block: int, buckets: int):
    """The windows around a chunk's hits, each distinct hash once, apart from those that repeat in the chunk itself."""

    def task(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not len(docs) or not len(hits):
            return _SENT.empty_table()
        hit_keys = np.unique(C.joined(C.unpack(hits["hashes"], np.uint64), np.uint64))
        found = []
        for _, buf, ends in C.batches(docs["text"]):
            hashes, inside, _, counts, roll = _gram_hashes(buf, ends, block)
            anchors = np.flatnonzero(inside & C.member(_keys(hashes, buckets), hit_keys))
            near = np.zeros(len(hashes) + window, dtype=bool)
            near[np.maximum(anchors - (window - block), 0)] = True
            starts = np.flatnonzero(C.spread(near, window - block + 1)[: len(hashes)] & C.in_one_row(counts, window))
            found.append(roll.runs(starts, starts + window))
        hashes, times = np.unique(C.joined(found, np.uint64), return_counts=True)
        order = np.argsort(hashes % U64(buckets), kind="stable")
        hashes, times = hashes[order], times[order]
        chunk = docs["chunk"][0].as_py()
        parts = [(b, chunk, hashes[at][times[at] == 1].tobytes(), hashes[at][times[at] > 1].tobytes()) for b, at in C.split_by(hashes % U64(buckets), buckets)]
        return _rows(parts, _SENT)

    return task


def _compare(table: pa.Table) -> pa.Table:
    """For each chunk those of its single windows that another chunk has as well."""
    once, more = C.unpack(table["once"], np.uint64), C.unpack(table["more"], np.uint64)
    hashes, times = np.unique(C.joined([*once, *more], np.uint64), return_counts=True)
    shared = hashes[times > 1]
    parts = [(c, 1, found.tobytes()) for c, a in zip(table["chunk"].to_pylist(), once, strict=True) if len(found := a[C.member(a, shared)])]
    return _rows(parts, _HITS)


def _remove(window: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def task(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not len(docs):
            return schema.append(docs.schema.field("rest")).empty_table()
        shared = np.unique(C.joined(C.unpack(hits["hashes"], np.uint64), np.uint64))
        seen, batches = [], []
        for row, buf, ends in C.batches(docs["text"]):
            hashes, inside, _, counts, _ = _gram_hashes(buf, ends, window)
            batches.append((row, buf, ends, counts, hashes, inside))
            seen.append(hashes[inside])
        here, times = np.unique(C.joined(seen, np.uint64), return_counts=True)
        shared = np.union1d(shared, here[times > 1])
        n_words, n_removed, kept, digests = [], [], [], []
        for _, buf, ends, counts, hashes, inside in batches:
            gone = C.spread(inside & C.member(hashes, shared), window)
            at, begin, raw = 0, 0, buf.tobytes()
            for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
                parts = raw[begin:end].split()
                mask = gone[at : at + n]
                if mask.any():
                    parts = [w for w, out in zip(parts, mask.tolist(), strict=True) if not out]
                text = b" ".join(parts)
                n_words.append(n)
                n_removed.append(n - len(parts))
                kept.append(text if with_text else None)
                digests.append(hashlib.sha256(text).hexdigest())
                begin, at = end, at + n
        return pa.table([docs["doc_id"], n_words, n_removed, pa.array(kept, pa.binary()), digests, docs["rest"]], schema=schema.append(docs.schema.field("rest")))

    return task


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Remove from each text the words that a repeated window covers.

    docs: a row per document; ``id_col`` is a whole number, ``text_col`` a string. Other columns are not read, but for
    those in ``carry``, which come back as the fields of ``rest``, whatever their names.
    window: words are the runs of characters other than space and tab to carriage return, compared as they are. Each
    word that lies in a run of ``window`` words whose sequence also starts anywhere else, in this document or another,
    is removed; all windows are judged on the input.

    Returns, for each row of docs, doc_id, n_words, n_removed, kept (the kept words joined by one space; null unless
    with_text) and kept_sha256. A null text has no words; texts under ``window`` words lose none; rows with the same or
    a null id are documents of their own; two copies of a text both lose what they share; an empty table gives none.
    """
    if window < 3:
        raise ValueError("window takes three words at least")
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    block = (window + 1) // 2
    rest = F.struct(*(docs[c].alias(f"_{k}") for k, c in enumerate(carry))) if carry else F.struct(F.lit(True).alias("_"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest"))
    # The text's own hash spreads the rows of a missing or repeated id.
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2 * n)).cast("int")).repartition(n, "chunk")
    chunks = dealt.groupBy("chunk")
    sent = chunks.applyInArrow(C.lean(_probe(window, block, n)), _SENT_DDL)
    hits = sent.groupBy("bucket").applyInArrow(C.lean(_index_lookup), _HITS_DDL)
    near = chunks.cogroup(hits.groupBy("chunk")).applyInArrow(C.lean(_extend(window, block, n)), _SENT_DDL)
    shared = near.groupBy("bucket").applyInArrow(C.lean(_compare), _HITS_DDL)
    kept = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string").add("rest", own.schema["rest"].dataType)
    out = chunks.cogroup(shared.groupBy("chunk")).applyInArrow(C.lean(_remove(window, with_text)), kept).withColumn("kept", F.col("kept").cast("string"))
    return out if carry else out.drop("rest")


def without_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept words as text, and n_chars, where there is such a column, as its length.

    Every row stays, with its other columns, whatever their names; a null text becomes an empty one; long texts, rows with
    the same or no id and repeated rows count as in ``remove_repeats``; an empty table gives none.
    """
    carry = [c for c in docs.columns if c != text_col]
    done = remove_repeats(docs, window, id_col, text_col, carry=carry)
    back = {c: F.col(f"rest._{k}") for k, c in enumerate(carry)} | {text_col: F.col("kept")}
    if "n_chars" in back:
        back["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return done.select(*(back[c].alias(c) for c in docs.columns))
