"""Vector code compression: codebooks by Lloyd's rounds over integer vectors, with heaps that say which parts may move.

Vectors are cut into parts; the parts at a position share a codebook. Tasks hold chunks of vectors, and for each chunk,
position and entry a heap of the parts that the entry has, keyed by the slack between the bounds of the second nearest
and of the entry's own distance. What an entry and the others have drifted since then adds up in one number for each
entry; only the parts whose key it has reached can have another nearest entry. They are popped and compared with all
entries again, exactly; the others keep their code, and no distance is computed for them. Sums of the entries change by
the parts that moved alone.

The driver holds codebooks, sums and drifts, whose size is parts x entries x length; chunks stay in files of the shared
folder between the rounds, so a lost executor costs a read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _columnar as C
from tidemark.llm._session import cut, partitions, shared_folder
from tidemark.runtime import drop_folder

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a chunk: as many as Spark hands over at once unless told otherwise.
CHUNK = 10_000
#: Parts compared with a codebook at once.
_BLOCK = 4_096
#: Float arithmetic is exact up to here, 64-bit arithmetic up to there; bounds are taken wider by this share.
_EXACT, _LONGEST, _MARGIN = 2.0**52, 2.0**62, 1e-9


@dataclass
class Books:
    """entries[p, e]: the codebooks; drift[p, e]: what bounds of parts at (p, e) have lost so far."""

    entries: np.ndarray
    drift: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    rescans: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def start(cls, entries: np.ndarray) -> Books:
        p, e, _ = entries.shape
        return cls(entries, np.zeros((p, e)), np.zeros((p, e), np.int64), np.zeros(entries.shape, np.int64))

    def moved(self, counts: np.ndarray, sums: np.ndarray) -> None:
        """Take in what parts have come and gone, put used entries at the floor of their mean, and add the drifts up."""
        self.counts += counts
        self.sums += sums
        used = self.counts > 0
        new = np.where(used[..., None], self.sums // np.maximum(self.counts, 1)[..., None], self.entries)
        far = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + _MARGIN)
        self.entries = new
        for p in range(len(far)):
            most = int(np.argmax(far[p]))
            others = np.full(far.shape[1], far[p, most])
            others[most] = np.delete(far[p], most).max(initial=0.0)
            self.drift[p] += far[p] + others

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2.0**31:
        raise ValueError("squared distances leave 64 bits")
    return scaled.astype(np.int64)


def _usable(vectors: pa.ListArray) -> tuple[np.ndarray, pa.ListArray]:
    """Which rows are neither null nor hold null or non-finite components, and those rows."""
    flat, offsets = vectors.flatten(), vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(len(vectors)), offsets)
    ok = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    ok[owner[bad]] = False
    return ok, vectors.filter(pa.array(ok))


def _padded(vectors: pa.ListArray, width: int) -> np.ndarray:
    """One row of ``width`` integers for each vector, zeros after the end of shorter ones."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    whole = _whole(vectors.flatten().to_numpy(zero_copy_only=False))
    if len(lengths) and (lengths == width).all():
        return whole.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(whole)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return out


def _scan(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part the nearest entry, ties to the lower index, and the slack: second distance less the nearest."""
    best, slack = np.zeros(len(parts), np.uint8), np.full(len(parts), math.inf)
    far = float(max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)))
    if parts.shape[1] * (2 * far) ** 2 >= _LONGEST:
        raise ValueError("squared distances leave 64 bits")
    kind = np.float64 if parts.shape[1] * (2 * far) ** 2 < _EXACT else np.int64
    book = book.astype(kind)
    norms = (book * book).sum(axis=1)
    for k in range(0, len(parts), _BLOCK):
        x = parts[k : k + _BLOCK].astype(kind)
        d = (x * x).sum(axis=1)[:, None] + norms - 2 * (x @ book.T)
        best[k : k + _BLOCK] = d.argmin(axis=1)
        if d.shape[1] > 1:
            two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
            slack[k : k + _BLOCK] = two[:, 1] * (1 - _MARGIN) - two[:, 0] * (1 + _MARGIN)
    return best, slack


def _pop(heaps: list[list[tuple[float, int]]], drift: np.ndarray) -> list[int]:
    """Take the parts out of the heaps whose key the entry's drift has reached."""
    out = []
    for heap, gone in zip(heaps, drift.tolist(), strict=True):
        limit = gone * (1 + _MARGIN) + _MARGIN
        while heap and heap[0][0] <= limit:
            out.append(heapq.heappop(heap)[1])
    return out


def _heaps(codes: np.ndarray, keys: np.ndarray, count: int) -> list[list[tuple[float, int]]]:
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(count)]
    for at, (entry, key) in enumerate(zip(codes.tolist(), keys.tolist(), strict=True)):
        heaps[entry].append((key, at))
    for heap in heaps:
        heapq.heapify(heap)
    return heaps


def _reassign(parts: np.ndarray, codes: np.ndarray, keys: np.ndarray, books: Books, p: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, keys, change of counts, change of sums, parts compared) of a chunk's parts at position p."""
    entries = books.entries[p]
    popped = np.arange(len(parts)) if first else np.array(_pop(_heaps(codes, keys, len(entries)), books.drift[p]), np.int64)
    counts, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    if len(popped):
        best, slack = _scan(parts[popped], entries)
        changed = np.ones(len(popped), bool) if first else best != codes[popped]
        np.add.at(counts, best[changed], 1)
        np.add.at(sums, best[changed], parts[popped[changed]])
        if not first:
            np.subtract.at(counts, codes[popped[changed]], 1)
            np.subtract.at(sums, codes[popped[changed]], parts[popped[changed]])
        codes, keys = codes.copy(), keys.copy()
        codes[popped], keys[popped] = best, slack + books.drift[p][best]
    return codes, keys, counts, sums, len(popped)


_STATE = pa.schema([("rows", pa.int32()), ("ints", pa.binary()), ("codes", pa.binary()), ("keys", pa.binary()), ("change", pa.binary()), ("scanned", pa.int64()), ("error", pa.list_(pa.int64()))])
_STATE_SQL = "rows int, ints binary, codes binary, keys binary, change binary, scanned bigint, error array<bigint>"


def _small(values: np.ndarray) -> bytes:
    """Integers in the narrowest kind that holds them, which the first byte names."""
    top = int(np.abs(values).max(initial=0))
    kind = next(k for k, t in enumerate(_KINDS) if top <= np.iinfo(t).max)
    return bytes([kind]) + values.astype(_KINDS[kind]).tobytes()


_KINDS = (np.int8, np.int16, np.int32, np.int64)


def _large(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, _KINDS[packed[0]], offset=1).astype(np.int64) if packed else np.zeros(0, np.int64)


def _chunks(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, width: int, size: int) -> DataFrame:
    """Rows of up to ``size`` vectors each: their ids and labels as arrays, their integers packed; codes and keys empty."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    label = rows.schema["label"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, kept = _usable(batch.column(2))
            table = batch.filter(pa.array(ok))
            for k in range(0, len(table), size):
                some = table.slice(k, size)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), c) for c in some.columns[:2]]
                ints = pa.array([_small(_padded(kept.slice(k, size), width))], pa.binary())
                none = pa.array([b""], pa.binary())
                yield pa.record_batch([*lists, pa.array([len(some)], pa.int32()), ints, none, none, none, pa.array([0], pa.int64()), pa.array([[]], pa.list_(pa.int64()))], names=["vec_id", "label", *_STATE.names])
            C.release()

    return rows.mapInArrow(task, f"vec_id array<bigint>, label array<{label}>, {_STATE_SQL}")


def _assign(chunks: DataFrame, books: Books, first: bool, last: bool) -> DataFrame:
    """One round over the chunks: new codes and keys, what it changes in the sums, how many parts it compared."""
    shape = books.entries.shape

    def one(rows: int, ints: bytes, codes: bytes, keys: bytes) -> list:
        x = _large(ints).reshape(rows, shape[0], shape[2])
        before = np.frombuffer(codes, np.uint8).reshape(shape[0], -1) if codes else np.zeros((shape[0], rows), np.uint8)
        slack = np.frombuffer(keys, np.float64).reshape(shape[0], -1) if keys else np.zeros((shape[0], rows))
        done = [_reassign(x[:, p], before[p], slack[p], books, p, first) for p in range(shape[0])]
        after = np.stack([d[0] for d in done])
        error = []
        if last:
            error = sum(((x[:, p] - books.entries[p][after[p]]) ** 2).sum(axis=1) for p in range(shape[0])).tolist()
        change = b"" if last else _small(np.concatenate([np.concatenate([d[2][:, None], d[3]], axis=1).ravel() for d in done]))
        return [after.tobytes(), b"" if last else np.stack([d[1] for d in done]).tobytes(), change, sum(d[4] for d in done), error]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                rows, ints, codes, keys = (row.column(j)[0].as_py() for j in range(2, 6))
                made = one(rows, ints, codes, keys)
                new = [pa.array([v], t) for v, t in zip(made, _STATE.types[2:], strict=True)]
                yield pa.record_batch([row.column(0), row.column(1), row.column(2), row.column(3), *new], names=row.schema.names)
                C.release()

    return chunks.mapInArrow(task, chunks.schema)


def _changes(chunks: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all chunks' changes; tasks add up before they send."""
    size = shape[0] * shape[1] * (1 + shape[2])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += _large(packed.as_py())
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "v"])

    found = chunks.select("change").mapInArrow(task, "k int, v bigint").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["k"].to_numpy()] = found["v"].to_numpy()
    out = out.reshape(shape[0], shape[1], 1 + shape[2])
    return out[..., 0], out[..., 1:]


def _smallest(chunks: DataFrame, entries: int, width: int) -> np.ndarray:
    """The vectors of the smallest ids, at most ``entries`` of them; null ids last, of equal ids the smaller vector."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                x = _large(row.column(1)[0].as_py()).reshape(-1, width)
                ids = row.column(0).flatten().to_pylist()
                order = sorted(range(len(ids)), key=lambda j: (ids[j] is None, ids[j] or 0, x[j].tolist()))[:entries]
                yield pa.record_batch([pa.array([ids[j] for j in order], pa.int64()), pa.array([x[j].tolist() for j in order], pa.list_(pa.int64()))], names=["vec_id", "x"])

    top = chunks.select("vec_id", "ints").mapInArrow(task, "vec_id bigint, x array<bigint>")
    found = top.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    return np.array([r.x for r in found], np.int64).reshape(len(found), width)


def _with_label_errors(coded: DataFrame, spark: SparkSession) -> DataFrame:
    """Add the error summed over equal labels. Labels that more than a quarter of an even share of rows have, at most four
    for each partition, are broadcast; the rest are joined by label, so no task holds a hot one."""
    totals = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("held")))
    rows = totals.agg(F.sum("held")).first()[0] or 0
    often = F.col("held") > rows / (4 * partitions(spark))
    pick = lambda of: totals.filter(of).select(F.col("label").alias("of_label"), "label_error", F.lit(True).alias("known"))
    hot = coded.join(F.broadcast(pick(often)), coded.label.eqNullSafe(F.col("of_label")), "left").drop("of_label")
    rest = hot.filter("known IS NULL").drop("label_error", "known")
    cold = rest.join(pick(~often), rest.label.eqNullSafe(F.col("of_label"))).drop("of_label", "known")
    return hot.filter("known").drop("known").unionByName(cold)


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books]:
    """(vec_id, label, codes, error, label_error of every usable row; the codebooks).

    Components become floor(SCALE * x). Codebooks start as the parts of the vectors with the smallest ids; ``rounds``
    times every part goes to its nearest entry by squared distance, ties to the lower index, and used entries become the
    floor of the mean of their parts; then the parts are assigned once more. codes has one byte for each part; error is
    the sum of the parts' squared distances, and label_error its sum over all rows with that label, nulls together.
    ``Books.rescans`` says how many parts each assignment compared with the codebook, and of how many.

    Vectors that are null or hold null or non-finite components have no row. Shorter vectors count as ending in zeros, up
    to the longest, or as many more as equal parts need; an empty vector is all zeros. Rows with a null id are coded and
    come last for the first codebook; equal rows get equal results, one each; with fewer rows than entries codebooks are
    that much smaller; an empty table gives none. Components so large that squared distances would leave 64 bits (about
    2**18 at 16 components a part) are an error. Other columns are not read, whatever their names.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("codes are bytes: 1 to 256 entries, and 1 part at least")
    spark = vectors.sparkSession
    partitions(spark)
    longest = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    part = max(1, -(-max(longest, 0) // parts))
    folder = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, step: int) -> DataFrame:
        rows.write.parquet(f"{folder}/{step}")
        if step:
            drop_folder(spark, f"{folder}/{step - 1}")
        return spark.read.parquet(f"{folder}/{step}")

    chunks = keep(_chunks(vectors, id_col, vector_col, label_col, parts * part, CHUNK), 0)
    start = _smallest(chunks, entries, parts * part)
    books = Books.start(start.reshape(len(start), parts, part).transpose(1, 0, 2))
    if not len(start):
        return _coded(chunks, spark, parts), books
    for k in range(rounds + 1):
        chunks = keep(_assign(chunks, books, k == 0, k == rounds), k + 1)
        compared, of = chunks.agg(F.sum("scanned"), F.sum("rows")).first()
        books.rescans.append((compared, of * parts))
        if k < rounds:
            books.moved(*_changes(chunks, books.entries.shape))
    return _coded(chunks, spark, parts), books


def _coded(chunks: DataFrame, spark: SparkSession, parts: int) -> DataFrame:
    """A row for each vector of the chunks."""
    label = chunks.schema["label"].dataType.elementType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                codes = np.frombuffer(row.column(2)[0].as_py(), np.uint8).reshape(parts, -1).T
                code = pa.array([bytes(c) for c in codes], pa.binary())
                yield pa.record_batch([row.column(0).flatten(), row.column(1).flatten(), code, row.column(3).flatten()], names=["vec_id", "label", "codes", "error"])

    rows = chunks.select("vec_id", "label", "codes", "error").mapInArrow(task, f"vec_id bigint, label {label}, codes binary, error bigint")
    return _with_label_errors(rows, spark)
