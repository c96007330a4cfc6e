"""Removal of byte strings that already stand earlier in a corpus: common-prefix intervals of an enhanced suffix array.

A window of ``length`` bytes that starts twice has the same smallest 64-byte gram (by hash) in both places, so only the
suffixes around such anchors need sorting. Documents are dealt into chunks by ranges of their id, so that an earlier
chunk holds the earlier copy. Then

1. each chunk sends each distinct (anchor, context) once; the anchor's bucket tells which contexts an earlier chunk
   holds whole, and which must be compared with other contexts of the same anchor;
2. the chunks that own those contexts send their bytes; each bucket sorts the suffixes of its contexts, takes the
   longest common prefix of neighbours and scans them with a stack: every common-prefix interval of ``length`` bytes or
   more whose occurrences differ in the byte to their left is a maximal repeat, with all its occurrences; all but the
   earliest are removed;
3. each chunk marks what it was told and hashes the rest.

An anchor with very many contexts in one chunk isn't gathered: its windows are compared one by one by hash, each dealt
to a bucket of its own, once a chunk.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _columnar as C
from tidemark.llm._session import partitions

U64, U32 = np.uint64, np.uint32
GRAM = 64
#: Distinct contexts of one anchor in one chunk beyond which its windows are compared by hash.
HOT = 256

_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])
_SENT_DDL = "bucket int, chunk int, keys binary, ids binary"
_OWN = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("ids", pa.binary()), ("places", pa.binary()), ("lefts", pa.binary()), ("sizes", pa.binary()), ("contexts", pa.binary()), ("windows", pa.binary())])
_OWN_DDL = "bucket int, chunk int, ids binary, places binary, lefts binary, sizes binary, contexts binary, windows binary"
_TOLD = pa.schema([("chunk", pa.int32()), ("seen", pa.binary()), ("own", pa.binary()), ("hot", pa.binary()), ("masks", pa.binary()), ("windows", pa.binary())])
_TOLD_DDL = "chunk int, seen binary, own binary, hot binary, masks binary, windows binary"
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary()), ("kept_sha256", pa.string())])
_KEPT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary, kept_sha256 string"


def _rows(parts: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*parts, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sliding(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every run of width items."""
    n, step = len(a) - width + 1, 1
    while step * 2 <= width:
        a = f(a[:-step], a[step:])
        step *= 2
    return f(a[:n], a[width - step : width - step + n])


class _Anchors:
    """The anchors of a run of rows: the grams that are the smallest of some window."""

    def __init__(self, buf: np.ndarray, ends: np.ndarray, length: int):
        self.roll = C.Rolling(C.BYTE_CODES[buf])
        lens = np.diff(ends, prepend=0)
        none = np.zeros(0, np.int64)
        self.at, self.lo, self.hi, self.keys, self.ids = none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(buf) < length:
            return
        grams = self.roll.grams(GRAM)
        order = (grams >> U64(32)).astype(np.uint32) | U32(1)
        width = length - GRAM + 1
        least = _sliding(order, width, np.minimum)
        row_end = np.repeat(ends, lens)
        least[np.arange(len(least)) + length > row_end[: len(least)]] = 0
        edge = np.zeros(width - 1, np.uint32)
        self.at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == order)
        row_start = np.repeat(ends - lens, lens)
        self.lo = np.maximum(self.at - (length - GRAM), row_start[self.at])
        self.hi = np.minimum(self.at + length, row_end[self.at])
        self.keys = grams[self.at]
        shape = ((self.at - self.lo) << 16 | (self.hi - self.at)).astype(np.uint64)
        self.ids = C.mix(self.roll.runs(self.lo, self.hi) + C.mix(shape))


def _ordered(docs: pa.Table) -> pa.Table:
    """By id, then by text; a missing id last."""
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _spots(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and key of an anchor in one number."""
    return ((keys >> U64(32)) % U64(buckets)) << U64(32) | (keys & U64(0xFFFFFFFF))


def _submit(length: int, buckets: int, crowd: int):
    def task(docs: pa.Table) -> pa.Table:
        keys, ids = [], []
        for _, buf, ends in C.batches(docs["text"]):
            a = _Anchors(buf, ends, length)
            keys.append(_spots(a.keys, buckets))
            ids.append(a.ids)
        ids, first = np.unique(C.joined(ids, np.uint64), return_index=True)
        spots = C.joined(keys, np.uint64)[first]
        kinds, group, times = np.unique(spots, return_inverse=True, return_counts=True)
        keep = times[group] <= crowd
        many = kinds[times > crowd]
        spots, ids = np.concatenate([spots[keep], many]), np.concatenate([ids[keep], np.zeros(len(many), np.uint64)])
        order = np.argsort(spots, kind="stable")
        spots, ids = spots[order], ids[order]
        chunk, low = docs["chunk"][0].as_py(), (spots & U64(0xFFFFFFFF)).astype(np.uint32)
        return _rows([(b, chunk, low[at].tobytes(), ids[at].tobytes()) for b, at in C.split_by(spots >> U64(32), buckets)], _SENT)

    return task


def _decide(table: pa.Table) -> pa.Table:
    """For each chunk: contexts that an earlier chunk holds, contexts to compare, anchors to compare by windows."""
    bucket = U64(table["bucket"][0].as_py()) << U64(32)
    chunks = np.array(table["chunk"].to_pylist(), np.int64)
    each = C.unpack(table["keys"], np.uint32)
    keys, ids = C.joined(each, np.uint32), C.joined(C.unpack(table["ids"], np.uint64), np.uint64)
    chunk = np.repeat(chunks, [len(x) for x in each])
    order = np.lexsort((chunk, ids, keys))
    keys, ids, chunk = keys[order], ids[order], chunk[order]
    new_key = np.diff(keys, prepend=keys[:1] ^ U32(1)) != 0
    first = new_key | (np.diff(ids, prepend=ids[:1]) != 0)
    group = np.cumsum(new_key) - 1
    hot = (np.bincount(group[ids == 0], minlength=group[-1] + 1) > 0)[group]
    various = (np.bincount(group[first]) > 1)[group]
    seen, own = ~first & ~hot, first & various & ~hot
    parts = []
    for c in np.unique(chunk[seen | own | hot]):
        mine = chunk == c
        parts.append((int(c), ids[mine & seen].tobytes(), ids[mine & own].tobytes(), (bucket | np.unique(keys[mine & hot]).astype(np.uint64)).tobytes(), None, None))
    return _rows(parts, _TOLD)


def _windows_of(a: _Anchors, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window that holds one of the anchors, each start once."""
    spans = a.hi[which] - length - a.lo[which] + 1
    starts = np.unique(np.repeat(a.lo[which], spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans))
    return starts, a.roll.runs(starts, starts + length)


def _send_contexts(length: int, buckets: int):
    wide = 2 * length - GRAM

    def task(docs: pa.Table, told: pa.Table) -> pa.Table:
        own = np.sort(C.joined(C.unpack(told["own"], np.uint64), np.uint64))
        hot = np.sort(C.joined(C.unpack(told["hot"], np.uint64), np.uint64))
        if not len(docs) or not len(own) + len(hot):
            return _OWN.empty_table()
        found, windows, passed = [], [], 0
        for _, buf, ends in C.batches(_ordered(docs)["text"]):
            a = _Anchors(buf, ends, length)
            spots = _spots(a.keys, buckets)
            mine = np.flatnonzero(C.member(a.ids, own))
            ids, first = np.unique(a.ids[mine], return_index=True)
            at = mine[first]
            cells = np.arange(wide) + a.lo[at][:, None]
            inside = cells < a.hi[at][:, None]
            found.append((ids, passed + a.at[at], spots[at] >> U64(32), a.at[at] - a.lo[at], a.hi[at] - a.lo[at], np.where(inside, buf[np.minimum(cells, len(buf) - 1)], 0).astype(np.uint8)))
            if len(hot):
                windows.append(np.unique(_windows_of(a, np.flatnonzero(C.member(spots, hot)), length)[1]))
            passed += len(buf)
        ids, places, bucket, lefts, sizes, contexts = (np.concatenate(x) for x in zip(*found, strict=True))
        ids, first = np.unique(ids, return_index=True)
        order = np.argsort(bucket[first], kind="stable")
        pick = first[order]
        ids, bucket = ids[order], bucket[pick]
        chunk, parts = docs["chunk"][0].as_py(), {}
        for b, at in C.split_by(bucket, buckets):
            p = pick[at]
            parts[b] = [ids[at].tobytes(), places[p].astype(np.int64).tobytes(), lefts[p].astype(np.uint8).tobytes(), sizes[p].astype(np.uint16).tobytes(), contexts[p].tobytes(), None]
        hashes = np.unique(C.joined(windows, np.uint64))
        hashes = hashes[np.argsort(hashes % U64(buckets), kind="stable")]
        for b, at in C.split_by(hashes % U64(buckets), buckets):
            parts.setdefault(b, [None] * 6)[5] = hashes[at].tobytes()
        return _rows([(b, chunk, *p) for b, p in parts.items()], _OWN)

    return task


def common_prefix_intervals(lcp: list[int], before: list[int], order: list[int], least: int):
    """Scan an enhanced suffix array with a stack for its maximal repeats.

    lcp[i] is the common prefix of suffixes i - 1 and i (0 for the first), before[i] the byte to the left of suffix i
    (a number of its own where none is known), order[i] its rank by place. Yields (length, heads), smallest intervals
    first, for each interval of at least ``least`` whose suffixes differ to their left; heads are the earliest suffixes of
    its child intervals and single suffixes, the earliest of all first.
    """
    stack: list[list] = []  # length, heads, smallest and largest byte to the left
    for i in range(len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) and lcp[i] >= least else 0
        head, low, high = i - 1, (before[i - 1] if i else 0), (before[i - 1] if i else 0)
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            heads, low, high = [*top[1], head], min(low, top[2]), max(high, top[3])
            head = min(heads, key=order.__getitem__)
            if low != high:
                yield top[0], [head, *(x for x in heads if x != head)]
        if depth and stack and stack[-1][0] == depth:
            top = stack[-1]
            top[1].append(head)
            top[2], top[3] = min(top[2], low), max(top[3], high)
        elif depth:
            stack.append([depth, [head], low, high])


def _compare(length: int):
    wide = 2 * length - GRAM

    def task(table: pa.Table) -> pa.Table:
        chunks = np.array(table["chunk"].to_pylist(), np.int64)
        each = C.unpack(table["ids"], np.uint64)
        ids = C.joined(each, np.uint64)
        owner = np.repeat(chunks, [len(x) for x in each])
        places = C.joined(C.unpack(table["places"], np.int64), np.int64)
        lefts = C.joined(C.unpack(table["lefts"], np.uint8), np.uint8).astype(np.int64)
        sizes = C.joined(C.unpack(table["sizes"], np.uint16), np.uint16).astype(np.int64)
        contexts = C.joined(C.unpack(table["contexts"], np.uint8), np.uint8)
        masks = np.zeros(len(ids), np.uint64)
        if len(ids):
            # Only a suffix whose first window occurs twice stands in an interval that is long enough.
            spans = sizes - length + 1
            row = np.repeat(np.arange(len(ids)), spans)
            skip = np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans)
            # Two anchors close by share suffixes; each place counts once.
            place = (places - lefts)[row] + skip
            alone = np.sort(np.unique(owner[row] << 44 | place, return_index=True)[1])
            row, skip, place = row[alone], skip[alone], place[alone]
            start = row * wide + skip
            hashes = C.Rolling(C.BYTE_CODES[contexts]).runs(start, start + length)
            _, group, times = np.unique(hashes, return_inverse=True, return_counts=True)
            twice = times[group] > 1
            row, skip, start, place = row[twice], skip[twice], start[twice], place[twice]
        if len(ids) and len(row):
            left = sizes[row] - skip
            cells = np.zeros((len(row), wide), np.uint8)
            flat = np.concatenate([contexts, np.zeros(wide, np.uint8)])
            for k in range(wide):
                cells[:, k] = np.where(k < left, flat[start + k], 0)
            by = np.argsort(cells.reshape(-1).view(f"S{wide}"), kind="stable")
            cells, row, skip, start, left, place = cells[by], row[by], skip[by], start[by], left[by], place[by]
            lcp = np.zeros(len(row), np.int64)
            differ = cells[1:] != cells[:-1]
            lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
            lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]))
            # Where the suffix one byte to the left isn't at hand, the byte counts as one of its own.
            before = np.where((skip > 0) & C.member(start - 1, np.sort(start)), flat[start - 1].astype(np.int64), 256 + np.arange(len(row)))
            rank = np.empty(len(row), np.int64)
            rank[np.lexsort((place, owner[row]))] = np.arange(len(row))
            bits = {}
            rows, skips = row.tolist(), skip.tolist()
            for size, heads in common_prefix_intervals(lcp.tolist(), before.tolist(), rank.tolist(), length):
                for x in heads[1:]:
                    bits[rows[x]] = bits.get(rows[x], 0) | ((1 << (size - length + 1)) - 1) << skips[x]
            for k, v in bits.items():
                masks[k] = v
        told = {int(c): [None] * 3 for c in np.unique(chunks)}
        for c in np.unique(owner[masks > 0]):
            mine = (owner == c) & (masks > 0)
            told[int(c)][:2] = ids[mine].tobytes(), masks[mine].tobytes()
        windows = C.unpack(table["windows"], np.uint64)
        known = np.zeros(0, np.uint64)
        for k in np.argsort(chunks, kind="stable"):
            told[int(chunks[k])][2] = windows[k][C.member(windows[k], known)].tobytes()
            known = np.union1d(known, windows[k]) if len(windows[k]) else known
        return _rows([(c, None, x[0], None, x[1], x[2]) for c, x in told.items() if any(x)], _TOLD)

    return task


def _remove(length: int, buckets: int, with_text: bool):
    def task(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not len(docs):
            return _KEPT.empty_table()
        docs = _ordered(docs)
        parts = {"seen": [], "hot": [], "own": [], "masks": [], "windows": []}
        for name in parts:
            parts[name] = C.unpack(told[name], np.uint64)
        seen, hot, earlier = (np.sort(C.joined(parts[x], np.uint64)) for x in ("seen", "hot", "windows"))
        answered = [k for k, x in enumerate(parts["masks"]) if len(x)]
        ids, masks = C.joined([parts["own"][k] for k in answered], np.uint64), C.joined([parts["masks"][k] for k in answered], np.uint64)
        by = np.argsort(ids, kind="stable")
        ids, masks = ids[by], masks[by]
        # First the contexts of the whole chunk, for what repeats within it.
        every, hot_windows, passed = [], [], 0
        for _, buf, ends in C.batches(docs["text"]):
            a = _Anchors(buf, ends, length)
            is_hot = C.member(_spots(a.keys, buckets), hot)
            starts, hashes = _windows_of(a, np.flatnonzero(is_hot), length)
            every.append((a.ids[~is_hot], a.at[~is_hot], a.lo[~is_hot], a.hi[~is_hot], buf, ends, starts))
            hot_windows.append(hashes)
            passed += len(buf)
        all_ids = C.joined([x[0] for x in every], np.uint64)
        again = np.ones(len(all_ids), bool)
        again[np.unique(all_ids, return_index=True)[1]] = False
        all_windows = C.joined(hot_windows, np.uint64)
        window_again = np.ones(len(all_windows), bool)
        window_again[np.unique(all_windows, return_index=True)[1]] = False
        window_again |= C.member(all_windows, earlier)
        out, i, j = {f.name: [] for f in _KEPT if f.name != "doc_id"}, 0, 0
        for (own, at, lo, hi, buf, ends, starts), _ in zip(every, hot_windows, strict=True):
            flags = np.zeros(len(buf), bool)
            flags[starts[window_again[j : j + len(starts)]]] = True
            j += len(starts)
            whole = again[i : i + len(own)] | C.member(own, seen)
            i += len(own)
            some = np.flatnonzero(~whole & C.member(own, ids))
            wanted = masks[np.searchsorted(ids, own[some])]
            spans = np.where(whole, hi - length - lo + 1, 0)
            for k in range(length - GRAM + 1):
                flags[lo[spans > k] + k] = True
                flags[lo[some[(wanted >> U64(k)) & U64(1) > 0]] + k] = True
            gone = C.spread(flags, length)
            raw, begin = buf.tobytes(), 0
            for end in ends.tolist():
                mask = gone[begin:end]
                edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist() if mask.any() else []
                text = raw[begin:end] if not edge else buf[begin:end][~mask].tobytes()
                out["n_bytes"].append(end - begin)
                out["n_removed"].append(end - begin - len(text))
                out["n_spans"].append(len(edge) // 2)
                out["starts"].append(edge[::2])
                out["ends"].append(edge[1::2])
                out["kept"].append(text if with_text else None)
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                begin = end
        return pa.table([docs["doc_id"], *(pa.array(out[f.name], f.type) for f in _KEPT if f.name != "doc_id")], schema=_KEPT)

    return task


def _range_chunk(docs: DataFrame, count: int):
    """A column with the chunk of a row: ranges of doc_id, found in two steps so that few bounds are compared; no id: the last."""
    bounds = sorted(set(docs.approxQuantile("doc_id", [k / count for k in range(1, count)], 0.25 / count)))
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) or 1
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id").cast("double")))
    outer = below(F.array(*(F.lit(float(g[0])) for g in groups)))
    rest = F.array(*(F.array(*(F.lit(float(b)) for b in g[1:])).cast("array<double>") for g in groups))
    return F.when(F.col("doc_id").isNull(), len(bounds)).when(outer == 0, 0).otherwise((outer - 1) * step + 1 + below(F.element_at(rest, F.greatest(outer, F.lit(1)))))


def remove_earlier_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, crowd: int = HOT) -> DataFrame:
    """Remove from each text the bytes that a string with an earlier occurrence covers.

    docs: a row per document; ``id_col`` is a whole number, ``text_col`` a string, taken as UTF-8. Other columns are not
    read. length: from 66 to 127. crowd: how many contexts of an anchor a chunk may have before its windows are compared by
    hash. Each byte that lies in a string of ``length`` bytes that also starts earlier, in a
    document with a smaller id or earlier in the same one, is removed; strings are judged on the input and never cross
    documents.

    Returns, for each row of docs, doc_id, n_bytes, n_removed, n_spans (maximal removed runs), starts and ends (of the
    runs), kept (the remaining bytes, which may cut a character; null unless with_text) and kept_sha256. A null text is
    empty; rows with one id are ordered by their text, and rows without an id come last; an empty table gives none.
    """
    if not GRAM + 2 <= length < 2 * GRAM:
        raise ValueError(f"length must be from {GRAM + 2} to {2 * GRAM - 1}")
    n = partitions(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = own.withColumn("chunk", _range_chunk(own.select("doc_id"), 2 * n).cast("int")).repartition(n, "chunk")
    chunks = dealt.groupBy("chunk")
    sent = chunks.applyInArrow(C.lean(_submit(length, n, crowd)), _SENT_DDL)
    told = sent.groupBy("bucket").applyInArrow(C.lean(_decide), _TOLD_DDL)
    contexts = chunks.cogroup(told.groupBy("chunk")).applyInArrow(C.lean(_send_contexts(length, n)), _OWN_DDL)
    compared = contexts.groupBy("bucket").applyInArrow(C.lean(_compare(length)), _TOLD_DDL)
    return chunks.cogroup(told.unionByName(compared).groupBy("chunk")).applyInArrow(C.lean(_remove(length, n, with_text)), _KEPT_DDL)
