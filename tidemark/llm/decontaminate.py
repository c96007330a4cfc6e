"""Benchmark decontamination by latent semantic retrieval, then common subsequences and answer checks.

Benchmark items are cut into passages. A distributed randomised SVD of the passages' TF-IDF rows, weighted by how many
documents of the corpus have a term, gives a latent space, to which passages add what it loses of them. Windows of every
document are folded into it by their counts of words. Their product with a passage's place is then at least the share of
the passage's weight that a window has in any order, and so at least the share that it has in order: a window below the
least share of a leak can't be one, and every other is compared. It is a leak if the passage's words, weighted by rarity,
stand in the window in order to a large part, its answer (the end of the item) included, or nearly whole. Windows are
SPREAD times as long as the passage, whatever stands around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _columnar as C
from tidemark.llm._session import cut, partitions
from tidemark.runtime import ship

PASSAGE, STRIDE = 64, 48
#: Length of the text that a leak may take, over the passage's; windows are longer by a step, so that none falls between two.
SPREAD, STEP = 2, 6
RANK = 256
#: Least share of a leak with and without its answer.
SHARE, WHOLE = 0.5, 0.75
#: Least share of a leak in the passage's rarest terms; windows below it aren't folded into the space.
RARE = 0.2
#: Least length that the latent space leaves of a passage's unit vector; passages below add what it loses.
LEAST_KEPT = 1 - 1e-9
#: Passages that go to every task at once; more are searched for in turns.
TURN = 512

_PASSAGES = pa.schema([("item_id", pa.int64()), ("part", pa.int32()), ("codes", pa.binary())])


def _words(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower = C.LOWER[buf]
    start, end, counts = C.words(lower, ends, C.PLAIN)
    return C.word_codes(lower, start, end), counts


def _cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for first, buf, ends in C.batches(batch.column(1)):
            codes, counts = _words(buf, ends)
            at = 0
            for k, n in enumerate(counts.tolist()):
                item = batch.column(0)[first + k].as_py()
                for part, begin in enumerate(range(0, max(1, n - PASSAGE + STRIDE), STRIDE)):
                    piece = codes[at + begin : at + min(n, begin + PASSAGE)]
                    if len(piece):
                        rows.append((item, part, piece.tobytes()))
                at += n
        yield pa.record_batch([pa.array([r[k] for r in rows], _PASSAGES.field(k).type) for k in range(3)], schema=_PASSAGES)


@dataclass(frozen=True)
class Index:
    """What every task has of up to TURN passages: terms, their weights and latent places, the passages."""

    terms: np.ndarray
    idf: np.ndarray
    latent: np.ndarray
    other: float
    items: list[int]
    parts: list[int]
    passages: list[np.ndarray]
    places: np.ndarray

    @cached_property
    def weights(self) -> list[np.ndarray]:
        """The weight of each word of each passage."""
        return [self.idf[self._terms_of(words)] for words in self.passages]

    @cached_property
    def sizes(self) -> np.ndarray:
        """Words of the windows that each passage is looked for in."""
        return np.array([-(-SPREAD * len(words) // STEP) * STEP + STEP for words in self.passages])

    @cached_property
    def scale(self) -> np.ndarray:
        """What turns a window's product with each place into a bound on its share."""
        return np.array([np.sqrt(((times * self.idf[at]) ** 2).sum()) / w.sum() for (at, times), w in zip(map(self._counted, self.passages), self.weights, strict=True)])

    @cached_property
    def rare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which passages want each term: (first entry and number of entries by term, passage and share by entry, least sum by passage).

        A passage wants its rarest terms, so many that the others are worth less than SHARE - RARE of it: a window with
        SHARE of the passage then has RARE of it or more in wanted terms.
        """
        rows, least = [], np.zeros(len(self.passages))
        for p, (words, w) in enumerate(zip(self.passages, self.weights, strict=True)):
            kinds, times = self._counted(words)
            order = np.argsort(-self.idf[kinds], kind="stable")
            worth = (times * self.idf[kinds])[order] / w.sum()
            enough = int(np.searchsorted(np.cumsum(worth), 1 - (SHARE - RARE))) + 1
            least[p] = SHARE - worth[enough:].sum()
            rows += [(int(t), p, float(self.idf[t] / w.sum())) for t in kinds[order][:enough]]
        rows.sort()
        term, passage, share = (np.array(x) for x in zip(*rows, strict=True))
        edges = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # Term -1, a word of no passage, is wanted by none.
        return np.append(edges[:-1], 0), np.append(np.diff(edges), 0), passage, share, least

    def _counted(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self._terms_of(words), return_counts=True)

    def find(self, texts: pa.Array) -> Iterator[list[dict]]:
        for _, buf, ends in C.batches(texts):
            codes, counts = _words(buf, ends)
            yield from self._leaks(codes, counts)

    def _terms_of(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        return np.where(self.terms[at] == codes, at, -1)

    def _reached(self, term: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, passage, window starts in the row) of the windows that have enough of the terms that the passage wants."""
        opens, listed, passage, share, least = self.rare
        last = np.cumsum(counts)
        at = np.flatnonzero(listed[term])
        many = listed[term[at]]
        place = np.repeat(at, many)
        entry = opens[term[place]] + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
        of, row = passage[entry], np.searchsorted(last, place, side="right")
        # Words by row and passage; what stands within a window's length from each on is a sum over its successors.
        far = len(term) + int(self.sizes.max()) + 1
        pair = row * len(self.passages) + of
        order = np.argsort(pair * far + place, kind="stable")
        pair, place, of, row = pair[order], place[order], of[order], row[order]
        sums = np.concatenate([[0.0], np.cumsum(share[entry][order])])
        key = pair * far + place
        until = np.searchsorted(key, key + self.sizes[of])
        first = np.flatnonzero(sums[until] - sums[np.arange(len(key))] >= least[of] - 1e-6)
        if not len(first):
            return
        pair, of, row, here = pair[first], of[first], row[first], place[first] - (last - counts)[row[first]]
        # The windows, STEP apart, that hold the word.
        most = np.maximum(-(-(counts[row] - self.sizes[of]) // STEP), 0)
        low = np.clip(-(-(here - self.sizes[of] + 1) // STEP), 0, most)
        spans = np.minimum(here // STEP, most) - low + 1
        number = np.repeat(low, spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        windows = np.unique(np.repeat(pair, spans) * far + number)
        pair, number = windows // far, windows % far
        for group in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(pair)) + 1):
            yield *map(int, divmod(pair[group[0]], len(self.passages))), number[group] * STEP

    def _leaks(self, codes: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
        term = self._terms_of(codes)
        last = np.cumsum(counts)
        found: list[list[dict]] = [[] for _ in counts]
        for r, p, starts in self._reached(term, counts):
            begin = int(last[r] - counts[r])
            a = begin + starts
            b = np.minimum(a + self.sizes[p], last[r])
            near = self._products(p, term, a, b)
            # A thousandth for the rounding of sums and places.
            windows = [(int(x), int(y)) for x, y in zip(a[near >= SHARE - 1e-3], b[near >= SHARE - 1e-3], strict=True)]
            if windows and (best := self._checked(codes, term, p, windows)):
                start, end = best.pop("start"), best.pop("end")
                found[r].append({"item_id": self.items[p], "part": self.parts[p], **best, "start": start - begin, "end": end - begin})
        return found

    def _products(self, p: int, term: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The bounds on the share that windows from a to b have of a passage: their places' products with its place."""
        low = int(a[0])
        here = term[low : int(b[-1])]
        adds = np.where(here >= 0, (self.latent[here] @ self.places[p]) / self.idf[here] * self.scale[p], 0)
        sums = np.concatenate([[0.0], np.cumsum(adds)])
        return sums[b - low] - sums[a - low]

    def _checked(self, codes: np.ndarray, term: np.ndarray, p: int, windows: list[tuple[int, int]]) -> dict | None:
        """The window that has most of a passage in order, if it is a leak."""
        words, weight = self.passages[p], self.weights[p]
        kinds, times = self._counted(words)
        tail = max(3, len(words) // 4)
        a, b = np.array(windows).T
        # The product counts a word that both repeat too often; the lesser of the two counts is a bound as well.
        slot = np.full(len(self.terms) + 1, len(kinds))
        slot[kinds] = np.arange(len(kinds))
        here = np.stack([np.bincount(slot[term[x:y]], minlength=len(kinds) + 1)[: len(kinds)] for x, y in windows])
        bound = np.minimum(here, times) @ self.idf[kinds] / weight.sum()
        order = np.argsort(-bound, kind="stable")
        best = None
        for k in order[bound[order] >= SHARE - 1e-9].tolist():
            if best and bound[k] <= best["share"] + 1e-9:
                break
            text = codes[a[k] : b[k]]
            share = ordered_share(words, weight, text)
            if share < SHARE or best and share <= best["share"]:
                continue
            answer = ordered_share(words[-tail:], weight[-tail:], text)
            if share >= WHOLE or answer >= SHARE:
                best = {"cosine": self._cosine(p, term[a[k] : b[k]]), "share": share, "answer": answer, "start": int(a[k]), "end": int(b[k])}
        return best

    def _cosine(self, p: int, term: np.ndarray) -> float:
        at, times = np.unique(term[term >= 0], return_counts=True)
        mass = ((times * self.idf[at]) ** 2).sum() + (term < 0).sum() * self.other**2
        return float(times @ self.latent[at] @ self.places[p] / np.sqrt(mass))


def ordered_share(words: np.ndarray, weight: np.ndarray, text: np.ndarray) -> float:
    """The heaviest common subsequence of a passage and a text, as a share of the passage's weight."""
    best = np.zeros(len(text) + 1)
    for word, w in zip(words, weight, strict=True):
        best[1:] = np.maximum(best[1:], np.where(text == word, best[:-1] + w, 0))
        np.maximum.accumulate(best, out=best)
    return float(best[-1] / max(weight.sum(), 1e-9))


def _document_counts(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents have each term, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, rows = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, buf, ends in C.batches(batch.column(0)):
                codes, counts = _words(buf, ends)
                at = np.minimum(np.searchsorted(terms, codes), len(terms) - 1)
                here = terms[at] == codes
                row = np.repeat(np.arange(len(counts)), counts)
                pairs = np.unique(row[here] * len(terms) + at[here])
                totals += np.bincount(pairs % len(terms), minlength=len(terms))
        some = np.flatnonzero(totals)
        yield pa.record_batch([pa.array([*some, -1], pa.int64()), pa.array([*totals[some], rows], pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out, n = np.zeros(len(terms), np.int64), 0
    for term, times in zip(rows["term"].to_pylist(), rows["n"].to_pylist(), strict=True):
        if term < 0:
            n = times
        else:
            out[term] = times
    return out, n


def randomised_svd(passages: DataFrame, terms: np.ndarray, idf: np.ndarray, rank: int, rounds: int = 2, seed: int = 3) -> np.ndarray:
    """Right singular vectors (terms by rank) of the passages' TF-IDF rows; each round is one pass over the passages."""
    width = min(rank + 8, len(terms))
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(terms), width)))[0]

    def product(basis: np.ndarray, square: bool) -> np.ndarray:
        """Sum over passages of x (x basis), or of (x basis)' (x basis)."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width if square else len(terms), width))
            for batch in batches:
                for codes in batch.column(0):
                    at, times = np.unique(np.searchsorted(terms, np.frombuffer(codes.as_buffer(), np.uint64)), return_counts=True)
                    x = times * idf[at]
                    x /= np.sqrt((x * x).sum()) or 1.0
                    y = x @ basis[at]
                    if square:
                        total += np.outer(y, y)
                    else:
                        total[at] += np.outer(x, y)
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])

        parts = passages.select("codes").coalesce(4).mapInArrow(task, "total binary").toArrow()["total"]
        return sum(np.frombuffer(p.as_buffer(), np.float64).reshape(-1, width) for p in parts)

    for _ in range(rounds):
        turn = np.linalg.qr(product(turn, square=False))[0]
    values, vectors = np.linalg.eigh(product(turn, square=True))
    order = np.argsort(-values)[:rank]
    return turn @ vectors[:, order[values[order] > 1e-9]]


def _vectors(codes: list[np.ndarray], terms: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, weights) of each passage's TF-IDF row, unit length."""
    out = []
    for c in codes:
        at, times = np.unique(np.searchsorted(terms, c), return_counts=True)
        x = times * idf[at]
        out.append((at, x / max(np.sqrt((x * x).sum()), 1e-9)))
    return out


def places_of(vectors: list[tuple[np.ndarray, np.ndarray]], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(basis, places): the basis with directions for what it loses of passages, and each passage's place in it.

    A place is as long as makes a passage's own product with it one.
    """
    projected = lambda: np.stack([x @ basis[at] for at, x in vectors])
    places = projected()
    lost = np.flatnonzero(np.linalg.norm(places, axis=1) < LEAST_KEPT)
    if len(lost):
        rest = np.zeros((len(basis), len(lost)))
        for k, p in enumerate(lost):
            at, x = vectors[p]
            rest[at, k] = x
        # What they lose may have fewer dimensions than there are passages.
        more, size, _ = np.linalg.svd(rest - basis @ (basis.T @ rest), full_matrices=False)
        basis = np.hstack([basis, more[:, size > 1e-7]])
        places = projected()
    return basis, places / np.maximum((places * places).sum(axis=1, keepdims=True), 1e-9)


def _indexes(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[tuple[Index, bool]]:
    """The indexes of the benchmark's passages, TURN at a time, and whether others follow; one is in the driver at once.

    How passages fall into turns changes no result: a term's weight is that of all documents, and each space holds its
    passages whole.
    """
    ship(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    passages = cut(items.mapInArrow(_cut_passages, "item_id long, part int, codes binary"))
    turns = max(1, -(-passages.count() // TURN))
    for turn in range(turns):
        own = passages.filter(F.pmod(F.xxhash64("item_id", "part", "codes"), F.lit(turns)) == turn)
        rows = own.toArrow()
        if not len(rows):
            continue
        codes = [np.frombuffer(c.as_buffer(), np.uint64) for c in rows["codes"].combine_chunks()]
        terms = np.unique(np.concatenate(codes))
        counts, n = _document_counts(docs, terms)
        idf = np.log((1 + n) / (1 + counts)) + 0.1
        basis, places = places_of(_vectors(codes, terms, idf), randomised_svd(own, terms, idf, RANK))
        latent = (idf[:, None] * basis).astype(np.float32)
        yield Index(terms, idf, latent, float(np.log1p(n)) / 2, rows["item_id"].to_pylist(), rows["part"].to_pylist(), codes, places.astype(np.float32)), turn < turns - 1


_LEAKS_DDL = "array<struct<item_id long, part int, cosine double, share double, answer double, start int, end int>>"
_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("part", pa.int32()), ("cosine", pa.float64()), ("share", pa.float64()), ("answer", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def _leaks(text: Column, index: Index) -> Column:
    ship(SparkSession.active())

    @F.arrow_udf(_LEAKS_DDL)
    def leaks(texts: pa.Array) -> pa.Array:
        out = pa.array(list(index.find(texts)), _LEAKS)
        C.release()
        return out

    return leaks(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each benchmark passage that a document leaks: doc_id, item_id, part, cosine, share, answer, start, end.

    share and answer are the weights of the passage's, and of its last quarter's, words that the document has in order;
    start and end are the words of the document that were compared, at most twice the passage and two steps. A null or empty text, or an item without words, leaks
    nothing; equal ids are searched apart; empty tables give none; other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for index, more in _indexes(own, benchmark, item_col, item_text_col):
        part = own.select("doc_id", F.explode(_leaks(F.col("text"), index)).alias("m")).select("doc_id", "m.*")
        found.append(cut(part) if more else part)
    return reduce(DataFrame.unionByName, found) if found else own.sparkSession.createDataFrame([], "doc_id long, item_id long, part int, cosine double, share double, answer double, start int, end int")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no passage, with their own columns, whatever their names.

    A null or empty text leaks nothing and stays; texts may be as long as a cell; each of the rows that share an id, or are
    the same, is judged by itself; without a benchmark all rows stay; an empty table gives none.
    """
    own = docs.select(F.col(text_col).alias("text"))
    for index, more in _indexes(own, benchmark, item_col, item_text_col):
        clean = docs.filter(F.size(_leaks(F.col(text_col), index)) == 0)
        docs = cut(clean) if more else clean
    return docs
