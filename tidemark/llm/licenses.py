"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _columnar as C
from tidemark.llm.license_texts import TEXTS
from tidemark.runtime import ship

#: Words of a fingerprint, fingerprints of a winnowing window, least coverage.
SHINGLE, WINDOW, LEAST = 5, 4, 0.8

def _words(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower = C.LOWER[text]
    start, end, counts = C.words(lower, ends, C.PLAIN)
    return C.word_codes(lower, start, end), counts


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of every window, the last of equal ones; of all hashes where they fill no window."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    width = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    return np.unique(np.arange(len(views)) + width - 1 - np.argmin(views[:, ::-1], axis=1))


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched, start, end): most words that match in order within ``band`` of a diagonal, and the span they take in text.

    Of equal alignments the one that ends first, and then the one that begins last.
    """
    best = np.zeros((len(template) + 1, len(text) + 1), np.int32)
    places = np.arange(len(text))
    for i, word in enumerate(template):
        fits = (text == word) & (np.abs(places - i - diagonal) <= band)
        best[i + 1, 1:] = np.maximum(best[i, 1:], np.where(fits, best[i, :-1] + 1, 0))
        np.maximum.accumulate(best[i + 1], out=best[i + 1])
    matched = int(best[-1, -1])
    if not matched:
        return 0, 0, 0
    i, j = len(template), int(np.argmax(best[-1] == matched))
    start, end = j, j
    while best[i, j]:
        if best[i - 1, j] == best[i, j]:
            i -= 1
        elif best[i, j - 1] == best[i, j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            start = j
    return matched, start, end


class Templates:
    """Templates and the inverted indexes of their winnowed fingerprints, one for each length of shingle."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.words = []
        entries: dict[int, list] = {}
        for k, name in enumerate(self.names):
            raw = np.frombuffer(texts[name].encode(), np.uint8)
            codes, _ = _words(raw, np.array([len(raw)]))
            self.words.append(codes)
            # A template of fewer words than a shingle has is one shingle.
            size = min(SHINGLE, len(codes))
            if size:
                prints = C.Rolling(codes).grams(size)
                entries.setdefault(size, []).extend((prints[at], k, at) for at in winnow(prints))
        self.index = {}
        for size, rows in entries.items():
            rows.sort()
            self.index[size] = np.array([r[0] for r in rows], np.uint64), np.array([(r[1], r[2]) for r in rows], np.int64).reshape(-1, 2)

    def scan(self, texts: pa.Array) -> Iterator[list[dict]]:
        """For each text its matches."""
        for _, buf, ends in C.batches(texts):
            codes, counts = _words(buf, ends)
            last, roll = np.cumsum(counts), C.Rolling(codes)
            starts: list[tuple[int, int, int]] = []  # row, template, diagonal
            for size, (prints, of) in self.index.items():
                grams = roll.grams(size)
                for at in np.flatnonzero(C.member(grams, prints) & C.in_one_row(counts, size)[: len(grams)]).tolist():
                    row = int(np.searchsorted(last, at, side="right"))
                    low, high = np.searchsorted(prints, grams[at]), np.searchsorted(prints, grams[at], side="right")
                    starts += [(row, int(k), int(at - (last[row] - counts[row]) - place)) for k, place in of[low:high]]
            found: list[list[dict]] = [[] for _ in counts]
            for row in sorted({r for r, _, _ in starts}):
                found[row] = self._matches(codes[last[row] - counts[row] : last[row]], sorted({(k, d) for r, k, d in starts if r == row}))
            yield from found

    def _matches(self, text: np.ndarray, starts: list[tuple[int, int]]) -> list[dict]:
        out, done = [], {}
        for k, diagonal in starts:
            template = self.words[k]
            band = max(2, len(template) // 5)
            if diagonal <= done.get(k, -(1 << 60)) + band:
                continue
            # Only the words about the diagonal are looked at.
            base = max(0, diagonal - band)
            matched, start, end = align(template, text[base : diagonal + len(template) + band + 1], diagonal - base, band)
            done[k] = diagonal
            if matched >= LEAST * len(template):
                out.append({"license": self.names[k], "coverage": matched / len(template), "matched": matched, "start": base + start, "end": base + end})
        return _best_of(out)


def _best_of(matches: list[dict]) -> list[dict]:
    """Of matches that share words the one that covers most of the text, less what its template lacks; versions of a license differ in few words."""
    kept: list[dict] = []
    for m in sorted(matches, key=lambda m: (-(2 * m["matched"] - m["matched"] / m["coverage"]), -m["coverage"], m["license"])):
        if all(m["end"] <= x["start"] or x["end"] <= m["start"] for x in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m["start"], m["license"]))


_MATCH_DDL = "array<struct<license string, coverage double, matched int, start int, end int>>"
_MATCH = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def license_matches(text: Column, templates: dict[str, str] | None = None) -> Column:
    """The licenses that a text carries, with coverage of the template and span in words."""
    ship(SparkSession.active())
    index = Templates(TEXTS if templates is None else templates)

    @F.arrow_udf(_MATCH_DDL)
    def scan(texts: pa.Array) -> pa.Array:
        out = pa.array(list(index.scan(texts)), _MATCH)
        C.release()
        return out

    return scan(text)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each place where a document carries a license: doc_id, license, coverage, matched, start, end.

    Words are runs of letters and digits in lower case. Templates' shingles of five words are winnowed into an inverted
    index, which every shingle of a document probes; about each hit's diagonal a banded alignment counts the template's
    words that the text has in order, and 80 % or more of them make a match. start and end are word places in the text. Of
    matches that share words, as versions of one license do, the best stays; ties go by the license's name. Shorter
    templates are found whole. A null or empty text has no match; texts may be as long as a cell; equal ids and repeated
    rows are scanned apart; an empty table gives none; other columns are not read, whatever their names. The templates,
    about 20 KB, go to every task.
    """
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(license_matches(F.col(text_col), templates)).alias("m"))
    return found.select("doc_id", "m.license", F.round("m.coverage", 6).alias("coverage"), "m.matched", "m.start", "m.end")
