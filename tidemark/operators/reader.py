"""Word-by-word reading: units of a text, and the binary package of a document."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tidemark.runtime import bites, ship
from tidemark.schemas import UNITS

#: Longest chunk that isn't split, bytes of a unit's text and of a preview.
SPLIT_OVER, TOKEN_BYTES, PREVIEW_BYTES = 24, 32, 64


def cut_bytes(text: str, most: int) -> str:
    """The longest head of whole characters that fits so many UTF-8 bytes."""
    return text.encode()[:most].decode(errors="ignore")


def _split(chunk: str) -> list[str]:
    """A long chunk in two at the last hyphen before its middle, or else the first after it."""
    if len(chunk) <= SPLIT_OVER or "-" not in chunk:
        return [chunk]
    cut = chunk.rfind("-", 0, len(chunk) // 2 + 1)
    cut = (cut if cut >= 0 else chunk.find("-")) + 1
    return [x for x in (chunk[:cut], chunk[cut:]) if x]


def _pauses(chunk: str, after: int) -> tuple[bool, bool]:
    """(clause, sentence): what the punctuation behind the last letter asks for."""
    core, tail = chunk[:after].lstrip("([{\"'"), chunk[after:]
    dots, letters = core.count("."), sum(c.isascii() and c.isalpha() for c in core)
    short = dots > 0 and letters > dots and dots + letters == len(core)
    sentence = any(c in tail for c in "!?") or ("." in tail and not short)
    return not sentence and any(c in tail for c in ",;:—"), sentence


def _units(lines: list[str]) -> list[dict]:
    units: list[dict] = []
    for number, line in enumerate(lines, 1):
        begun = False
        for chunk in line.split():
            if not any(c.isalnum() for c in chunk):
                # Punctuation by itself belongs to the word before.
                if units:
                    clause, sentence = _pauses(chunk, 0)
                    units[-1]["clause_pause"] |= clause
                    units[-1]["sentence_pause"] |= sentence
                continue
            parts = _split(chunk)
            for k, part in enumerate(parts):
                places = [i for i, c in enumerate(part) if c.isalnum()] or [0]
                size = places[-1] + 1 - places[0] if any(c.isalnum() for c in part) else len(part)
                shown = cut_bytes(part, TOKEN_BYTES)
                anchor = places[0] + next((a for a, most in enumerate((1, 5, 9, 13)) if size <= most), 4)
                clause, sentence = _pauses(part, places[-1] + 1) if k == len(parts) - 1 else (False, False)
                units.append({"paragraph": number, "anchor": max(0, min(anchor, len(shown) - 1)), "chars": len(shown), "font": "L" if len(shown) <= 11 else "M" if len(shown) <= 17 else "S", "paragraph_start": not begun, "paragraph_end": False, "clause_pause": clause, "sentence_pause": sentence, "display": shown})
                begun = True
        if units:
            units[-1]["paragraph_end"] = True
    return units


def _bites(batch: pa.RecordBatch, lines: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, by the lengths of its lines; a unit of a text takes some ten times its text."""
    column = batch.column(lines)
    chars = np.append(0, np.cumsum(pc.fill_null(pc.utf8_length(column.flatten()), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
    upto = chars[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64))]
    for a, b in bites((4 * np.diff(upto)).tolist()):
        yield batch.slice(a, b - a)


def reading_units(docs: DataFrame, key: str, paragraphs: str) -> DataFrame:
    """(key, place, unit fields) of documents whose column ``paragraphs`` is an array of lines."""

    units = to_arrow_type(DataType.fromDDL(UNITS))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _bites(whole, paragraphs):
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array([_units(x or []) for x in b.column(paragraphs).to_pylist()], units)], [key, "units"])

    ship(docs.sparkSession)
    rows = docs.select(key, paragraphs).mapInArrow(of, f"{key} {docs.schema[key].dataType.simpleString()}, units {UNITS}")
    return rows.select(key, F.posexplode("units").alias("place", "u")).select(key, "place", "u.*")


#: The package's layout, little endian. Header: mark, version, 0, bytes of the title, paragraphs, units, places
#: of both tables, revision. A paragraph: first unit, bytes of its preview, preview. A unit: paragraph from 1, anchor,
#: characters, font, flags, bytes of its text, text.
HEADER, PARAGRAPH, UNIT = "<4sHHHHIIIQ", "<IB3x64s", "<HBBBBBx32s"
UNTITLED, MOST_TITLE = "UNTITLED ARTICLE", 65_535


def _package(title: str, revision: int, lines: list[str], units: list[dict]) -> bytes | None:
    """The package of a text; None where it has nothing to read, or too many paragraphs to count."""
    if not units or len(lines) > 65_535:
        return None
    name = cut_bytes((title or "").strip() or UNTITLED, MOST_TITLE).encode()
    first: dict[int, int] = {}
    for k, u in enumerate(units):
        first.setdefault(u["paragraph"], k)
    following, starts = len(units), []
    for n in range(len(lines), 0, -1):
        following = first.get(n, following)
        starts.append(following)
    tables = struct.calcsize(HEADER) + len(name)
    parts = [struct.pack(HEADER, b"MTRP", 1, 0, len(name), len(lines), len(units), tables, tables + struct.calcsize(PARAGRAPH) * len(lines), revision), name]
    for start, line in zip(reversed(starts), lines, strict=True):
        preview = cut_bytes(" ".join(line.split()), PREVIEW_BYTES).encode()
        parts.append(struct.pack(PARAGRAPH, start, len(preview), preview))
    for u in units:
        text = u["display"].encode()
        flags = u["clause_pause"] | u["sentence_pause"] << 1 | u["paragraph_start"] << 2 | u["paragraph_end"] << 3
        parts.append(struct.pack(UNIT, u["paragraph"], u["anchor"], u["chars"], "LMS".index(u["font"]), flags, len(text), text))
    return b"".join(parts)


def packages(docs: DataFrame, key: str, paragraphs: str, title: str | None = None, revision: str | None = None) -> DataFrame:
    """(key, package): the binary package of each document's paragraphs, with its title and revision where columns name them."""
    own = docs.select(F.col(key).alias("key"), F.col(paragraphs).alias("lines"), (F.col(title) if title else F.lit(None)).cast("string").alias("title"), (F.col(revision) if revision else F.lit(0)).cast("long").alias("revision"))
    kind = docs.schema[key].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _bites(whole, "lines"):
                made = [_package(r["title"], r["revision"], x := r["lines"] or [], _units(x)) for r in b.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(made, pa.binary())], [key, "package"])

    ship(docs.sparkSession)
    return own.mapInArrow(of, f"{key} {kind}, package binary")
