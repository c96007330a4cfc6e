"""SimHash near-duplicates: fingerprints of word shingles, linked through pigeonhole blocks.

Two fingerprints that differ in three bits or fewer agree on three of six blocks, so each distinct fingerprint is dealt
out under the twenty choices of three blocks, and only those that meet are compared. A key that more than ``CROWD``
fingerprints share is taken apart again: under the 560 choices of thirteen of sixteen blocks of four bits no key can
hold more than 2**12 fingerprints. Of each key only a spanning star of each linked group is kept, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _columnar as C
from tidemark.llm._session import cut, partitions
from tidemark.llm.components import components, join_spread
from tidemark.runtime import ship

DISTANCE = 3
SEED = 42
CROWD = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fingerprint(text: bytes, size: int) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - size + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), ">u8", n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def simhash(text: Column | str, size: int = 3) -> Column:
    """The 64-bit SimHash of a text as a long: bit by bit, whether over half the shingles' XXH64 (seed 42) have it set.

    Words are the runs of characters other than space and tab to carriage return, A-Z in lower case; a shingle is
    ``size`` words joined by one space, repeats included; fewer words make one shingle, none or a null text zero.
    """

    ship(SparkSession.active())

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        values = (_fingerprint(t.as_buffer().to_pybytes(), size) for t in C.binary(texts))
        out = pa.array(np.fromiter(values, np.uint64, len(texts)).view(np.int64))
        C.release()
        return out

    return fingerprints(text if isinstance(text, Column) else F.col(text))


def _masks(blocks: int, kept: int) -> list[int]:
    """Masks that keep ``kept`` of so many blocks of the 64 bits, each as signed."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(parts, kept)]


def _linked(values: np.ndarray) -> Iterator[tuple[np.uint64, np.uint64]]:
    """(member, smallest member) of each group that links of so few bits hold together."""
    values = np.unique(values)
    if len(values) < 2:
        return
    near = np.zeros((len(values), len(values)), bool)
    for k in range(0, len(values), 512):
        near[k : k + 512] = np.bitwise_count(values[k : k + 512, None] ^ values[None]) <= DISTANCE
    left = np.ones(len(values), bool)
    for k in range(len(values)):
        if left[k]:
            group, edge = np.zeros(len(values), bool), np.array([k])
            group[k] = True
            while len(edge):
                reach = near[edge].any(axis=0) & ~group
                group |= reach
                edge = np.flatnonzero(reach)
            left &= ~group
            for x in values[group][1:]:
                yield x, values[k]


def _link(crowd: int):
    """Over rows sorted by key: stars of linked fingerprints, or the members of a key that too many share (root null)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key, passing = [], None, False

        def flush():
            return [] if passing else list(_linked(np.concatenate(held))) if held else []

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else []
            links, crowded = [], []
            starts, stops = np.asarray(edges[:-1]), np.asarray(edges[1:])
            # Keys with one row that neither begin nor end the batch hold no link.
            busy = np.flatnonzero((stops - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))
            for a, b in zip(starts[busy].tolist(), stops[busy].tolist(), strict=True):
                if keys[a] != held_key:
                    links += flush()
                    held, held_key, passing = [], keys[a], False
                held.append(prints[a:b])
                if passing or sum(map(len, held)) > crowd:
                    passing = True
                    crowded += [x for part in held for x in part.tolist()]
                    held = []
            members = np.array([x for x, _ in links] + crowded, np.uint64).view(np.int64)
            roots = [int(np.uint64(y).astype(np.int64)) for _, y in links] + [None] * len(crowded)
            yield pa.record_batch([pa.array(members, pa.int64()), pa.array(roots, pa.int64())], names=["member", "root"])
        links = flush()
        yield pa.record_batch([pa.array([int(x.astype(np.int64)) for x, _ in links], pa.int64()), pa.array([int(y.astype(np.int64)) for _, y in links], pa.int64())], names=["member", "root"])

    return task


def _links_by(prints: DataFrame, masks: list[int], crowd: int) -> DataFrame:
    n = partitions(prints.sparkSession)
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fingerprint").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)))
    dealt = prints.select(F.explode(keys).alias("key"), "fingerprint").repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_link(crowd), "member long, root long")


def near_duplicate_groups(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(vertex, root) for the fingerprints that links hold together with others; prints has each ``fingerprint`` once."""
    links = cut(_links_by(prints, _masks(6, 6 - DISTANCE), crowd))
    crowded = links.filter("root IS NULL").select(F.col("member").alias("fingerprint")).distinct()
    finer = _links_by(crowded, _masks(16, 16 - DISTANCE), max(crowd, CROWD))
    return components(links.filter("root IS NOT NULL").unionByName(finer), "member", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Each document's fingerprint and the group of documents that it is linked to, directly or through others.

    docs: a row per document. Fingerprints link at three or fewer differing bits. Returns, for each row of docs, doc_id,
    fingerprint (a long), root (the group's smallest fingerprint as a signed number) and component_id (the smallest
    doc_id in the group). A null text has fingerprint zero and links like any other; equal ids stay rows of their own;
    a group whose ids are all null has a null component_id; an empty table gives none. Texts may be as long as a cell;
    other columns are not read, whatever their names.
    """
    own = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), simhash(F.col(text_col)).alias("fingerprint")))
    prints = cut(own.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    rooted = _rooted(prints, crowd)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = join_spread(rooted.select("fingerprint", "root", F.col("n").alias("rows")), least, "root", prints.count())
    named = cut(named.withColumnRenamed("rows", "n"))
    return join_spread(own, named, "fingerprint", own.count()).select("doc_id", "fingerprint", "root", "component_id")


def _rooted(prints: DataFrame, crowd: int) -> DataFrame:
    """prints with root, the smallest fingerprint of the group; cut, since several steps read it."""
    grouped = near_duplicate_groups(prints.select("fingerprint"), crowd)
    return cut(prints.join(grouped, prints.fingerprint == grouped.vertex, "left").drop("vertex").withColumn("root", F.coalesce("root", "fingerprint")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest id, with its own columns.

    Null and empty texts, and texts of white space, are one group (fingerprint zero). Rows without id come last; of rows
    that share the smallest id the one with the smallest hash of its text stays, and of rows that share id and text any
    one. Texts may be as long as a cell; columns may have any name; an empty table gives none.
    """
    names = docs.columns
    identity = (F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("mark"))
    own = docs.select(*identity, simhash(F.col(text_col)).alias("fingerprint"))
    # The groups are settled on ids and fingerprints alone; texts are moved once, copies of a row having been dropped.
    prints = cut(own.groupBy("fingerprint").agg(F.min(F.struct("none", "id", "mark")).alias("place")))
    chosen = _rooted(prints, crowd).groupBy("root").agg(F.min("place").alias("place")).select("place.*")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *identity).dropDuplicates(["none", "id", "mark"])
    return rows.join(chosen, ["none", "id", "mark"], "left_semi").select("row.*")
