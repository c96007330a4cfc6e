"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Unit vectors are centred and turned by rotations that iterative quantisation learns on a bounded sample; the signs are
the code. Codes are split into m substrings of a byte, each with its own table. By the pigeonhole principle a code within
``radius`` of a query agrees with it up to t bits on at least one substring, where the substrings' bounds t add up to
radius - m + 1; so probing every table that far retrieves every such code. Of those within the radius, and of no other
row, exact cosines are computed.
The first radius is the one that holds the true neighbours of the sample. A query is settled once its radius holds what
lies at the angle of its k-th row found; others are asked again with a wider one. The query set meets the rows in blocks,
each with its own tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import _columnar as C
from tidemark.llm._session import cut, partitions

SAMPLE = 4_000
ROTATIONS = 2
BLOCK = 4_096
QUERY_BLOCK = 2_048
#: Queries of a block that are compared at a time, which bounds a task's memory.
AT_ONCE = 256
#: A radius holds bits that differ by so many standard deviations more than an angle makes likely.
SIGMAS = 1.0
_BITS = np.bitwise_count(np.arange(256, dtype=np.uint8))
_APART = _BITS[np.arange(256)[:, None] ^ np.arange(256)[None]]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Codes:
    """How vectors become codes, and how far a search goes."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """A row of bytes, the substrings, for each vector."""
        signs = (_unit(vectors) - self.mean) @ self.turn > 0
        return np.packbits(np.pad(signs, ((0, 0), (0, -signs.shape[1] % 8))), axis=1)


def learn_codes(sample: np.ndarray, k: int = 5, rotations: int = ROTATIONS, share: float = 0.93, rounds: int = 25, seed: int = 5) -> Codes:
    """Learn the rotations by iterative quantisation, and the radius that holds ``share`` of the sample's k neighbours."""
    rng, units = np.random.default_rng(seed), _unit(sample)
    mean = units.mean(axis=0)
    x, d = units - mean, sample.shape[1]
    turns = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
            r = u @ v
        turns.append(r)
    codes = Codes(mean, np.hstack(turns), 0)
    bytes_ = codes.encode(sample)
    some = rng.permutation(len(sample))[:500]
    near = units[some] @ units.T
    near[np.arange(len(some)), some] = -2
    k = min(k, len(sample) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(some), 0), int)
    apart = np.bitwise_count(bytes_[some][:, None] ^ bytes_[best]).sum(axis=2)
    return Codes(mean, codes.turn, int(np.quantile(apart, share)) if apart.size else 8 * bytes_.shape[1])


def bounds(radius: int, substrings: int) -> np.ndarray:
    """How many bits of each substring may differ: together radius - substrings + 1, as even as can be; -1 is none at all."""
    total = radius - substrings + 1
    return total // substrings + (np.arange(substrings) < total % substrings)


class Tables:
    """One table a substring of a block's codes, probed for many queries at once."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        width = -(-codes.shape[1] // 8) * 8
        self.words = np.pad(codes, ((0, 0), (0, width - codes.shape[1]))).view(np.uint64)

    def within(self, probes: np.ndarray, radius: int) -> np.ndarray:
        """Which rows have a code that differs from each probe's in at most ``radius`` bits: a matrix of probes by rows."""
        met = np.zeros((len(probes), len(self.codes)), bool)
        for j, bound in enumerate(bounds(radius, self.codes.shape[1])):
            if bound >= 0:
                # The buckets of table j that a probe reaches, and the rows in them.
                met |= (_APART[probes[:, j]] <= bound)[:, self.codes[:, j]]
        asked, rows = np.nonzero(met)
        words = np.pad(probes, ((0, 0), (0, self.words.shape[1] * 8 - probes.shape[1]))).view(np.uint64)
        far = sum(np.bitwise_count(words[asked, w] ^ self.words[rows, w]).astype(np.int32) for w in range(words.shape[1])) > radius
        met[asked[far], rows[far]] = False
        return met


def reranked(query: np.ndarray, units: np.ndarray, firsts: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` best of ``rows`` by exact cosine, ties to the smaller id, and their cosines; no other row is scored."""
    score = (units[rows] * query).sum(axis=1)
    if len(rows) > most:
        best = np.flatnonzero(score >= np.partition(score, -most)[-most])
        rows, score = rows[best], score[best]
    order = np.lexsort((firsts[rows], -score))[:most]
    return rows[order], score[order]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_FOUND = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])


def _search(codes: Codes, k: int):
    def task(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return _FOUND.empty_table()
        x, q = _matrix(rows["vector"]), _matrix(queries["asked"])
        tables, probes = Tables(codes.encode(x)), codes.encode(q)
        ux, uq = _unit(x), _unit(q)
        ids, asked = rows["ids"].combine_chunks(), queries["query"].to_pylist()
        firsts = np.array([v[0].as_py() for v in ids])
        found: list[list] = [[], [], []]
        for begin in range(0, len(probes), AT_ONCE):
            some = slice(begin, begin + AT_ONCE)
            for n, met in enumerate(tables.within(probes[some], codes.radius), begin):
                best, score = reranked(uq[n], ux, firsts, np.flatnonzero(met), k + 1)
                found[0] += [asked[n]] * len(best)
                found[1] += best.tolist()
                found[2] += score.tolist()
        return pa.table([pa.array(found[0], pa.int64()), ids.take(pa.array(found[1], pa.int64())), pa.array(found[2], pa.float64())], schema=_FOUND)

    return task


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine of each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    A row's own id is no candidate of it; ties go to the smaller id. Rows with a null id, and vectors that are null,
    empty or zero, hold null or non-finite numbers or have another length than most, take no part. Rows that share a
    vector are searched once; of each vector the k + 1 smallest ids can be among the results; rows that are the same count
    once. A query gets fewer than k rows only where the table holds no more; an empty table gives none. Other columns are
    not read, whatever their names. The codes are fitted on ``sample`` vectors at most; every row is indexed.
    """
    n = partitions(vectors.sparkSession)
    # Numbers of 32 bits stay so on their way; tasks reckon with 64.
    kind = "float" if vectors.select(vector_col).schema[0].dataType.elementType.simpleString() == "float" else "double"
    vector = F.transform(F.col(vector_col), lambda v: v.cast(kind))
    fine = F.forall(F.col("vector"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(F.col("vector"), lambda v: v != 0)
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).filter(F.col("vec_id").isNotNull() & fine)
    top = clean.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # -0.0 and 0.0 are one number here; equal vectors then have one key.
    keyed = cut(clean.filter(F.size("vector") == top.d).withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0).cast(kind))).withColumn("key", F.xxhash64("vector")))
    low = Window.partitionBy("key", "vector").orderBy("vec_id")
    few = keyed.dropDuplicates(["vec_id", "key"]).withColumn("n", F.row_number().over(low)).filter(F.col("n") <= k + 1)
    distinct = cut(few.groupBy("key", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    drawn = distinct.orderBy("key").limit(sample).select("vector").toArrow()
    codes = learn_codes(_matrix(drawn["vector"]), k)
    asking = keyed.filter(F.col("vec_id") % every == 0)
    queries = asking.groupBy("key", "vector").agg(F.min("vec_id").alias("query"))
    blocks, across = -(-distinct.count() // BLOCK), lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])

    def probe(queries: DataFrame, asked: int, codes: Codes) -> DataFrame:
        """The k + 1 best rows of each query within the radius."""
        query_blocks = max(1, -(-asked // QUERY_BLOCK))
        left = distinct.select("ids", "vector", F.pmod("key", F.lit(blocks)).cast("int").alias("block"), across(query_blocks).alias("query_block"))
        right = queries.select("query", F.col("vector").alias("asked"), across(blocks).alias("block"), F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int").alias("query_block"))
        pairs = left.repartition(n, "block", "query_block").groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block"))
        found = pairs.applyInArrow(C.lean(_search(codes, k)), "query long, ids array<long>, score double")
        return cut(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n"))

    bits, step = codes.turn.shape[1], -(-codes.turn.shape[1] // 8)
    apart = F.acos(F.greatest(F.least(F.min("score"), F.lit(1.0)), F.lit(-1.0))) / F.lit(np.pi)
    wanted = F.ceil(apart * bits + SIGMAS * F.sqrt(bits * apart * (1 - apart)))
    short, open_, asked = None, queries, asking.count()
    while asked:
        found = probe(open_, asked, codes)
        last_round = codes.radius >= bits
        # How far out each query must look, by the last of its rows; those with too few rows go on in growing steps.
        reach = found.groupBy("query").agg(F.sum(F.size("ids")).alias("n"), F.count("*").alias("rows"), F.least(wanted, F.lit(bits)).alias("wanted"))
        enough = reach.filter((F.col("n") >= k + 1) & ((F.col("wanted") <= codes.radius) | (F.col("rows") < k + 1))).select("query")
        settled = found if last_round else found.join(enough, "query", "left_semi")
        short = settled if short is None else short.unionByName(settled)
        if last_round:
            break
        open_ = cut(open_.join(enough, "query", "left_anti"))
        more = open_.join(reach.filter(F.col("n") >= k + 1), "query", "left").agg(F.count("*").alias("n"), F.max("wanted").alias("far"), F.count_if(F.col("wanted").isNull()).alias("short")).first()
        radius = max(more.far or 0, codes.radius + 1, codes.radius + step if more.short else 0)
        asked, codes, step = more.n, replace(codes, radius=min(bits, radius)), 2 * step if more.short else step
    if short is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Back from distinct query vectors to the query rows; a query's own id then drops out.
    named = asking.select("vec_id", "key", "vector").dropDuplicates(["vec_id", "key"]).join(queries, ["key", "vector"]).select(F.col("vec_id").alias("query_id"), "query")
    each = named.join(short, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
