"""Mixing sources to target weights: shares of the corpus by water-filling, documents by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._session import cut

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Ranks are counted in so many bins a source and level before the one bin that the target cuts is looked at.
BINS = 1024
_WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """How many runs of characters other than space and tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``most`` times its source's size; the excess is shared again by weight until none is above. A source of size 0 has
    target 0; an empty table gives none. Each round is one aggregation over the sources and fills one more at least.
    """
    # Places of the sources: counted by ranges of the name, so that no task ranks them all.
    named = sizes.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").sortWithinPartitions("none", "source")
    placed = cut(named.select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    # One row for each partition, not for each source.
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("base")).select("part", "base", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    turn = F.pmod(F.col("before") + F.col("at") - F.col("base"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    weighed = cut(placed.join(before, "part").select("source", "source_size", weight.alias("weight"), (most * F.col("source_size") / weight).alias("full_at")))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate, seen = 0.0, None
    while True:  # the rate only rises, so each round fills at least one more source or is the last
        full = F.col("full_at") <= F.lit(rate)
        n, taken, rest = weighed.agg(F.count_if(full), F.sum(F.when(full, most * F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == seen or not rest:
            break
        seen, rate = n, (total - (taken or 0)) / rest
    target = F.when(F.col("full_at") <= F.lit(rate), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(rate))
    return weighed.select("source", "source_size", target.alias("target"))


def _pareto_rank(seed: int, chance: Column) -> Column:
    """Random odds over inclusion odds; the random number is a hash of the row, so that reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("mark")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return (u / (1 - u)) / (chance / (1 - chance))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document, so that each source's words come to its target.

    docs: a row per document. Size is the number of words. A source's target over its size is the mean number of copies
    of its documents: the whole copies in it are certain, and of the rest one more copy of some documents is drawn by
    Pareto order sampling. A document's chance of that copy is the fraction that is left, smaller for documents longer
    than what the source has left to take. Documents are taken in order of their rank, random odds over inclusion odds,
    up to the target; the one document whose size fits what is then left best closes the gap.

    Returns, for each row of docs, doc_id, source, size, source_size, target, copies and taken (size times copies). No
    document gets more than ``most`` copies. A null or empty text has size 0 and is taken for nothing; null is a source of
    its own, the last; rows that share id and text share their draw, but each is taken by itself; ties of rank go by id
    and text; an empty table gives none. Other columns are not read, whatever their names.
    """
    own = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark"), F.monotonically_increasing_id().alias("row")))
    targets = cut(source_targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    return _draw(own, targets, most, seed)


def _draw(own: DataFrame, targets: DataFrame, most: int, seed: int) -> DataFrame:
    pair = own.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sure = F.least(F.floor(ratio), F.lit(most)).cast("int")
    left = F.col("target") - sure * F.col("source_size")
    part = F.greatest(ratio - sure, F.lit(0.0))
    # A text that is long against what is left would overshoot: its chance falls with its length.
    chance = F.least(F.greatest(part * F.least(F.lit(1.0), left / F.greatest(F.col("size"), F.lit(1))), F.lit(1e-9)), F.lit(1 - 1e-9))
    open_ = (part > 0) & (F.col("size") > 0) & (sure < most)
    ranked = cut(pair.select("doc_id", "mark", "row", "source", "size", "source_size", "target", sure.alias("sure"), left.alias("left"), F.when(open_, _pareto_rank(seed, chance)).alias("rank")))
    return _take(ranked)


def _take(ranked: DataFrame) -> DataFrame:
    """Add one copy of the rows with the smallest ranks of each source until its words left are reached."""
    unit = F.col("rank") / (1 + F.col("rank"))
    binned = ranked.withColumn("fine", F.floor(unit * F.lit(float(BINS * BINS))).cast("long")).withColumn("bin", F.floor(F.col("fine") / BINS))
    edges = None
    # Words by bin of the rank, the bin in which the target falls, then the finer bins of that bin.
    for level in ("bin", "fine"):
        inside = binned.filter("rank IS NOT NULL")
        if edges is None:
            inside = inside.withColumn("base", F.lit(0).cast("long"))
        else:
            inside = inside.join(edges, inside.source.eqNullSafe(edges.edge_source) & (inside.bin == edges.edge))
        sums = inside.groupBy("source", level, "left", "base").agg(F.sum("size").alias("words"))
        lower = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        upto = sums.withColumn("upto", F.col("base") + F.coalesce(F.sum("words").over(lower), F.lit(0)))
        crossed = upto.filter((F.col("upto") < F.col("left")) & (F.col("upto") + F.col("words") >= F.col("left")))
        edges = cut(crossed.select(F.col("source").alias("edge_source"), F.col(level).alias("edge"), F.col("upto").alias("base")))
    keyed = binned.join(edges, binned.source.eqNullSafe(edges.edge_source), "left")
    below = F.col("rank").isNotNull() & (F.col("edge").isNull() | (F.col("fine") < F.col("edge")))
    clear = keyed.filter("NOT fine <=> edge OR edge IS NULL").withColumn("extra", below)
    order = Window.partitionBy("source", "fine").orderBy("rank", "doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, 0)
    close = keyed.filter("fine = edge").withColumn("extra", F.col("base") + F.sum("size").over(order) <= F.col("left"))
    drawn = cut(clear.unionByName(close).select(*ranked.columns, "extra"))
    # What the row that would cross the target leaves open goes to the one row that fits it best, if any brings it nearer.
    gaps = drawn.groupBy("source").agg((F.max("left") - F.coalesce(F.sum(F.when(F.col("extra"), F.col("size"))), F.lit(0))).alias("gap")).withColumnRenamed("source", "gap_source")
    fits = drawn.filter("rank IS NOT NULL AND NOT extra").join(gaps, drawn.source.eqNullSafe(gaps.gap_source))
    miss = F.abs(F.col("size") - F.col("gap"))
    best = fits.filter(miss < F.col("gap")).groupBy("gap_source").agg(F.min_by("row", F.struct(miss, "rank", "doc_id", "mark", "row")).alias("fit"))
    last = drawn.row == best.fit
    extra = F.coalesce(F.col("extra"), F.lit(False)) | F.col("gap_source").isNotNull()
    copies = F.when(F.col("size") > 0, F.col("sure") + extra.cast("int")).otherwise(0)
    return drawn.join(best, last, "left").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
