"""Connected components by alternating large and small stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._session import cut, partitions


def join_spread(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to table by key; table has each key once, and as ``n`` how many of the ``total`` rows have it.

    Keys of more than a quarter of an even share of the rows, of which there are at most four for each partition, are
    broadcast, so that their rows stay where they are; only the others are shuffled.
    """
    limit = max(1000, total // (4 * partitions(rows.sparkSession)))
    many = F.broadcast(table.filter(F.col("n") > limit).drop("n"))
    rest = rows.join(many.select(key), key, "left_anti").join(table.filter(F.col("n") <= limit).drop("n"), key)
    return rows.join(many, key).unionByName(rest)


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Each vertex hands its smallest neighbour, or itself, to its larger neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    return join_spread(both.filter("v > u"), least.filter("n > 0"), "u", count).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Each vertex hands its smallest neighbour to its smaller neighbours and to itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    handed = join_spread(edges, least, "u", count).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(vertex, root) for every vertex that an edge joins to another; root is the smallest vertex of its component.

    Vertices are whole numbers. Edges may repeat, run either way or from a vertex to itself. The number of rounds grows
    with the logarithm of the longest path; each is cut by a checkpoint.
    """
    a, b = F.col(left), F.col(right)
    stars = cut(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return stars.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        seen = state
        stars = cut(_small_star(_large_star(stars, state[0]), state[0]))
