"""What the operators read from the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.runtime import cut, shared_folder, ship

__all__ = ["cut", "partitions", "shared_folder"]


def partitions(spark: SparkSession) -> int:
    """The cluster's own parallelism for shuffles; everything that is dealt out scales with it."""
    return max(1, int(ship(spark).conf.get("spark.sql.shuffle.partitions")))
