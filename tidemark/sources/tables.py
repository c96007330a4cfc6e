"""Tables as DataFrames; paths go to Spark's readers alone, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``folder``: one file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
