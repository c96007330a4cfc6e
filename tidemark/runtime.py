"""What plans need of the cluster: this package on the executors, and a shared folder for results that are read again."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors once per application, for the tasks that run Python."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark


#: Python turns texts into objects many times their size: so many characters of them at a time.
BITE = 1 << 20


def bites(sizes: Iterable[int | None]) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of rows that hold about BITE characters each, or one larger row; what a task works on at a time."""
    start = held = end = 0
    for end, size in enumerate(sizes, 1):
        held += (size or 0) + 256
        if held >= BITE:
            yield start, end
            start, held = end, 0
    if end > start:
        yield start, end


def pieces(batches: Iterable[pa.Array]) -> Iterator[list[str | None]]:
    """The texts of Arrow batches, a bite at a time: no others become Python's objects, however many a batch holds."""
    for texts in batches:
        for start, end in bites(pc.utf8_length(texts).to_pylist()):
            yield texts.slice(start, end - start).to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session names in spark.checkpoint.dir.

    Where that is unset on one machine, as in tests, a temporary folder is set; on a cluster that is an error, as
    executors don't share the driver's folders.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of results that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs only a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
