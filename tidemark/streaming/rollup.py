"""The rollups as a stream: each micro-batch is aggregated and merged into the days that it touches.

Late events land in their own day, however late, so there is no watermark. A rollup is kept by day, and a batch writes
the days that it touches anew, in folders named by the batch. A batch counts once its mark is written, after all four
rollups and the dirty targets. The mark is a manifest: the version of each day of each rollup, and the folders of dirty
targets, as the batch leaves them. Readers open the folders that it names and no others, so a batch reads the days that it
touches only. A batch that runs again after a failure starts from the mark before it and replaces what it wrote, so every
event counts once. Of each day the last two versions are kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import rollup as R

#: By rollup: its keys, the last of them the day, and how it follows from events and content.
ROLLUPS: dict[str, tuple[list[str], Callable[[DataFrame, DataFrame], DataFrame]]] = {
    "content_feedback": (["user_id", "content_id", "signal_date"], R.content_feedback_daily),
    "source_signals": (["user_id", "source_id", "signal_date"], lambda events, content: R.source_signals_daily(events)),
    "content_halo": (["content_id", "halo_date"], lambda events, content: R.content_halo_daily(events)),
    "source_halo": (["source_id", "halo_date"], R.source_halo_daily),
}
_KEPT = 2
#: Folders of dirty targets that are merged into one when a batch would leave more.
_MOST_DIRTY = 16


def _files(spark: SparkSession, folder: str):
    """Spark's own file system for a folder, and the folder's path in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def _manifest(spark: SparkSession, target: str, upto: int | None = None) -> dict:
    """What the last complete batch, or the last of those up to one, left: versions by rollup and day, dirty folders."""
    marks = [int(n) for n in _names(spark, f"{target}/done") if n.isdigit() and (upto is None or int(n) <= upto)]
    if not marks:
        return {"dirty": [], **{name: {} for name in ROLLUPS}}
    files, path = _files(spark, f"{target}/done/{max(marks)}")
    stream = files.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _mark(spark: SparkSession, target: str, batch_id: int, manifest: dict) -> None:
    """Write a batch's manifest under another name and give it its own when it is whole."""
    files, whole = _files(spark, f"{target}/done/{batch_id}")
    _, part = _files(spark, f"{target}/done/{batch_id}.part")
    out = files.create(part, True)
    out.write(json.dumps(manifest).encode())
    out.close()
    files.delete(whole, False)
    files.rename(part, whole)


def _days(spark: SparkSession, target: str, name: str, versions: dict[str, int]) -> DataFrame | None:
    """The rows of a rollup's days in these versions; None where there are no days."""
    if not versions:
        return None
    paths = [f"{target}/{name}/day={day}/batch={version}" for day, version in sorted(versions.items())]
    return spark.read.option("basePath", f"{target}/{name}").parquet(*paths).drop("day", "batch")


def _write_days(rows: DataFrame, day: str, batch_id: int, path: str) -> None:
    dated = rows.withColumns({"day": F.col(day).cast("string"), "batch": F.lit(batch_id)})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def _drop_old(spark: SparkSession, path: str, days: list[str]) -> None:
    for day in days:
        versions = sorted((int(v.partition("=")[2]) for v in _names(spark, f"{path}/day={day}") if v.startswith("batch=")), reverse=True)
        for version in versions[_KEPT:]:
            files, old = _files(spark, f"{path}/day={day}/batch={version}")
            files.delete(old, True)


def roll_up(batch: DataFrame, batch_id: int, content: DataFrame, target: str) -> None:
    """Merge one micro-batch of events into the four rollups and the dirty targets kept in target; events without time count nowhere."""
    spark = batch.sparkSession
    before = _manifest(spark, target, batch_id - 1)
    after = {"dirty": before["dirty"], **{name: dict(before[name]) for name in ROLLUPS}}
    batch = batch.filter("occurred_at IS NOT NULL").persist()
    days = [r[0] for r in batch.select(F.to_date("occurred_at").cast("string")).dropna().distinct().collect()]
    for name, (keys, of) in ROLLUPS.items():
        new = of(batch, content)
        old = _days(spark, target, name, {d: v for d, v in before[name].items() if d in days})
        if old is not None:
            new = R.merged(old, new, keys)
        _write_days(new, keys[-1], batch_id, f"{target}/{name}")
        # A rollup need not have a row on each of the batch's days.
        written = [d for d in days if f"batch={batch_id}" in _names(spark, f"{target}/{name}/day={d}")]
        after[name] |= dict.fromkeys(written, batch_id)
    marks = R.dirty_targets(batch, content)
    if len(before["dirty"]) >= _MOST_DIRTY:
        marks = _dirty(_dirty_rows(spark, target, before["dirty"]).select(*marks.columns).unionByName(marks))
        after["dirty"] = []
    marks.write.mode("overwrite").parquet(f"{target}/dirty/batch={batch_id}")
    after["dirty"] = [*after["dirty"], batch_id]
    _mark(spark, target, batch_id, after)
    for name in ROLLUPS:
        _drop_old(spark, f"{target}/{name}", days)
    for folder in _names(spark, f"{target}/dirty"):
        # What the mark before this one names stays, as this batch may run again.
        if int(folder.partition("=")[2]) not in {*before["dirty"], *after["dirty"]}:
            files, old = _files(spark, f"{target}/dirty/{folder}")
            files.delete(old, True)
    batch.unpersist()


def start_rollup(events: DataFrame, content: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run the rollups over all that a stream of events has now, in micro-batches."""
    return events.writeStream.foreachBatch(lambda batch, k: roll_up(batch, k, content, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, name: str = "content_feedback") -> DataFrame | None:
    """A rollup as the last complete batch left it; None before the first."""
    return _days(spark, target, name, _manifest(spark, target)[name])


def _dirty_rows(spark: SparkSession, target: str, batches: list[int]) -> DataFrame:
    return spark.read.option("basePath", f"{target}/dirty").parquet(*(f"{target}/dirty/batch={b}" for b in batches))


def _dirty(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "id").agg(F.min("first_marked_at").alias("first_marked_at"), F.max("last_marked_at").alias("last_marked_at"))


def dirty(spark: SparkSession, target: str) -> DataFrame:
    """The targets that events have touched since the folder was emptied, with the first and last event of each."""
    return _dirty(_dirty_rows(spark, target, _manifest(spark, target)["dirty"]))
