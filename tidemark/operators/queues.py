"""Work lists: messages, claims, retries. One writer owns a list; every step is a DataFrame from one state to the next."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds to wait before each retry, by list.
BACKOFF = {"content": (60, 300, 1800), "source": (60, 300, 1800), "recovery": (300, 1800), "render": (900, 3600)}
STALE_SECONDS = {"content": 900, "source": 900, "recovery": 900, "render": 1800}


def readable(queue: DataFrame, now: Column, n: int) -> DataFrame:
    """The first n messages that are due."""
    return queue.filter(F.col("visible_at") <= now).orderBy("message_id").limit(n)


def taken(queue: DataFrame, now: Column, n: int, hide_seconds: int) -> DataFrame:
    """queue after n messages were read: those are hidden for a while and count one more read."""
    got = readable(queue, now, n).select("message_id", F.lit(True).alias("got"))
    rows = queue.join(got, "message_id", "left")
    later = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hide_seconds))
    return rows.select("message_id", "payload", F.when(F.col("got"), later).otherwise(F.col("visible_at")).alias("visible_at"), (F.col("reads") + F.coalesce(F.col("got"), F.lit(False)).cast("int")).alias("reads"))


def sent(queue: DataFrame, messages: DataFrame, now: Column, delay_seconds: int = 0) -> DataFrame:
    """queue with messages (message_id, payload) behind it, hidden for a while."""
    at = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max(0, delay_seconds)))
    return queue.unionByName(messages.select("message_id", "payload", at.alias("visible_at"), F.lit(0).alias("reads")))


def archived(queue: DataFrame, archive: DataFrame, done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(queue, archive) after the messages of done (message_id) moved from the one to the other; unknown ones change nothing."""
    gone = queue.join(done.select("message_id"), "message_id", "left_semi").withColumn("archived_at", now)
    return queue.join(done.select("message_id"), "message_id", "left_anti"), archive.unionByName(gone.select(*archive.columns))


def claimed(rows: DataFrame, now: Column, stale_seconds: int, n: int) -> DataFrame:
    """rows after a worker claimed the first n that it may: those are in progress from now on."""
    mine = claimable(rows, now, stale_seconds).orderBy("id").limit(n).select("id", F.lit(True).alias("mine"))
    got = F.coalesce("mine", F.lit(False))
    marked = rows.join(mine, "id", "left").withColumn("status", F.when(got, "in_progress").otherwise(F.col("status"))).withColumn("claimed_at", F.when(got, now).otherwise(F.col("claimed_at")))
    return marked.select(*rows.columns)


def attempts_accepted(attempts: DataFrame, key: str, at: str, most: int, window_seconds: int) -> DataFrame:
    """attempts with accepted: whether fewer than ``most`` were accepted of that key in the window before; ties of time by id.

    An attempt depends on those accepted before it, so each key is walked in order of time. A task streams through its
    sorted rows and holds the last ``most`` accepted times of one key, however many rows the key has.
    """
    schema = attempts.withColumn("accepted", F.lit(True)).schema
    k, t = attempts.columns.index(key), attempts.columns.index(at)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, times = None, deque(maxlen=most)
        for batch in batches:
            out = []
            for who, when in zip(batch.column(k).to_pylist(), batch.column(t).cast(pa.int64()).to_pylist(), strict=True):
                if who != here:
                    here, times = who, deque(maxlen=most)
                while times and times[0] <= when - window_seconds * 1_000_000:
                    times.popleft()
                out.append(len(times) < most)
                if out[-1]:
                    times.append(when)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "accepted"])

    rows = attempts.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, at, *([c for c in attempts.columns if c == "id"])).mapInArrow(walk, schema)


def enqueued(queue: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources (payload) that aren't in the queue yet, each once."""
    return sources.select("payload").distinct().join(queue.select("payload"), "payload", "left_anti")


def claimable(rows: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """Rows to work on: pending ones, failed ones whose retry is due, and claims that have gone stale."""
    old = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stale_seconds))
    return rows.filter((F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("retry_at") <= now)) | ((F.col("status") == "in_progress") & (F.col("claimed_at") < old)))


def retry_after(retries: Column, kind: str) -> Column:
    """Seconds to wait after so many retries; null once they are used up."""
    ladder = BACKOFF[kind]
    n = F.greatest(F.coalesce(retries, F.lit(0)), F.lit(0))
    return F.when(n < len(ladder), F.element_at(F.array(*map(F.lit, ladder)), n + 1))


def due_sources(sources: DataFrame, queued: DataFrame, now: Column, stale_seconds: int = 900, subscriptions: DataFrame | None = None) -> DataFrame:
    """Sources to refresh: due, never refreshed or with a subscriber without a first delivery; not in the queue, not being worked on.

    subscriptions: source_id, backfilled_at.
    """
    fresh = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stale_seconds))
    busy = (F.col("status") == "in_progress") & (F.col("claimed_at") >= fresh)
    due = F.col("next_refresh_at").isNull() | (F.col("next_refresh_at") <= now)
    if subscriptions is not None:
        waiting = subscriptions.filter("backfilled_at IS NULL").select("source_id").distinct().withColumn("waits", F.lit(True))
        sources, due = sources.join(waiting, "source_id", "left"), due | F.coalesce("waits", F.lit(False))
    return sources.filter(due & ~F.coalesce(busy, F.lit(False))).drop("waits").join(queued.select("source_id"), "source_id", "left_anti")


def due_recoveries(rows: DataFrame) -> DataFrame:
    """Rows that want recovery, urgent ones first, then the oldest."""
    urgent = F.when(F.get_json_object("recovery", "$.priority") == "high", 0).otherwise(1)
    return rows.filter(F.get_json_object("recovery", "$.should_recover") == "true").withColumn("urgency", urgent).orderBy("urgency", "parsed_at", "id")


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def frequencies(rows: DataFrame, values: str) -> DataFrame:
    """How many rows have each of the values in a column of arrays: value, n, most frequent first."""
    each = rows.select(F.explode(F.array_distinct(values)).alias("value"))
    return each.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
