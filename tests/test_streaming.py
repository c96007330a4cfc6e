import pytest
from pyspark.sql import functions as F

from tidemark.operators import rollup as R
from tidemark.sources import entities as E
from tidemark.streaming import rollup as stream


def few_days(spark, data, days=4):
    """The events of the last days."""
    events = E.events(spark, data)
    last = events.select(F.max(F.to_date("occurred_at"))).first()[0]
    return events.filter(F.to_date("occurred_at") > F.date_sub(F.lit(last), days))


def key(rows):
    return sorted(map(str, rows))


def test_any_split_of_the_log_gives_one_rollup(spark, data, tmp_path):
    events, content = E.events(spark, data).filter("id % 10 < 3"), E.content_keys(spark, data)
    source, target = f"{tmp_path}/log", f"{tmp_path}/table"
    events.repartition(3, F.col("id") % 7).write.parquet(source)
    log = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.start_rollup(log, content, target, f"{tmp_path}/checkpoint").awaitTermination()
    for name, (_, of) in stream.ROLLUPS.items():
        want = of(events, content)
        assert key(stream.current(spark, target, name).select(*want.columns).collect()) == key(want.collect()), name
    want = R.dirty_targets(events, content)
    assert key(stream.dirty(spark, target).select(*want.columns).collect()) == key(want.collect())


@pytest.mark.parametrize("fails", [None, "source_signals", "dirty"])
def test_a_batch_that_runs_again_counts_once(spark, data, tmp_path, monkeypatch, fails):
    events, content, target = few_days(spark, data, 12), E.content_keys(spark, data), str(tmp_path)
    thirds = [events.filter(f"id % 3 = {k}") for k in range(3)]
    stream.roll_up(thirds[0], 0, content, target)
    if fails:
        # The second batch breaks off half-way, once: what it left must not show.
        before = key(stream.current(spark, target).collect())
        with monkeypatch.context() as m:
            def broken(*a):
                raise RuntimeError("lost")
            if fails == "dirty":
                m.setattr(stream.R, "dirty_targets", broken)
            else:
                m.setitem(stream.ROLLUPS, fails, (stream.ROLLUPS[fails][0], broken))
            with pytest.raises(RuntimeError):
                stream.roll_up(thirds[1], 1, content, target)
        assert key(stream.current(spark, target).collect()) == before
    for k in (1, 1, 2):
        stream.roll_up(thirds[k], k, content, target)
    want = R.content_feedback_daily(events, content)
    assert key(stream.current(spark, target).select(*want.columns).collect()) == key(want.collect())


def test_only_touched_days_are_written(spark, data, tmp_path):
    events, content, target = few_days(spark, data, 12), E.content_keys(spark, data), str(tmp_path)
    stream.roll_up(events, 0, content, target)
    day = events.select(F.max(F.to_date("occurred_at"))).first()[0]
    for k in range(1, 4):
        stream.roll_up(events.filter(F.to_date("occurred_at") == F.lit(day)), k, content, target)
    versions = {d.name: sorted(v.name for v in d.iterdir()) for d in (tmp_path / "content_feedback").glob("day=*")}
    assert versions.pop(f"day={day}") == ["batch=2", "batch=3"] and set(map(tuple, versions.values())) == {("batch=0",)}


def test_files_of_untouched_days_are_not_read(spark, data, tmp_path, monkeypatch):
    events, content, target = few_days(spark, data), E.content_keys(spark, data), str(tmp_path)
    stream.roll_up(events, 0, content, target)
    day = str(events.select(F.max(F.to_date("occurred_at"))).first()[0])
    opened, whole = [], stream._days

    def days(spark, target, name, versions):
        rows = whole(spark, target, name, versions)
        opened.extend(rows.inputFiles() if rows is not None else [])
        return rows

    monkeypatch.setattr(stream, "_days", days)
    stream.roll_up(events.filter(F.to_date("occurred_at") == F.lit(day)), 1, content, target)
    assert opened and all(f"/day={day}/batch=0/" in f for f in opened), opened
    # With the other days' files gone the batch can still run: nothing else of theirs is touched.
    for other in tmp_path.glob("content_feedback/day=*"):
        if other.name != f"day={day}":
            for f in other.rglob("*.parquet"):
                f.write_bytes(b"")
    stream.roll_up(events.filter(F.to_date("occurred_at") == F.lit(day)), 2, content, target)
    assert stream._manifest(spark, target)["content_feedback"][day] == 2


def test_dirty_folders_are_merged(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "_MOST_DIRTY", 2)
    events, content, target = few_days(spark, data), E.content_keys(spark, data), str(tmp_path)
    parts = [events.filter(f"id % 4 = {k}") for k in range(4)]
    for k in (0, 1, 2, 2, 3):  # the third, which merges, runs again
        stream.roll_up(parts[k], k, content, target)
    assert len(list((tmp_path / "dirty").iterdir())) <= 4 and len(stream._manifest(spark, target)["dirty"]) <= 2
    want = R.dirty_targets(events, content)
    assert key(stream.dirty(spark, target).select(*want.columns).collect()) == key(want.collect())
