"""Streams: late rows, restart of a batch, equality with the batch form."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from marquee import catalog
from marquee.schemas import EVENTS
from marquee.session import folder_names, new_folder
from marquee.sources.snapshots import SnapshotStore
from marquee.streaming import activity
from tests.conftest import SMALL, by
from tests.test_snapshots import T1, T2, rows

T0 = T1 - timedelta(days=1)


def events(spark, folder, *times, kind="view"):
    items = [(i, t, 1, kind, 1.5, "{}") for i, t in enumerate(times)]
    spark.createDataFrame(items, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_complete_keeps_late_rows(spark):
    folder = new_folder(spark, "events")
    events(spark, folder, datetime(2024, 1, 1, 10, 5), datetime(2024, 1, 1, 10, 59), datetime(2024, 1, 1, 20))
    events(spark, folder, datetime(2024, 1, 1, 10, 30))
    out = activity.run_complete(spark, activity.hourly_activity(activity.event_stream(spark, folder)), "t")
    got = by(out, "window_start")
    assert got[datetime(2024, 1, 1, 10)]["events"] == 3 and len(got) == 2
    assert float(got[datetime(2024, 1, 1, 10)]["total_value"]) == 4.5


def test_append_holds_open_hours_and_drops_late_rows(spark):
    folder = new_folder(spark, "events")
    events(spark, folder, datetime(2024, 1, 1, 10, 5), datetime(2024, 1, 1, 20))
    frame = activity.hourly_activity(activity.event_stream(spark, folder))
    out, state = new_folder(spark, "out"), new_folder(spark, "state")

    def run():
        query = (
            frame.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state)
            .trigger(availableNow=True).start(out)
        )
        query.awaitTermination()
        return by(spark.read.schema(frame.schema).parquet(out), "window_start")

    first = run()
    assert set(first) == {datetime(2024, 1, 1, 10)}
    events(spark, folder, datetime(2024, 1, 1, 10, 30), datetime(2024, 1, 2, 5))
    second = run()
    assert second[datetime(2024, 1, 1, 10)]["events"] == 1
    assert set(second) == {datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 20)}


def test_update_merges_hours_with_bounded_state(spark):
    folder, out, state = (new_folder(spark, n) for n in ("events", "hours", "state"))
    for day in range(1, 9):  # one micro-batch a day, three hours each
        events(spark, folder, *(datetime(2024, 1, day, hour, 5) for hour in (1, 2, 23)))
    rows_in_state, dropped = [], []

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event): ...
        def onQueryTerminated(self, event): ...
        def onQueryIdle(self, event): ...
        def onQueryProgress(self, event):
            rows_in_state.extend(s.numRowsTotal for s in event.progress.stateOperators)
            dropped.extend(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    listener = Progress()
    spark.streams.addListener(listener)
    try:
        frame = activity.hourly_activity(activity.event_stream(spark, folder, files=1))
        first = by(activity.run_update(spark, frame, "t", state, out), "window_start")
        assert len(first) == 24 and {r["events"] for r in first.values()} == {1}
        # Later: one more in an hour that is still open, one that is too late, one in a new hour of an old day.
        events(spark, folder, datetime(2024, 1, 8, 23, 50), datetime(2024, 1, 2, 1, 50), datetime(2024, 1, 8, 22, 30))
        second = by(activity.run_update(spark, frame, "t", state, out), "window_start")
    finally:
        spark.streams.removeListener(listener)
    assert second[datetime(2024, 1, 8, 23)]["events"] == 2 and second[datetime(2024, 1, 2, 1)]["events"] == 1
    assert second[datetime(2024, 1, 8, 22)]["events"] == 1 and len(second) == 25
    assert max(rows_in_state) <= 6 and sum(dropped) == 1


def test_update_repeated_batch_changes_nothing(spark):
    out = new_folder(spark, "hours")
    schema = "window_start timestamp, window_end timestamp, event_type string, events long, total_value decimal(28,4)"

    def batch(*items):
        rows = [(datetime(2024, 1, d, h), datetime(2024, 1, d, h + 1), kind, n, None) for d, h, kind, n in items]
        return spark.createDataFrame(rows, schema)

    def table():
        rows = spark.read.schema(schema).parquet(out).collect()
        return {(r["window_start"].day, r["window_start"].hour, r["event_type"]): r["events"] for r in rows}

    activity.merge_hours(batch((1, 1, "a", 2), (1, 1, None, 1), (2, 1, "a", 5)), 0, out)
    files = set(Path(out, "day=2024-01-02").glob("*.parquet"))
    for _ in range(2):
        activity.merge_hours(batch((1, 1, "a", 3), (1, 2, "a", 1)), 1, out)
        assert table() == {(1, 1, "a"): 3, (1, 1, None): 1, (1, 2, "a"): 1, (2, 1, "a"): 5}
    activity.merge_hours(batch(), 2, out)
    assert len(table()) == 4
    # A day without changes keeps its files.
    assert set(Path(out, "day=2024-01-02").glob("*.parquet")) == files and files


def test_update_without_input(spark):
    folder = new_folder(spark, "events")
    spark.createDataFrame([], EVENTS).write.parquet(folder)
    assert activity.run_update(spark, activity.hourly_activity(activity.event_stream(spark, folder)), "t").count() == 0


def test_overlapping_hours(spark):
    folder = new_folder(spark, "events")
    events(spark, folder, datetime(2024, 1, 1, 10, 5))
    frame = activity.hourly_activity(activity.event_stream(spark, folder), slide="10 minutes")
    out = activity.run_complete(spark, frame, "t")
    assert out.count() == 6 and out.agg(F.sum("events")).first()[0] == 6


def test_upsert_stream(spark):
    landing = new_folder(spark, "landing")
    rows(spark, ("city", "A", "2024-02-01", "one", T1)).write.mode("append").parquet(landing)
    rows(spark, ("city", "A", "2024-02-01", "two", T2), ("city", "B", "2024-02-01", "b", T2)).write.mode("append").parquet(landing)
    store = SnapshotStore(spark, new_folder(spark, "store"))
    got = by(activity.upsert_stream(spark, landing, store), "scope_value")
    assert (got["A"]["title"], got["A"]["created_at"], got["B"]["title"]) == ("two", T1, "b")


def test_upsert_stream_rewrites_a_period_once_for_all_files(spark):
    """Many files of one period are one version, later files continue it, and of rows as new the newest file's stays."""
    landing, state = new_folder(spark, "landing"), new_folder(spark, "state")
    for i in range(6):
        both = rows(spark, ("city", "A", "2024-02-01", f"title {i}", T1), ("city", f"B{i}", "2024-02-01", "b", T1))
        both.coalesce(1).write.mode("append").parquet(landing)
    store = SnapshotStore(spark, new_folder(spark, "store"))
    got = by(activity.upsert_stream(spark, landing, store, state=state), "scope_value")
    assert {k: r["title"] for k, r in got.items()} == {"A": "title 5"} | {f"B{i}": "b" for i in range(6)}
    assert len(folder_names(spark, f"{store.root}/data")) == 1
    rows(spark, ("city", "A", "2024-02-01", "old", T0)).write.mode("append").parquet(landing)
    rows(spark, ("city", "B0", "2024-02-01", "as new", T1)).write.mode("append").parquet(landing)
    got = by(activity.upsert_stream(spark, landing, store, state=state), "scope_value")
    assert (got["A"]["title"], got["A"]["created_at"], got["B0"]["title"], len(got)) == ("title 5", T0, "as new", 7)
    assert len(folder_names(spark, f"{store.root}/data")) == 2
    one_by_one = SnapshotStore(spark, new_folder(spark, "store"))
    again = activity.upsert_stream(spark, landing, one_by_one, files=1)
    assert by(again, "scope_value") == got


def test_streamed_runs_are_merged_run_by_run(spark, monkeypatch):
    """Three runs are three versions, however many files each has; the third meets the period of the first."""
    seen = []
    plain_upsert = SnapshotStore.upsert
    monkeypatch.setattr(SnapshotStore, "upsert", lambda self, rows: seen.append(plain_upsert(self, rows)))

    def runs(t, wanted):
        for i in range(3):
            part = rows(spark, *[("city", f"{k}", "2024-02-01", f"run {i}", (T0, T1, T2)[i]) for k in range(8)])
            yield part.repartition(4, "scope_value")

    monkeypatch.setattr(catalog.insights, "insight_runs", runs)
    out = catalog._streamed_upsert(spark, SMALL).collect()
    assert seen == [1, 2, 3]
    assert {(r["scope_value"], r["title"], r["created_at"]) for r in out} == {(f"{k}", "run 2", T0) for k in range(8)}
