"""Pages and totals agree, filters reach the rows, and texts survive missing values."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marquee.functions.expr import fill
from marquee.functions.frames import in_order, page, page_after, totals
from marquee.operators import lists
from marquee.plans.filters import Filters
from marquee.session import new_folder, shared_folder
from marquee.sources.retail import read_retail
from marquee.sources.snapshots import SnapshotStore
from marquee.sources.tables import date_slices
from marquee.streaming import activity
from tests.conftest import SMALL, one


@pytest.mark.parametrize("limit", [1, 20, 500])
def test_walking_the_pages_gives_each_row_once(spark, limit):
    t = read_retail(spark, SMALL)
    counts = one(lists.studios_count(t, Filters(cinema_id=3), limit=limit))
    pages = [lists.studios_list(t, Filters(cinema_id=3), page_number=k + 1, limit=limit) for k in range(counts["total_pages"])]
    ids = [r["studio_id"] for p in pages for r in p.collect()]
    assert len(ids) == len(set(ids)) == counts["total"]
    assert lists.studios_list(t, Filters(cinema_id=3), page_number=counts["total_pages"] + 1, limit=limit).isEmpty()


def test_large_pages_are_not_cut(spark):
    t = read_retail(spark, SMALL)
    counts = one(lists.movies_count(t, limit=500))
    assert counts["total_pages"] == 1
    assert lists.movies_list(t, page_number=1, limit=500).count() == counts["total"] > 100


def test_bad_pages_are_refused(spark):
    frame = spark.range(3)
    for number, limit in ((0, 20), (-1, 20), (1, 0)):
        with pytest.raises(ValueError):
            page(frame, [F.asc("id")], number, limit)
    with pytest.raises(ValueError):
        totals(frame, 0)


def test_counts_follow_the_filters(spark):
    t = read_retail(spark, SMALL)
    assert one(lists.movies_count(t, rating_usia="SU"))["total"] == t.movies.filter("rating_usia = 'SU'").count()


def test_missing_values_are_empty_fields(spark):
    row = spark.range(1).select(fill("a {x} b {y}", x=F.lit(None).cast("string"), y=F.lit(2)).alias("t")).first()
    assert row["t"] == "a  b 2"


def test_streams_over_nothing_are_empty(spark):
    folder = new_folder(spark, "none")
    spark.createDataFrame([], activity.EVENTS).write.parquet(folder)
    for sink in (activity.run_append, activity.run_complete):
        rows = activity.hourly_activity(activity.event_stream(spark, f"{folder}/none*"))
        assert sink(spark, rows, "none").count() == 0


def test_a_broken_pointer_is_an_error_and_not_an_empty_store(spark):
    store = SnapshotStore(spark, new_folder(spark, "store"))
    assert store.read().count() == 0
    spark.sparkContext.parallelize(["no parquet"]).saveAsTextFile(f"{store.root}/pointer")
    with pytest.raises(Exception):
        store.read().count()


def test_date_slices_cover_each_day_once():
    parts = date_slices("d", date(2024, 1, 1), date(2024, 1, 20))
    assert parts[0] == "d < '2024-01-01' OR d IS NULL" and parts[1] == "d >= '2024-01-15'"
    assert parts[2:] == ["d >= '2024-01-01' AND d < '2024-01-08'", "d >= '2024-01-08' AND d < '2024-01-15'"]


def test_the_shared_folder_is_of_the_session(spark):
    assert shared_folder(spark) == shared_folder(spark)


def walked(ask, limit) -> list:
    """All rows by continuation: each page is asked for with the last row of the one before."""
    rows, last = [], None
    while True:
        # The first page goes by its number.
        found = (ask(page_number=1, limit=limit) if last is None else ask(after=last, limit=limit)).collect()
        rows += found
        if len(found) < limit:
            return rows
        last = found[-1]


@pytest.mark.parametrize("limit", [7, 40])
def test_continuation_gives_each_row_once_and_in_order(spark, limit):
    t = read_retail(spark, SMALL)
    f = Filters(cinema_id=3)
    for ask, key in (
        (lambda **k: lists.studios_list(t, f, **k), "studio_id"),
        (lambda **k: lists.schedules_list(t, Filters(studio_id=t.studio.first()["studio_id"]), **k), "schedule_id"),
        (lambda **k: lists.tickets_list(t, schedule_id=t.schedules.first()["schedule_id"], **k), "ticket_id"),
    ):
        whole = ask(page_number=1, limit=100_000).collect()
        assert walked(ask, limit) == whole != [] and len({r[key] for r in whole}) == len(whole)


def test_continuation_over_ties_and_nulls(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3, None if i % 7 == 0 else f"t{i % 2}") for i in range(60)], "id long, a long, b string")
    for down in (False, True):
        keys = [(F.col("a"), down), (F.col("b"), not down), (F.col("id"), down)]
        whole = rows.orderBy(*in_order(keys)).collect()
        found, last = [], None
        while chunk := page_after(rows, keys, last, 7).collect():
            found += chunk
            last = [F.lit(chunk[-1][c]) for c in ("a", "b", "id")]
        assert found == whole


def test_a_late_page_keeps_a_page_per_task_and_reaches_the_scan(spark):
    house = read_retail(spark, SMALL)
    plan = lists.tickets_list(house, after={"trans_time": datetime(2024, 2, 1), "ticket_id": "x"}, limit=20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=20" in plan and "offset" not in plan.lower()
    folder = new_folder(spark, "late")
    house.movies.write.parquet(folder)
    late = page_after(spark.read.parquet(folder), [(F.col("movie_id"), False)], [F.lit(40)], 5)
    assert "GreaterThanOrEqual(movie_id,40)" in late._jdf.queryExecution().executedPlan().toString()


def test_number_and_continuation_exclude_each_other(spark):
    t = read_retail(spark, SMALL)
    with pytest.raises(ValueError):
        lists.movies_list(t, page_number=2, after={"movie_id": 3})
    with pytest.raises(ValueError):
        lists.movies_list(t, after={"movie_id": 3}, limit=0)
