"""What Spark makes of the operators: what is read, how often, and where rows meet."""

from __future__ import annotations

import contextlib
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions

from marquee import catalog
from marquee.operators import actions, kpi, lists, rules, sales, scopes, titles
from marquee.plans import facts
from marquee.session import new_folder
from marquee.sources.retail import read_retail
from marquee.sources.tables import read_parquet, write_parquet
from tests.conftest import SMALL, House

W = catalog.WINDOW


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


@contextlib.contextmanager
def settings(spark, **values):
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def stored_house(spark):
    """A chain in its own layout, shows partitioned by date."""
    house = House(spark).cinema().studio().movie()
    for d in range(1, 29):
        house.show(f"A{d}", f"2024-02-{d:02}", sold=3)
    root = new_folder(spark, "tables")
    write_parquet(house.tables(), root)
    return read_parquet(spark, root)


def no_broadcast(spark):
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0",
    )


F = W.between(W.start.replace(month=2, day=5), W.end.replace(month=2, day=8))


def test_dates_prune_folders_and_columns(stored_house):
    plan = plan_of(sales.time_slots(stored_house, F))
    assert re.search(r"PartitionFilters: \[isnotnull\(show_date[^]]*>= 2024-02-05", plan)
    tickets = re.search(r"ReadSchema: struct<schedule_id:string,final_price:decimal\(18,4\)>", plan)
    assert tickets, "tickets are read in two columns"


REPORTS = {
    "time_slots": sales.time_slots,
    "city_revenue": kpi.city_revenue,
    "schedule_performance": titles.schedule_performance,
    "cannibalization": rules.cannibalization,
}


@pytest.mark.parametrize("name", REPORTS)
def test_show_dates_prune_folders_of_tickets_too(stored_house, name):
    plan = plan_of(REPORTS[name](stored_house, F))
    scans = re.findall(r"FileScan parquet (?:\[.*?\]).*?PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert len([x for x in scans if ">= 2024-02-05" in x and "<= 2024-02-08" in x]) >= 2


@pytest.mark.parametrize("name", REPORTS)
def test_dated_tickets_give_the_same_rows(stored_house, name):
    plain = replace(stored_house, tiket=stored_house.tiket.drop("show_date"))
    a, b = (sorted(map(str, REPORTS[name](t, F).collect())) for t in (stored_house, plain))
    assert a == b and (a or name == "cannibalization")


def test_hot_show_and_hot_minute_are_several_files(spark):
    house = House(spark).cinema().studio().movie().show("A1", "2024-02-05", sold=400).show("A2", "2024-02-05", sold=3)
    root = new_folder(spark, "tables")
    write_parquet(house.tables(), root, file_rows=50)
    t = read_parquet(spark, root)
    files = t.tiket.groupBy(functions.input_file_name().alias("f")).count().collect()
    assert len(files) >= 8 and max(r["count"] for r in files) <= 50
    assert t.tiket.count() == 403 and t.tiket.columns[-1] == "show_date"


def test_rollup_without_dates_covers_every_window(spark):
    t = read_retail(spark, SMALL)
    once = facts.with_rollup(t, W.without_dates())
    assert facts.rolled(once, W) is once and facts.rolled(once, W.without_dates()) is once
    a = sorted(map(str, sales.time_slots(once, W).collect()))
    assert a == sorted(map(str, sales.time_slots(t, W).collect()))


def test_sale_time_and_ids_reach_the_scan(stored_house):
    plan = plan_of(kpi.movie_sales_txn(stored_house, F))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(trans_time,2024-02-05", plan)
    plan = plan_of(lists.lookup(stored_house.movies, "movie_id", "M1"))
    assert "EqualTo(movie_id,M1)" in plan


def test_tickets_of_other_shows_stop_at_the_scan(spark, stored_house):
    """Without any broadcast a Bloom filter of the kept shows sits below the sums of tickets."""
    with no_broadcast(spark):
        frame = sales.time_slots(stored_house, F)
        assert re.search(r"Aggregate \[schedule_id.*\n.*\n.*might_contain", optimized(frame))
        assert frame.collect()[0]["demand"] == 12


def test_tickets_are_summed_before_the_shuffle(spark, stored_house):
    with no_broadcast(spark):
        plan = plan_of(kpi.city_revenue(stored_house, F))
    assert re.search(r"partial_sum\(final_price", plan)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("name", ["scope_ad_slots", "reduce_showtimes", "promotion_opportunity", "candidate_actions"])
def test_first_rows_per_scope_are_cut_in_each_task(spark, name):
    plan = plan_of(catalog.OPERATORS[name](read_retail(spark, SMALL)))
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_overlaps_and_larger_rooms_pair_nothing(spark):
    t = read_retail(spark, SMALL)
    for frame in (rules.cannibalization(t, W), actions.larger_rooms(t, W), actions.candidate_actions(t, W)):
        plan = plan_of(frame)
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture(scope="module")
def plans(spark):
    t = read_retail(spark, SMALL)
    return {name: plan_of(operator(t)) for name, operator in catalog.OPERATORS.items()}


@pytest.mark.parametrize("word", ["Python", "NestedLoop", "Cartesian", "Pandas", "MapInArrow"])
def test_no_python_and_no_pairs(plans, word):
    assert [name for name, plan in plans.items() if word in plan] == []


# Operators with a window over a whole frame, and the most rows the frame can have.
WHOLE_FRAME = {
    "time_slots": "24 start hours",
    "time_slots_asia": "24 start hours",
    "time_slots_peak_quiet": "24 start hours",
    "pricing_recommendation": "24 start hours",
    "pricing_recommendation_summary": "24 start hours",
    "payment_mix": "payment types",
    "sales_trend_daily": "days of the calendar",
    "sales_trend_monthly": "months of the calendar",
    "forecast": "days of the week",
    "forecast_next_week": "days of the week",
    "forecast_summary": "days of the week",
    "sales_bundle_counts": "days of the calendar, payment types",
    "revenue_by_cinema": "shuffle partitions",
    "revenue_by_studio": "shuffle partitions",
}


def test_windows_over_a_whole_frame_are_small(plans):
    alone = re.compile(r"Window .*\n(?:.*Sort .*\n)?.*Exchange SinglePartition")
    assert {name for name, plan in plans.items() if alone.search(plan)} == set(WHOLE_FRAME)


def test_unused_distinct_counts_cost_nothing(spark):
    assert "Expand" not in plan_of(scopes.scope_metrics(read_retail(spark, SMALL), W))


def test_one_scan_of_tickets_for_all_actions(spark):
    t = read_retail(spark, SMALL)
    plan = plan_of(actions.candidate_actions(t, W))
    # the rollup has read the tickets already; what is left is the sale-time side of the rooms
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) <= 1


def test_forecast_reads_tickets_once_for_each_axis(spark):
    plan = plan_of(rules.forecast(read_retail(spark, SMALL), W))
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 2
    assert len(re.findall(r"FileScan parquet \[o_orderkey", plan)) == 2


def test_scopes_are_expanded_after_the_sums(spark):
    plan = plan_of(scopes.scope_metrics(read_retail(spark, SMALL), W))
    assert plan.index("Generate explode") < plan.index("partial_sum(final_price")
