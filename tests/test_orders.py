"""Reports in their order, held against a sort in plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquee import catalog
from marquee.operators import kpi, orders, rules, sales
from marquee.plans.filters import Filters
from marquee.sources.retail import read_retail
from tests.conftest import SMALL, House
from tests.test_plans import plan_of

W = Filters(start="2024-02-01", end="2024-02-07", as_of="2024-02-07")


def seconds(clock):
    return None if clock is None else sum(int(x) * w for x, w in zip(clock.split(":"), (3600, 60, 1)))


def up(value):
    return (value is None, 0 if value is None else value)


def down(value):
    return (value is not None, 0 if value is None else -value)


def day_down(value):
    return (value is not None, 0 if value is None else -value.toordinal())


# What a report is in order of, stated once more.
KEYS = {
    "movie_rankings": lambda r: (down(r.tickets_sold), up(r.title), up(r.movie_id)),
    "movie_sales_txn": lambda r: (down(r.total_tickets), down(r.total_revenue or 0), up(r.title), up(r.movie_id)),
    "rating_breakdown": lambda r: (down(r.total_tickets_sold), up(r.rating_usia)),
    "city_revenue": lambda r: (down(r.total_revenue or 0), down(r.total_tickets), up(r.city)),
    "time_slots": lambda r: up(r.time_slot),
    "trend_daily": lambda r: up(r.time_group),
    "movie_daily_trend": lambda r: (up(r.movie_id), up(r.time_group)),
    "payment_mix": lambda r: (down(r.total_transactions), up(r.payment_type)),
    "risk_schedules": lambda r: (day_down(r.show_date), down(seconds(r.start_time)), up(r.schedule_id)),
    "risk_by_movie": lambda r: (down(r.impacted_revenue or 0), up(r.title), up(r.movie_id)),
    "schedule_performance": lambda r: (day_down(r.show_date), down(seconds(r.start_time)), up(r.schedule_id)),
    "repeat_schedule": lambda r: (day_down(r.show_date), up(r.title), up(r.movie_id)),
    "audience_density": lambda r: (down(r.total_tickets), up(r.title), up(r.movie_id)),
    "occupancy_by_movie": lambda r: (down(r.total_tickets), up(r.title), up(r.movie_id)),
    "occupancy_by_studio": lambda r: (down(r.total_tickets), up(r.studio_name), up(r.studio_id)),
    "genre_popularity": lambda r: (down(r.total_tickets), up(r.genre)),
    "studio_format": lambda r: (down(r.total_studios), up(r.format)),
    "early_blockbuster": lambda r: (down(r.growth_rate), down(r.current_tickets), up(r.title), up(r.movie_id)),
    "cannibalization": lambda r: (
        down(r.occupancy_gap), up(r.cinema_id), up(r.show_date), up(r.time_slot), up(r.impacted_title), up(r.impacted_movie_id)
    ),
}


@pytest.fixture(scope="module")
def retail(spark):
    return read_retail(spark, SMALL)


@pytest.mark.parametrize("name", KEYS)
def test_order_of_whole_reports(retail, name):
    rows = catalog.OPERATORS[name](retail)
    got = orders.ordered(name, rows).collect()
    want = sorted(rows.collect(), key=KEYS[name])
    assert got == want
    assert len({KEYS[name](r) for r in want}) == len(want), "the order is total"
    assert orders.ordered(name, rows, 3).collect() == want[:3]


def test_every_order_is_of_a_report(retail):
    for name in orders.ORDERS:
        orders.ordered(name, catalog.OPERATORS[name](retail)).schema  # the columns are there


def test_first_rows_are_cut_in_the_tasks(retail):
    plan = plan_of(orders.ordered("movie_rankings", catalog.OPERATORS["movie_rankings"](retail), 5))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


@pytest.fixture(scope="module")
def untitled(spark):
    """Titles without a name, times of one and two digits, a show without a time, free tickets."""
    house = House(spark).cinema().studio(capacity=4).movie("M0", "").movie("M1", "Beta").movie("M2", "Alpha").movie("M3", "Gamma")
    house.rows["movies"].append(("M4", None, "Drama", None, 90))
    for i, (movie, clock) in enumerate([("M4", "9:00:00"), ("M1", "10:00:00"), ("M2", "21:00:00"), ("M3", None), ("M4", "10:00:00")]):
        house.show(f"A{i}", "2024-02-03", movie=movie, start=clock, status="delayed", sold=2 if movie != "M4" else 1)
    house.rows["tiket"] = [(*r[:3], None, *r[4:]) if r[1] == "A3" else r for r in house.rows["tiket"]]
    return house.tables()


def test_titles_without_a_name_come_last(untitled):
    assert [r.movie_id for r in kpi.movie_sales_txn(untitled, W, 10).collect()] == ["M2", "M1", "M4", "M3"]
    best = kpi.movie_stats_summary(untitled, W).collect()[0]
    assert (best.top_movie_id, best.top_movie_title) == ("M2", "Alpha")
    assert sales.revenue_by_movie_summary(untitled, W).collect()[0].top_movie_id == "M2"
    assert [r.movie_id for r in sales.revenue_by_movie(untitled, W, 2).collect()] == ["M2", "M1"]


def test_times_are_no_texts(untitled):
    got = [r.start_time for r in orders.ordered("risk_schedules", sales.risk_schedules(untitled, W)).collect()]
    assert got == [None, "21:00:00", "10:00:00", "10:00:00", "9:00:00"]


def test_strongest_title_with_a_name_wins_a_tie(spark):
    house = House(spark).cinema().studio("S1", capacity=4).studio("S2", capacity=4).studio("S3", capacity=10)
    house.movie("M1", "Beta").movie("M2", "Weak")
    house.rows["movies"].append(("M0", None, "Drama", None, 90))
    house.show("A", "2024-02-03", movie="M0", studio="S1", sold=4).show("B", "2024-02-03", movie="M1", studio="S2", sold=4)
    house.show("C", "2024-02-03", movie="M2", studio="S3", sold=1)
    rows = rules.cannibalization(house.tables(), W).collect()
    assert [(r.impacted_movie_id, r.competitor_movie_id) for r in rows] == [("M2", "M1")]


def test_bad_requests(retail):
    rows = retail.movies
    with pytest.raises(ValueError):
        orders.ordered("unknown", rows)
    with pytest.raises(ValueError):
        orders.ordered("movie_rankings", rows.withColumn("tickets_sold", F.lit(1)), 0)
