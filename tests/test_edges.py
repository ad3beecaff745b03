"""Edge cases on hand-made tables."""

from __future__ import annotations

import itertools
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions import expr
from marquee.functions.frames import numbered, page, top_numbered
from marquee.operators import actions, alerts, composites, extra, kpi, lists, rules, sales, scopes, titles
from marquee.plans.facts import rolled, session_facts
from marquee.plans.filters import Filters
from tests.conftest import House, by, one

W = Filters(start="2024-03-04", end="2024-03-10", as_of="2024-03-10")


# ---------------------------------------------------------------- filters


def test_windows():
    assert W.days == 7
    assert (W.previous().start, W.previous().end) == (date(2024, 2, 26), date(2024, 3, 3))
    assert (W.with_previous().start, W.with_previous().end) == (date(2024, 2, 26), date(2024, 3, 10))
    assert Filters.rolling("2024-03-10").start == date(2024, 2, 26)
    monthly = Filters.period("monthly", "2024-03-10")
    assert (monthly.start, monthly.end) == (date(2024, 2, 9), date(2024, 3, 10))
    assert Filters.period("daily", "2024-03-10").days == 1


@pytest.mark.parametrize("bad", [{"start": "2024-03-10"}, {"start": "2024-03-10", "end": "2024-03-09"}, {"start": "x", "end": "y"}])
def test_bad_windows(bad):
    with pytest.raises(ValueError):
        Filters(**bad)


def test_unknown_period():
    with pytest.raises(ValueError):
        Filters.period("hourly", "2024-03-10")


def test_empty_text_switches_a_filter_off(house):
    t = house.show("A", "2024-03-05", sold=2).tables()
    assert kpi.show_facts(t, W.scoped(city="", cinema_id=None)).count() == 1
    assert kpi.show_facts(t, W.scoped(city="Bandung")).count() == 0


# ---------------------------------------------------------------- sums and growth


def test_empty_window(house):
    t = house.tables()
    row = one(kpi.sales_summary(t, W))
    assert row["total_tickets"] == 0 and row["revenue"] == 0 and row["avg_occupancy"] == 0
    assert row["growth_tickets"] == 0 and row["cinema_tersedia"] == 1
    assert one(sales.sales_trend_forecast(t, W)) == {"group_by": "daily", "next_period": None, "projected_revenue": 0.0}
    assert sales.time_slots(t, W).count() == 0
    assert one(kpi.occupancy_summary(t, W))["occupancy"] == 0
    assert one(kpi.movie_stats_summary(t, W))["top_movie_id"] is None
    assert sales.revenue_by_cinema(t, W).count() == 0


def test_growth_from_zero_and_down(house):
    t = house.show("A", "2024-03-05", sold=3).tables()
    assert one(kpi.sales_summary(t, W))["growth_tickets"] == 100
    t = house.show("B", "2024-02-27", sold=6).tables()
    assert one(kpi.sales_summary(t, W))["growth_tickets"] == -50
    assert "growth_tickets" not in kpi.sales_summary(t, W, compare=False).columns


def test_zero_capacity_counts_in_the_mean(house):
    t = (
        house.studio("S0", capacity=0)
        .show("A", "2024-03-05", sold=5)
        .show("B", "2024-03-05", studio="S0", sold=3)
        .tables()
    )
    assert one(kpi.sales_summary(t, W))["avg_occupancy"] == 25
    assert by(titles.schedule_performance(t, W), "schedule_id")["B"]["occupancy"] == 0


def test_occupancy_is_not_capped(house):
    t = house.show("A", "2024-03-05", sold=15).tables()
    assert one(kpi.occupancy(t, W, "daily"))["occupancy"] == 150


def test_occupancy_summary_averages_rounded_groups(house):
    house.studio("S3", capacity=3)
    house.show("A", "2024-03-05", studio="S3", sold=1)
    for i in range(2):
        house.show(f"B{i}", "2024-03-06", studio="S3", sold=2)
    t = house.tables()
    # 33.33 once and 66.67 twice
    assert one(kpi.occupancy_summary(t, W))["occupancy"] == 55.56


def test_show_without_tickets_stays_or_goes(house):
    t = house.show("A", "2024-03-05").tables()
    assert kpi.show_facts(t, W).count() == 1
    assert kpi.trend(t, W, "daily").count() == 0
    assert sales.sales_trend(t, W).count() == 0
    assert kpi.movie_rankings(t, W).count() == 1
    assert one(kpi.cinema_stats(t, W))["total_tickets"] == 0


def test_bad_group_by(house):
    with pytest.raises(ValueError):
        kpi.trend(house.tables(), W, "weekly")


def test_sale_and_show_axes(house):
    house.show("A", "2024-03-05", sold=4, when=datetime(2024, 3, 1, 9))
    t = house.show("B", "2024-03-20", sold=2, when=datetime(2024, 3, 10, 23, 59, 59)).tables()
    assert one(kpi.sales_summary(t, W))["total_tickets"] == 4
    assert one(kpi.movie_sales_txn(t, W))["total_tickets"] == 2
    # sold in the window over seats shown in the window
    row = one(kpi.cinema_stats(t, W))
    assert (row["total_tickets"], row["total_capacity"], row["occupancy"]) == (2, 10, 20)


def test_rooms_without_sales_are_absent(house):
    t = house.studio("S2").show("A", "2024-03-05", sold=1).show("B", "2024-03-05", studio="S2").tables()
    assert [r["studio_id"] for r in sales.revenue_by_studio(t, W).collect()] == ["S1"]


# ---------------------------------------------------------------- texts and missing values


def test_room_filter_keeps_its_venue(house):
    house.cinema("C2", "Two", "Bandung").studio("S2").studio("S9", "C2")
    t = house.show("A", "2024-03-05", sold=1).show("B", "2024-03-05", studio="S9", sold=1).tables()
    assert set(by(kpi.cinema_stats(t, W.scoped(studio_id="S2")), "cinema_id")) == {"C1"}
    assert one(kpi.cinema_stats_summary(t, W.scoped(studio_id="S2")))["total_tickets"] == 1


def test_genres(house):
    house.movie("M2", genre=None).movie("M3", genre=" Comedy ,, ").movie("M4", genre="")
    for i, m in enumerate(("M1", "M2", "M3", "M4")):
        house.show(f"A{i}", "2024-03-05", movie=m, sold=i + 1)
    t = house.tables()
    assert {g: r["total_tickets"] for g, r in by(titles.genre_popularity(t, W), "genre").items()} == {
        "Drama": 1,
        "Action": 1,
        "Comedy": 3,
    }
    assert by(extra.genre_share(t, W), "genre")["Comedy"]["share"] == 30
    shown = by(lists.movies_list(t), "movie_id")
    assert shown["M2"]["genre"] == [] and shown["M3"]["genre"] == ["Comedy", "", ""]
    best = one(kpi.movie_stats_summary(t, W))
    assert (best["top_movie_id"], best["top_genre"]) == ("M4", "Comedy")


def test_missing_rating_payment_status(house):
    house.movie("M2", rating=None)
    t = house.show("A", "2024-03-05", movie="M2", status=None, sold=2, pay=None, seat=None).tables()
    assert one(kpi.rating_breakdown(t, W))["rating_usia"] == "Unknown"
    mix = one(sales.payment_mix(t, W))
    assert (mix["payment_type"], mix["admin_fee"], mix["net_profitability"]) == ("unknown", 1000, 20 - 2000)
    assert one(sales.risk_summary(t, W))["problematic_rate"] == 0
    assert one(kpi.movie_seat_distribution(t, W))["seat_category"] is None
    assert kpi.movie_detail_seats(t).count() == 0


def test_payment_name_is_normalised(house):
    t = house.show("A", "2024-03-05", sold=1, pay="Debit  Card").tables()
    assert one(sales.payment_mix(t, W))["admin_fee"] == 1500
    assert one(lists.payment_config(t))["admin_fee"] == 1500


def test_incidents(house):
    house.show("A", "2024-03-05", status="Cancelled", sold=2).show("B", "2024-03-05", status="canceled")
    t = house.show("C", "2024-03-05", status="DELAYED", sold=1).show("D", "2024-03-05", sold=9).tables()
    row = one(sales.risk_summary(t, W))
    assert (row["total_shows"], row["cancelled"], row["delayed"], row["problematic_rate"]) == (4, 2, 1, 75)
    assert one(sales.risk_by_movie(t, W))["impacted_revenue"] == 30


# ---------------------------------------------------------------- ties and order


def test_ties_go_by_title(house):
    house.movie("M2", title="Alpha")
    t = house.show("A", "2024-03-05", sold=2).show("B", "2024-03-05", movie="M2", sold=2).tables()
    assert [r["title"] for r in kpi.movie_rankings(t, W, top=1).collect()] == ["Alpha"]
    assert [r["title"] for r in sales.revenue_by_movie(t, W, 2).orderBy("rank").collect()] == ["Alpha", "Title M1"]


def test_equal_slots(house):
    house.show("A", "2024-03-05", start="09:15:00", sold=2)
    t = house.show("B", "2024-03-05", start="21:00", sold=2).tables()
    slots = by(sales.time_slots(t, W), "time_slot")
    assert set(slots) == {"09:00", "21:00"}
    assert all(r["normalized_demand"] == 1 and r["optimization_score"] == 1 for r in slots.values())
    peak = one(sales.time_slots_peak_quiet(t, W))
    assert (peak["peak_time_slot"], peak["quiet_time_slot"]) == ("09:00", "09:00")


def test_slots_without_demand(house):
    t = house.show("A", "2024-03-05").tables()
    slot = one(sales.time_slots(t, W))
    assert (slot["normalized_demand"], slot["recommendation"]) == (0, C.SLOT_QUIET)
    assert rules.pricing_recommendation(t, W).count() == 0


# ---------------------------------------------------------------- trends


def test_moving_average_is_over_rows(house):
    for i, (day, sold) in enumerate((("2024-03-04", 1), ("2024-03-05", 2), ("2024-03-09", 3), ("2024-03-10", 4))):
        house.show(f"A{i}", day, sold=sold)
    t = house.tables()
    rows = by(sales.sales_trend(t, W), "time_group")
    assert [rows[d]["moving_average"] for d in sorted(rows)] == [10, 15, 20, 30]
    assert one(sales.sales_trend_forecast(t, W))["next_period"] == "2024-03-11"
    assert one(sales.sales_trend_forecast(t, W))["projected_revenue"] == 30


def test_month_end_and_year_end(house):
    t = house.show("A", "2023-12-31", sold=1).tables()
    f = Filters(start="2023-12-01", end="2023-12-31")
    assert one(sales.sales_trend_forecast(t, f, "monthly"))["next_period"] == "2024-01"
    assert one(sales.sales_trend_forecast(t, f, "daily"))["next_period"] == "2024-01-01"


def test_year_shares_its_end_months(house):
    house.show("A", "2023-03-20", sold=1).show("B", "2024-03-05", sold=2).show("C", "2023-03-01", sold=9)
    assert one(sales.yearly_breakdown(house.tables(), W)) == {"month_num": 3, "month": "Mar", "revenue": 30.0}


def test_weekend_only(house):
    t = house.show("A", "2024-03-09", sold=2).tables()
    rows = by(sales.weekend_weekday(t, W), "day_type")
    assert rows["weekday"]["total_shows"] == 0 and rows["weekend"]["total_tickets"] == 2
    assert one(sales.weekend_weekday_summary(t, W))["winning_period"] == "weekend"


def test_forecast_fallback(house):
    # history: one Monday and one Tuesday; the other weekdays take the mean of both
    house.show("A", "2024-02-26", sold=2, when=datetime(2024, 2, 26, 10))
    t = house.show("B", "2024-02-27", sold=4, when=datetime(2024, 2, 27, 10)).tables()
    rows = by(rules.forecast(t, W), "weekday_label")
    assert rows["Monday"]["predicted_tickets"] == 2 and rows["Tuesday"]["predicted_tickets"] == 4
    assert rows["Friday"]["predicted_tickets"] == 3 and rows["Friday"]["predicted_occupancy"] == 30
    assert (rows["Monday"]["sample_size"], rows["Friday"]["sample_size"]) == (1, 0)
    nothing = by(rules.forecast(House(t.spark).tables(), W), "weekday_label")
    assert nothing["Monday"]["predicted_tickets"] == 0 and len(nothing) == 7
    assert rules.forecast(t, Filters(as_of="2024-03-10"), days_ahead=3).count() == 3


# ---------------------------------------------------------------- rules


def test_price_cascade(spark):
    columns = "time_slot string, demand long, revenue double, occupancy double, normalized_demand double, normalized_revenue double, optimization_score double"
    cases = [
        ("01:00", 9, 1.0, 70.0, 0.7, 0.45, 0.6),
        ("02:00", 9, 1.0, 80.0, 0.6, 0.9, 0.6),
        ("03:00", 9, 1.0, 35.0, 0.1, 0.1, 0.1),
        ("04:00", 9, 1.0, 50.0, 0.5, 0.5, 0.5),
        ("05:00", 0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ]
    got = by(rules.price_actions(spark.createDataFrame(cases, columns)), "time_slot")
    assert [got[k]["suggested_price_change_pct"] for k in sorted(got)] == [8, 5, -10, 0]
    assert [got[k]["confidence"] for k in sorted(got)] == [0.8, 0.8, 0.8, 0.45]


def test_breakout(house):
    house.movie("M2").show("A", "2024-03-05", sold=5).show("B", "2024-02-27", sold=4)
    t = house.show("C", "2024-02-27", movie="M2", sold=4).tables()
    row = one(rules.early_blockbuster(t, W, min_tickets=5, min_growth=25))
    assert (row["movie_id"], row["growth_rate"], row["blockbuster_signal"]) == ("M1", 25, True)
    assert not one(rules.early_blockbuster(t, W, min_tickets=6, min_growth=25))["blockbuster_signal"]


def test_overlaps(house):
    house.studio("S2").studio("S3").movie("M2", title="Alpha").movie("M3", title="Beta")
    house.show("A", "2024-03-05", sold=7).show("B", "2024-03-05", studio="S2", movie="M2", sold=4)
    house.show("C", "2024-03-05", studio="S3", movie="M3", sold=7)
    t = house.show("D", "2024-03-06", sold=9).tables()
    row = one(rules.cannibalization(t, W))
    # two titles at 70: the first by name is the competitor; the limits belong to the rule
    assert (row["impacted_title"], row["competitor_title"], row["occupancy_gap"]) == ("Alpha", "Beta", 30)
    assert one(rules.cannibalization_summary(t, W)) == {
        "total_slots_analyzed": 2,
        "possible_cannibalization_cases": 1,
    }


# ---------------------------------------------------------------- actions and scopes


def brute_force_larger(rooms, capacity, cinema):
    fits = [r for r in rooms if r["cinema"] == cinema and r["capacity"] > capacity and r["fill"] <= 60]
    return min(fits, key=lambda r: (r["fill"], -r["capacity"], r["name"]), default=None)


def test_larger_rooms_against_all_pairs(spark):
    house = House(spark).cinema("C1").cinema("C2").movie()
    rooms = []
    sizes = [10, 10, 20, 20, 30, 40, 40, 0]
    fills = [100, 10, 70, 50, 50, 55, None, None]
    for c, (i, (size, full)) in itertools.product(("C1", "C2"), enumerate(zip(sizes, fills))):
        key = f"{c}-{i}"
        if c == "C2" and full is not None:
            full = 105 - full
        house.studio(key, c, size, name=f"Room {9 - i}")
        sold = 0 if full is None or not size else size * full // 100
        if full is not None:
            house.show(f"show-{key}", "2024-03-05", studio=key, sold=sold)
        rooms.append({"cinema": c, "capacity": size, "fill": sold * 100 / size if sold else 0, "name": f"Room {9 - i}"})
    found = by(actions.larger_rooms(house.tables(), W), "cinema_id", "total_capacity")
    for r in rooms:
        best = brute_force_larger(rooms, r["capacity"], r["cinema"])
        have = found.get((r["cinema"], r["capacity"]))
        assert (have and have["target_name"]) == (best and best["name"])


def test_move_needs_a_larger_room(house):
    t = house.show("A", "2024-03-05", sold=9).tables()
    assert actions.move_to_larger_studio(t, W).count() == 0
    t = house.studio("S2", capacity=14).studio("S3", capacity=14, name="Room A").tables()
    rows = by(actions.move_to_larger_studio(t, W), "scope_type")
    assert set(rows) == {"global", "city", "cinema"}
    best = rows["cinema"]
    assert (best["studio_name"], best["score"], best["priority"]) == ("Room A", 94, "high")
    assert best["title"] == "Move Title M1 to Room A"
    assert best["reason"].startswith("Average occupancy for this session is 90%")


def test_equal_actions_count_once(house):
    # the same title at the same hour on two days
    house.show("A", "2024-03-05", sold=1).show("B", "2024-03-06", sold=2)
    rows = actions.candidate_actions(house.tables(), W).filter("scope_type = 'global'").collect()
    assert [(r["action_type"], r["occupancy"], r["position"]) for r in rows] == [(C.REDUCE, 10.0, 1)]
    assert (rows[0]["color"], rows[0]["icon"]) == ("red", "minus-circle")


def test_insight_without_action(house):
    t = house.show("A", "2024-03-05", sold=5).tables()
    rows = by(actions.scope_insight(scopes.scope_metrics(t, W), actions.candidate_actions(t, W)), "scope_type")
    assert rows["global"]["title"] == "Global is stable with room to monetize stronger demand"
    assert rows["global"]["category"] == "revenue" and len(rows["global"]["action_items"]) == 3
    assert "50%" in rows["studio"]["description"]


def test_scope_without_shows_is_listed(house):
    t = house.cinema("C2", "Two", "Bandung").show("A", "2024-03-05", sold=5).tables()
    rows = by(scopes.scope_metrics(t, W), "scope_type", "scope_value")
    assert rows[("cinema", "C2")]["total_tickets"] == 0
    assert rows[("city", "Jakarta")]["total_tickets"] == 5
    assert rows[("global", "")]["total_tickets"] == 5


def test_alerts(house, spark):
    t = house.studio("S2").show("A", "2024-03-05", sold=1).show("B", "2024-02-27", sold=4).tables()
    rows = alerts.alerts(t, W)
    network = by(rows.filter("scope_type = 'global'"), "type")
    assert network["revenue-growth"]["severity"] == "warning" and network["revenue-growth"]["impact_size"] == -75
    assert network["occupancy-level"]["severity"] == "warning"
    assert network["cinema-activity"]["what_happened"] == "1 of 1 cinemas are active."
    log = spark.createDataFrame([("revenue-growth", datetime(2024, 3, 11)), ("revenue-growth", datetime(2024, 3, 12))], "notification_id string, read_at timestamp")
    unread = alerts.alerts_filtered(rows, log, status="unread").filter("scope_type = 'global'")
    assert {r["type"] for r in unread.collect()} == set(network) - {"revenue-growth"}
    assert by(alerts.alert_summary(rows, log), "scope_type")["global"]["unread"] == 3
    down = alerts.alerts(t, W, system_active=False).filter("scope_type = 'global' AND type = 'system-health'")
    assert one(down)["severity"] == "critical"


# ---------------------------------------------------------------- lists and helpers


def test_filter_violations(house, spark):
    t = house.cinema("C2", "Two", "Bandung").tables()
    asked = [
        ("1", "Jakarta", "C1", "S1"),
        ("2", "Jakarta", "C2", None),
        ("3", None, "C9", "S1"),
        ("4", None, None, "S9"),
        ("5", None, "C2", "S1"),
        ("6", "", None, None),
    ]
    requests = spark.createDataFrame(asked, "request_id string, city string, cinema_id string, studio_id string")
    assert {k: r["reason"] for k, r in by(lists.filter_violations(t, requests), "request_id").items()} == {
        "2": "CINEMA_NOT_IN_CITY",
        "3": "CINEMA_NOT_FOUND",
        "4": "STUDIO_NOT_FOUND",
        "5": "STUDIO_NOT_IN_CINEMA",
    }


def test_pages(spark):
    rows = spark.range(45).toDF("id")
    order = [F.asc("id")]
    assert [r["id"] for r in page(rows, order, 3, 20).collect()] == list(range(40, 45))
    assert page(rows, order, 1, 500).count() == 45
    for number, limit in ((-1, 20), (0, 20), (1, 0), (1, -5)):
        with pytest.raises(ValueError):
            page(rows, order, number, limit)
    assert page(rows, order).count() == 45


@pytest.mark.parametrize("hot", [0, 700])
def test_numbered_matches_a_sort(spark, hot):
    """Also where many rows share the first sort key."""
    rows = spark.range(1000).select(F.when(F.col("id") < hot, 0).otherwise(F.col("id") * 7919 % 101).alias("v"), "id")
    got = {r["id"]: r["rank"] for r in numbered(rows.repartition(7), [F.desc("v"), F.asc("id")]).collect()}
    values = {r["id"]: r["v"] for r in rows.collect()}
    want = {k: i + 1 for i, k in enumerate(sorted(values, key=lambda k: (-values[k], k)))}
    assert got == want
    first = top_numbered(rows, [F.desc("v"), F.asc("id")], 5).collect()
    assert {r["id"]: r["rank"] for r in first} == {k: v for k, v in want.items() if v <= 5}


@pytest.mark.parametrize("value, text", [(85.0, "85"), (85.5, "85.5"), (85.25, "85.25"), (100.0, "100"), (0.0, "0"), (-12.3, "-12.3")])
def test_number_text(spark, value, text):
    assert spark.range(1).select(expr.number_text(F.lit(value)).alias("x")).first()["x"] == text


@pytest.mark.parametrize("value, rounded", [(1.005, 1.01), (2.675, 2.68), (-1.005, -1.01), (33.333333, 33.33), (0.0, 0.0)])
def test_round2(spark, value, rounded):
    assert spark.range(1).select(expr.round2(F.lit(value)).alias("x")).first()["x"] == rounded


def test_rollup_gives_the_same(house):
    t = house.show("A", "2024-03-05", sold=3).show("B", "2024-02-27", sold=1).tables()
    r = rolled(t, W.with_previous())
    assert rolled(r, W) is r
    for report in (kpi.sales_summary, sales.time_slots, sales.sales_trend, extra.movie_contribution_by_cinema):
        assert sorted(report(t, W).collect()) == sorted(report(r, W).collect())
    outside = Filters(start="2024-01-01", end="2024-12-31")
    assert session_facts(r, outside).count() == 2


def test_composites_hold_every_part_as_its_own_report(house):
    house.cinema("C2", "Two", "Bogor").studio("S2", "C2", 20).movie("M2", genre="Comedy")
    house.show("A", "2024-03-05", sold=3).show("B", "2024-03-06", "M2", "S2", sold=5, pay="QRIS", status="Cancelled")
    t = house.show("C", "2024-02-27", sold=1).tables()
    log = t.spark.createDataFrame([], "notification_id string, read_at timestamp")
    films, sold, top = composites.films_bundle(t, W), composites.sales_bundle(t, W), composites.executive(t, W, log)
    assert (len(films), len(sold), len(top)) == (14, 17, 5)
    own = {
        "schedules.repeat": (films, titles.repeat_schedule(t, W)),
        "occupancy.day": (films, titles.occupancy_by_day(t, W)),
        "occupancy": (films, titles.occupancy_by_movie(t, W)),
        "operational_risk.schedules": (sold, sales.risk_schedules(t, W)),
        "trend.projection": (sold, sales.sales_trend_forecast(t, W)),
        "payment": (sold, sales.payment_mix(t, W)),
        "weekend_vs_weekday.summary": (sold, sales.weekend_weekday_summary(t, W)),
        "franchise_performance": (top, kpi.cinema_stats(t, W)),
        "city_revenue_summary": (top, kpi.city_revenue(t, W)),
    }
    for name, (parts, report) in own.items():
        rows = [sorted(map(str, x.collect())) for x in (parts[name], report)]
        assert rows[0] == rows[1] and rows[0], name
    status = one(top["system_status"])
    assert (status["status"], status["total_nodes"], status["active_nodes"], status["health_rate"]) == ("active", 2, 2, 100)
    counted = {r["part"]: r["n_rows"] for r in composites.part_counts(sold).collect()}
    assert counted["payment"] == 2 and set(counted) == set(sold)


def test_composites_without_any_row(spark):
    t = House(spark).tables()
    log = spark.createDataFrame([], "notification_id string, read_at timestamp")
    assert one(composites.system_status(t, system_active=False))["last_update"] is None
    for parts in (composites.films_bundle(t, W), composites.sales_bundle(t, W), composites.executive(t, W, log)):
        assert {r["part"] for r in composites.part_counts(parts).collect()} == set(parts)
