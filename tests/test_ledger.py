"""Tickets by the day of their sale: what is opened, equal rows, late and cancelled tickets."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions

from marquee.operators import alerts, composites, kpi, lists, rules, sales, titles
from marquee.plans.filters import Filters
from marquee.session import new_folder
from marquee.sources.ledger import SalesLedger, days_of
from marquee.sources.tables import read_parquet, write_parquet
from tests.conftest import House
from tests.test_plans import plan_of, settings

F = Filters(start="2024-02-05", end="2024-02-11", as_of="2024-02-11")


def chain(spark) -> House:
    """Sales long before, on and around midnight of the days, one at the end of the newest hour."""
    house = House(spark).cinema().cinema("C2", "Two", "Bandung").studio().studio("S2", "C2", 40).movie().movie("M2")
    for d in range(1, 21):
        for i, clock in enumerate(("00:00:00", "12:30:00", "23:59:59")):
            when = datetime.fromisoformat(f"2024-02-{d:02} {clock}")
            house.show(f"A{d}-{i}", f"2024-02-{min(d + 5, 28):02}", studio=f"S{i % 2 + 1}", movie=f"M{d % 2 + 1}", sold=d % 3 + 1, when=when)
    for n, clock in enumerate(("23:20:00", "23:40:00")):
        house.show(f"LATE{n}", "2024-02-28", sold=3, when=datetime.fromisoformat(f"2024-02-20 {clock}"))
    house.show("NEW", "2024-02-28", studio="S2", sold=2, when=datetime.fromisoformat("2024-02-21 00:30:00"))
    house.rows["tiket"].append(("timeless", "NEW", "Regular", None, None, "Cash"))
    return house


@pytest.fixture(scope="module")
def plain(spark):
    return chain(spark).tables()


@pytest.fixture(scope="module")
def ledger(spark, plain):
    store = SalesLedger(spark, new_folder(spark, "sales"))
    store.build(plain)
    return store


def lines(frame) -> list[str]:
    return sorted(map(str, frame.collect()))


REPORTS = {
    "last_hour_total": lambda t, f: kpi.last_hour_total(t),
    "last_hour_by_city": lambda t, f: kpi.last_hour_by_city(t),
    "last_hour_by_studio": lambda t, f: kpi.last_hour_by_studio(t),
    "last_hour_by_movie": lambda t, f: kpi.last_hour_by_movie(t),
    "system_status": lambda t, f: composites.system_status(t),
    "alerts": alerts.alerts,
    "movie_sales_txn": kpi.movie_sales_txn,
    "cinema_stats": kpi.cinema_stats,
    "revenue_by_studio": sales.revenue_by_studio,
    "films_performance": titles.films_performance,
    "forecast": rules.forecast,
    "tickets_list": lists.tickets_list,
    "tickets_count": lists.tickets_count,
}


@pytest.mark.parametrize("name", REPORTS)
def test_same_rows(plain, ledger, name):
    want = lines(REPORTS[name](plain, F))
    assert lines(REPORTS[name](ledger.tables(plain), F)) == want != []


@pytest.mark.parametrize("zone", ["Pacific/Kiritimati", "Etc/GMT+12"])
def test_same_rows_in_any_zone(spark, plain, ledger, zone):
    """The folders are of days in UTC, the windows of days in the session's zone."""
    with settings(spark, spark__sql__session__timeZone=zone):
        for report in (kpi.movie_sales_txn, lists.tickets_count, REPORTS["last_hour_by_city"]):
            assert lines(report(ledger.tables(plain), F)) == lines(report(plain, F))


def filters_of(plan: str) -> list[str]:
    return [x for x in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if "sale_date" in x]


def test_newest_hour_opens_the_newest_days_only(plain, ledger):
    t = ledger.tables(plain)
    # The tickets themselves cannot be read, so nothing but the ledger can have been.
    none = replace(t, tiket=t.tiket.filter(functions.raise_error(functions.lit("read")).isNotNull()))
    assert t.last_sale == date(2024, 2, 21)
    total = kpi.last_hour_total(none).collect()[0]
    assert total["last_data_in"] == datetime(2024, 2, 21, 0, 30) and total["tickets_last_hour"] == 8
    for name in ("last_hour_total", "last_hour_by_city", "last_hour_by_studio", "last_hour_by_movie"):
        plan = plan_of(REPORTS[name](none, F))
        found = filters_of(plan)
        assert found and all("2024-02-2" in x for x in found), plan


def test_sale_windows_open_the_days_around_them(plain, ledger):
    t = ledger.tables(plain)
    for report in (kpi.movie_sales_txn, lists.tickets_list, titles.films_performance):
        found = filters_of(plan_of(report(t, F)))
        assert found and all("2024-02-04" in x and "2024-02-12" in x for x in found)


def test_tickets_without_a_window_are_the_whole_table(plain, ledger):
    assert lines(lists.tickets_list(ledger.tables(plain))) == lines(lists.tickets_list(plain))


def files(store) -> dict[str, set[str]]:
    found: dict[str, set[str]] = {}
    for file in store.spark.read.parquet(store.root).inputFiles():
        day, name = file.split("/")[-2:]
        found.setdefault(day, set()).add(name)
    return found


def test_late_and_cancelled_tickets(spark):
    house = chain(spark)
    store = SalesLedger(spark, new_folder(spark, "sales"))
    store.build(house.tables())
    before = files(store)
    gone = [r for r in house.rows["tiket"] if r[1] in ("NEW", "A3-1")]
    house.rows["tiket"] = [r for r in house.rows["tiket"] if r not in gone]
    late = [(f"late{i}", "A4-0", "Regular", house.rows["tiket"][0][3], datetime(2024, 2, 7, 9), "Card") for i in range(4)]
    house.rows["tiket"] += late
    t = house.tables()
    days = days_of(spark.createDataFrame([*gone, *late], t.tiket.schema))
    assert set(days) == {None, date(2024, 2, 3), date(2024, 2, 7), date(2024, 2, 21)}
    store.refresh(t, days)
    touched = {f"sale_date={d}" for d in ("2024-02-03", "2024-02-07", "2024-02-21", "__HIVE_DEFAULT_PARTITION__")}
    now = files(store)
    assert {k: v for k, v in now.items() if k not in touched} == {k: v for k, v in before.items() if k not in touched}
    # The newest day has lost its tickets, so the newest hour is one of the day before.
    assert "sale_date=2024-02-21" in before and "sale_date=2024-02-21" not in now and store.newest() == date(2024, 2, 20)
    for name in REPORTS:
        assert lines(REPORTS[name](store.tables(t), F)) == lines(REPORTS[name](t, F)), name
    rows = lines(store.tables(t).sales)
    store.refresh(t, days)
    store.refresh(t, [])
    assert lines(store.tables(t).sales) == rows and len(rows) == len(house.rows["tiket"])


def test_added_tickets_leave_other_files(spark, plain):
    store = SalesLedger(spark, new_folder(spark, "sales"), file_rows=5)
    store.build(plain)
    before = files(store)
    one = plain.tiket.filter("schedule_id = 'NEW' and trans_time is not null")
    store.append(one.withColumn("tiket_id", functions.concat(functions.lit("more"), "tiket_id")))
    now = files(store)
    assert all(before[k] <= now[k] for k in before) and sum(map(len, now.values())) > sum(map(len, before.values()))
    both = replace(plain, tiket=plain.tiket.union(one.withColumn("tiket_id", functions.concat(functions.lit("more"), "tiket_id"))))
    assert lines(kpi.last_hour_by_city(store.tables(plain))) == lines(kpi.last_hour_by_city(both))


def test_no_tickets_at_all(spark):
    t = House(spark).cinema().studio().movie().show("A", "2024-02-05").tables()
    store = SalesLedger(spark, new_folder(spark, "sales"))
    store.build(t)
    assert store.newest() is None
    for name in ("last_hour_total", "last_hour_by_city", "movie_sales_txn", "tickets_count"):
        assert lines(REPORTS[name](store.tables(t), F)) == lines(REPORTS[name](t, F))


def test_beside_stored_shows(spark, plain, ledger):
    """Reports by show date go on reading the tickets by the date of the show."""
    root = new_folder(spark, "tables")
    write_parquet(plain, root)
    t = ledger.tables(read_parquet(spark, root))
    assert "sale_date" not in plan_of(sales.time_slots(t, F))
    assert lines(sales.time_slots(t, F)) == lines(sales.time_slots(plain, F)) != []
    assert lines(kpi.cinema_stats(t, F)) == lines(kpi.cinema_stats(plain, F))
