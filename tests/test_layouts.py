"""Tables in buckets, the rollup that follows its tickets, and how often reports read tickets."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions

from marquee import catalog
from marquee.operators import kpi, rules, sales, titles
from marquee.plans import facts
from marquee.plans.rollups import DailyRollup, dates_of
from marquee.session import new_folder
from marquee.sources.buckets import HOT, read_bucketed, write_bucketed
from marquee.sources.retail import read_retail
from marquee.sources.tables import read_parquet, write_parquet
from tests.conftest import SMALL, House
from tests.test_plans import no_broadcast, plan_of

W = catalog.WINDOW
F = W.between(date(2024, 2, 1), date(2024, 2, 14))


def chain(spark) -> House:
    """Two venues, a show with most of the tickets, shows without any, and one without a date."""
    house = House(spark).cinema().cinema("C2", "Two", "Bandung").studio().studio("S2", "C2", 40).movie().movie("M2")
    for d in range(1, 21):
        pay = ("Cash", "Card", None)[d % 3]
        house.show(f"A{d}", f"2024-02-{d:02}", sold=d % 4, pay=pay, movie=f"M{d % 2 + 1}", start=f"{10 + d % 9}:00:00")
        house.show(f"B{d}", f"2024-02-{d:02}", studio="S2", sold=(d * 7) % 5, pay=pay, price=20 + d)
    return house.show("HOT", "2024-02-07", studio="S2", sold=400)


@pytest.fixture(scope="module")
def plain(spark):
    return chain(spark).tables()


@pytest.fixture(scope="module")
def packed(spark, plain):
    name = f"chain{new_folder(spark, 'x')[-8:]}"
    write_bucketed(plain, name, 4, new_folder(spark, "bucketed"), hot_rows=100, file_rows=60)
    return read_bucketed(spark, name)


@pytest.fixture(scope="module")
def dated(spark, plain):
    root = new_folder(spark, "tables")
    write_parquet(plain, root)
    return read_parquet(spark, root)


def lines(frame) -> list[str]:
    return sorted(map(str, frame.collect()))


REPORTS = {
    "facts": lambda t, f: facts.session_facts(t, f).select(*facts.ROLLUP_COLUMNS),
    "sold": lambda t, f: facts.sold_shows(t, f).select("schedule_id", "tickets", "revenue", "city"),
    "time_slots": sales.time_slots,
    "sales_summary": kpi.sales_summary,
    "cinema_stats": kpi.cinema_stats,
    "city_revenue": kpi.city_revenue,
    "payment_mix": sales.payment_mix,
    "revenue_by_movie": sales.revenue_by_movie,
    "pricing": rules.pricing_recommendation_summary,
    "schedule_performance": titles.schedule_performance,
}


@pytest.mark.parametrize("name", REPORTS)
@pytest.mark.parametrize("scope", [{}, {"city": "Bandung"}, {"studio_id": "S1", "movie_id": "M2"}])
def test_buckets_give_the_same_rows(plain, packed, name, scope):
    f = F.scoped(**scope)
    want = lines(REPORTS[name](plain, f))
    assert lines(REPORTS[name](packed, f)) == want != []


def test_bucketed_sums_and_fact_join_move_no_row(spark, packed):
    with no_broadcast(spark):
        plan = plan_of(facts.packed_shows(packed, F))
        # What is left is the one row of the Bloom filter of the kept shows.
        assert set(re.findall(r"Exchange (\w+)", plan)) <= {"SinglePartition"} and "SortMergeJoin" in plan
        assert plan.count("Bucketed: true") == 2 and plan.count(">= 2024-02-01") >= 2
    # In whole reports only the sums of the hot shows are dealt out, and they are few.
    whole = plan_of(facts.session_facts(packed, F))
    assert len(re.findall(r"Exchange hashpartitioning\(schedule_id", whole)) == 1


def test_hot_show_is_several_files_beside_the_buckets(spark, packed):
    files = packed.hot.groupBy(functions.input_file_name().alias("f")).count().collect()
    assert len(files) >= 7 and max(r["count"] for r in files) <= 60
    assert {r["schedule_id"] for r in packed.hot.select("schedule_id").distinct().collect()} == {"HOT"}
    assert packed.packed.where("schedule_id = 'HOT'").isEmpty() and HOT == "tiket_hot"


# ---------------------------------------------------------------- rollup


def folder_files(spark, root: str) -> dict[str, set[str]]:
    found: dict[str, set[str]] = {}
    for file in spark.read.parquet(root).inputFiles():
        day, name = file.split("/")[-2:]
        found.setdefault(day, set()).add(name)
    return found


def changed(spark, house: House):
    """Late tickets, a cancelled one, a show without tickets any more, and a date without shows."""
    gone = [r for r in house.rows["tiket"] if r[1] in ("B1", "B2")]
    house.rows["tiket"] = [r for r in house.rows["tiket"] if r not in gone]
    before = len(house.rows["tiket"])
    template = house.rows["tiket"][0]
    house.rows["tiket"] += [(f"late{i}", "A4", *template[2:]) for i in range(5)]
    late = house.rows["tiket"][before:]
    house.rows["schedules"] = [r for r in house.rows["schedules"] if r[0] not in ("A20", "B20")]
    house.rows["tiket"] = [r for r in house.rows["tiket"] if r[1] not in ("A20", "B20")]
    return [*gone, *late]


@pytest.mark.parametrize("layout", ["plain", "dated", "packed"])
def test_refreshed_rollup_equals_a_new_one(spark, layout):
    def tables(house):
        t, root = house.tables(), new_folder(spark, "tables")
        if layout == "plain":
            return t
        if layout == "dated":
            write_parquet(t, root)
            return read_parquet(spark, root)
        name = f"db{root[-8:]}"
        write_bucketed(t, name, 3, root, hot_rows=100)
        return read_bucketed(spark, name)

    house = chain(spark)
    old = tables(house)
    store = DailyRollup(spark, new_folder(spark, "daily"))
    store.build(old)
    files = folder_files(spark, store.root)
    delta = changed(spark, house)
    new = tables(house)
    days = dates_of(new, spark.createDataFrame(delta, old.tiket.drop("show_date").schema))
    assert sorted(days) == [date(2024, 2, d) for d in (1, 2, 4)]
    store.refresh(new, [*days, date(2024, 2, 20)])
    fresh = DailyRollup(spark, new_folder(spark, "daily"))
    fresh.build(new)
    for f in (F, F.without_dates()):
        a, b = (lines(facts.session_facts(x.tables(new), f).select(*facts.ROLLUP_COLUMNS)) for x in (store, fresh))
        assert a == b == lines(facts.session_facts(new, f).select(*facts.ROLLUP_COLUMNS)) != []
    # Other dates keep their files; a date without shows has none.
    now = folder_files(spark, store.root)
    touched = {f"show_date=2024-02-{d:02}" for d in (1, 2, 4, 20)}
    assert {k: v for k, v in now.items() if k not in touched} == {k: v for k, v in files.items() if k not in touched}
    assert "show_date=2024-02-20" in files and "show_date=2024-02-20" not in now
    # The same dates once more change nothing in the rows.
    store.refresh(new, days)
    assert lines(store.tables(new).rollup) == lines(fresh.tables(new).rollup)


def test_reports_on_the_rollup_read_no_ticket(spark, dated):
    store = DailyRollup(spark, new_folder(spark, "daily"))
    store.build(dated)
    t = store.tables(dated)
    for name in ("time_slots", "sales_summary", "trend_daily", "occupancy_hourly", "occupancy_by_day", "scope_metrics", "session_facts"):
        report = catalog.OPERATORS[name]
        assert "/tiket" not in plan_of(report(t)), name
        order = sorted(report(t).columns)
        assert lines(report(t).select(*order)) == lines(report(dated).select(*order)), name
    days = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan_of(sales.time_slots(t, F)))
    assert any("2024-02-01" in x and "2024-02-14" in x for x in days)


def test_refresh_of_nothing_and_of_an_unknown_date(spark, plain):
    store = DailyRollup(spark, new_folder(spark, "daily"))
    store.build(plain)
    before = folder_files(spark, store.root)
    store.refresh(plain, [])
    store.refresh(plain, [date(1999, 1, 1)])
    assert folder_files(spark, store.root) == before


# ---------------------------------------------------------------- reads


@pytest.mark.parametrize("report", [sales.payment_mix, sales.payment_mix_summary, sales.revenue_by_movie, rules.pricing_recommendation_summary])
def test_groups_and_their_whole_come_from_one_read(dated, report):
    plan = plan_of(report(dated, F))
    scans = [x for x in re.findall(r"FileScan parquet [^\n]*", plan) if "/tiket" in x]
    assert len(scans) == 1 and "Subquery" not in plan


def test_groups_and_their_whole_without_rows(spark, dated):
    none = F.between(F.start - timedelta(days=9000), F.end - timedelta(days=9000))
    assert sales.payment_mix(dated, none).count() == 0 == sales.revenue_by_movie(dated, none).count()
    assert sales.revenue_by_movie(dated, F, 1).collect()[0]["rank"] == 1


def test_shares_are_of_all_titles(spark):
    t = read_retail(spark, SMALL)
    few, more = (sales.revenue_by_movie(t, W, n).collect() for n in (2, 10_000))
    assert [r["contribution"] for r in few] == [r["contribution"] for r in more[:2]]
    assert [r["rank"] for r in more] == list(range(1, len(more) + 1)) and abs(sum(r["contribution"] for r in more) - 100) < 0.005 * len(more)
    assert replace(t, rollup=None) == t
