"""Sales reports: overview, shares and ranks, start hours, trends, day types, payments, incidents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import constants as C
from marquee.functions.expr import day_type, minmax, money, payment_fee, percent, round2, rounded_ratio, text_place
from marquee.functions.frames import attach, numbered, of_whole, top_numbered, with_whole
from marquee.operators import kpi, orders
from marquee.plans.facts import (
    sales_facts,
    session_facts,
    shows,
    sold_shows,
    ticket_sums,
    with_tickets,
)
from marquee.plans.filters import Filters
from marquee.sources.tables import Tables


def _cents(column: str) -> Column:
    """A rounded amount as DECIMAL, so that adding it up has one answer."""
    return F.col(column).cast("decimal(28,2)")


# ---------------------------------------------------------------- overview, shares, ranks


def exec_film_contribution(t: Tables, f: Filters) -> DataFrame:
    """The ten titles with most tickets and their share of the revenue of these ten."""
    shown = Window.partitionBy()  # ten rows
    return (
        kpi.movie_rankings(t, f, top=10)
        .withColumn("_all", F.sum(F.col("revenue").cast("decimal(28,4)")).over(shown))
        .select(
            "movie_id",
            "title",
            F.col("tickets_sold").alias("total_tickets"),
            F.col("revenue").alias("total_revenue"),
            percent("revenue", "_all").alias("revenue_share"),
        )
    )


def sales_overview(t: Tables, f: Filters) -> DataFrame:
    return kpi.sales_summary(t, f).select(
        round2("revenue").alias("total_revenue"),
        "total_tickets",
        rounded_ratio("revenue", "total_tickets").alias("avg_ticket_price"),
        rounded_ratio("revenue", "total_capacity").alias("revenue_per_seat"),
        "avg_occupancy",
        "growth_tickets",
        "growth_revenue",
        "growth_occupancy",
    )


def revenue_by_cinema(t: Tables, f: Filters, top_n: int | None = None) -> DataFrame:
    """Venues by revenue with their share of the network."""
    order = [F.desc("total_revenue"), F.asc("cinema_id")]
    rows = kpi.cinema_rows(t, f).select(
        "cinema_id",
        "cinema_name",
        "city",
        "total_revenue",
        "total_tickets",
        "occupancy",
        F.col("top_movie.title").alias("top_movie_title"),
    )
    ranked = numbered(rows, order)
    out = attach(ranked, ranked.agg(F.sum("total_revenue").alias("_all")), "_all").select(
        "rank",
        "cinema_id",
        "cinema_name",
        "city",
        money("total_revenue").alias("total_revenue"),
        "total_tickets",
        "occupancy",
        percent("total_revenue", "_all").alias("contribution"),
        "top_movie_title",
    )
    return out if not top_n else out.filter(F.col("rank") <= top_n)


def revenue_by_cinema_summary(t: Tables, f: Filters) -> DataFrame:
    """Network totals with the best and the last venue by revenue."""
    revenue, key = F.col("total_revenue"), F.col("cinema_id")
    who = F.struct("cinema_id", "cinema_name", "total_revenue")
    return (
        kpi.cinema_totals(t, f)
        .agg(
            F.count(F.lit(1)).alias("total_cinemas"),
            F.count_if(F.col("total_tickets") > 0).alias("active_cinemas"),
            F.coalesce(F.sum("total_tickets"), F.lit(0)).alias("total_tickets_network"),
            money(F.sum("total_revenue")).alias("total_revenue_network"),
            F.coalesce(F.max("active_movies"), F.lit(0)).alias("active_movies"),
            F.min_by(who, F.struct(-revenue, key)).alias("top"),
            F.max_by(who, F.struct(-revenue, key)).alias("low"),
        )
        .select(
            "total_cinemas",
            "active_cinemas",
            "total_tickets_network",
            "total_revenue_network",
            "active_movies",
            F.col("top.cinema_id").alias("top_cinema_id"),
            F.col("top.cinema_name").alias("top_cinema_name"),
            F.col("low.cinema_id").alias("lowest_cinema_id"),
            F.col("low.cinema_name").alias("lowest_cinema_name"),
        )
    )


def studio_sales(t: Tables, f: Filters) -> DataFrame:
    """Per room with sales in the window, by sale time: shows, tickets, revenue, mean occupancy.

    Only shows that sold something count, for capacity and occupancy too.
    """
    return (
        sales_facts(t, f)
        .groupBy("studio_id", "studio_name", "cinema_id", "cinema_name", "city")
        .agg(
            F.count(F.lit(1)).alias("total_shows"),
            F.sum("tickets").alias("total_tickets"),
            F.sum("revenue").alias("revenue"),
            round2(F.avg("seat_share") * 100).alias("occupancy"),
        )
    )


def revenue_by_studio(t: Tables, f: Filters) -> DataFrame:
    order = [F.desc("revenue"), F.desc("total_tickets"), F.asc("studio_name"), F.asc("studio_id")]
    return numbered(studio_sales(t, f), order).select(
        "rank",
        "studio_id",
        "studio_name",
        "cinema_id",
        "cinema_name",
        "city",
        "total_shows",
        "total_tickets",
        money("revenue").alias("total_revenue"),
        rounded_ratio("revenue", "total_shows").alias("avg_revenue_per_show"),
        "occupancy",
    )


def revenue_by_studio_summary(t: Tables, f: Filters) -> DataFrame:
    place = F.struct(-F.col("revenue"), -F.col("total_tickets"), F.col("studio_name"), F.col("studio_id"))
    rows = studio_sales(t, f).withColumn("rounded", money("revenue"))
    return rows.agg(
        F.count(F.lit(1)).alias("total_studios"),
        F.count_if(F.col("total_shows") > 0).alias("active_studios"),
        round2(F.coalesce(F.sum(_cents("rounded")), F.lit(0))).alias("total_revenue"),
        F.min_by("studio_id", place).alias("top_studio_id"),
        F.max_by("studio_id", place).alias("lowest_studio_id"),
    )


def revenue_by_movie(t: Tables, f: Filters, top_n: int = 10) -> DataFrame:
    """The first titles by tickets with their share of the revenue of **all** titles."""
    sums = [F.sum(c).alias(c) for c in ("total_tickets", "total_revenue")]
    rows = with_whole(kpi.movie_sales_rows(t, f), ["movie_id", "title"], *sums)
    # All titles together come first, so the window holds one row more than is asked for.
    first = top_numbered(rows, [F.desc("_whole"), *orders.movie_sales()], (top_n or 10) + 1)
    first = first.withColumn("_all", of_whole("total_revenue")).filter("not _whole")
    return first.select(
        (F.col("rank") - 1).alias("rank"),
        "movie_id",
        "title",
        money("total_revenue").alias("total_revenue"),
        "total_tickets",
        percent("total_revenue", "_all").alias("contribution"),
    )


def revenue_by_movie_summary(t: Tables, f: Filters) -> DataFrame:
    place = F.struct(-F.col("total_tickets"), -orders.amount("total_revenue"), text_place("title"), F.col("movie_id"))
    best = F.min_by(F.struct("movie_id", "title"), place)
    return (
        kpi.movie_sales_rows(t, f)
        .agg(F.count(F.lit(1)).alias("total_movies"), best.alias("best"))
        .select(
            "total_movies",
            F.col("best.movie_id").alias("top_movie_id"),
            F.col("best.title").alias("top_movie_title"),
        )
    )


# ---------------------------------------------------------------- start hours


def slot_scores(facts: DataFrame, *keys: str) -> DataFrame:
    """Demand, revenue, occupancy and score per start hour, within ``keys``.

    The windows hold the start hours of one key: at most 24 rows.
    """
    within = Window.partitionBy(*keys)
    sums = facts.groupBy(*keys, "time_slot").agg(
        F.sum("tickets").alias("demand"),
        F.sum("revenue").alias("amount"),
        F.coalesce(F.sum("total_capacity"), F.lit(0)).alias("capacity"),
    )
    span = sums.select(
        "*",
        minmax("demand", F.min("demand").over(within), F.max("demand").over(within)).alias("_d"),
        minmax("amount", F.min("amount").over(within), F.max("amount").over(within)).alias("_r"),
    )
    scored = span.select(
        *keys,
        "time_slot",
        money("amount").alias("revenue"),
        "demand",
        percent("demand", "capacity").alias("occupancy"),
        round2("_d").alias("normalized_demand"),
        round2("_r").alias("normalized_revenue"),
        round2(F.col("_d") * C.SLOT_DEMAND_WEIGHT + F.col("_r") * C.SLOT_REVENUE_WEIGHT).alias("optimization_score"),
    )
    score, full = F.col("optimization_score"), F.col("occupancy")
    advice = (
        F.when((score >= 0.6) & (full >= 70), C.SLOT_PREMIUM)
        .when(score >= 0.5, C.SLOT_STRONG)
        .when(full < 40, C.SLOT_QUIET)
        .otherwise(C.SLOT_KEEP)
    )
    return scored.withColumn("recommendation", advice)


def time_slots(t: Tables, f: Filters) -> DataFrame:
    return slot_scores(session_facts(t, f))


def peak_and_quiet(slots: DataFrame, *keys: str) -> DataFrame:
    """The start hours with most and least revenue; the earlier one where two are equal."""
    row = F.struct("time_slot", "revenue", "demand", "occupancy", "recommendation")
    return (
        slots.groupBy(*keys)
        .agg(
            F.min_by(row, F.struct(-F.col("revenue"), F.col("time_slot"))).alias("peak"),
            F.min_by(row, F.struct(F.col("revenue"), F.col("time_slot"))).alias("quiet"),
        )
        .select(
            *keys,
            F.col("peak.time_slot").alias("peak_time_slot"),
            F.col("peak.revenue").alias("peak_revenue"),
            F.col("peak.demand").alias("peak_demand"),
            F.col("peak.occupancy").alias("peak_occupancy"),
            F.col("peak.recommendation").alias("peak_recommendation"),
            F.col("quiet.time_slot").alias("quiet_time_slot"),
            F.col("quiet.revenue").alias("quiet_revenue"),
            F.col("quiet.demand").alias("quiet_demand"),
        )
    )


def time_slots_peak_quiet(t: Tables, f: Filters) -> DataFrame:
    return peak_and_quiet(time_slots(t, f))


# ---------------------------------------------------------------- trend


def _period(group_by: str) -> Column:
    return F.date_format("show_date", "yyyy-MM" if group_by == "monthly" else "yyyy-MM-dd")


def _trend_rows(t: Tables, f: Filters, group_by: str) -> DataFrame:
    return (
        sold_shows(t, f)
        .groupBy(_period(group_by).alias("time_group"))
        .agg(F.sum("tickets").alias("total_tickets"), money(F.sum("revenue")).alias("revenue"))
    )


def sales_trend(t: Tables, f: Filters, group_by: str = "daily") -> DataFrame:
    """Tickets and revenue per date or month with the mean of this and the two rows before it.

    The mean is over rows that exist and not over calendar days. The window holds one row
    per day of the calendar, whatever the amount of data.
    """
    trailing = Window.orderBy("time_group").rowsBetween(-2, 0)
    mean = rounded_ratio(F.sum(_cents("revenue")).over(trailing), F.count(F.lit(1)).over(trailing))
    return _trend_rows(t, f, group_by).withColumn("moving_average", mean)


def sales_trend_summary(t: Tables, f: Filters, group_by: str = "daily") -> DataFrame:
    return _trend_rows(t, f, group_by).agg(
        F.lit(group_by).alias("group_by"),
        F.lit("show_date").alias("date_axis"),
        round2(F.coalesce(F.sum(_cents("revenue")), F.lit(0))).alias("total_revenue"),
        F.coalesce(F.sum("total_tickets"), F.lit(0)).alias("total_tickets"),
    )


def sales_trend_forecast(t: Tables, f: Filters, group_by: str = "daily") -> DataFrame:
    """Mean revenue of the last three rows as the next date's or month's; 0 and no label without rows."""
    last = _trend_rows(t, f, group_by).orderBy(F.desc("time_group")).limit(3)
    newest = F.max("time_group")
    if group_by == "monthly":
        following = F.date_format(F.add_months(F.to_date(newest, "yyyy-MM"), 1), "yyyy-MM")
    else:
        following = F.date_format(F.date_add(F.to_date(newest), 1), "yyyy-MM-dd")
    return last.agg(
        F.lit(group_by).alias("group_by"),
        following.alias("next_period"),
        rounded_ratio(F.coalesce(F.sum(_cents("revenue")), F.lit(0)), F.count(F.lit(1))).alias("projected_revenue"),
    )


def _year_before(day: date) -> date:
    leap_day = day.month == 2 and day.day == 29
    return date(day.year - 1, 3, 1) if leap_day else day.replace(year=day.year - 1)


def yearly_breakdown(t: Tables, f: Filters) -> DataFrame:
    """Revenue by month name over the year up to ``as_of``; the two ends of the year share a month."""
    year = f.between(_year_before(f.as_of), f.as_of)
    return (
        sold_shows(t, year)
        .groupBy(F.month("show_date").cast("long").alias("month_num"), F.date_format("show_date", "MMM").alias("month"))
        .agg(money(F.sum("revenue")).alias("revenue"))
    )


# ---------------------------------------------------------------- day types


def weekend_weekday(t: Tables, f: Filters) -> DataFrame:
    """Weekend (Saturday, Sunday) against weekday; both rows are always there."""
    facts = session_facts(t, f).withColumn("day_type", day_type("show_date"))

    def sums(name: str) -> list[Column]:
        this = F.col("day_type") == name
        return [
            F.count_if(this).alias(f"{name}_shows"),
            F.coalesce(F.sum(F.when(this, F.col("tickets"))), F.lit(0)).alias(f"{name}_tickets"),
            F.coalesce(F.sum(F.when(this, F.col("revenue"))), F.lit(0)).alias(f"{name}_revenue"),
            F.coalesce(F.sum(F.when(this, F.col("total_capacity"))), F.lit(0)).alias(f"{name}_capacity"),
        ]

    def row(name: str) -> Column:
        n, k, r, c = (F.col(f"{name}_{x}") for x in ("shows", "tickets", "revenue", "capacity"))
        return F.struct(
            F.lit(name).alias("day_type"),
            n.alias("total_shows"),
            k.alias("total_tickets"),
            money(r).alias("total_revenue"),
            rounded_ratio(r, n).alias("avg_revenue_per_show"),
            rounded_ratio(k, n).alias("avg_tickets_per_show"),
            percent(k, c).alias("occupancy"),
        )

    return (
        facts.agg(*sums("weekday"), *sums("weekend"))
        .select(F.explode(F.array(row("weekday"), row("weekend"))).alias("r"))
        .select("r.*")
    )


def weekend_weekday_summary(t: Tables, f: Filters) -> DataFrame:
    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("day_type") == name, F.col(column)))

    end, week = of("weekend", "total_revenue"), of("weekday", "total_revenue")
    return weekend_weekday(t, f).agg(
        F.when(end >= week, "weekend").otherwise("weekday").alias("winning_period"),
        round2(F.abs(end - week)).alias("revenue_gap"),
        F.abs(of("weekend", "total_tickets") - of("weekday", "total_tickets")).alias("ticket_gap"),
    )


# ---------------------------------------------------------------- payments


def payment_mix(t: Tables, f: Filters) -> DataFrame:
    """Per payment type: tickets, share, revenue, mean price, fee, revenue less fees."""
    sold = sold_shows(t, f, "payment_type").filter(f.scope("payment_type"))
    sold = sold.select(F.coalesce("payment_type", F.lit("unknown")).alias("payment_type"), "tickets", "revenue")
    rows = with_whole(
        sold, ["payment_type"], F.sum("tickets").alias("total_transactions"), F.sum("revenue").alias("revenue")
    )
    # The window holds a row per payment type.
    rows = rows.withColumn("_all", of_whole("total_transactions")).filter("not _whole")
    count, fee = F.col("total_transactions"), payment_fee("payment_type")
    return rows.select(
        "payment_type",
        "total_transactions",
        percent(count, "_all").alias("usage_rate"),
        money("revenue").alias("gross_revenue"),
        rounded_ratio("revenue", count).alias("avg_price"),
        fee.alias("admin_fee"),
        round2(F.col("revenue") - (count * fee).cast("decimal(28,4)")).alias("net_profitability"),
    )


def payment_mix_summary(t: Tables, f: Filters) -> DataFrame:
    return payment_mix(t, f).agg(
        F.coalesce(F.sum("total_transactions"), F.lit(0)).alias("total_transactions"),
        F.min_by("payment_type", F.struct(-F.col("total_transactions"), F.col("payment_type"))).alias(
            "preferred_payment"
        ),
    )


# ---------------------------------------------------------------- incidents


def _status() -> Column:
    return F.lower(F.coalesce("status", F.lit("")))


def risk_summary(t: Tables, f: Filters) -> DataFrame:
    cancelled, delayed = F.col("cancelled"), F.col("delayed")
    return (
        shows(t, f)
        .agg(
            F.count(F.lit(1)).alias("total_shows"),
            F.count_if(_status().isin(*C.CANCELLED)).alias("cancelled"),
            F.count_if(_status() == C.DELAYED).alias("delayed"),
        )
        .withColumn("problematic_rate", percent(cancelled + delayed, "total_shows"))
    )


def _risk_rows(t: Tables, f: Filters) -> DataFrame:
    affected = shows(t, f).filter(_status().isin(*C.CANCELLED, C.DELAYED))
    return with_tickets(affected, ticket_sums(t, shown=f)).join(t.movies.select("movie_id", "title"), "movie_id", "left")


def risk_schedules(t: Tables, f: Filters) -> DataFrame:
    """Cancelled and delayed shows with the tickets and revenue at risk."""
    return _risk_rows(t, f).select(
        "schedule_id",
        "movie_id",
        "title",
        "studio_id",
        "cinema_id",
        "cinema_name",
        "city",
        "show_date",
        "start_time",
        "status",
        F.col("tickets").alias("tickets_sold"),
        money("revenue").alias("revenue"),
    )


def risk_by_movie(t: Tables, f: Filters) -> DataFrame:
    return (
        risk_schedules(t, f)
        .groupBy("movie_id", "title")
        .agg(
            F.count_if(_status().contains("cancel")).alias("cancelled"),
            F.count_if(_status() == C.DELAYED).alias("delayed"),
            round2(F.sum(_cents("revenue"))).alias("impacted_revenue"),
        )
    )
