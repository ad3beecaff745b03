"""Shared inputs of the operators: shows with their venue, and ticket sums per show.

Tickets are always summed to the show **before** any join. Spark combines them inside each
scan task, so a show that holds a third of all tickets is a few rows when it reaches the
shuffle, and the join with shows moves one row per show. No side carries a broadcast hint:
Spark broadcasts a side whose size is below its limit and shuffles it otherwise.

``tiket_id`` is the key of the ticket table and never null, so tickets are counted as rows
and the column is not read.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.expr import ratio, seat_counts, slot_label
from marquee.plans.filters import Filters
from marquee.session import stored
from marquee.sources.tables import Tables

SCOPE_COLUMNS = ("city", "cinema_id", "studio_id", "movie_id")


def venues(t: Tables) -> DataFrame:
    """Rooms with their venue."""
    return t.studio.join(t.cinema, "cinema_id")


def all_shows(t: Tables) -> DataFrame:
    """Shows with room and venue, left-deep so that each dimension is sized on its own."""
    return t.schedules.join(t.studio, "studio_id").join(t.cinema, "cinema_id")


def shows(t: Tables, f: Filters) -> DataFrame:
    """Shows in the window and scope."""
    return all_shows(t).filter(f.show_window() & f.scope(*SCOPE_COLUMNS))


def tickets_sold(t: Tables, f: Filters) -> DataFrame:
    """Tickets of the window of sale times; from the folders of its days where there are such.

    A folder is a day in UTC and the window one of the session, so a day more is opened at either end.
    """
    if t.sales is None or f.start is None:
        return t.tiket.filter(f.sale_window())
    day = timedelta(days=1)
    near = F.col("sale_date").between(F.lit(f.start - day), F.lit(f.end + day))
    return t.sales.filter(near & f.sale_window()).drop("sale_date")


def newest_sale(t: Tables) -> DataFrame:
    """The time of the newest sale, one row; null without tickets. The newest folder alone is read
    where tickets lie by the day of their sale."""
    tickets = t.tiket if t.last_sale is None else t.sales.filter(F.col("sale_date") == F.lit(t.last_sale))
    return tickets.agg(F.max("trans_time").alias("newest"))


def last_hour(t: Tables) -> DataFrame:
    """Tickets of the hour up to the newest sale, both ends included."""
    newest = newest_sale(t).scalar()
    tickets = t.tiket
    if t.last_sale is not None:
        # The hour reaches into the day before at most.
        near = F.col("sale_date").between(F.lit(t.last_sale - timedelta(days=1)), F.lit(t.last_sale))
        tickets = t.sales.filter(near).drop("sale_date")
    return tickets.filter(F.col("trans_time").between(newest - F.expr("INTERVAL 1 HOUR"), newest))


def ticket_sums(
    t: Tables, *extra: str, f: Filters | None = None, shown: Filters | None = None, seats: bool = False
) -> DataFrame:
    """Tickets and revenue per show and ``extra`` ticket columns; ``f`` filters on sale time.

    ``shown`` is the window of the shows that the sums will be joined with. Where the stored
    tickets carry the date of their show it prunes their folders; where not, the join alone decides.
    ``seats`` adds a count per known seat category, still one row per show.
    """
    tickets = t.tiket if f is None else tickets_sold(t, f)
    if shown is not None and "show_date" in tickets.columns:
        tickets = tickets.filter(shown.show_window())
    return tickets.groupBy("schedule_id", *extra).agg(
        F.count(F.lit(1)).alias("tickets"),
        F.sum("final_price").alias("revenue"),
        *(seat_counts() if seats else []),
    )


def with_tickets(show_rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Keep shows without tickets, as zeros."""
    return (
        show_rows.join(sums, "schedule_id", "left")
        .withColumn("tickets", F.coalesce("tickets", F.lit(0)))
        .withColumn("revenue", F.coalesce("revenue", F.lit(0).cast("decimal(28,4)")))
    )


def packed_shows(t: Tables, f: Filters) -> DataFrame:
    """Shows of the dates with the sums of their bucket's tickets, in the tasks that read the buckets."""
    return t.schedules.filter(f.show_window()).join(ticket_sums(replace(t, tiket=t.packed), shown=f), "schedule_id", "left")


def _bucketed(t: Tables, f: Filters) -> DataFrame:
    """Shows in the window and scope with their sums, from tables in buckets.

    The fact join comes first, while rows still lie in their buckets; the sums of the few hot shows
    are joined behind it.
    """
    hot = ticket_sums(replace(t, tiket=t.hot), shown=f).toDF("schedule_id", "hot_tickets", "hot_revenue")
    both = packed_shows(t, f).join(hot, "schedule_id", "left")
    zero = F.lit(0).cast("decimal(28,4)")
    both = both.withColumn("tickets", F.coalesce("tickets", "hot_tickets", F.lit(0)))
    both = both.withColumn("revenue", F.coalesce("revenue", "hot_revenue", zero)).drop("hot_tickets", "hot_revenue")
    return both.join(t.studio, "studio_id").join(t.cinema, "cinema_id").filter(f.scope(*SCOPE_COLUMNS))


def rolled_up(t: Tables, f: Filters) -> DataFrame:
    """Shows in the window and scope with their sums, from the tickets themselves."""
    rows = with_tickets(shows(t, f), ticket_sums(t, shown=f)) if t.packed is None else _bucketed(t, f)
    return (
        rows.withColumn("seat_share", ratio("tickets", "total_capacity"))
        .withColumn("time_slot", slot_label())
    )


ROLLUP_COLUMNS = [
    *["schedule_id", "movie_id", "studio_id", "studio_name", "cinema_id", "cinema_name", "city", "screen_type"],
    *["show_date", "start_time", "time_slot", "status", "price", "total_capacity"],
    *["tickets", "revenue", "seat_share"],
]


def with_rollup(t: Tables, f: Filters) -> Tables:
    """Tables that hold the rolled-up shows of a window, for several reports on it.

    The ticket table is read once; reports on dates inside the window then start from one
    row per show. ``f`` sets the dates only, the rollup holds every scope.
    """
    rows = rolled_up(t, Filters(start=f.start, end=f.end)).select(*ROLLUP_COLUMNS)
    return replace(t, rollup=stored(rows, "rollup"), rollup_days=(f.start, f.end))


def rolled(t: Tables, f: Filters) -> Tables:
    """Tables with a rollup that covers the window: the one there is, or a new one."""
    return t if covers(t, f) else with_rollup(t, f)


def covers(t: Tables, f: Filters) -> bool:
    """The stored rollup has every show of the window; one without dates covers all windows."""
    if t.rollup is None:
        return False
    first, last = t.rollup_days
    if first is None:
        return True
    return f.start is not None and first <= f.start and f.end <= last


def session_facts(t: Tables, f: Filters) -> DataFrame:
    """One row per show in the window: tickets, revenue, capacity, share of seats sold.

    The share is 0 without capacity and is not capped at 1.
    """
    if covers(t, f):
        return t.rollup.filter(f.show_window() & f.scope(*SCOPE_COLUMNS))
    return rolled_up(t, f)


def sold_shows(t: Tables, f: Filters, *extra: str) -> DataFrame:
    """Shows in the window that sold something, per ``extra`` ticket columns (inner join)."""
    if not extra and (t.packed is not None or covers(t, f)):
        return session_facts(t, f).filter("tickets > 0")
    return ticket_sums(t, *extra, shown=f).join(shows(t, f), "schedule_id")


def sales_facts(t: Tables, f: Filters) -> DataFrame:
    """One row per show with sales inside the window, by sale time and not by show date."""
    return (
        ticket_sums(t, f=f)
        .join(all_shows(t).filter(f.scope(*SCOPE_COLUMNS)), "schedule_id")
        .withColumn("seat_share", ratio("tickets", "total_capacity"))
    )
