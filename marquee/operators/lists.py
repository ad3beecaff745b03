"""Lists and lookups: titles, rooms, shows, tickets, cities, payment types, filter checks.

A list gives one page, by its number or as what follows ``after``, the last row of the page before;
the latter costs the same for every page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from marquee.functions.expr import genre_array, payment_fee, start_seconds
from marquee.functions.frames import paged, totals
from marquee.plans.facts import tickets_sold, venues
from marquee.plans.filters import Filters
from marquee.sources.tables import Tables


def lookup(frame: DataFrame, key: str, value) -> DataFrame:
    """The row of one id; the comparison reaches the scan."""
    return frame.filter(F.col(key) == F.lit(value))


def _like(column: str, text: str | None) -> Column:
    """Contains ``text``, upper and lower case alike; ``%`` and ``_`` in it are wildcards."""
    return F.lit(True) if not text else F.col(column).ilike(f"%{text}%")


def _is(column: str, value) -> Column:
    return F.lit(True) if value in (None, "") else F.col(column) == F.lit(value)


def _values(after: Row | dict | None, *names: str) -> list[Column] | None:
    return None if after is None else [F.lit(after[name]) for name in names]


def movies_list(
    t: Tables,
    search: str | None = None,
    genre: str | None = None,
    rating_usia: str | None = None,
    page_number: int | None = None,
    limit: int = 20,
    after: Row | dict | None = None,
) -> DataFrame:
    rows = t.movies.filter(_like("title", search) & _like("genre", genre) & _is("rating_usia", rating_usia))
    return paged(rows, [(F.col("movie_id"), False)], page_number, limit, _values(after, "movie_id")).select(
        "movie_id",
        "title",
        genre_array().alias("genre"),
        "rating_usia",
        F.coalesce(F.col("duration_min").cast("long"), F.lit(0)).alias("duration_min"),
    )


def movies_count(
    t: Tables, search: str | None = None, genre: str | None = None, rating_usia: str | None = None, limit: int = 20
) -> DataFrame:
    """Rows and pages of the same list."""
    return totals(movies_list(t, search, genre, rating_usia), limit)


def studios_list(
    t: Tables,
    f: Filters = Filters(),
    screen_type: str | None = None,
    page_number: int | None = None,
    limit: int = 20,
    after: Row | dict | None = None,
) -> DataFrame:
    rows = t.studio.filter(f.scope("cinema_id", "studio_id") & _is("screen_type", screen_type))
    return paged(rows, [(F.col("studio_id"), False)], page_number, limit, _values(after, "studio_id")).select(
        "studio_id",
        "cinema_id",
        "studio_name",
        F.coalesce(F.col("total_capacity").cast("long"), F.lit(0)).alias("total_capacity"),
        "screen_type",
    )


def studios_count(t: Tables, f: Filters = Filters(), screen_type: str | None = None, limit: int = 20) -> DataFrame:
    return totals(studios_list(t, f, screen_type), limit)


def schedules_list(
    t: Tables,
    f: Filters = Filters(),
    status: str | None = None,
    page_number: int | None = None,
    limit: int = 20,
    after: Row | dict | None = None,
) -> DataFrame:
    """Shows of the dates, the latest first."""
    rows = t.schedules.join(t.studio.select("studio_id", "cinema_id"), "studio_id").filter(
        f.show_window() & f.scope("movie_id", "cinema_id", "studio_id") & _is("status", status)
    )
    keys = [(F.col("show_date"), True), (start_seconds(), True), (F.col("schedule_id"), False)]
    values = _values(after, "show_date", "start_time", "schedule_id")
    if values is not None:
        values[1] = start_seconds(values[1])
    return paged(rows, keys, page_number, limit, values).select(
        "schedule_id",
        "movie_id",
        "studio_id",
        "cinema_id",
        "show_date",
        "start_time",
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
        "status",
    )


def schedules_count(t: Tables, f: Filters = Filters(), status: str | None = None, limit: int = 20) -> DataFrame:
    return totals(schedules_list(t, f, status), limit)


def _tickets(t: Tables, f: Filters = Filters()) -> DataFrame:
    return tickets_sold(t, f).join(t.schedules.select("schedule_id", "movie_id", "studio_id"), "schedule_id").join(
        t.studio.select("studio_id", "cinema_id"), "studio_id"
    )


def tickets_list(
    t: Tables,
    f: Filters = Filters(),
    schedule_id=None,
    seat_category: str | None = None,
    page_number: int | None = None,
    limit: int = 20,
    after: Row | dict | None = None,
) -> DataFrame:
    """Tickets by sale time, the newest first, under their public names."""
    rows = _tickets(t, f).filter(
        f.scope("movie_id", "cinema_id", "payment_type")
        & _is("schedule_id", schedule_id)
        & _is("seat_category", seat_category)
    )
    keys = [(F.col("trans_time"), True), (F.col("tiket_id"), False)]
    return paged(rows, keys, page_number, limit, _values(after, "trans_time", "ticket_id")).select(
        F.col("tiket_id").alias("ticket_id"),
        "schedule_id",
        "movie_id",
        "cinema_id",
        "seat_category",
        F.coalesce(F.col("final_price").cast("double"), F.lit(0.0)).alias("final_price"),
        "trans_time",
        "payment_type",
        F.lit("success").alias("status"),
    )


def tickets_count(
    t: Tables, f: Filters = Filters(), schedule_id=None, seat_category: str | None = None, limit: int = 20
) -> DataFrame:
    return totals(tickets_list(t, f, schedule_id, seat_category), limit)


def ticket_detail(t: Tables, tiket_id=None) -> DataFrame:
    """Every ticket, or one, with title, room and venue."""
    rows = _tickets(t) if tiket_id is None else lookup(_tickets(t), "tiket_id", tiket_id)
    return rows.select(
        "tiket_id",
        "schedule_id",
        "movie_id",
        "studio_id",
        "cinema_id",
        "seat_category",
        F.coalesce(F.col("final_price").cast("double"), F.lit(0.0)).alias("final_price"),
        "trans_time",
        "payment_type",
        F.lit("success").alias("status"),
    )


def cities(t: Tables) -> DataFrame:
    return t.cinema.groupBy("city").agg(F.count(F.lit(1)).alias("total_cinemas"))


def payment_config(t: Tables) -> DataFrame:
    """The payment types in use with their fee."""
    return (
        t.tiket.select(F.coalesce("payment_type", F.lit("unknown")).alias("payment_type"))
        .distinct()
        .withColumn("admin_fee", payment_fee("payment_type"))
    )


def studio_inventory(t: Tables, f: Filters = Filters()) -> DataFrame:
    """Rooms with their venue, in order of city, venue, most seats, name."""
    return (
        venues(t)
        .filter(f.scope("city", "cinema_id", "studio_id"))
        .select(
            "studio_id",
            "studio_name",
            F.coalesce(F.col("total_capacity").cast("long"), F.lit(0)).alias("total_capacity"),
            "cinema_id",
            "cinema_name",
            "city",
        )
        .orderBy(
            F.asc_nulls_last("city"),
            F.asc_nulls_last("cinema_name"),
            F.desc_nulls_last("total_capacity"),
            F.asc_nulls_last("studio_name"),
            "studio_id",
        )
    )


def filter_violations(t: Tables, requests: DataFrame) -> DataFrame:
    """Requests whose city, venue and room do not exist or do not belong together, with the first reason.

    ``requests`` has request_id, city, cinema_id and studio_id; an empty part is not checked.
    """
    cinema = t.cinema.select(F.col("cinema_id").alias("_cinema"), F.col("city").alias("_city"))
    studio = t.studio.select(F.col("studio_id").alias("_studio"), F.col("cinema_id").alias("_owner"))
    rows = requests.join(cinema, F.col("cinema_id") == F.col("_cinema"), "left").join(
        studio, F.col("studio_id") == F.col("_studio"), "left"
    )
    asked_cinema, asked_studio = F.col("cinema_id").isNotNull(), F.col("studio_id").isNotNull()
    asked_city = F.coalesce("city", F.lit("")) != ""
    reason = (
        F.when(asked_cinema & F.col("_cinema").isNull(), "CINEMA_NOT_FOUND")
        .when(asked_cinema & asked_city & (F.col("_city") != F.col("city")), "CINEMA_NOT_IN_CITY")
        .when(asked_studio & F.col("_studio").isNull(), "STUDIO_NOT_FOUND")
        .when(asked_studio & asked_cinema & (F.col("_owner") != F.col("cinema_id")), "STUDIO_NOT_IN_CINEMA")
    )
    return (
        rows.withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("request_id", "city", "cinema_id", "studio_id", "reason")
    )
