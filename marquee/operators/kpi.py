"""Base figures: totals, growth, trends, occupancy, titles, rooms, venues, cities, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.expr import (
    SEAT_COLUMNS,
    genre_array,
    genres,
    growth,
    money,
    percent,
    ratio,
    round2,
    rounded_ratio,
    seat_sums,
    start_hour,
    text_place,
)
from marquee.functions.frames import attach, first_per, page
from marquee.operators import orders
from marquee.plans.facts import (
    all_shows,
    last_hour,
    newest_sale,
    sales_facts,
    session_facts,
    shows,
    sold_shows,
    ticket_sums,
    with_tickets,
)
from marquee.plans.filters import Filters
from marquee.session import stored
from marquee.sources.tables import Tables

MOVIE_COLUMNS = ["movie_id", "title", "genre", "rating_usia", "duration_min"]


# ---------------------------------------------------------------- shows and totals


def show_facts(t: Tables, f: Filters) -> DataFrame:
    """Per show: tickets, revenue, capacity, occupancy in percent."""
    return session_facts(t, f).select(
        "schedule_id",
        "movie_id",
        "studio_id",
        "cinema_id",
        "city",
        "show_date",
        "time_slot",
        F.col("total_capacity").cast("long").alias("total_capacity"),
        "tickets",
        money("revenue").alias("revenue"),
        round2(F.col("seat_share") * 100).alias("occupancy"),
    )


def window_parts(f: Filters) -> list[Column]:
    """Aggregates over shows for the window and for the window before it. They can be added up."""
    now, before = f.in_window(), f.previous().in_window()

    def parts(when: Column, prefix: str) -> list[Column]:
        def total(column: str, name: str) -> Column:
            return F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0)).alias(prefix + name)

        return [
            F.count_if(when).alias(f"{prefix}shows"),
            total("tickets", "tickets"),
            total("total_capacity", "capacity"),
            total("revenue", "revenue"),
            total("seat_share", "share"),
        ]

    return parts(now, "") + parts(before, "previous_")


PARTS = [f"{prefix}{name}" for prefix in ("", "previous_") for name in ("shows", "tickets", "capacity", "revenue", "share")]


def with_occupancy(sums: DataFrame) -> DataFrame:
    """Add the mean occupancy of both windows: the mean of the shares of the shows."""
    for prefix in ("", "previous_"):
        mean = ratio(f"{prefix}share", f"{prefix}shows")
        sums = sums.withColumn(f"{prefix}occupancy", round2(mean * 100))
    return sums


def window_sums(facts: DataFrame, f: Filters) -> DataFrame:
    """Sums of the window and of the window before it, from one pass; ``facts`` covers both."""
    venues = F.count_distinct(F.when(f.in_window(), F.col("cinema_id"))).alias("venues")
    return with_occupancy(facts.agg(*window_parts(f), venues))


def sales_summary(t: Tables, f: Filters, compare: bool = True) -> DataFrame:
    """Totals of the window. A "transaction" is a show, sold or not; a venue is active with a show."""
    facts = session_facts(t, f.with_previous() if compare else f)
    sums = window_sums(facts, f)
    columns = [
        F.col("tickets").alias("total_tickets"),
        F.col("capacity").alias("total_capacity"),
        F.col("revenue").cast("double").alias("revenue"),
        F.col("occupancy").alias("avg_occupancy"),
        F.col("shows").alias("total_transactions"),
        F.col("venues").alias("cinema_aktif"),
        t.cinema.agg(F.count(F.lit(1)).alias("n")).scalar().alias("cinema_tersedia"),
    ]
    if compare:
        columns += [
            growth("tickets", "previous_tickets").alias("growth_tickets"),
            growth("revenue", "previous_revenue").alias("growth_revenue"),
            growth("occupancy", "previous_occupancy").alias("growth_occupancy"),
        ]
    return sums.select(*columns)


def period_growth(t: Tables, f: Filters) -> DataFrame:
    """One row per figure: this window, the one before it, change in percent."""
    sums = window_sums(session_facts(t, f.with_previous()), f)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).cast("double").alias("current_value"),
                F.col(f"previous_{name}").cast("double").alias("previous_value"),
            )
            for name in ("tickets", "revenue", "occupancy")
        ]
    )
    return (
        sums.select(F.explode(rows).alias("r"))
        .select("r.*")
        .withColumn("growth_pct", growth("current_value", "previous_value"))
    )


# ---------------------------------------------------------------- trends


def trend(t: Tables, f: Filters, group_by: str = "hourly") -> DataFrame:
    """Tickets and revenue by start hour or by date; groups without tickets are absent."""
    if group_by not in ("hourly", "daily"):
        raise ValueError("group_by must be hourly or daily")
    group = start_hour() if group_by == "hourly" else F.col("show_date")
    return (
        sold_shows(t, f)
        .groupBy(group.alias("time_group"))
        .agg(F.sum("tickets").alias("tickets_sold"), money(F.sum("revenue")).alias("revenue"))
    )


def trend_summary(t: Tables, f: Filters) -> DataFrame:
    sums = window_sums(session_facts(t, f.with_previous()), f)
    return sums.select(
        F.col("tickets").alias("total_tickets"),
        money("revenue").alias("revenue"),
        growth("tickets", "previous_tickets").alias("growth_tickets"),
        growth("revenue", "previous_revenue").alias("growth_revenue"),
    )


# ---------------------------------------------------------------- occupancy


def occupancy_groups(t: Tables, f: Filters, group_by: str = "hourly") -> DataFrame:
    group = F.col("show_date")
    if group_by == "hourly":
        group = F.concat_ws(" ", F.date_format("show_date", "yyyy-MM-dd"), "time_slot")
    return (
        session_facts(t, f)
        .groupBy(group.alias("time_group"))
        .agg(
            F.sum("tickets").alias("total_tickets"),
            F.coalesce(F.sum("total_capacity"), F.lit(0)).cast("long").alias("total_capacity"),
            F.count(F.lit(1)).alias("total_schedules"),
            round2(F.avg("seat_share") * 100).alias("occupancy"),
        )
    )


def occupancy(t: Tables, f: Filters, group_by: str = "hourly") -> DataFrame:
    """Tickets, capacity and mean share of seats sold by date and hour, or by date."""
    return occupancy_groups(t, f, group_by).drop("total_schedules")


def occupancy_summary(t: Tables, f: Filters, group_by: str = "daily") -> DataFrame:
    """Overall occupancy: mean of the **rounded** group values, weighted by shows."""
    weighted = F.sum((F.col("occupancy") * F.col("total_schedules")).cast("decimal(28,4)"))
    return occupancy_groups(t, f, group_by).agg(
        F.coalesce(F.sum("total_tickets"), F.lit(0)).alias("total_tickets"),
        F.coalesce(F.sum("total_capacity"), F.lit(0)).alias("total_capacity"),
        rounded_ratio(weighted, F.coalesce(F.sum("total_schedules"), F.lit(0))).alias("occupancy"),
    )


# ---------------------------------------------------------------- titles


def movie_stats_summary(t: Tables, f: Filters) -> DataFrame:
    """Titles on show, tickets, best title and best genre; a ticket counts once per genre."""
    sold = ticket_sums(t, shown=f)
    rows = with_tickets(shows(t, f), sold).groupBy("movie_id").agg(F.sum("tickets").alias("tickets"))
    by_movie = rows.join(t.movies, "movie_id").filter(f.scope("rating_usia"))
    best_movie = by_movie.filter("tickets > 0").agg(
        F.min_by(
            F.struct("movie_id", "title", "tickets"), F.struct(-F.col("tickets"), text_place("title"), F.col("movie_id"))
        ).alias("m")
    )
    best_genre = (
        by_movie.filter("tickets > 0")
        .select(F.explode(genres()).alias("genre"), "tickets")
        .groupBy("genre")
        .agg(F.sum("tickets").alias("tickets"))
        .agg(F.min_by(F.struct("genre", "tickets"), F.struct(-F.col("tickets"), F.col("genre"))).alias("g"))
    )
    totals = by_movie.agg(
        F.count(F.lit(1)).alias("total_movies_showing"),
        F.coalesce(F.sum("tickets"), F.lit(0)).alias("total_tickets_sold"),
    )
    return (
        totals.withColumn("m", best_movie.scalar())
        .withColumn("g", best_genre.scalar())
        .select(
            "total_movies_showing",
            "total_tickets_sold",
            F.col("m.movie_id").alias("top_movie_id"),
            F.col("m.title").alias("top_movie_title"),
            F.col("m.tickets").alias("top_movie_tickets"),
            F.col("g.genre").alias("top_genre"),
            F.col("g.tickets").alias("top_genre_tickets"),
        )
    )


def _seats_by_movie(t: Tables, f: Filters) -> DataFrame:
    """Per title on show: shows, tickets, revenue and seats by category, with the title's columns."""
    sums = (
        with_tickets(shows(t, f), ticket_sums(t, shown=f, seats=True))
        .groupBy("movie_id")
        .agg(
            F.count(F.lit(1)).alias("shows"),
            F.sum("tickets").alias("tickets"),
            F.sum("revenue").alias("revenue"),
            *seat_sums(),
        )
    )
    return sums.join(t.movies, "movie_id").filter(f.scope("rating_usia"))


def rating_breakdown(t: Tables, f: Filters) -> DataFrame:
    """By age rating: tickets, shows, seats by category."""
    return (
        _seats_by_movie(t, f)
        .groupBy(F.coalesce("rating_usia", F.lit("Unknown")).alias("rating_usia"))
        .agg(
            F.sum("tickets").alias("total_tickets_sold"),
            F.sum("shows").alias("total_showings"),
            *seat_sums(),
        )
    )


def movie_rankings(t: Tables, f: Filters, top: int | None = None) -> DataFrame:
    """Per title on show: tickets, revenue, seat split. ``top`` keeps the first by tickets, then title."""
    rows = _seats_by_movie(t, f).select(
        "movie_id",
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        genre_array().alias("genre"),
        "rating_usia",
        F.coalesce(F.col("duration_min").cast("long"), F.lit(0)).alias("duration_min"),
        F.col("tickets").alias("tickets_sold"),
        F.col("revenue").cast("double").alias("revenue"),
        *SEAT_COLUMNS,
    )
    return rows if top is None else orders.ordered("movie_rankings", rows, top)


def movie_sales_rows(t: Tables, f: Filters) -> DataFrame:
    """Per title: tickets and exact revenue by sale time."""
    return (
        sales_facts(t, f)
        .groupBy("movie_id")
        .agg(F.sum("tickets").alias("total_tickets"), F.sum("revenue").alias("total_revenue"))
        .join(t.movies.select("movie_id", "title", "genre", "rating_usia", "duration_min"), "movie_id")
    )


def movie_sales_txn(t: Tables, f: Filters, top_n: int | None = None) -> DataFrame:
    rows = movie_sales_rows(t, f)
    if top_n:
        rows = orders.ordered("movie_sales_txn", rows, top_n)
    return rows.select("movie_id", "title", "total_tickets", F.col("total_revenue").cast("double").alias("total_revenue"))


def movie_detail(t: Tables, f: Filters = Filters()) -> DataFrame:
    """Every title over all time: tickets, revenue, mean price, venues that show it."""
    sums = (
        with_tickets(t.schedules.join(t.studio, "studio_id"), ticket_sums(t))
        .groupBy("movie_id")
        .agg(
            F.sum("tickets").alias("total_tickets"),
            F.sum("revenue").alias("total_revenue"),
            F.count_distinct("cinema_id").alias("showing_at_count"),
        )
    )
    return (
        t.movies.filter(f.scope("movie_id"))
        .join(sums, "movie_id", "left")
        .select(
            "movie_id",
            "title",
            genre_array().alias("genre"),
            "rating_usia",
            F.coalesce(F.col("duration_min").cast("long"), F.lit(0)).alias("duration_min"),
            F.coalesce("total_tickets", F.lit(0)).alias("total_tickets"),
            F.coalesce(F.col("total_revenue").cast("double"), F.lit(0.0)).alias("total_revenue"),
            ratio("total_revenue", F.coalesce("total_tickets", F.lit(0))).alias("avg_ticket_price"),
            F.coalesce("showing_at_count", F.lit(0)).alias("showing_at_count"),
        )
    )


def movie_showing_at(t: Tables, f: Filters = Filters()) -> DataFrame:
    """The venues of every title, one row each, with the shows there."""
    return (
        t.schedules.join(t.studio, "studio_id")
        .filter(f.scope("movie_id"))
        .groupBy("movie_id", "cinema_id")
        .agg(F.count(F.lit(1)).alias("total_shows"))
    )


def movie_detail_seats(t: Tables, f: Filters = Filters()) -> DataFrame:
    """Tickets of every title by seat category as it is written; missing categories are left out."""
    return (
        ticket_sums(t, "seat_category")
        .filter(F.col("seat_category").isNotNull() & (F.col("seat_category") != ""))
        .join(t.schedules.join(t.studio, "studio_id").filter(f.scope("movie_id")), "schedule_id")
        .groupBy("movie_id", "seat_category")
        .agg(F.sum("tickets").alias("total_tickets"))
    )


def movie_performance(t: Tables, f: Filters) -> DataFrame:
    return (
        session_facts(t, f)
        .groupBy("movie_id")
        .agg(
            F.sum("tickets").alias("total_tickets"),
            F.sum("revenue").alias("revenue"),
            F.count_distinct("cinema_id").alias("showing_at_count"),
        )
        .select(
            "movie_id",
            "total_tickets",
            F.col("revenue").cast("double").alias("total_revenue"),
            rounded_ratio("revenue", "total_tickets").alias("avg_ticket_price"),
            "showing_at_count",
        )
    )


def movie_daily_trend(t: Tables, f: Filters) -> DataFrame:
    return (
        sold_shows(t, f)
        .groupBy("movie_id", F.col("show_date").alias("time_group"))
        .agg(F.sum("tickets").alias("tickets_sold"), F.sum("revenue").cast("double").alias("revenue"))
    )


def movie_seat_distribution(t: Tables, f: Filters) -> DataFrame:
    """Tickets per title and seat category, summed over venues.

    The known behaviour of keeping only the last venue's count is not repeated: it depends
    on the order of rows.
    """
    return (
        sold_shows(t, f, "seat_category")
        .groupBy("movie_id", "seat_category")
        .agg(F.sum("tickets").alias("total_tickets"))
    )


# ---------------------------------------------------------------- rooms, shows, venues


def studio_detail(t: Tables, f: Filters = Filters()) -> DataFrame:
    """Every room with its number of shows and tickets."""
    sums = (
        with_tickets(t.schedules, ticket_sums(t))
        .groupBy("studio_id")
        .agg(F.count(F.lit(1)).alias("total_schedules"), F.sum("tickets").alias("total_tickets"))
    )
    return (
        t.studio.filter(f.scope("studio_id"))
        .join(sums, "studio_id", "left")
        .select(
            "studio_id",
            "cinema_id",
            "studio_name",
            F.coalesce(F.col("total_capacity").cast("long"), F.lit(0)).alias("total_capacity"),
            "screen_type",
            F.coalesce("total_schedules", F.lit(0)).alias("total_schedules"),
            F.coalesce("total_tickets", F.lit(0)).alias("total_tickets"),
        )
    )


def schedule_detail(t: Tables, schedule_id=None) -> DataFrame:
    """Every show, or one, with its tickets and revenue."""
    rows, sums = t.schedules, ticket_sums(t)
    if schedule_id is not None:
        rows = rows.filter(F.col("schedule_id") == schedule_id)
    return with_tickets(rows.join(t.studio.select("studio_id", "cinema_id"), "studio_id"), sums).select(
        "schedule_id",
        "movie_id",
        "studio_id",
        "cinema_id",
        "show_date",
        "start_time",
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
        "status",
        F.col("tickets").alias("tickets_sold"),
        F.col("revenue").cast("double").alias("revenue"),
    )


def cinema_detail(t: Tables, f: Filters = Filters()) -> DataFrame:
    """Every venue with its rooms, shows and tickets."""
    per_room = (
        with_tickets(t.schedules, ticket_sums(t))
        .groupBy("studio_id")
        .agg(F.count(F.lit(1)).alias("shows"), F.sum("tickets").alias("tickets"))
    )
    sums = (
        t.studio.join(per_room, "studio_id", "left")
        .groupBy("cinema_id")
        .agg(
            F.count(F.lit(1)).alias("total_studios"),
            F.coalesce(F.sum("shows"), F.lit(0)).alias("total_schedules"),
            F.coalesce(F.sum("tickets"), F.lit(0)).alias("total_tickets"),
        )
    )
    counts = ["total_studios", "total_schedules", "total_tickets"]
    return (
        t.cinema.filter(f.scope("cinema_id"))
        .join(sums, "cinema_id", "left")
        .fillna(0, counts)
        .select("cinema_id", "cinema_name", "city", "address", _activity().alias("status"), *counts)
    )


def _activity(tickets: str = "total_tickets") -> Column:
    return F.when(F.col(tickets) > 0, F.lit("active")).otherwise(F.lit("inactive"))


def _venues_asked_for(t: Tables, f: Filters) -> DataFrame:
    cinema = t.cinema.filter(f.scope("city", "cinema_id"))
    if f.studio_id in (None, ""):
        return cinema
    owner = t.studio.filter(f.scope("studio_id")).select("cinema_id")
    return cinema.join(owner, "cinema_id", "left_semi")


def cinema_rows(t: Tables, f: Filters) -> DataFrame:
    """Per venue with shows: sales, capacity, occupancy, best title and best genre.

    Two date axes meet here: tickets and revenue are those **sold** in the window, capacity
    and active titles are those **shown** in it, and the occupancy divides one by the other.
    A room filter keeps the venues that own the room.
    """
    cinema = _venues_asked_for(t, f)
    rows = t.schedules.filter(f.scope("movie_id")).join(t.studio, "studio_id").join(cinema, "cinema_id")
    sold = with_tickets(rows, ticket_sums(t, f=f))
    shown = f.show_window()

    # Shows to (venue, room, title), the finest grain any of the branches below needs. The
    # branches differ in columns, so Spark would run the tickets once for each; the sums are
    # written once instead.
    grain = sold.groupBy("cinema_id", "studio_id", "movie_id").agg(
        F.sum("tickets").alias("tickets"),
        F.sum("revenue").alias("revenue"),
        F.coalesce(F.sum(F.when(shown, F.col("total_capacity"))), F.lit(0)).alias("capacity"),
        F.count_if(shown).alias("shown"),
    )
    grain = stored(grain, "venues")
    sales = grain.groupBy("cinema_id").agg(
        F.sum("tickets").alias("total_tickets"),
        F.sum("revenue").alias("total_revenue"),
        F.count_distinct(F.when(F.col("shown") > 0, F.col("movie_id"))).alias("active_movies"),
        F.count_distinct(F.when(F.col("tickets") > 0, F.col("studio_id"))).alias("active_studios"),
        F.sum("capacity").cast("long").alias("total_capacity"),
    )
    by_movie = grain.groupBy("cinema_id", "movie_id").agg(F.sum("tickets").alias("tickets_sold")).join(t.movies, "movie_id")
    best_movie = first_per(
        by_movie,
        ["cinema_id"],
        [-F.col("tickets_sold"), text_place("title"), F.col("movie_id")],
        ["movie_id", "title", "tickets_sold"],
        "top_movie",
    )
    by_genre = (
        by_movie.select("cinema_id", F.explode(genres()).alias("genre"), "tickets_sold")
        .groupBy("cinema_id", "genre")
        .agg(F.sum("tickets_sold").alias("tickets_sold"))
    )
    best_genre = first_per(
        by_genre, ["cinema_id"], [-F.col("tickets_sold"), F.col("genre")], ["genre", "tickets_sold"], "top_genre"
    )
    return (
        sales.join(cinema, "cinema_id")
        .join(best_movie, "cinema_id", "left")
        .join(best_genre, "cinema_id", "left")
        .withColumn("occupancy", percent("total_tickets", "total_capacity"))
        .withColumn("status", _activity())
    )


def cinema_stats(t: Tables, f: Filters = Filters()) -> DataFrame:
    return cinema_rows(t, f).select(
        "cinema_id",
        "cinema_name",
        "city",
        "total_tickets",
        F.col("total_revenue").cast("double").alias("total_revenue"),
        "active_movies",
        "active_studios",
        "total_capacity",
        "occupancy",
        F.col("top_movie.movie_id").alias("top_movie_id"),
        F.col("top_movie.title").alias("top_movie_title"),
        F.col("top_movie.tickets_sold").alias("top_movie_tickets"),
        F.col("top_genre.genre").alias("top_genre"),
        F.col("top_genre.tickets_sold").alias("top_genre_tickets"),
    )


def cinema_totals(t: Tables, f: Filters) -> DataFrame:
    """Figures per venue without the best title and genre, for totals over venues."""
    rows = t.schedules.filter(f.scope("movie_id")).join(t.studio, "studio_id").join(_venues_asked_for(t, f), "cinema_id")
    return with_tickets(rows, ticket_sums(t, f=f)).groupBy("cinema_id", "cinema_name", "city").agg(
        F.sum("tickets").alias("total_tickets"),
        F.sum("revenue").alias("total_revenue"),
        F.count_distinct(F.when(f.show_window(), F.col("movie_id"))).alias("active_movies"),
    )


def cinema_stats_summary(t: Tables, f: Filters = Filters()) -> DataFrame:
    """Network totals; ``active_movies`` is the largest number of titles of any venue."""
    return cinema_totals(t, f).agg(
        F.count(F.lit(1)).alias("total_cinemas"),
        F.count_if(F.col("total_tickets") > 0).alias("active_cinemas"),
        F.coalesce(F.sum("total_tickets"), F.lit(0)).alias("total_tickets"),
        money(F.sum("total_revenue")).alias("total_revenue"),
        F.coalesce(F.max("active_movies"), F.lit(0)).alias("active_movies"),
    )


def cinemas_list(t: Tables, f: Filters = Filters(), page_number: int | None = None, limit: int = 20) -> DataFrame:
    """Venues with address and status over all time, ordered by id."""
    rows = cinema_rows(t, f.without_dates()).select(
        "cinema_id",
        "cinema_name",
        "city",
        "address",
        "status",
        "total_tickets",
        F.col("total_revenue").cast("double").alias("total_revenue"),
        "total_capacity",
        "occupancy",
        F.col("top_movie.title").alias("top_movie_title"),
        F.col("top_genre.genre").alias("top_genre"),
    )
    return page(rows, [F.asc("cinema_id")], page_number, limit)


def cinema_performance(t: Tables, f: Filters) -> DataFrame:
    return cinema_stats(t, f).drop("cinema_name", "city")


def city_revenue(t: Tables, f: Filters) -> DataFrame:
    return (
        session_facts(t, f)
        .groupBy("city")
        .agg(
            F.count_distinct("cinema_id").alias("total_cinemas"),
            F.sum("tickets").alias("total_tickets"),
            F.sum("revenue").cast("double").alias("total_revenue"),
            F.coalesce(F.sum("total_capacity"), F.lit(0)).cast("long").alias("total_capacity"),
            F.count(F.lit(1)).alias("total_shows"),
            round2(F.avg("seat_share") * 100).alias("avg_occupancy"),
        )
    )


# ---------------------------------------------------------------- activity


def last_hour_tickets(t: Tables) -> DataFrame:
    """Tickets of the hour up to the newest ticket, both ends included, summed per show."""
    return last_hour(t).groupBy("schedule_id").agg(
        F.count(F.lit(1)).alias("tickets"), F.sum("final_price").alias("revenue")
    )


def _sold(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(
        F.sum("tickets").alias("tickets_sold"), F.sum("revenue").cast("double").alias("revenue")
    )


def last_hour_total(t: Tables) -> DataFrame:
    newest = newest_sale(t).withColumnRenamed("newest", "window_end")
    return attach(
        last_hour_tickets(t).agg(F.coalesce(F.sum("tickets"), F.lit(0)).alias("tickets_last_hour")), newest, "window_end"
    ).select(
        F.col("window_end").alias("last_data_in"),
        (F.col("window_end") - F.expr("INTERVAL 1 HOUR")).alias("window_start"),
        "window_end",
        "tickets_last_hour",
    )


def last_hour_by_city(t: Tables) -> DataFrame:
    return _sold(last_hour_tickets(t).join(all_shows(t), "schedule_id"), "city")


def last_hour_by_studio(t: Tables) -> DataFrame:
    return _sold(
        last_hour_tickets(t).join(all_shows(t), "schedule_id"), "studio_id", "studio_name", "cinema_id", "city"
    )


def last_hour_by_movie(t: Tables) -> DataFrame:
    return _sold(last_hour_tickets(t).join(t.schedules, "schedule_id"), "movie_id").join(
        t.movies.select("movie_id", "title"), "movie_id"
    ).select("movie_id", "title", "tickets_sold", "revenue")


def venue_status(t: Tables, system_active: bool = True) -> DataFrame:
    """Per venue: active or inactive by tickets over all time; all down with the system."""
    status = _activity() if system_active else F.lit("down")
    return cinema_totals(t, Filters()).select("cinema_id", "cinema_name", "city", status.alias("status"))


def venue_status_summary(t: Tables, system_active: bool = True) -> DataFrame:
    status = F.col("status")
    return (
        venue_status(t, system_active)
        .agg(
            F.count(F.lit(1)).alias("total_nodes"),
            F.count_if(status == "active").alias("active_nodes"),
            F.count_if(status == "inactive").alias("inactive_nodes"),
            F.count_if(status == "down").alias("down_nodes"),
        )
        .withColumn("health_rate", percent("active_nodes", "total_nodes"))
    )
