"""Title reports: overview, performance, shows, occupancy, genres and room formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.expr import (
    SEAT_COLUMNS,
    genre_array,
    genres,
    money,
    percent,
    ratio,
    round2,
    rounded_ratio,
    seat_sums,
)
from marquee.functions.frames import attach, top_numbered
from marquee.operators import kpi, orders, sales
from marquee.plans.facts import SCOPE_COLUMNS, all_shows, session_facts, shows, ticket_sums, rolled
from marquee.plans.filters import Filters
from marquee.sources.tables import Tables


def films_overview(t: Tables, f: Filters) -> DataFrame:
    """Titles on show, shows, tickets, revenue, occupancy (as in the occupancy report) and growth."""
    t = rolled(t, f.with_previous())
    titles = shows(t, f).join(t.movies.select("movie_id"), "movie_id").agg(
        F.count_distinct("movie_id").alias("active_films")
    )
    rows = kpi.sales_summary(t, f).drop("avg_occupancy")
    rows = attach(rows, titles, "active_films")
    overall = kpi.occupancy_summary(t, f).select(F.col("occupancy").alias("avg_occupancy"))
    return attach(rows, overall, "avg_occupancy").select(
        "active_films",
        F.col("total_transactions").alias("total_shows"),
        F.col("total_tickets").alias("tickets_sold"),
        round2("revenue").alias("revenue"),
        "avg_occupancy",
        "growth_tickets",
        "growth_revenue",
        "growth_occupancy",
    )


def films_performance(t: Tables, f: Filters, top_n: int = 10) -> DataFrame:
    """The first titles by tickets, then revenue, by sale time, with shares **of the rows shown**.

    Genre, age rating, length and seats are those of the title.
    """
    sums = (
        ticket_sums(t, f=f, seats=True)
        .join(all_shows(t).filter(f.scope(*SCOPE_COLUMNS)), "schedule_id")
        .groupBy("movie_id")
        .agg(F.sum("tickets").alias("total_tickets"), F.sum("revenue").alias("total_revenue"), *seat_sums())
    )
    first = top_numbered(sums.join(t.movies, "movie_id"), orders.movie_sales(), top_n or 10)
    shown = Window.partitionBy()  # top_n rows
    tickets, revenue = F.col("total_tickets"), F.col("total_revenue")
    score = (
        ratio(tickets, F.greatest(F.max(tickets).over(shown), F.lit(1))) * 0.6
        + ratio(revenue, F.greatest(F.max(revenue).over(shown), F.lit(1))) * 0.4
    )
    return first.select(
        "rank",
        "movie_id",
        "title",
        "total_tickets",
        money(revenue).alias("total_revenue"),
        F.coalesce(F.get(genre_array(), F.lit(0)), F.lit("Unknown")).alias("genre"),
        genre_array().alias("genres"),
        F.coalesce("rating_usia", F.lit("SU")).alias("rating_usia"),
        F.coalesce(F.col("duration_min").cast("long"), F.lit(0)).alias("duration_min"),
        *SEAT_COLUMNS,
        percent(tickets, F.sum(tickets).over(shown)).alias("share_of_tickets"),
        percent(revenue, F.sum(revenue).over(shown)).alias("share_of_revenue"),
        round2(score).alias("blockbuster_score"),
    )


def _titles(t: Tables) -> DataFrame:
    return t.movies.select("movie_id", "title")


def schedule_performance(t: Tables, f: Filters) -> DataFrame:
    return session_facts(t, f).join(_titles(t), "movie_id").select(
        "schedule_id",
        "movie_id",
        "title",
        "show_date",
        "start_time",
        "studio_id",
        "cinema_id",
        F.col("tickets").alias("total_tickets"),
        money("revenue").alias("revenue"),
        percent("tickets", "total_capacity").alias("occupancy"),
    )


def repeat_schedule(t: Tables, f: Filters) -> DataFrame:
    """Per title and date: shows, tickets, revenue."""
    return (
        session_facts(t, f)
        .groupBy("movie_id", "show_date")
        .agg(
            F.count(F.lit(1)).alias("total_schedules"),
            F.sum("tickets").alias("total_tickets"),
            money(F.sum("revenue")).alias("revenue"),
        )
        .join(_titles(t), "movie_id")
    )


def audience_density(t: Tables, f: Filters) -> DataFrame:
    """Per title: tickets per show and share of all seats sold."""
    n, k = F.count(F.lit(1)), F.sum("tickets")
    return (
        session_facts(t, f)
        .groupBy("movie_id")
        .agg(
            n.alias("total_schedules"),
            k.alias("total_tickets"),
            rounded_ratio(k, n).alias("audience_density"),
            percent(k, F.coalesce(F.sum("total_capacity"), F.lit(0))).alias("capacity_utilization"),
        )
        .join(_titles(t), "movie_id")
    )


def _occupancy_by(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.groupBy(*keys).agg(
        F.sum("tickets").alias("total_tickets"),
        F.coalesce(F.sum("total_capacity"), F.lit(0)).cast("long").alias("total_capacity"),
        round2(F.avg("seat_share") * 100).alias("occupancy"),
    )


def occupancy_by_movie(t: Tables, f: Filters) -> DataFrame:
    """Mean occupancy per title against the overall occupancy."""
    overall = kpi.occupancy_summary(t, f).select(F.col("occupancy").alias("_all"))
    relative = ratio("occupancy", "_all")
    known = F.col("_all") > 0
    rows = _occupancy_by(session_facts(t, f), "movie_id").join(_titles(t), "movie_id")
    return attach(rows, overall, "_all").select(
        "movie_id",
        "title",
        "total_tickets",
        "total_capacity",
        "occupancy",
        F.col("occupancy").alias("capacity_fit"),
        round2(relative).alias("underperforming_score"),
        F.when(known & (relative < 0.5), "critical")
        .when(known & (relative < 0.7), "underperforming")
        .otherwise("good")
        .alias("status"),
    )


def occupancy_by_day(t: Tables, f: Filters) -> DataFrame:
    return _occupancy_by(session_facts(t, f), "show_date")


def occupancy_by_studio(t: Tables, f: Filters) -> DataFrame:
    return _occupancy_by(session_facts(t, f), "studio_id", "studio_name")


def genre_popularity(t: Tables, f: Filters) -> DataFrame:
    """Tickets per genre; a ticket counts once for each genre of its title, genres without tickets stay."""
    per_movie = session_facts(t, f).groupBy("movie_id").agg(F.sum("tickets").alias("tickets"))
    return (
        per_movie.join(t.movies.select("movie_id", "genre"), "movie_id")
        .select(F.explode(genres()).alias("genre"), "tickets")
        .groupBy("genre")
        .agg(F.sum("tickets").alias("total_tickets"))
    )


def studio_format(t: Tables, f: Filters) -> DataFrame:
    """Rooms and shows in the window per screen type."""
    return (
        shows(t, f)
        .groupBy("studio_id", F.coalesce("screen_type", F.lit("unknown")).alias("format"))
        .agg(F.count(F.lit(1)).alias("shows"))
        .groupBy("format")
        .agg(F.count(F.lit(1)).alias("total_studios"), F.sum("shows").alias("total_schedules"))
    )
