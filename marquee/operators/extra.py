"""Reports that are only specified by formula: contribution, health score, heatmap, repeat trend, genre share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.expr import minmax, money, percent, round2, rounded_ratio
from marquee.functions.frames import attach
from marquee.operators import kpi, titles
from marquee.plans.facts import session_facts, sold_shows
from marquee.plans.filters import Filters
from marquee.sources.tables import Tables


def movie_contribution_by_cinema(t: Tables, f: Filters) -> DataFrame:
    """Share of each title in the revenue of its venue.

    The venue's total is an aggregate that is joined back, so a large venue is not one task.
    """
    rows = (
        sold_shows(t, f)
        .groupBy("cinema_id", "cinema_name", "movie_id")
        .agg(F.sum("revenue").alias("revenue"))
    )
    totals = rows.groupBy("cinema_id").agg(F.sum("revenue").alias("_all"))
    return (
        rows.join(totals, "cinema_id")
        .join(t.movies.select("movie_id", "title"), "movie_id")
        .select(
            "cinema_id",
            "cinema_name",
            "movie_id",
            "title",
            money("revenue").alias("total_revenue"),
            percent("revenue", "_all").alias("contribution"),
        )
    )


def cinema_health_score(t: Tables, f: Filters) -> DataFrame:
    """0.6 of the normalised revenue and 0.4 of the normalised occupancy of each venue."""
    rows = kpi.cinema_rows(t, f).select("cinema_id", "cinema_name", "city", "total_revenue", "occupancy")
    span = rows.agg(
        F.min("total_revenue").alias("r0"),
        F.max("total_revenue").alias("r1"),
        F.min("occupancy").alias("o0"),
        F.max("occupancy").alias("o1"),
    )
    score = minmax("total_revenue", "r0", "r1") * 0.6 + minmax("occupancy", "o0", "o1") * 0.4
    return attach(rows, span, "r0", "r1", "o0", "o1").select(
        "cinema_id",
        "cinema_name",
        "city",
        money("total_revenue").alias("total_revenue"),
        "occupancy",
        round2(score).alias("health_score"),
    )


def seat_demand_heatmap(t: Tables, f: Filters) -> DataFrame:
    """Tickets per date, start hour and room; combinations with shows but without tickets are zero."""
    return (
        session_facts(t, f)
        .groupBy("show_date", "time_slot", "studio_id", "studio_name")
        .agg(F.count(F.lit(1)).alias("total_shows"), F.sum("tickets").alias("total_tickets"))
    )


def repeat_schedule_trend(t: Tables, f: Filters) -> DataFrame:
    """Mean tickets per show of each title and week, against the week before in which it ran.

    The window holds the weeks of one title.
    """
    weeks = (
        session_facts(t, f)
        .groupBy("movie_id", F.date_trunc("week", "show_date").cast("date").alias("period_start"))
        .agg(F.count(F.lit(1)).alias("total_schedules"), F.sum("tickets").alias("total_tickets"))
        .withColumn("avg_tickets", rounded_ratio("total_tickets", "total_schedules"))
    )
    by_week = Window.partitionBy("movie_id").orderBy("period_start")
    return (
        weeks.withColumn("previous_avg", F.lag("avg_tickets").over(by_week))
        .join(t.movies.select("movie_id", "title"), "movie_id")
        .select(
            "movie_id",
            "title",
            "period_start",
            "total_schedules",
            "total_tickets",
            "avg_tickets",
            "previous_avg",
            round2(F.col("avg_tickets") - F.col("previous_avg")).alias("change"),
        )
    )


def genre_share(t: Tables, f: Filters) -> DataFrame:
    """Tickets of each genre as a share of all tickets.

    A ticket counts for each genre of its title, so the shares can add up to more than 100.
    """
    total = session_facts(t, f).agg(F.sum("tickets").alias("_all"))
    return attach(titles.genre_popularity(t, f), total, "_all").select(
        "genre", "total_tickets", percent("total_tickets", "_all").alias("share")
    )
