"""Several reports for one set of filters: the executive view, the titles bundle, the sales bundle.

Each gives its parts by name. Shows are rolled up once for the window and the one before, and all
parts that go by show date start from there; parts by sale time or payment read tickets themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.frames import attach
from marquee.operators import alerts, kpi, sales, titles
from marquee.plans.facts import newest_sale, rolled
from marquee.plans.filters import Filters
from marquee.sources.tables import Tables


def system_status(t: Tables, system_active: bool = True) -> DataFrame:
    """Whether data arrive, the newest sale, and venues by activity over all time."""
    newest = newest_sale(t).withColumnRenamed("newest", "last_update")
    status = F.lit("active" if system_active else "down").alias("status")
    return attach(kpi.venue_status_summary(t, system_active), newest, "last_update").select(
        status, "last_update", "health_rate", "total_nodes", "active_nodes", "inactive_nodes", "down_nodes"
    )


def executive(t: Tables, f: Filters, read_log: DataFrame, system_active: bool = True) -> dict[str, DataFrame]:
    """Status and alerts are those of the whole chain and of every scope; the rest follows the filters."""
    t = rolled(t, f.with_previous())
    return {
        "system_status": system_status(t, system_active),
        "franchise_performance": kpi.cinema_stats(t, f),
        "city_revenue_summary": kpi.city_revenue(t, f),
        "top_film_contribution": sales.exec_film_contribution(t, f),
        "alert_summary": alerts.alert_summary(alerts.alerts(t, f, system_active), read_log),
    }


def films_bundle(t: Tables, f: Filters, top_n: int = 20) -> dict[str, DataFrame]:
    t = rolled(t, f.with_previous())
    return {
        "overview": titles.films_overview(t, f),
        "performance": titles.films_performance(t, f, top_n),
        "schedules": titles.schedule_performance(t, f),
        "schedules.repeat": titles.repeat_schedule(t, f),
        "schedules.density": titles.audience_density(t, f),
        "occupancy": titles.occupancy_by_movie(t, f),
        "occupancy.overall": kpi.occupancy_summary(t, f),
        "occupancy.day": titles.occupancy_by_day(t, f),
        "occupancy.studio": titles.occupancy_by_studio(t, f),
        "distribution": titles.genre_popularity(t, f),
        "distribution.format": titles.studio_format(t, f),
        "operational_risk": sales.risk_by_movie(t, f),
        "operational_risk.summary": sales.risk_summary(t, f),
        "operational_risk.schedules": sales.risk_schedules(t, f),
    }


def sales_bundle(t: Tables, f: Filters, cinema_top_n: int = 10, movie_top_n: int = 7) -> dict[str, DataFrame]:
    t = rolled(t, f.with_previous())
    return {
        "overview": sales.sales_overview(t, f),
        "revenue_by_cinema": sales.revenue_by_cinema(t, f, cinema_top_n),
        "revenue_by_cinema.summary": sales.revenue_by_cinema_summary(t, f),
        "revenue_by_movie": sales.revenue_by_movie(t, f, movie_top_n),
        "revenue_by_movie.summary": sales.revenue_by_movie_summary(t, f),
        "time_slots": sales.time_slots(t, f),
        "time_slots.summary": sales.time_slots_peak_quiet(t, f),
        "trend": sales.sales_trend(t, f),
        "trend.summary": sales.sales_trend_summary(t, f),
        "trend.projection": sales.sales_trend_forecast(t, f),
        "trend.year": sales.yearly_breakdown(t, f),
        "weekend_vs_weekday": sales.weekend_weekday(t, f),
        "weekend_vs_weekday.summary": sales.weekend_weekday_summary(t, f),
        "payment": sales.payment_mix(t, f),
        "payment.summary": sales.payment_mix_summary(t, f),
        "operational_risk": sales.risk_summary(t, f),
        "operational_risk.schedules": sales.risk_schedules(t, f),
    }


def part_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """``part, n_rows`` of every part, in one job."""
    counted = [rows.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_rows")) for name, rows in parts.items()]
    return reduce(DataFrame.unionByName, counted)
