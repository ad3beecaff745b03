"""The order of every report that is a list, for pages, files and screens.

Reports come without an order, since most of their uses don't need one; ``ordered`` sorts a report or
takes its first rows. Texts and times are ascending with nulls last; figures and newest-first dates are descending
with nulls first. Each order ends in columns that are unique in the report, so that it is total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.expr import start_seconds


def up(*names: str) -> list[Column]:
    return [F.asc_nulls_last(n) for n in names]


def down(*columns: Column | str) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).desc_nulls_first() for c in columns]


def amount(name: str) -> Column:
    """A sum that is null where nothing was added up counts as 0."""
    return F.coalesce(F.col(name), F.lit(0))


def movie_sales() -> list[Column]:
    return [*down("total_tickets", amount("total_revenue")), *up("title", "movie_id")]


def ad_slots() -> list[Column]:
    return [*down("ad_score", "audience_size", "total_revenue"), *up("title", "time_slot", "movie_id")]


def prices() -> list[Column]:
    return [*down(F.abs("suggested_price_change_pct")), *up("time_slot")]


def _latest() -> list[Column]:
    """Times are compared as such, so 9:00 comes before 10:00."""
    known = F.when(F.col("start_time").isNotNull(), start_seconds())
    return [*down("show_date", known), *up("schedule_id")]


ORDERS: dict[str, Callable[[], list[Column]]] = {
    "movie_rankings": lambda: [*down("tickets_sold"), *up("title", "movie_id")],
    "movie_sales_txn": movie_sales,
    "rating_breakdown": lambda: [*down("total_tickets_sold"), *up("rating_usia")],
    "city_revenue": lambda: [*down(amount("total_revenue"), "total_tickets"), *up("city")],
    "time_slots": lambda: up("time_slot"),
    "pricing_recommendation": prices,
    "best_ad_slot": ad_slots,
    "trend_daily": lambda: up("time_group"),
    "trend_hourly": lambda: up("time_group"),
    "sales_trend_daily": lambda: up("time_group"),
    "sales_trend_monthly": lambda: up("time_group"),
    "occupancy_daily": lambda: up("time_group"),
    "occupancy_hourly": lambda: up("time_group"),
    "movie_daily_trend": lambda: up("movie_id", "time_group"),
    "yearly_breakdown": lambda: up("month_num"),
    "weekend_weekday": lambda: up("day_type"),
    "payment_mix": lambda: [*down("total_transactions"), *up("payment_type")],
    "risk_schedules": _latest,
    "risk_by_movie": lambda: [*down(amount("impacted_revenue")), *up("title", "movie_id")],
    "schedule_performance": _latest,
    "repeat_schedule": lambda: [*down("show_date"), *up("title", "movie_id")],
    "audience_density": lambda: [*down("total_tickets"), *up("title", "movie_id")],
    "occupancy_by_movie": lambda: [*down("total_tickets"), *up("title", "movie_id")],
    "occupancy_by_day": lambda: up("show_date"),
    "occupancy_by_studio": lambda: [*down("total_tickets"), *up("studio_name", "studio_id")],
    "genre_popularity": lambda: [*down("total_tickets"), *up("genre")],
    "studio_format": lambda: [*down("total_studios"), *up("format")],
    "early_blockbuster": lambda: [*down("growth_rate", "current_tickets"), *up("title", "movie_id")],
    "cannibalization": lambda: [
        *down("occupancy_gap"),
        *up("cinema_id", "show_date", "time_slot", "impacted_title", "impacted_movie_id"),
    ],
    "cities": lambda: up("city"),
    "forecast": lambda: up("forecast_date"),
}


def ordered(name: str, rows: DataFrame, first: int | None = None) -> DataFrame:
    """The rows of report ``name`` in its order; the ``first`` of them where a number is given.

    Each task then keeps that many rows, and no more than these meet in one task.
    """
    if name not in ORDERS:
        raise ValueError(f"no order for report: {name}")
    if first is not None and first < 1:
        raise ValueError("first starts at 1")
    out = rows.orderBy(*ORDERS[name]())
    return out if first is None else out.limit(first)
