"""All operators by name, with the parameters used for checks and for the benchmark."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators import actions, alerts, composites, extra, insights, kpi, lists, rules, sales, scopes, titles
from marquee.plans.filters import Filters
from marquee.session import new_folder, tune
from marquee.sources import examples, snapshots
from marquee.sources.retail import read_retail
from marquee.sources.tables import Tables
from marquee.streaming import activity

WINDOW = Filters(start="2024-01-29", end="2024-02-11", as_of="2024-02-25")
ASIA = WINDOW.scoped(city="ASIA")

Operator = Callable[[Tables], DataFrame]

KPI: dict[str, Operator] = {
    "session_facts": lambda t: kpi.show_facts(t, WINDOW),
    "sales_summary": lambda t: kpi.sales_summary(t, WINDOW),
    "sales_summary_asia": lambda t: kpi.sales_summary(t, ASIA),
    "sales_summary_venue": lambda t: kpi.sales_summary(t, WINDOW.scoped(cinema_id=8)),
    "sales_summary_room": lambda t: kpi.sales_summary(t, WINDOW.scoped(city="ASIA", studio_id=13)),
    "sales_summary_title": lambda t: kpi.sales_summary(t, WINDOW.scoped(movie_id=17)),
    "period_growth": lambda t: kpi.period_growth(t, WINDOW),
    "trend_hourly": lambda t: kpi.trend(t, WINDOW, "hourly"),
    "trend_daily": lambda t: kpi.trend(t, WINDOW, "daily"),
    "trend_summary": lambda t: kpi.trend_summary(t, WINDOW),
    "occupancy_hourly": lambda t: kpi.occupancy(t, WINDOW, "hourly"),
    "occupancy_daily": lambda t: kpi.occupancy(t, WINDOW, "daily"),
    "occupancy_summary": lambda t: kpi.occupancy_summary(t, WINDOW),
    "movie_stats_summary": lambda t: kpi.movie_stats_summary(t, WINDOW),
    "rating_breakdown": lambda t: kpi.rating_breakdown(t, WINDOW),
    "rating_breakdown_rating": lambda t: kpi.rating_breakdown(t, WINDOW.scoped(rating_usia="17+")),
    "movie_rankings": lambda t: kpi.movie_rankings(t, WINDOW),
    "movie_rankings_rating": lambda t: kpi.movie_rankings(t, WINDOW.scoped(rating_usia="13+", city="ASIA")),
    "movie_rankings_top10": lambda t: kpi.movie_rankings(t, WINDOW, top=10),
    "movie_sales_txn": lambda t: kpi.movie_sales_txn(t, WINDOW),
    "movie_detail": lambda t: kpi.movie_detail(t),
    "movie_showing_at": lambda t: kpi.movie_showing_at(t),
    "movie_detail_seats": lambda t: kpi.movie_detail_seats(t),
    "movie_performance": lambda t: kpi.movie_performance(t, WINDOW),
    "movie_daily_trend": lambda t: kpi.movie_daily_trend(t, WINDOW),
    "movie_seat_distribution": lambda t: kpi.movie_seat_distribution(t, WINDOW),
    "studio_detail": lambda t: kpi.studio_detail(t),
    "schedule_detail": lambda t: kpi.schedule_detail(t),
    "cinema_detail": lambda t: kpi.cinema_detail(t),
    "cinema_stats": lambda t: kpi.cinema_stats(t, WINDOW),
    "cinema_stats_summary": lambda t: kpi.cinema_stats_summary(t, WINDOW),
    "cinemas_list": lambda t: kpi.cinemas_list(t),
    "cinema_performance": lambda t: kpi.cinema_performance(t, WINDOW),
    "city_revenue": lambda t: kpi.city_revenue(t, WINDOW),
    "last_hour_total": kpi.last_hour_total,
    "last_hour_by_city": kpi.last_hour_by_city,
    "last_hour_by_studio": kpi.last_hour_by_studio,
    "last_hour_by_movie": kpi.last_hour_by_movie,
    "venue_status": kpi.venue_status,
    "venue_status_summary": kpi.venue_status_summary,
}

SALES: dict[str, Operator] = {
    "exec_film_contribution": lambda t: sales.exec_film_contribution(t, WINDOW),
    "sales_overview": lambda t: sales.sales_overview(t, WINDOW),
    "revenue_by_cinema": lambda t: sales.revenue_by_cinema(t, WINDOW),
    "revenue_by_cinema_summary": lambda t: sales.revenue_by_cinema_summary(t, WINDOW),
    "revenue_by_studio": lambda t: sales.revenue_by_studio(t, WINDOW),
    "revenue_by_studio_summary": lambda t: sales.revenue_by_studio_summary(t, WINDOW),
    "revenue_by_movie": lambda t: sales.revenue_by_movie(t, WINDOW),
    "revenue_by_movie_summary": lambda t: sales.revenue_by_movie_summary(t, WINDOW),
    "time_slots": lambda t: sales.time_slots(t, WINDOW),
    "time_slots_asia": lambda t: sales.time_slots(t, ASIA),
    "time_slots_peak_quiet": lambda t: sales.time_slots_peak_quiet(t, WINDOW),
    "sales_trend_daily": lambda t: sales.sales_trend(t, WINDOW, "daily"),
    "sales_trend_monthly": lambda t: sales.sales_trend(t, WINDOW, "monthly"),
    "sales_trend_summary": lambda t: sales.sales_trend_summary(t, WINDOW),
    "sales_trend_forecast": lambda t: sales.sales_trend_forecast(t, WINDOW, "daily"),
    "sales_trend_forecast_monthly": lambda t: sales.sales_trend_forecast(t, WINDOW, "monthly"),
    "yearly_breakdown": lambda t: sales.yearly_breakdown(t, WINDOW),
    "weekend_weekday": lambda t: sales.weekend_weekday(t, WINDOW),
    "weekend_weekday_summary": lambda t: sales.weekend_weekday_summary(t, WINDOW),
    "payment_mix": lambda t: sales.payment_mix(t, WINDOW),
    "payment_mix_venue": lambda t: sales.payment_mix(t, WINDOW.scoped(cinema_id=8, payment_type="QRIS")),
    "payment_mix_summary": lambda t: sales.payment_mix_summary(t, WINDOW),
    "risk_summary": lambda t: sales.risk_summary(t, WINDOW),
    "risk_schedules": lambda t: sales.risk_schedules(t, WINDOW),
    "risk_by_movie": lambda t: sales.risk_by_movie(t, WINDOW),
}

TITLES: dict[str, Operator] = {
    "films_overview": lambda t: titles.films_overview(t, WINDOW),
    "films_performance": lambda t: titles.films_performance(t, WINDOW),
    "schedule_performance": lambda t: titles.schedule_performance(t, WINDOW),
    "repeat_schedule": lambda t: titles.repeat_schedule(t, WINDOW),
    "audience_density": lambda t: titles.audience_density(t, WINDOW),
    "occupancy_by_movie": lambda t: titles.occupancy_by_movie(t, WINDOW),
    "occupancy_by_day": lambda t: titles.occupancy_by_day(t, WINDOW),
    "occupancy_by_studio": lambda t: titles.occupancy_by_studio(t, WINDOW),
    "genre_popularity": lambda t: titles.genre_popularity(t, WINDOW),
    "studio_format": lambda t: titles.studio_format(t, WINDOW),
}

RULES: dict[str, Operator] = {
    "pricing_recommendation": lambda t: rules.pricing_recommendation(t, WINDOW),
    "pricing_recommendation_summary": lambda t: rules.pricing_recommendation_summary(t, WINDOW),
    "best_ad_slot": lambda t: rules.best_ad_slot(t, WINDOW),
    "best_ad_slot_summary": lambda t: rules.best_ad_slot_summary(t, WINDOW),
    "early_blockbuster": lambda t: rules.early_blockbuster(t, WINDOW),
    "early_blockbuster_loose": lambda t: rules.early_blockbuster(t, WINDOW, min_tickets=50, min_growth=0),
    "early_blockbuster_summary": lambda t: rules.early_blockbuster_summary(t, WINDOW),
    "cannibalization": lambda t: rules.cannibalization(t, WINDOW),
    "cannibalization_summary": lambda t: rules.cannibalization_summary(t, WINDOW),
    "forecast": lambda t: rules.forecast(t, WINDOW),
    "forecast_next_week": lambda t: rules.forecast(t, WINDOW.without_dates()),
    "forecast_summary": lambda t: rules.forecast_summary(t, WINDOW),
}

ACTIONS: dict[str, Operator] = {
    "scope_list": scopes.scope_list,
    "scope_expand": lambda t: scopes.scope_expand(t, WINDOW),
    "scope_metrics": lambda t: scopes.scope_metrics(t, WINDOW),
    "scope_time_slots": lambda t: scopes.scope_time_slots(t, WINDOW),
    "scope_peak_quiet": lambda t: scopes.scope_peak_quiet(t, WINDOW),
    "scope_pricing": lambda t: scopes.scope_pricing(t, WINDOW),
    "scope_pricing_summary": lambda t: scopes.scope_pricing_summary(t, WINDOW),
    "scope_ad_slots": lambda t: scopes.scope_ad_slots(t, WINDOW),
    "move_to_larger_studio": lambda t: actions.public(actions.move_to_larger_studio(t, WINDOW)),
    "reduce_showtimes": lambda t: actions.public(actions.reduce_showtimes(t, WINDOW)),
    "promotion_opportunity": lambda t: actions.public(actions.promotion_opportunity(t, WINDOW)),
    "premium_pricing": lambda t: actions.public(actions.premium_pricing(t, WINDOW)),
    "candidate_actions": lambda t: actions.candidate_actions(t, WINDOW),
    "scope_insight": lambda t: actions.scope_insight(
        scopes.scope_metrics(t, WINDOW), actions.candidate_actions(t, WINDOW)
    ).drop("recommended_actions"),
}

RUNS = (
    ("2024-02-11", datetime(2024, 2, 12, 3)),
    ("2024-02-25", datetime(2024, 2, 26, 3)),
    ("2024-02-11", datetime(2024, 2, 26, 4)),
)


_STORES: dict[tuple[str, str], snapshots.SnapshotStore] = {}


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with two runs and a third that repeats the period of the first; filled once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        t, store = read_retail(spark, sf_dir), snapshots.SnapshotStore(spark, new_folder(spark, "insights"))
        for records in insights.insight_runs(t, RUNS):
            store.upsert(records)
        _STORES[key] = store
    return _STORES[key].read()


LISTS: dict[str, Operator] = {
    "movies_list": lists.movies_list,
    "movies_list_page": lambda t: lists.movies_list(t, search="BLUE", genre="bolt", page_number=2),
    "movies_count": lambda t: lists.movies_count(t, search="BLUE", genre="bolt"),
    "movies_count_rating": lambda t: lists.movies_count(t, rating_usia="13+", limit=500),
    "studios_count": lambda t: lists.studios_count(t, screen_type="BUILDING", limit=50),
    "schedules_count": lambda t: lists.schedules_count(t, WINDOW, status="Delayed", limit=500),
    "tickets_count": lambda t: lists.tickets_count(t, WINDOW.scoped(payment_type="QRIS"), limit=7),
    "studios_list": lists.studios_list,
    "studios_list_format": lambda t: lists.studios_list(t, screen_type="BUILDING"),
    "schedules_list": lambda t: lists.schedules_list(t, WINDOW),
    "schedules_list_page": lambda t: lists.schedules_list(t, WINDOW, status="Delayed", page_number=1),
    "tickets_list": lambda t: lists.tickets_list(t, WINDOW),
    "tickets_list_page": lambda t: lists.tickets_list(t, WINDOW.scoped(payment_type="QRIS"), page_number=2),
    "ticket_detail": lists.ticket_detail,
    "cities": lists.cities,
    "payment_config": lists.payment_config,
    "studio_inventory": lists.studio_inventory,
    "filter_violations": lambda t: lists.filter_violations(t, examples.filter_requests(t)),
}

ALERTS: dict[str, Operator] = {
    "alerts": lambda t: alerts.alerts(t, WINDOW),
    "alerts_filtered": lambda t: alerts.alerts_filtered(
        alerts.alerts(t, WINDOW), examples.read_log(t), status="unread", severity="info"
    ).drop("read_at"),
    "alerts_count": lambda t: alerts.alerts_count(
        alerts.alerts(t, WINDOW), examples.read_log(t), status="unread", severity="info"
    ),
    "alert_summary": lambda t: alerts.alert_summary(alerts.alerts(t, WINDOW), examples.read_log(t)),
}

EXTRA: dict[str, Operator] = {
    "movie_contribution_by_cinema": lambda t: extra.movie_contribution_by_cinema(t, WINDOW),
    "cinema_health_score": lambda t: extra.cinema_health_score(t, WINDOW),
    "seat_demand_heatmap": lambda t: extra.seat_demand_heatmap(t, WINDOW),
    "repeat_schedule_trend": lambda t: extra.repeat_schedule_trend(t, Filters()),
    "genre_share": lambda t: extra.genre_share(t, WINDOW),
}

COMPOSITES: dict[str, Operator] = {
    "system_status": composites.system_status,
    "executive_counts": lambda t: composites.part_counts(composites.executive(t, WINDOW, examples.read_log(t))),
    "films_bundle_counts": lambda t: composites.part_counts(composites.films_bundle(t, WINDOW)),
    "sales_bundle_counts": lambda t: composites.part_counts(composites.sales_bundle(t, WINDOW)),
}

OPERATORS: dict[str, Operator] = {**KPI, **SALES, **TITLES, **RULES, **ACTIONS, **LISTS, **ALERTS, **EXTRA, **COMPOSITES}

# Operators that read a table besides the base tables.
WithFolder = Callable[[SparkSession, str], DataFrame]


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = insights.insight_payload_normalized(examples.responses(spark, sf_dir))
    return rows.withColumn("recommended_count", F.size("recommended_actions").cast("long")).drop("recommended_actions")


def _streamed(slide: str | None = None, sink: Callable[..., DataFrame] = activity.run_complete) -> WithFolder:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = activity.hourly_activity(activity.event_stream(spark, f"{sf_dir}/events*.parquet"), slide)
        return sink(spark, rows, "activity")

    return run


def _streamed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs arrive as files, each file with rows of one run, and are merged run by run."""
    landing, state = new_folder(spark, "landing"), new_folder(spark, "upsert-state")
    t = read_retail(spark, sf_dir)
    store = snapshots.SnapshotStore(spark, new_folder(spark, "insights"))
    for records in insights.insight_runs(t, RUNS):
        records.write.mode("append").parquet(landing)
        activity.upsert_stream(spark, landing, store, state=state)
    return insights.decoded(store.read())


OTHERS: dict[str, WithFolder] = {
    "stream_hourly_activity": _streamed(),
    "stream_hourly_activity_sliding": _streamed(slide="10 minutes"),
    "stream_hourly_activity_append": _streamed(sink=activity.run_append),
    "stream_hourly_activity_update": _streamed(sink=activity.run_update),
    "stream_hourly_activity_sliding_update": _streamed(slide="10 minutes", sink=activity.run_update),
    "stream_upsert": _streamed_upsert,
    "insight_upsert": lambda spark, d: insights.decoded(_stored(spark, d)),
    "insight_history": lambda spark, d: insights.decoded(
        insights.insight_history(_stored(spark, d), scope_type="city", start="2024-01-29", end="2024-02-25")
    ),
    "insight_history_count": lambda spark, d: insights.insight_history_count(
        _stored(spark, d), scope_type="city", start="2024-01-29", end="2024-02-25", limit=3
    ),
    "insight_latest_page": lambda spark, d: insights.decoded(
        insights.insight_latest_page(_stored(spark, d), page_number=2, limit=40)
    ),
    "insight_latest": lambda spark, d: insights.decoded(insights.insight_latest(_stored(spark, d))),
    "insight_latest_counts": lambda spark, d: insights.insight_latest_counts(_stored(spark, d)),
    "insight_payload_normalized": _responses,
}


def plain(frame: DataFrame) -> DataFrame:
    """Dates, timestamps, decimals and lists as types that every engine writes alike."""
    columns = []
    for field in frame.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DecimalType):
            c = c.cast("double")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, "|")
        elif isinstance(kind, T.IntegerType | T.ShortType):
            c = c.cast("long")
        columns.append(c.alias(field.name))
    return frame.select(*columns)


def _bind(operator: Operator) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(operator(read_retail(tune(spark), sf_dir)))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    bound = {name: _bind(operator) for name, operator in OPERATORS.items()}
    for name, operator in OTHERS.items():
        bound[name] = lambda spark, sf_dir, operator=operator: plain(operator(tune(spark), sf_dir))
    return bound
