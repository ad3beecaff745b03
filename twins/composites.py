"""SQL of the composites: the rows of each part's own query, cut where the part is."""

from twins import kpi, others, sales, titles
from twins.base import pct, sql
from twins.kpi import VENUE_STATUS, cinema_ctes


def counts(parts: dict[str, str], cut: dict[str, int] | None = None) -> str:
    rows = []
    for part, query in parts.items():
        n = f"least(COUNT(*), {cut[part]})" if cut and part in cut else "COUNT(*)"
        rows.append(f"SELECT '{part}' AS part, CAST({n} AS BIGINT) AS n_rows FROM (SELECT * FROM ({query}))")
    return " UNION ALL ".join(rows)


STATUS = sql(
    cinema_ctes(False)
    + f""", v AS ({VENUE_STATUS})
    SELECT 'active' AS status, (SELECT strftime(MAX(trans_time), '%Y-%m-%d %H:%M:%S') FROM tiket) AS last_update,
    {pct("COUNT(CASE WHEN status = 'active' THEN 1 END)", 'COUNT(*)')} AS health_rate, COUNT(*) AS total_nodes,
    COUNT(CASE WHEN status = 'active' THEN 1 END) AS active_nodes, COUNT(CASE WHEN status = 'inactive' THEN 1 END) AS inactive_nodes,
    CAST(0 AS BIGINT) AS down_nodes FROM v"""
)

K, S, T = kpi.QUERIES, sales.QUERIES, titles.QUERIES

QUERIES = {
    "system_status": STATUS,
    "executive_counts": counts(
        {
            "system_status": STATUS,
            "franchise_performance": K["cinema_stats"],
            "city_revenue_summary": K["city_revenue"],
            "top_film_contribution": S["exec_film_contribution"],
            "alert_summary": others.QUERIES["alert_summary"],
        }
    ),
    "films_bundle_counts": counts(
        {
            "overview": T["films_overview"],
            "performance": sql("SELECT DISTINCT movie_id FROM sold_txn JOIN movies USING (movie_id)"),
            "schedules": T["schedule_performance"],
            "schedules.repeat": T["repeat_schedule"],
            "schedules.density": T["audience_density"],
            "occupancy": T["occupancy_by_movie"],
            "occupancy.overall": K["occupancy_summary"],
            "occupancy.day": T["occupancy_by_day"],
            "occupancy.studio": T["occupancy_by_studio"],
            "distribution": T["genre_popularity"],
            "distribution.format": T["studio_format"],
            "operational_risk": S["risk_by_movie"],
            "operational_risk.summary": S["risk_summary"],
            "operational_risk.schedules": S["risk_schedules"],
        },
        {"performance": 20},
    ),
    "sales_bundle_counts": counts(
        {
            "overview": S["sales_overview"],
            "revenue_by_cinema": sql("SELECT cinema_id FROM cinema"),
            "revenue_by_cinema.summary": S["revenue_by_cinema_summary"],
            "revenue_by_movie": sql("SELECT DISTINCT movie_id FROM sold_txn JOIN movies USING (movie_id)"),
            "revenue_by_movie.summary": S["revenue_by_movie_summary"],
            "time_slots": S["time_slots"],
            "time_slots.summary": S["time_slots_peak_quiet"],
            "trend": S["sales_trend_daily"],
            "trend.summary": S["sales_trend_summary"],
            "trend.projection": S["sales_trend_forecast"],
            "trend.year": S["yearly_breakdown"],
            "weekend_vs_weekday": S["weekend_weekday"],
            "weekend_vs_weekday.summary": S["weekend_weekday_summary"],
            "payment": S["payment_mix"],
            "payment.summary": S["payment_mix_summary"],
            "operational_risk": S["risk_summary"],
            "operational_risk.schedules": S["risk_schedules"],
        },
        {"revenue_by_cinema": 10, "revenue_by_movie": 7},
    ),
}
