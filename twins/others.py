"""SQL of the lists, the alerts, the reports given by formula and the streams."""

from twins import values as C
from twins.actions import S, SUMS, scoped
from twins.base import GENRE_TEXT, WINDOW, big, day, dbl, minmax, money, pct, r2, rratio, sql
from twins.kpi import LAST_HOUR, cinema_ctes
from twins.sales import FEE

ALERT = {name: (title, advice) for name, title, advice in C.ALERTS}


def alert(name: str, message: str, severity: str, size: str) -> str:
    title, advice = ALERT[name]
    return f"""SELECT {S}, label AS "where", '{name}' AS type, '{title}' AS title, {message} AS what_happened,
      {severity} AS severity, {dbl(size)} AS impact_size, '{advice}' AS recommended_action FROM facts_of"""


ALERTS = SUMS + scoped("facts", "af") + LAST_HOUR + scoped("recent", "ar") + f"""
, act AS (SELECT {S}, COUNT(DISTINCT cinema_id) AS n, COUNT(DISTINCT CASE WHEN tickets > 0 THEN cinema_id END) AS a FROM af GROUP BY 1, 2)
, hour AS (SELECT {S}, COUNT(*) AS k FROM ar GROUP BY 1, 2)
, facts_of AS (SELECT metrics.*, COALESCE(n, 0) AS n, COALESCE(a, 0) AS a, COALESCE(k, 0) AS k FROM metrics
   LEFT JOIN act USING (scope_type, scope_value) LEFT JOIN hour USING (scope_type, scope_value))
, alert_rows AS (
  {alert('system-health', f"'{C.HEALTH_UP}'", "'success'", 'k')}
  UNION ALL {alert('revenue-growth', f"CASE WHEN growth_revenue < 0 THEN '{C.REVENUE_DOWN}' ELSE '{C.REVENUE_OK}' END",
                   "CASE WHEN growth_revenue < -10 THEN 'warning' ELSE 'info' END", 'growth_revenue')}
  UNION ALL {alert('occupancy-level', f"CASE WHEN avg_occupancy < 25 THEN '{C.OCCUPANCY_LOW}' ELSE '{C.OCCUPANCY_OK}' END",
                   "CASE WHEN avg_occupancy < 20 THEN 'warning' ELSE 'info' END", 'avg_occupancy')}
  UNION ALL {alert('cinema-activity', "CAST(a AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' cinemas are active.'",
                   "CASE WHEN a = n THEN 'success' ELSE 'warning' END", 'a')})
, alerts AS (SELECT *, CASE WHEN scope_type = 'global' THEN type ELSE scope_type || '/' || scope_value || '/' || type END
   AS alert_id FROM alert_rows)
, read_alerts AS (SELECT *, CASE WHEN (scope_type = 'city' AND type = 'occupancy-level')
   OR (scope_type = 'cinema' AND type = 'system-health') THEN 'read' ELSE 'unread' END AS status FROM alerts)
"""

TICKETS = f"""tiket_id, schedule_id, movie_id, studio_id, cinema_id, seat_category, {dbl('final_price')} AS final_price,
  strftime(trans_time, '%Y-%m-%d %H:%M:%S') AS trans_time, payment_type, 'success' AS status"""
TICKET_LIST = f"SELECT * EXCLUDE (tiket_id, studio_id), tiket_id AS ticket_id FROM (SELECT {TICKETS} FROM {{}})"
MOVIE_LIST = f"SELECT movie_id, title, {GENRE_TEXT} AS genre, rating_usia, duration_min FROM movies"
SHOW_LIST = f"""SELECT schedule_id, movie_id, studio_id, cinema_id, {day('show_date')} AS show_date, start_time,
  {dbl('price')} AS price, status FROM shows"""


def counted(rows: str, limit: int) -> str:
    return f"SELECT COUNT(*) AS total, CAST(CEIL(COUNT(*) / {limit}.0) AS BIGINT) AS total_pages FROM {rows}"


def stream(slide: int = 60, closed: bool = False) -> str:
    n = 60 // slide
    keep = "WHERE window_end <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR" if closed else ""
    return f"""WITH e AS (SELECT ts, event_type, value, time_bucket(INTERVAL {slide} MINUTE, ts) - to_minutes(CAST({slide} * i AS INTEGER)) AS ws
      FROM events, range({n}) AS r(i)),
    g AS (SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, event_type, COUNT(*) AS events,
      SUM(CAST(value AS DECIMAL(18,4))) AS total_value FROM e GROUP BY 1, 2, 3)
    SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end,
      event_type, events, {dbl('total_value')} AS total_value FROM g {keep}"""


QUERIES = {
    "movies_list": sql(MOVIE_LIST),
    "movies_list_page": sql(MOVIE_LIST + " WHERE title ILIKE '%BLUE%' AND genre ILIKE '%bolt%' ORDER BY movie_id LIMIT 20 OFFSET 20"),
    "movies_count": sql(
        """SELECT COUNT(*) AS total, CAST(CEIL(COUNT(*) / 20.0) AS BIGINT) AS total_pages FROM movies
        WHERE title ILIKE '%BLUE%' AND genre ILIKE '%bolt%'"""
    ),
    "movies_count_rating": sql(counted("movies WHERE rating_usia = '13+'", 500)),
    "studios_count": sql(counted("studio WHERE screen_type = 'BUILDING'", 50)),
    "schedules_count": sql(counted(f"shows WHERE show_date {WINDOW} AND status = 'Delayed'", 500)),
    "tickets_count": sql(counted("sold_txn WHERE payment_type = 'QRIS'", 7)),
    "studios_list": sql("SELECT studio_id, cinema_id, studio_name, total_capacity, screen_type FROM studio"),
    "studios_list_format": sql(
        "SELECT studio_id, cinema_id, studio_name, total_capacity, screen_type FROM studio WHERE screen_type = 'BUILDING'"
    ),
    "schedules_list": sql(SHOW_LIST + f" WHERE show_date {WINDOW}"),
    "schedules_list_page": sql(
        SHOW_LIST
        + f" WHERE show_date {WINDOW} AND status = 'Delayed' ORDER BY shows.show_date DESC, start_time DESC, schedule_id LIMIT 20"
    ),
    "tickets_list": sql(TICKET_LIST.format("sold_txn")),
    "tickets_list_page": sql(
        TICKET_LIST.format("(SELECT * FROM sold_txn WHERE payment_type = 'QRIS' ORDER BY sold_txn.trans_time DESC, tiket_id LIMIT 20 OFFSET 20)")
    ),
    "ticket_detail": sql(f"SELECT {TICKETS} FROM sold"),
    "cities": sql("SELECT city, COUNT(*) AS total_cinemas FROM cinema GROUP BY 1"),
    "payment_config": sql(f"SELECT payment_type, {FEE} AS admin_fee FROM (SELECT DISTINCT COALESCE(payment_type, 'unknown') AS payment_type FROM tiket)"),
    "studio_inventory": sql(
        "SELECT studio_id, studio_name, total_capacity, cinema_id, cinema_name, city FROM studio JOIN cinema USING (cinema_id)"
    ),
    "filter_violations": sql(
        """, req AS (SELECT studio_id AS request_id, CASE WHEN studio_id % 4 <> 0 THEN c.city END AS city,
          CASE WHEN studio_id % 10 = 0 THEN studio_id + 1000 WHEN studio_id % 10 <> 1 THEN s.cinema_id END AS cinema_id,
          CASE WHEN studio_id % 7 = 0 THEN -studio_id - 1 WHEN studio_id % 7 = 1 THEN CAST(FLOOR(studio_id / 2) AS BIGINT)
               WHEN studio_id % 7 <> 2 THEN studio_id END AS studio_id
          FROM studio s LEFT JOIN cinema c ON c.cinema_id = s.studio_id % 25)
        , v AS (SELECT request_id, req.city, req.cinema_id, req.studio_id,
          CASE WHEN req.cinema_id IS NOT NULL AND c.cinema_id IS NULL THEN 'CINEMA_NOT_FOUND'
               WHEN req.cinema_id IS NOT NULL AND req.city <> '' AND c.city <> req.city THEN 'CINEMA_NOT_IN_CITY'
               WHEN req.studio_id IS NOT NULL AND st.studio_id IS NULL THEN 'STUDIO_NOT_FOUND'
               WHEN req.studio_id IS NOT NULL AND req.cinema_id IS NOT NULL AND st.cinema_id <> req.cinema_id
                 THEN 'STUDIO_NOT_IN_CINEMA' END AS reason
          FROM req LEFT JOIN cinema c ON req.cinema_id = c.cinema_id LEFT JOIN studio st ON req.studio_id = st.studio_id)
        SELECT * FROM v WHERE reason IS NOT NULL"""
    ),
    "alerts": sql(ALERTS + "SELECT * FROM alerts"),
    "alerts_filtered": sql(ALERTS + "SELECT * FROM read_alerts WHERE status = 'unread' AND severity = 'info'"),
    "alerts_count": sql(ALERTS + counted("read_alerts WHERE status = 'unread' AND severity = 'info'", 20)),
    "alert_summary": sql(
        ALERTS
        + "SELECT scope_type, "
        + ", ".join(f"COUNT(CASE WHEN severity = '{s}' THEN 1 END) AS {s}" for s in ("critical", "warning", "info"))
        + ", COUNT(CASE WHEN status = 'unread' THEN 1 END) AS unread FROM read_alerts GROUP BY 1"
    ),
    "movie_contribution_by_cinema": sql(
        f"""SELECT cinema_id, cinema_name, movie_id, title, {money('SUM(final_price)')} AS total_revenue,
        {pct('SUM(final_price)', 'SUM(SUM(final_price)) OVER (PARTITION BY cinema_id)')} AS contribution
        FROM sold_w JOIN movies USING (movie_id) GROUP BY 1, 2, 3, 4"""
    ),
    "cinema_health_score": sql(
        cinema_ctes(True)
        + f"""SELECT cinema_id, cinema_name, city, {money('total_revenue')} AS total_revenue, occupancy,
        {r2(f"({minmax('total_revenue', 'MIN(total_revenue) OVER ()', 'MAX(total_revenue) OVER ()')}) * CAST(0.6 AS DOUBLE) + ({minmax('occupancy', 'MIN(occupancy) OVER ()', 'MAX(occupancy) OVER ()')}) * CAST(0.4 AS DOUBLE)")}
          AS health_score FROM venue"""
    ),
    "seat_demand_heatmap": sql(
        f"""SELECT {day('show_date')} AS show_date, time_slot, studio_id, studio_name, COUNT(*) AS total_shows,
        {big('SUM(tickets)')} AS total_tickets FROM w GROUP BY 1, 2, 3, 4"""
    ),
    "repeat_schedule_trend": sql(
        f""", k AS (SELECT movie_id, title, date_trunc('week', show_date) AS ps, COUNT(*) AS n, SUM(tickets) AS t,
          {rratio('SUM(tickets)', 'COUNT(*)')} AS a FROM facts JOIN movies USING (movie_id) GROUP BY 1, 2, 3)
        , l AS (SELECT *, LAG(a) OVER (PARTITION BY movie_id ORDER BY ps) AS b FROM k)
        SELECT movie_id, title, {day('ps')} AS period_start, n AS total_schedules, {big('t')} AS total_tickets,
        a AS avg_tickets, b AS previous_avg, {r2('a - b')} AS change FROM l"""
    ),
    "genre_share": sql(
        f"""SELECT g AS genre, COUNT(tiket_id) AS total_tickets,
        {pct('COUNT(tiket_id)', '(SELECT COUNT(*) FROM sold_w)')} AS share
        FROM shows JOIN genre_of USING (movie_id) LEFT JOIN tiket USING (schedule_id) WHERE show_date {WINDOW} GROUP BY 1"""
    ),
    "stream_hourly_activity": stream(),
    "stream_hourly_activity_sliding": stream(10),
    "stream_hourly_activity_append": stream(closed=True),
    "stream_hourly_activity_update": stream(),
    "stream_hourly_activity_sliding_update": stream(10),
}
