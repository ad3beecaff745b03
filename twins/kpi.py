"""SQL of the base figures."""

from twins.base import GENRE_TEXT, SALE_WINDOW, WINDOW, big, day, dbl, growth, money, pct, r2, ratio, rratio, sql

SEATS = ", ".join(
    f"COUNT(CASE WHEN lower(seat_category) = '{s}' THEN 1 END) AS {s}_seats" for s in ("regular", "vip", "sweetbox")
)

TOTALS = f"""
, cur AS (SELECT COUNT(*) AS shows, COALESCE(SUM(tickets), 0) AS tickets, COALESCE(SUM(total_capacity), 0) AS capacity,
  COALESCE(SUM(revenue), 0) AS revenue, {r2('COALESCE(AVG(seat_share), 0) * 100')} AS occupancy,
  COUNT(DISTINCT cinema_id) AS venues FROM w)
, prev AS (SELECT COALESCE(SUM(tickets), 0) AS tickets, COALESCE(SUM(revenue), 0) AS revenue,
  {r2('COALESCE(AVG(seat_share), 0) * 100')} AS occupancy FROM p)
"""
GROWTHS = (
    f"{growth('cur.tickets', 'prev.tickets')} AS growth_tickets, "
    f"{growth('cur.revenue', 'prev.revenue')} AS growth_revenue"
)
SUMMARY = f"""SELECT {big('cur.tickets')} AS total_tickets, {big('capacity')} AS total_capacity,
  {dbl('cur.revenue')} AS revenue, cur.occupancy AS avg_occupancy, shows AS total_transactions, venues AS cinema_aktif,
  (SELECT COUNT(*) FROM cinema) AS cinema_tersedia, {GROWTHS},
  {growth('cur.occupancy', 'prev.occupancy')} AS growth_occupancy FROM cur, prev"""


def scoped_summary(scope: str) -> str:
    query = sql(TOTALS + SUMMARY)
    for name in "wp":
        query = query.replace(f"{name} AS (SELECT * FROM facts WHERE", f"{name} AS (SELECT * FROM facts WHERE {scope} AND")
    return query


def occupancy_group(expr: str) -> str:
    return f"""SELECT {expr} AS time_group, {big('SUM(tickets)')} AS total_tickets,
      {big('SUM(total_capacity)')} AS total_capacity, {r2('AVG(seat_share) * 100')} AS occupancy FROM w GROUP BY 1"""


MOVIE_ROWS = """
, per_movie AS (SELECT movie_id, title, COUNT(tiket_id) AS n FROM shows JOIN movies USING (movie_id)
   LEFT JOIN tiket USING (schedule_id) WHERE show_date {w} GROUP BY 1, 2)
, per_genre AS (SELECT g, COUNT(tiket_id) AS n FROM shows JOIN genre_of USING (movie_id)
   JOIN tiket USING (schedule_id) WHERE show_date {w} GROUP BY 1)
""".format(w=WINDOW)

def rankings(more: str = "") -> str:
    return f"""SELECT movie_id, title, {GENRE_TEXT} AS genre, rating_usia, duration_min,
  COUNT(tiket_id) AS tickets_sold, {dbl('COALESCE(SUM(final_price), 0)')} AS revenue, {SEATS}
  FROM shows JOIN movies USING (movie_id) LEFT JOIN tiket USING (schedule_id)
  WHERE show_date {WINDOW}{more} GROUP BY movie_id, title, genre, rating_usia, duration_min"""


def cinema_ctes(window: bool) -> str:
    """Everything about a venue from one table at (venue, room, title): what was sold in the sale
    window over all shows ever planned, and the seats shown in the window."""
    sale = SALE_WINDOW if window else "TRUE"
    shown = f"show_date {WINDOW}" if window else "TRUE"
    return f"""
, room_title AS (SELECT cinema_id, studio_id, movie_id, COUNT(tiket_id) AS sold, SUM(final_price) AS paid
    FROM shows LEFT JOIN (SELECT * FROM tiket WHERE {sale}) USING (schedule_id) GROUP BY ALL)
, on_screen AS (SELECT cinema_id, studio_id, movie_id, SUM(total_capacity) AS seats FROM shows WHERE {shown} GROUP BY ALL)
, figures AS (SELECT cinema_id, {big('SUM(sold)')} AS total_tickets, COALESCE(SUM(paid), 0) AS total_revenue,
    COUNT(DISTINCT studio_id) FILTER (sold > 0) AS active_studios,
    COUNT(DISTINCT movie_id) FILTER (on_screen.seats IS NOT NULL) AS active_movies,
    {big('COALESCE(SUM(on_screen.seats), 0)')} AS total_capacity
    FROM room_title LEFT JOIN on_screen USING (cinema_id, studio_id, movie_id) GROUP BY 1)
, best_title AS (SELECT cinema_id, movie_id AS top_movie_id, title AS top_movie_title, {big('SUM(sold)')} AS top_movie_tickets
    FROM room_title JOIN movies USING (movie_id) GROUP BY 1, 2, 3
    QUALIFY ROW_NUMBER() OVER (PARTITION BY cinema_id ORDER BY SUM(sold) DESC, title, movie_id) = 1)
, best_genre AS (SELECT cinema_id, g AS top_genre, {big('SUM(sold)')} AS top_genre_tickets
    FROM room_title JOIN genre_of USING (movie_id) GROUP BY 1, 2
    QUALIFY ROW_NUMBER() OVER (PARTITION BY cinema_id ORDER BY SUM(sold) DESC, g) = 1)
, venue AS (SELECT cinema.cinema_id, cinema_name, city, address, figures.* EXCLUDE (cinema_id),
    best_title.* EXCLUDE (cinema_id), best_genre.* EXCLUDE (cinema_id), {pct('total_tickets', 'total_capacity')} AS occupancy
    FROM figures JOIN cinema USING (cinema_id) LEFT JOIN best_title USING (cinema_id) LEFT JOIN best_genre USING (cinema_id))
"""


CINEMA_SELECT = f"""SELECT cinema_id, cinema_name, city, total_tickets, {dbl('total_revenue')} AS total_revenue,
  active_movies, active_studios, total_capacity, occupancy, top_movie_id, top_movie_title, top_movie_tickets,
  top_genre, top_genre_tickets FROM venue"""

NETWORK_SELECT = f"""SELECT COUNT(*) AS total_cinemas, COUNT(CASE WHEN total_tickets > 0 THEN 1 END) AS active_cinemas,
  {big('SUM(total_tickets)')} AS total_tickets, {money('SUM(total_revenue)')} AS total_revenue,
  MAX(active_movies) AS active_movies FROM venue"""

LAST_HOUR = """
, newest AS (SELECT MAX(trans_time) AS m FROM tiket)
, recent AS (SELECT sold.* FROM sold, newest WHERE trans_time BETWEEN m - INTERVAL 1 HOUR AND m)
"""
LAST = f"COUNT(*) AS tickets_sold, {dbl('SUM(final_price)')} AS revenue"

VENUE_STATUS = """SELECT cinema_id, cinema_name, city,
  CASE WHEN total_tickets > 0 THEN 'active' ELSE 'inactive' END AS status FROM venue"""

QUERIES = {
    "session_facts": sql(
        f"""SELECT schedule_id, movie_id, studio_id, cinema_id, city, {day('show_date')} AS show_date, time_slot,
        total_capacity, tickets, {money('revenue')} AS revenue, {r2('seat_share * 100')} AS occupancy FROM w"""
    ),
    "sales_summary": sql(TOTALS + SUMMARY),
    "sales_summary_asia": scoped_summary("city = 'ASIA'"),
    "sales_summary_venue": scoped_summary("cinema_id = 8"),
    "sales_summary_room": scoped_summary("city = 'ASIA' AND studio_id = 13"),
    "sales_summary_title": scoped_summary("movie_id = 17"),
    "period_growth": sql(
        TOTALS
        + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, {dbl('cur.' + m)} AS current_value, {dbl('prev.' + m)} AS previous_value, "
            f"{growth('cur.' + m, 'prev.' + m)} AS growth_pct FROM cur, prev"
            for m in ("tickets", "revenue", "occupancy")
        )
    ),
    "trend_hourly": sql(
        f"SELECT start_hour AS time_group, COUNT(*) AS tickets_sold, {money('SUM(final_price)')} AS revenue "
        "FROM sold_w GROUP BY 1"
    ),
    "trend_daily": sql(
        f"SELECT {day('show_date')} AS time_group, COUNT(*) AS tickets_sold, {money('SUM(final_price)')} AS revenue "
        "FROM sold_w GROUP BY 1"
    ),
    "trend_summary": sql(
        TOTALS + f"SELECT {big('cur.tickets')} AS total_tickets, {money('cur.revenue')} AS revenue, {GROWTHS} FROM cur, prev"
    ),
    "occupancy_hourly": sql(occupancy_group(f"{day('show_date')} || ' ' || time_slot")),
    "occupancy_daily": sql(occupancy_group(day("show_date"))),
    "occupancy_summary": sql(
        f""", g AS (SELECT show_date, SUM(tickets) AS t, SUM(total_capacity) AS c, COUNT(*) AS n,
          {r2('AVG(seat_share) * 100')} AS o FROM w GROUP BY 1)
        SELECT {big('SUM(t)')} AS total_tickets, {big('SUM(c)')} AS total_capacity,
          {rratio('SUM(CAST(o * n AS DECIMAL(28,4)))', 'SUM(n)')} AS occupancy FROM g"""
    ),
    "movie_stats_summary": sql(
        MOVIE_ROWS
        + """, tm AS (SELECT * FROM per_movie WHERE n > 0 ORDER BY n DESC, title, movie_id LIMIT 1)
        , tg AS (SELECT * FROM per_genre ORDER BY n DESC, g LIMIT 1)
        SELECT (SELECT COUNT(*) FROM per_movie) AS total_movies_showing,
          (SELECT CAST(SUM(n) AS BIGINT) FROM per_movie) AS total_tickets_sold, tm.movie_id AS top_movie_id,
          tm.title AS top_movie_title, tm.n AS top_movie_tickets, tg.g AS top_genre, tg.n AS top_genre_tickets
        FROM tm, tg"""
    ),
    "rating_breakdown": sql(
        f"""SELECT COALESCE(rating_usia, 'Unknown') AS rating_usia, COUNT(tiket_id) AS total_tickets_sold,
        COUNT(DISTINCT schedule_id) AS total_showings, {SEATS}
        FROM shows JOIN movies USING (movie_id) LEFT JOIN tiket USING (schedule_id)
        WHERE show_date {WINDOW} GROUP BY 1"""
    ),
    "rating_breakdown_rating": sql(
        f"""SELECT rating_usia, COUNT(tiket_id) AS total_tickets_sold, COUNT(DISTINCT schedule_id) AS total_showings, {SEATS}
        FROM shows JOIN movies USING (movie_id) LEFT JOIN tiket USING (schedule_id)
        WHERE show_date {WINDOW} AND rating_usia = '17+' GROUP BY 1"""
    ),
    "movie_rankings": sql(rankings()),
    "movie_rankings_rating": sql(rankings(" AND rating_usia = '13+' AND city = 'ASIA'")),
    "movie_rankings_top10": sql(rankings() + " ORDER BY tickets_sold DESC, title, movie_id LIMIT 10"),
    "movie_sales_txn": sql(
        f"""SELECT movie_id, title, COUNT(*) AS total_tickets, {dbl('SUM(final_price)')} AS total_revenue
        FROM sold_txn JOIN movies USING (movie_id) GROUP BY 1, 2"""
    ),
    "movie_detail": sql(
        f"""SELECT movie_id, title, {GENRE_TEXT} AS genre, rating_usia, duration_min, COUNT(tiket_id) AS total_tickets,
        {dbl('COALESCE(SUM(final_price), 0)')} AS total_revenue,
        {ratio('SUM(final_price)', 'COUNT(tiket_id)')} AS avg_ticket_price,
        COUNT(DISTINCT cinema_id) AS showing_at_count
        FROM movies LEFT JOIN shows USING (movie_id) LEFT JOIN tiket USING (schedule_id)
        GROUP BY movie_id, title, genre, rating_usia, duration_min"""
    ),
    "movie_showing_at": sql("SELECT movie_id, cinema_id, COUNT(*) AS total_shows FROM shows GROUP BY 1, 2"),
    "movie_detail_seats": sql(
        "SELECT movie_id, seat_category, COUNT(*) AS total_tickets FROM sold WHERE seat_category <> '' GROUP BY 1, 2"
    ),
    "movie_performance": sql(
        f"""SELECT movie_id, COUNT(tiket_id) AS total_tickets, {dbl('COALESCE(SUM(final_price), 0)')} AS total_revenue,
        {rratio('SUM(final_price)', 'COUNT(tiket_id)')} AS avg_ticket_price,
        COUNT(DISTINCT cinema_id) AS showing_at_count
        FROM shows LEFT JOIN tiket USING (schedule_id) WHERE show_date {WINDOW} GROUP BY 1"""
    ),
    "movie_daily_trend": sql(
        f"""SELECT movie_id, {day('show_date')} AS time_group, COUNT(*) AS tickets_sold,
        {dbl('SUM(final_price)')} AS revenue FROM sold_w GROUP BY 1, 2"""
    ),
    "movie_seat_distribution": sql(
        "SELECT movie_id, seat_category, COUNT(*) AS total_tickets FROM sold_w GROUP BY 1, 2"
    ),
    "studio_detail": sql(
        """SELECT studio.studio_id, studio.cinema_id, studio.studio_name, studio.total_capacity, studio.screen_type,
        COUNT(DISTINCT s.schedule_id) AS total_schedules, COUNT(tiket_id) AS total_tickets
        FROM studio LEFT JOIN schedules s ON studio.studio_id = s.studio_id
        LEFT JOIN tiket ON s.schedule_id = tiket.schedule_id GROUP BY 1, 2, 3, 4, 5"""
    ),
    "schedule_detail": sql(
        f"""SELECT schedule_id, movie_id, studio_id, cinema_id, {day('show_date')} AS show_date, start_time,
        {dbl('price')} AS price, status, tickets AS tickets_sold, {dbl('revenue')} AS revenue FROM facts"""
    ),
    "cinema_detail": sql(
        """SELECT cinema.cinema_id, cinema.cinema_name, cinema.city, cinema.address,
        CASE WHEN COUNT(tiket_id) > 0 THEN 'active' ELSE 'inactive' END AS status,
        COUNT(DISTINCT studio.studio_id) AS total_studios, COUNT(DISTINCT s.schedule_id) AS total_schedules,
        COUNT(tiket_id) AS total_tickets
        FROM cinema LEFT JOIN studio ON cinema.cinema_id = studio.cinema_id
        LEFT JOIN schedules s ON studio.studio_id = s.studio_id
        LEFT JOIN tiket ON s.schedule_id = tiket.schedule_id GROUP BY 1, 2, 3, 4"""
    ),
    "cinema_stats": sql(cinema_ctes(True) + CINEMA_SELECT),
    "cinema_stats_summary": sql(cinema_ctes(True) + NETWORK_SELECT),
    "cinemas_list": sql(
        cinema_ctes(False)
        + f"""SELECT cinema_id, cinema_name, city, address,
        CASE WHEN total_tickets > 0 THEN 'active' ELSE 'inactive' END AS status, total_tickets,
        {dbl('total_revenue')} AS total_revenue, total_capacity, occupancy, top_movie_title, top_genre FROM venue"""
    ),
    "cinema_performance": sql(
        cinema_ctes(True) + f"SELECT * EXCLUDE (cinema_name, city) FROM ({CINEMA_SELECT})"
    ),
    "city_revenue": sql(
        f"""SELECT city, COUNT(DISTINCT cinema_id) AS total_cinemas, {big('SUM(tickets)')} AS total_tickets,
        {dbl('SUM(revenue)')} AS total_revenue, {big('SUM(total_capacity)')} AS total_capacity,
        COUNT(*) AS total_shows, {r2('AVG(seat_share) * 100')} AS avg_occupancy FROM w GROUP BY 1"""
    ),
    "last_hour_total": sql(
        LAST_HOUR
        + """SELECT strftime(m, '%Y-%m-%d %H:%M:%S') AS last_data_in,
        strftime(m - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(m, '%Y-%m-%d %H:%M:%S') AS window_end,
        (SELECT COUNT(*) FROM tiket, newest n WHERE trans_time BETWEEN n.m - INTERVAL 1 HOUR AND n.m) AS tickets_last_hour
        FROM newest"""
    ),
    "last_hour_by_city": sql(LAST_HOUR + f"SELECT city, {LAST} FROM recent GROUP BY 1"),
    "last_hour_by_studio": sql(
        LAST_HOUR + f"SELECT studio_id, studio_name, cinema_id, city, {LAST} FROM recent GROUP BY 1, 2, 3, 4"
    ),
    "last_hour_by_movie": sql(
        LAST_HOUR + f"SELECT movie_id, title, {LAST} FROM recent JOIN movies USING (movie_id) GROUP BY 1, 2"
    ),
    "venue_status": sql(cinema_ctes(False) + VENUE_STATUS),
    "venue_status_summary": sql(
        cinema_ctes(False)
        + f""", v AS ({VENUE_STATUS})
        SELECT COUNT(*) AS total_nodes, COUNT(CASE WHEN status = 'active' THEN 1 END) AS active_nodes,
        COUNT(CASE WHEN status = 'inactive' THEN 1 END) AS inactive_nodes, CAST(0 AS BIGINT) AS down_nodes,
        {pct("COUNT(CASE WHEN status = 'active' THEN 1 END)", 'COUNT(*)')} AS health_rate FROM v"""
    ),
}
