"""SQL of the title reports."""

from twins.base import GENRE_TEXT, WINDOW, big, day, growth, money, pct, r2, ratio, rratio, sql
from twins.kpi import GROWTHS, SEATS, TOTALS

OVERALL = f"""
, g AS (SELECT show_date, COUNT(*) AS n, {r2('AVG(seat_share) * 100')} AS o FROM w GROUP BY 1)
, overall AS (SELECT {rratio('SUM(CAST(o * n AS DECIMAL(28,4)))', 'SUM(n)')} AS occ FROM g)
"""
FULL = f"""{big('SUM(tickets)')} AS total_tickets, {big('SUM(total_capacity)')} AS total_capacity,
  {r2('AVG(seat_share) * 100')} AS occupancy"""

QUERIES = {
    "films_overview": sql(
        TOTALS
        + OVERALL
        + f"""SELECT (SELECT COUNT(DISTINCT movie_id) FROM w JOIN movies USING (movie_id)) AS active_films,
        shows AS total_shows, {big('cur.tickets')} AS tickets_sold, {money('cur.revenue')} AS revenue,
        occ AS avg_occupancy, {GROWTHS}, {growth('cur.occupancy', 'prev.occupancy')} AS growth_occupancy
        FROM cur, prev, overall"""
    ),
    "films_performance": sql(
        f""", m AS (SELECT movie_id, title, genre, rating_usia, duration_min, COUNT(*) AS n, SUM(final_price) AS r, {SEATS}
          FROM sold_txn JOIN movies USING (movie_id) GROUP BY 1, 2, 3, 4, 5)
        , k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, r DESC, title, movie_id) AS rank FROM m)
        , top AS (SELECT * FROM k WHERE rank <= 10)
        SELECT rank, movie_id, title, n AS total_tickets, {money('r')} AS total_revenue,
        CASE WHEN COALESCE(genre, '') = '' THEN 'Unknown' ELSE trim(split_part(genre, ',', 1)) END AS genre,
        {GENRE_TEXT} AS genres, COALESCE(rating_usia, 'SU') AS rating_usia, duration_min,
        regular_seats, vip_seats, sweetbox_seats,
        {pct('n', 'SUM(n) OVER ()')} AS share_of_tickets, {pct('r', 'SUM(r) OVER ()')} AS share_of_revenue,
        {r2(f"({ratio('n', 'GREATEST(MAX(n) OVER (), 1)')}) * CAST(0.6 AS DOUBLE) + ({ratio('r', 'GREATEST(MAX(r) OVER (), 1)')}) * CAST(0.4 AS DOUBLE)")}
          AS blockbuster_score FROM top"""
    ),
    "schedule_performance": sql(
        f"""SELECT schedule_id, movie_id, title, {day('show_date')} AS show_date, start_time, studio_id, cinema_id,
        tickets AS total_tickets, {money('revenue')} AS revenue, {pct('tickets', 'total_capacity')} AS occupancy
        FROM w JOIN movies USING (movie_id)"""
    ),
    "repeat_schedule": sql(
        f"""SELECT movie_id, title, {day('show_date')} AS show_date, COUNT(DISTINCT schedule_id) AS total_schedules,
        COUNT(tiket_id) AS total_tickets, {money('SUM(final_price)')} AS revenue
        FROM shows JOIN movies USING (movie_id) LEFT JOIN tiket USING (schedule_id)
        WHERE show_date {WINDOW} GROUP BY 1, 2, 3"""
    ),
    "audience_density": sql(
        f"""SELECT movie_id, title, COUNT(*) AS total_schedules, {big('SUM(tickets)')} AS total_tickets,
        {rratio('SUM(tickets)', 'COUNT(*)')} AS audience_density,
        {pct('SUM(tickets)', 'SUM(total_capacity)')} AS capacity_utilization
        FROM w JOIN movies USING (movie_id) GROUP BY 1, 2"""
    ),
    "occupancy_by_movie": sql(
        OVERALL
        + f""", m AS (SELECT movie_id, title, {FULL} FROM w JOIN movies USING (movie_id) GROUP BY 1, 2)
        SELECT movie_id, title, total_tickets, total_capacity, occupancy, occupancy AS capacity_fit,
        {rratio('occupancy', 'occ')} AS underperforming_score,
        CASE WHEN occ > 0 AND occupancy / occ < 0.5 THEN 'critical'
             WHEN occ > 0 AND occupancy / occ < 0.7 THEN 'underperforming' ELSE 'good' END AS status FROM m, overall"""
    ),
    "occupancy_by_day": sql(f"SELECT {day('show_date')} AS show_date, {FULL} FROM w GROUP BY 1"),
    "occupancy_by_studio": sql(f"SELECT studio_id, studio_name, {FULL} FROM w GROUP BY 1, 2"),
    "genre_popularity": sql(
        f"""SELECT g AS genre, COUNT(tiket_id) AS total_tickets FROM shows JOIN genre_of USING (movie_id)
        LEFT JOIN tiket USING (schedule_id) WHERE show_date {WINDOW} GROUP BY 1"""
    ),
    "studio_format": sql(
        f"""SELECT COALESCE(screen_type, 'unknown') AS format, COUNT(DISTINCT studio_id) AS total_studios,
        COUNT(DISTINCT schedule_id) AS total_schedules FROM shows WHERE show_date {WINDOW} GROUP BY 1"""
    ),
}
