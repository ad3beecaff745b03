"""SQL of the sales reports."""

from twins import values as C
from twins.base import AS_OF, WINDOW, big, day, growth, minmax, money, pct, r2, rratio, sql
from twins.kpi import GROWTHS, TOTALS, cinema_ctes, rankings

CENTS = "CAST(revenue AS DECIMAL(28,2))"

STUDIOS = f"""
, per_show AS (SELECT schedule_id, studio_id, studio_name, cinema_id, cinema_name, city, total_capacity, COUNT(*) AS n,
   SUM(final_price) AS rev, CASE WHEN total_capacity > 0 THEN CAST(COUNT(*) AS DOUBLE) / total_capacity ELSE 0 END AS sh
   FROM sold_txn GROUP BY 1, 2, 3, 4, 5, 6, 7)
, studios AS (SELECT studio_id, studio_name, cinema_id, cinema_name, city, COUNT(*) AS total_shows,
   {big('SUM(n)')} AS total_tickets, SUM(rev) AS rev, {r2('AVG(sh) * 100')} AS occupancy FROM per_show GROUP BY 1, 2, 3, 4, 5)
, ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rev DESC, total_tickets DESC, studio_name, studio_id) AS rank FROM studios)
"""

MOVIES = """
, per_movie AS (SELECT movie_id, title, COUNT(*) AS n, SUM(final_price) AS rev FROM sold_txn JOIN movies USING (movie_id)
   GROUP BY 1, 2)
, ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, rev DESC, title, movie_id) AS rank FROM per_movie)
"""


def slots(source: str = "w", keys: str = "") -> str:
    """Scores per start hour; ``keys`` is a list of columns that ends with a comma."""
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    return f"""
, slot_sums AS (SELECT {keys} time_slot, SUM(tickets) AS d, SUM(revenue) AS r, SUM(total_capacity) AS cap
   FROM {source} GROUP BY ALL)
, slot_norm AS (SELECT *, {minmax('d', f'MIN(d) OVER ({part})', f'MAX(d) OVER ({part})')} AS nd,
   {minmax('r', f'MIN(r) OVER ({part})', f'MAX(r) OVER ({part})')} AS nr FROM slot_sums)
, slot_scored AS (SELECT {keys} time_slot, {money('r')} AS revenue, {big('d')} AS demand, {pct('d', 'cap')} AS occupancy,
   {r2('nd')} AS normalized_demand, {r2('nr')} AS normalized_revenue,
   {r2(f'nd * CAST({C.SLOT_DEMAND_WEIGHT} AS DOUBLE) + nr * CAST({C.SLOT_REVENUE_WEIGHT} AS DOUBLE)')}
     AS optimization_score FROM slot_norm)
, slots AS (SELECT *, CASE WHEN optimization_score >= 0.6 AND occupancy >= 70 THEN '{C.SLOT_PREMIUM}'
   WHEN optimization_score >= 0.5 THEN '{C.SLOT_STRONG}' WHEN occupancy < 40 THEN '{C.SLOT_QUIET}'
   ELSE '{C.SLOT_KEEP}' END AS recommendation FROM slot_scored)
"""


def trend(expr: str) -> str:
    return f""", tr AS (SELECT {expr} AS time_group, COUNT(*) AS total_tickets, {money('SUM(final_price)')} AS revenue
      FROM sold_w GROUP BY 1)"""


MONTH = "strftime(show_date, '%Y-%m')"
MOVING = f"""SELECT *, {rratio(
    f'SUM({CENTS}) OVER (ORDER BY time_group ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)',
    'COUNT(*) OVER (ORDER BY time_group ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS moving_average FROM tr"""


def forecast(kind: str, following: str) -> str:
    return f""", l AS (SELECT * FROM tr ORDER BY time_group DESC LIMIT 3)
    SELECT '{kind}' AS group_by, {following} AS next_period,
    {rratio(f'SUM({CENTS})', 'COUNT(*)')} AS projected_revenue FROM l"""


DAY_TYPES = f"""
, spine AS (SELECT * FROM (VALUES ('weekday'), ('weekend')) AS v(day_type))
, typed AS (SELECT *, CASE WHEN dayofweek(show_date) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_type FROM w)
, sums AS (SELECT spine.day_type, COUNT(schedule_id) AS n, COALESCE(SUM(tickets), 0) AS k, COALESCE(SUM(revenue), 0) AS r,
   COALESCE(SUM(total_capacity), 0) AS c FROM spine LEFT JOIN typed USING (day_type) GROUP BY 1)
, dt AS (SELECT day_type, n AS total_shows, {big('k')} AS total_tickets, {money('r')} AS total_revenue,
   {rratio('r', 'n')} AS avg_revenue_per_show, {rratio('k', 'n')} AS avg_tickets_per_show, {pct('k', 'c')} AS occupancy FROM sums)
"""

FEE = (
    "CAST(CASE lower(replace(payment_type, ' ', '_')) "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.PAYMENT_FEES.items())
    + f" ELSE {C.PAYMENT_FEES['unknown']} END AS BIGINT)"
)
def payments(rows: str = "sold_w") -> str:
    return f"""
, pay AS (SELECT COALESCE(payment_type, 'unknown') AS payment_type, COUNT(*) AS n, SUM(final_price) AS r FROM {rows} GROUP BY 1)
, mix AS (SELECT payment_type, n AS total_transactions, {pct('n', 'SUM(n) OVER ()')} AS usage_rate,
   {money('r')} AS gross_revenue, {rratio('r', 'n')} AS avg_price, {FEE} AS admin_fee,
   {r2(f'r - n * {FEE}')} AS net_profitability FROM pay)
"""


PAYMENTS = payments()

RISK = f"""
, risk AS (SELECT schedule_id, movie_id, title, studio_id, cinema_id, cinema_name, city, {day('show_date')} AS show_date,
   start_time, status, tickets AS tickets_sold, {money('revenue')} AS revenue
   FROM w LEFT JOIN movies USING (movie_id) WHERE lower(status) IN ('cancelled', 'canceled', 'delayed'))
"""

QUERIES = {
    "exec_film_contribution": sql(
        f""", top AS ({rankings()} ORDER BY tickets_sold DESC, title, movie_id LIMIT 10)
        SELECT movie_id, title, tickets_sold AS total_tickets, revenue AS total_revenue,
        {pct('revenue', 'SUM(CAST(revenue AS DECIMAL(28,4))) OVER ()')} AS revenue_share FROM top"""
    ),
    "sales_overview": sql(
        TOTALS
        + f"""SELECT {money('cur.revenue')} AS total_revenue, {big('cur.tickets')} AS total_tickets,
        {rratio('cur.revenue', 'cur.tickets')} AS avg_ticket_price, {rratio('cur.revenue', 'capacity')} AS revenue_per_seat,
        cur.occupancy AS avg_occupancy, {GROWTHS}, {growth('cur.occupancy', 'prev.occupancy')} AS growth_occupancy
        FROM cur, prev"""
    ),
    "revenue_by_cinema": sql(
        cinema_ctes(True)
        + f"""SELECT ROW_NUMBER() OVER (ORDER BY total_revenue DESC, cinema_id) AS rank, cinema_id, cinema_name, city,
        {money('total_revenue')} AS total_revenue, total_tickets, occupancy,
        {pct('total_revenue', 'SUM(total_revenue) OVER ()')} AS contribution, top_movie_title FROM venue"""
    ),
    "revenue_by_cinema_summary": sql(
        cinema_ctes(True)
        + f"""SELECT COUNT(*) AS total_cinemas, COUNT(CASE WHEN total_tickets > 0 THEN 1 END) AS active_cinemas,
        {big('SUM(total_tickets)')} AS total_tickets_network, {money('SUM(total_revenue)')} AS total_revenue_network,
        MAX(active_movies) AS active_movies,
        (SELECT cinema_id FROM venue ORDER BY total_revenue DESC, cinema_id LIMIT 1) AS top_cinema_id,
        (SELECT cinema_name FROM venue ORDER BY total_revenue DESC, cinema_id LIMIT 1) AS top_cinema_name,
        (SELECT cinema_id FROM venue ORDER BY total_revenue, cinema_id DESC LIMIT 1) AS lowest_cinema_id,
        (SELECT cinema_name FROM venue ORDER BY total_revenue, cinema_id DESC LIMIT 1) AS lowest_cinema_name
        FROM venue"""
    ),
    "revenue_by_studio": sql(
        STUDIOS
        + f"""SELECT rank, studio_id, studio_name, cinema_id, cinema_name, city, total_shows, total_tickets,
        {money('rev')} AS total_revenue, {rratio('rev', 'total_shows')} AS avg_revenue_per_show, occupancy FROM ranked"""
    ),
    "revenue_by_studio_summary": sql(
        STUDIOS
        + f"""SELECT COUNT(*) AS total_studios, COUNT(CASE WHEN total_shows > 0 THEN 1 END) AS active_studios,
        {r2(f"SUM(CAST({money('rev')} AS DECIMAL(28,2)))")} AS total_revenue,
        (SELECT studio_id FROM ranked ORDER BY rank LIMIT 1) AS top_studio_id,
        (SELECT studio_id FROM ranked ORDER BY rank DESC LIMIT 1) AS lowest_studio_id FROM ranked"""
    ),
    "revenue_by_movie": sql(
        MOVIES
        + f"""SELECT rank, movie_id, title, {money('rev')} AS total_revenue, n AS total_tickets,
        {pct('rev', '(SELECT SUM(rev) FROM per_movie)')} AS contribution FROM ranked WHERE rank <= 10"""
    ),
    "revenue_by_movie_summary": sql(
        MOVIES
        + """SELECT (SELECT COUNT(*) FROM per_movie) AS total_movies, movie_id AS top_movie_id, title AS top_movie_title
        FROM ranked WHERE rank = 1"""
    ),
    "time_slots": sql(slots() + "SELECT * FROM slots"),
    "time_slots_asia": sql(
        slots("(SELECT * FROM w WHERE city = 'ASIA')") + "SELECT * FROM slots"
    ),
    "time_slots_peak_quiet": sql(
        slots()
        + """, a AS (SELECT * FROM slots ORDER BY revenue DESC, time_slot LIMIT 1)
        , b AS (SELECT * FROM slots ORDER BY revenue, time_slot LIMIT 1)
        SELECT a.time_slot AS peak_time_slot, a.revenue AS peak_revenue, a.demand AS peak_demand,
        a.occupancy AS peak_occupancy, a.recommendation AS peak_recommendation, b.time_slot AS quiet_time_slot,
        b.revenue AS quiet_revenue, b.demand AS quiet_demand FROM a, b"""
    ),
    "sales_trend_daily": sql(trend(day("show_date")) + MOVING),
    "sales_trend_monthly": sql(trend(MONTH) + MOVING),
    "sales_trend_summary": sql(
        trend(day("show_date"))
        + f"""SELECT 'daily' AS group_by, 'show_date' AS date_axis, {r2(f'SUM({CENTS})')} AS total_revenue,
        {big('SUM(total_tickets)')} AS total_tickets FROM tr"""
    ),
    "sales_trend_forecast": sql(
        trend(day("show_date"))
        + forecast("daily", "strftime(CAST(MAX(time_group) AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d')")
    ),
    "sales_trend_forecast_monthly": sql(
        trend(MONTH)
        + forecast("monthly", "strftime(CAST(MAX(time_group) || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m')")
    ),
    "yearly_breakdown": sql(
        f"""SELECT CAST(month(show_date) AS BIGINT) AS month_num, strftime(show_date, '%b') AS month,
        {money('SUM(final_price)')} AS revenue FROM sold
        WHERE show_date BETWEEN DATE '{AS_OF}' - INTERVAL 1 YEAR AND DATE '{AS_OF}' GROUP BY 1, 2"""
    ),
    "weekend_weekday": sql(DAY_TYPES + "SELECT * FROM dt"),
    "weekend_weekday_summary": sql(
        DAY_TYPES
        + f"""SELECT CASE WHEN e.total_revenue >= d.total_revenue THEN 'weekend' ELSE 'weekday' END AS winning_period,
        {r2('ABS(e.total_revenue - d.total_revenue)')} AS revenue_gap, ABS(e.total_tickets - d.total_tickets) AS ticket_gap
        FROM dt e, dt d WHERE e.day_type = 'weekend' AND d.day_type = 'weekday'"""
    ),
    "payment_mix": sql(PAYMENTS + "SELECT * FROM mix"),
    "payment_mix_venue": sql(payments("sold_w WHERE cinema_id = 8 AND payment_type = 'QRIS'") + "SELECT * FROM mix"),
    "payment_mix_summary": sql(
        PAYMENTS
        + f"""SELECT {big('SUM(total_transactions)')} AS total_transactions,
        (SELECT payment_type FROM mix ORDER BY total_transactions DESC, payment_type LIMIT 1) AS preferred_payment FROM mix"""
    ),
    "risk_summary": sql(
        f""", c AS (SELECT COUNT(*) AS total_shows,
        COUNT(CASE WHEN lower(status) IN ('cancelled', 'canceled') THEN 1 END) AS cancelled,
        COUNT(CASE WHEN lower(status) = 'delayed' THEN 1 END) AS delayed FROM shows WHERE show_date {WINDOW})
        SELECT *, {pct('cancelled + delayed', 'total_shows').replace('CAST(cancelled + delayed AS DOUBLE)', 'CAST((cancelled + delayed) AS DOUBLE)')}
          AS problematic_rate FROM c"""
    ),
    "risk_schedules": sql(RISK + "SELECT * FROM risk"),
    "risk_by_movie": sql(
        RISK
        + f"""SELECT movie_id, title, COUNT(CASE WHEN lower(status) LIKE '%cancel%' THEN 1 END) AS cancelled,
        COUNT(CASE WHEN lower(status) = 'delayed' THEN 1 END) AS delayed, {r2(f'SUM({CENTS})')} AS impacted_revenue
        FROM risk GROUP BY 1, 2"""
    ),
}
