"""SQL of the rule-based reports."""

from twins import values as C
from twins.base import END, GENRE_TEXT, START, big, day, growth, minmax, money, pct, r2, rratio, sql
from twins.sales import slots


def case(lagging, packed, low, other) -> str:
    return (
        f"CASE WHEN normalized_demand >= 0.7 AND normalized_revenue <= 0.45 AND occupancy >= 70 THEN {lagging} "
        f"WHEN normalized_demand >= 0.6 AND occupancy >= 80 THEN {packed} WHEN occupancy <= 35 THEN {low} ELSE {other} END"
    )


def prices(keys: str = "") -> str:
    return f"""
, priced AS (SELECT {keys} time_slot, demand, revenue, occupancy, optimization_score,
  {case(f"'{C.PRICE_UP}'", f"'{C.PRICE_UP}'", f"'{C.PRICE_DOWN}'", f"'{C.PRICE_HOLD}'")} AS suggested_action,
  {big(case(8, 5, -10, 0))} AS suggested_price_change_pct,
  {case(*[f"'{x}'" for x in (C.PRICE_REASON_LAGGING, C.PRICE_REASON_PACKED, C.PRICE_REASON_LOW, C.PRICE_REASON_HOLD)])} AS reason
  FROM slots WHERE demand > 0)
, prices AS (SELECT *, CAST(CASE WHEN suggested_action = '{C.PRICE_HOLD}' THEN 0.45
   WHEN occupancy >= 70 OR occupancy <= 35 THEN 0.8 ELSE 0.65 END AS DOUBLE) AS confidence FROM priced)
"""


def ads(source: str = "w", keys: str = "") -> str:
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""

    def norm(name):
        return minmax(name, f"MIN({name}) OVER ({part})", f"MAX({name}) OVER ({part})")

    return f"""
, ad_sums AS (SELECT {keys} movie_id, title, genre, time_slot, COUNT(*) AS shows_n, SUM(tickets) AS aud, SUM(revenue) AS rev,
   {pct('SUM(tickets)', 'SUM(total_capacity)')} AS occ FROM {source} JOIN movies USING (movie_id) GROUP BY ALL)
, ads AS (SELECT {keys} movie_id, title, {GENRE_TEXT} AS genre, time_slot, shows_n AS total_shows, {big('aud')} AS audience_size,
   {money('rev')} AS total_revenue, {rratio('rev', 'shows_n')} AS revenue_per_show, occ AS occupancy,
   {r2(f"(({norm('aud')}) * CAST(0.5 AS DOUBLE) + ({norm('rev')}) * CAST(0.3 AS DOUBLE) + ({norm('occ')}) * CAST(0.2 AS DOUBLE)) * 100")}
     AS ad_score FROM ad_sums)
"""


AD_ORDER = "ad_score DESC, audience_size DESC, total_revenue DESC, title, time_slot, movie_id"

BLOCK = f"""
, c AS (SELECT movie_id, title, COUNT(*) AS n, SUM(final_price) AS r FROM sold_w JOIN movies USING (movie_id) GROUP BY 1, 2)
, b AS (SELECT movie_id, COUNT(*) AS n FROM sold WHERE show_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-28' GROUP BY 1)
, g AS (SELECT movie_id, title, c.n AS current_tickets, COALESCE(b.n, 0) AS previous_tickets,
   {growth('c.n', 'COALESCE(b.n, 0)')} AS growth_rate, {money('r')} AS total_revenue FROM c LEFT JOIN b USING (movie_id))
"""


def block(tickets: int, rate: float) -> str:
    signal = f"current_tickets >= {tickets} AND growth_rate >= {rate}"
    return BLOCK + f""", bb AS (SELECT *, {signal} AS blockbuster_signal,
      CASE WHEN {signal} THEN '{C.BREAKOUT_YES}' ELSE '{C.BREAKOUT_NO}' END AS suggested_action FROM g)"""


OVERLAP = f"""
, slot_titles AS (SELECT cinema_id, cinema_name, city, show_date, time_slot, movie_id, title,
   {pct('SUM(tickets)', 'SUM(total_capacity)')} AS occ FROM w JOIN movies USING (movie_id) GROUP BY 1, 2, 3, 4, 5, 6, 7)
, strong AS (SELECT *, COUNT(*) OVER s AS titles, ROW_NUMBER() OVER (PARTITION BY cinema_id, show_date, time_slot
   ORDER BY occ DESC, title, movie_id) AS rn FROM slot_titles WINDOW s AS (PARTITION BY cinema_id, show_date, time_slot))
, cases AS (SELECT a.movie_id AS impacted_movie_id, a.title AS impacted_title, b.movie_id AS competitor_movie_id,
   b.title AS competitor_title, a.cinema_id, a.cinema_name, a.city, {day('a.show_date')} AS show_date, a.time_slot,
   a.occ AS impacted_occupancy, b.occ AS competitor_occupancy, {r2('b.occ - a.occ')} AS occupancy_gap,
   '{C.OVERLAP_ADVICE}' AS suggested_action
   FROM slot_titles a JOIN strong b ON a.cinema_id = b.cinema_id AND a.show_date = b.show_date AND a.time_slot = b.time_slot
   WHERE b.rn = 1 AND b.titles >= 2 AND b.occ >= 70 AND a.movie_id <> b.movie_id AND a.occ <= 40)
"""


def forecast(start: str, end: str, weeks: int) -> str:
    past = f"BETWEEN DATE '{start}' - INTERVAL {weeks * 7} DAY AND DATE '{start}' - INTERVAL 1 DAY"
    return f"""
, ds AS (SELECT sale_date AS d, COUNT(*) AS n, SUM(final_price) AS r FROM sold WHERE sale_date {past} GROUP BY 1)
, do_ AS (SELECT show_date AS d, AVG(seat_share) * 100 AS o FROM facts WHERE show_date {past} GROUP BY 1)
, ws AS (SELECT dayofweek(d) AS wd, CAST(SUM(n) AS DOUBLE) / COUNT(*) AS t, CAST(SUM(r) AS DOUBLE) / COUNT(*) AS r, COUNT(*) AS k
   FROM ds GROUP BY 1)
, wo AS (SELECT dayofweek(d) AS wd, AVG(o) AS o, COUNT(*) AS k FROM do_ GROUP BY 1)
, cal AS (SELECT CAST(x AS DATE) AS d FROM generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL 1 DAY) AS g(x))
, fc AS (SELECT {day('cal.d')} AS forecast_date, CAST(dayofweek(cal.d) AS BIGINT) AS weekday_number,
   strftime(cal.d, '%A') AS weekday_label,
   {r2('COALESCE(ws.t, (SELECT CAST(SUM(n) AS DOUBLE) / COUNT(*) FROM ds), 0)')} AS predicted_tickets,
   {r2('COALESCE(ws.r, (SELECT CAST(SUM(r) AS DOUBLE) / COUNT(*) FROM ds), 0)')} AS predicted_revenue,
   {r2('COALESCE(wo.o, (SELECT AVG(o) FROM do_), 0)')} AS predicted_occupancy,
   GREATEST(COALESCE(ws.k, 0), COALESCE(wo.k, 0)) AS sample_size
   FROM cal LEFT JOIN ws ON dayofweek(cal.d) = ws.wd LEFT JOIN wo ON dayofweek(cal.d) = wo.wd)
"""


def cents(name: str) -> str:
    return f"SUM(CAST({name} AS DECIMAL(28,2)))"


QUERIES = {
    "pricing_recommendation": sql(
        slots() + prices() + "SELECT * FROM prices ORDER BY ABS(suggested_price_change_pct) DESC, time_slot LIMIT 10"
    ),
    "pricing_recommendation_summary": sql(
        slots()
        + prices()
        + f"""SELECT (SELECT COUNT(*) FROM slots) AS total_slots_analyzed,
        (SELECT time_slot FROM slots ORDER BY revenue DESC, time_slot LIMIT 1) AS peak_time_slot,
        (SELECT time_slot FROM slots ORDER BY revenue, time_slot LIMIT 1) AS quiet_time_slot,
        COUNT(CASE WHEN suggested_action <> '{C.PRICE_HOLD}' THEN 1 END) AS recommended_changes FROM prices"""
    ),
    "best_ad_slot": sql(ads() + f"SELECT * FROM ads ORDER BY {AD_ORDER} LIMIT 10"),
    "best_ad_slot_summary": sql(
        ads()
        + f"""SELECT (SELECT COUNT(*) FROM ads) AS total_candidates, title AS top_title, time_slot AS top_time_slot,
        ad_score AS top_ad_score, '{C.AD_FORMULA}' AS scoring_formula FROM ads ORDER BY {AD_ORDER} LIMIT 1"""
    ),
    "early_blockbuster": sql(block(100, 25) + "SELECT * FROM bb"),
    "early_blockbuster_loose": sql(block(50, 0) + "SELECT * FROM bb"),
    "early_blockbuster_summary": sql(
        block(100, 25)
        + """SELECT 'show_date' AS date_axis, CAST(100 AS BIGINT) AS min_tickets, CAST(25 AS DOUBLE) AS min_growth,
        COUNT(CASE WHEN blockbuster_signal THEN 1 END) AS detected_movies FROM bb"""
    ),
    "cannibalization": sql(OVERLAP + "SELECT * FROM cases"),
    "cannibalization_summary": sql(
        OVERLAP
        + """SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT cinema_id, show_date, time_slot FROM slot_titles))
          AS total_slots_analyzed, (SELECT COUNT(*) FROM cases) AS possible_cannibalization_cases"""
    ),
    "forecast": sql(forecast(START, END, 4) + "SELECT * FROM fc"),
    "forecast_next_week": sql(forecast("2024-02-26", "2024-03-03", 4) + "SELECT * FROM fc"),
    "forecast_summary": sql(
        forecast(START, END, 4)
        + f"""SELECT {r2(cents('predicted_tickets'))} AS predicted_tickets, {r2(cents('predicted_revenue'))} AS predicted_revenue,
        {rratio(cents('predicted_occupancy'), 'COUNT(*)')} AS predicted_avg_occupancy, COUNT(*) AS forecast_days,
        CAST(4 AS BIGINT) AS lookback_weeks FROM fc"""
    ),
}
