"""SQL of the all-scope figures, the action candidates and the stored insights."""

from __future__ import annotations

from twins import values as C
from twins import base
from twins.base import END, START, big, growth, money, num, pct, r2, rratio, sql
from twins.rules import AD_ORDER, ads, prices
from twins.sales import STUDIOS, slots

KEYS = "scope_type, scope_value, "


def scoped(source: str, name: str) -> str:
    kinds = (("global", "''"), ("city", "city"), ("cinema", "CAST(cinema_id AS VARCHAR)"), ("studio", "CAST(studio_id AS VARCHAR)"))
    parts = " UNION ALL ".join(f"SELECT '{k}' AS scope_type, {v} AS scope_value, * FROM {source}" for k, v in kinds)
    return f", {name} AS ({parts})"


SCOPES = """
, scopes AS (
  SELECT 'global' AS scope_type, '' AS scope_value, 'Global' AS label, NULL AS city, NULL AS cinema_id,
         NULL AS cinema_name, NULL AS studio_id, NULL AS studio_name
  UNION ALL SELECT DISTINCT 'city', city, city, city, NULL, NULL, NULL, NULL FROM cinema WHERE city <> ''
  UNION ALL SELECT 'cinema', CAST(cinema_id AS VARCHAR), cinema_name, city, CAST(cinema_id AS VARCHAR), cinema_name, NULL, NULL
            FROM cinema
  UNION ALL SELECT 'studio', CAST(studio_id AS VARCHAR), studio_name, city, CAST(cinema_id AS VARCHAR), cinema_name,
            CAST(studio_id AS VARCHAR), studio_name FROM studio JOIN cinema USING (cinema_id))
"""

SUMS = scoped("w", "sw") + scoped("p", "sp") + SCOPES + f"""
, cur AS (SELECT scope_type, scope_value, SUM(tickets) AS t, SUM(revenue) AS r, SUM(total_capacity) AS c,
   {r2('AVG(seat_share) * 100')} AS o FROM sw GROUP BY 1, 2)
, prev AS (SELECT scope_type, scope_value, SUM(tickets) AS pt, SUM(revenue) AS pr, {r2('AVG(seat_share) * 100')} AS po
   FROM sp GROUP BY 1, 2)
, m AS (SELECT scope_type, scope_value, label, COALESCE(t, 0) AS t, COALESCE(r, 0) AS r, COALESCE(c, 0) AS c, COALESCE(o, 0) AS o,
   COALESCE(pt, 0) AS pt, COALESCE(pr, 0) AS pr, COALESCE(po, 0) AS po
   FROM scopes LEFT JOIN cur USING (scope_type, scope_value) LEFT JOIN prev USING (scope_type, scope_value))
, metrics AS (SELECT scope_type, scope_value, label, '{START}' AS period_start, '{END}' AS period_end,
   {big('t')} AS total_tickets, {money('r')} AS total_revenue, {rratio('r', 't')} AS avg_ticket_price,
   {rratio('r', 'c')} AS revenue_per_seat, o AS avg_occupancy, {growth('t', 'pt')} AS growth_tickets,
   {growth('r', 'pr')} AS growth_revenue, {growth('o', 'po')} AS growth_occupancy FROM m)
"""


def filled(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return f"({out})"


PRIORITY = "CASE WHEN score >= 85 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END"


def candidates(kind: str, name: str, hour: str, room: str, source: str) -> str:
    order = [b[0] for b in C.ACTION_BADGES].index(kind)
    fields = {"t": "movie_title", "h": hour, "v": "cinema_name", "r": "studio_name", "n": room, "o": num("occupancy"),
              "k": "CAST(tickets AS VARCHAR)"}
    text = {part: filled(t, **fields) for part, t in C.ACTION_TEXT[kind].items()}
    return f""", {name} AS (SELECT scope_type, scope_value, '{kind}' AS action_type, {PRIORITY} AS priority,
      {text['title']} AS title, {text['description']} AS description, {text['reason']} AS reason,
      '{C.EXPECTED_IMPACT[kind]}' AS expected_impact, city, cinema_name, {room} AS studio_name, movie_title,
      schedule_time, occupancy, CAST(score AS DOUBLE) AS score, schedule_id, {order} AS ty, place, show_date, start_time
      FROM {source})"""


LATEST = "show_date DESC, start_time DESC, schedule_id"
S = "scope_type, scope_value"

ACTIONS = (
    scoped("w", "aw")
    + slots("aw", KEYS)
    + prices(KEYS)
    + STUDIOS
    + f"""
, top_prices AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S}
    ORDER BY ABS(suggested_price_change_pct) DESC, time_slot) AS position FROM prices) WHERE position <= 5)
, rows_ AS (SELECT aw.* EXCLUDE (revenue), title AS movie_title, substr(start_time, 1, 5) AS schedule_time,
    {money('revenue')} AS revenue, {pct('tickets', 'total_capacity')} AS occupancy FROM aw JOIN movies USING (movie_id))
, rooms AS (SELECT studio.*, COALESCE(s.occupancy, 0) AS used FROM studio LEFT JOIN studios s ON studio.studio_id = s.studio_id)
, moves AS (SELECT * FROM (SELECT r.*, t.studio_name AS target, t.total_capacity AS target_capacity,
    r.occupancy + (t.total_capacity - r.total_capacity) AS score, 0 AS place,
    ROW_NUMBER() OVER (PARTITION BY {S}, schedule_id ORDER BY used, t.total_capacity DESC, t.studio_name, t.studio_id) AS rn
    FROM rows_ r JOIN rooms t ON r.cinema_id = t.cinema_id AND r.studio_id <> t.studio_id
      AND t.total_capacity > r.total_capacity AND t.used <= 60
    WHERE r.occupancy >= 82 AND r.total_capacity > 0 AND scope_type <> 'studio') WHERE rn = 1)
, weak AS (SELECT *, (CAST(100 AS DOUBLE) - occupancy) + GREATEST(0, 30 - tickets) AS score FROM (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY {S} ORDER BY occupancy, revenue, {LATEST}) AS place FROM rows_ WHERE occupancy <= 22 AND tickets <= 25) WHERE place <= 4)
, promos AS (SELECT *, CAST(75 AS DOUBLE) - occupancy AS score FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY r.scope_type, r.scope_value
    ORDER BY r.occupancy, {LATEST}) AS place FROM rows_ r WHERE r.occupancy > 20 AND r.occupancy <= 45 AND EXISTS (SELECT 1 FROM top_prices p
      WHERE p.scope_type = r.scope_type AND p.scope_value = r.scope_value AND p.time_slot = r.schedule_time
      AND p.suggested_action = '{C.PRICE_DOWN}')) WHERE place <= 4)
, premiums AS (SELECT *, occupancy + 12 AS score FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY r.scope_type, r.scope_value
    ORDER BY r.occupancy DESC, {LATEST}) AS place FROM rows_ r WHERE r.occupancy >= 78 AND EXISTS (SELECT 1 FROM top_prices p
      WHERE p.scope_type = r.scope_type AND p.scope_value = r.scope_value AND p.time_slot = r.schedule_time
      AND p.suggested_action = '{C.PRICE_UP}')) WHERE place <= 3)
"""
    + candidates(C.MOVE, "c_move", "start_time", "target", "moves")
    + candidates(C.REDUCE, "c_reduce", "schedule_time", "studio_name", "weak")
    + candidates(C.PROMO, "c_promo", "schedule_time", "studio_name", "promos")
    + candidates(C.PREMIUM, "c_premium", "schedule_time", "studio_name", "premiums")
)
PUBLIC = "SELECT * EXCLUDE (ty, place, show_date, start_time) FROM"

ACTION_KEY = f"{S}, action_type, city, cinema_name, studio_name, movie_title, schedule_time"


def look(part: int) -> str:
    whens = " ".join(f"WHEN '{b[0]}' THEN '{b[1 + part]}'" for b in C.ACTION_BADGES)
    return f"CASE action_type {whens} ELSE '{C.DEFAULT_BADGE[part]}' END"


BEST = SCOPES + f"""
, every AS (SELECT * FROM c_move UNION ALL SELECT * FROM c_reduce UNION ALL SELECT * FROM c_promo UNION ALL SELECT * FROM c_premium)
, listed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY ty, place, {LATEST}) AS lo FROM every)
, ded AS (SELECT *, MIN(lo) OVER (PARTITION BY {ACTION_KEY}) AS first_lo,
   ROW_NUMBER() OVER (PARTITION BY {ACTION_KEY} ORDER BY score DESC, lo) AS rn FROM listed)
, placed AS (SELECT * EXCLUDE (place), ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY score DESC, first_lo) AS position
   FROM ded WHERE rn = 1)
, best AS (SELECT {S}, label AS scope_label, position, action_type, priority, title, description, reason, expected_impact,
   placed.city, placed.cinema_name, placed.studio_name, movie_title, schedule_time, occupancy, {r2('score')} AS score,
   {look(0)} AS color, {look(1)} AS icon FROM placed JOIN scopes USING (scope_type, scope_value) WHERE position <= 6)
"""

VALUES = {"s": "label", "o": num("avg_occupancy"), "k": num("growth_tickets"), "r": num("growth_revenue")}


def rule(of) -> str:
    t = C.INSIGHT_TEXT
    return (
        f"CASE WHEN avg_occupancy < 35 THEN {of(t['occupancy'])} WHEN growth_revenue < 0 OR growth_tickets < 0 "
        f"THEN {of(t['growth'])} ELSE {of(t['revenue'])} END"
    )


THEME = "CASE top_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ACTION_THEME.items()) + (
    " ELSE CASE WHEN avg_occupancy < 35 THEN 'occupancy' WHEN growth_revenue < 0 OR growth_tickets < 0 THEN 'growth' "
    "ELSE 'revenue' END END"
)

# The metric part brings its own list of scopes.
INSIGHT = SUMS + ACTIONS + BEST.replace(SCOPES, "") + f"""
, tops AS (SELECT {S}, MAX(CASE WHEN position = 1 THEN description END) AS top_description,
   MAX(CASE WHEN position = 1 THEN reason END) AS top_reason, MAX(CASE WHEN position = 1 THEN priority END) AS top_priority,
   MAX(CASE WHEN position = 1 THEN action_type END) AS top_type,
   string_agg(title, '|' ORDER BY position) FILTER (position <= 3) AS top_items FROM best GROUP BY 1, 2)
, insight AS (SELECT {S}, label, period_start, period_end, total_tickets, total_revenue, avg_ticket_price, revenue_per_seat,
   avg_occupancy, growth_tickets, growth_revenue, growth_occupancy,
   CASE WHEN top_type IS NOT NULL THEN {filled(C.INSIGHT_ACTION_TITLE, **VALUES)}
        ELSE {rule(lambda t: filled(t['title'], **VALUES))} END AS title,
   CASE WHEN top_type IS NOT NULL THEN top_description ELSE {rule(lambda t: filled(t['description'], **VALUES))} END AS description,
   CASE WHEN top_type IS NOT NULL THEN top_reason ELSE {rule(lambda t: filled(t['recommendation']))} END AS recommendation,
   CASE WHEN top_type IS NOT NULL THEN top_items ELSE {rule(lambda t: filled('|'.join(t['action_items'])))} END AS action_items,
   CASE WHEN top_type IS NOT NULL THEN top_priority ELSE {rule(lambda t: filled(t['impact_level']))} END AS impact_level,
   {THEME} AS category FROM metrics LEFT JOIN tops USING (scope_type, scope_value))
"""

PRICE_SUMMARY = f"""
, slot_place AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY revenue DESC, time_slot) AS hi,
   ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY revenue, time_slot) AS lo FROM slots)
, changes AS (SELECT {S}, COUNT(CASE WHEN suggested_action <> '{C.PRICE_HOLD}' THEN 1 END) AS n FROM prices GROUP BY 1, 2)
, price_summary AS (SELECT {S}, COUNT(*) AS total_slots_analyzed, COALESCE(MAX(n), 0) AS recommended_changes,
   MAX(CASE WHEN hi = 1 THEN time_slot END) AS peak_time_slot, MAX(CASE WHEN hi = 1 THEN revenue END) AS peak_revenue,
   MAX(CASE WHEN lo = 1 THEN time_slot END) AS quiet_time_slot, MAX(CASE WHEN lo = 1 THEN revenue END) AS quiet_revenue
   FROM slot_place LEFT JOIN changes USING (scope_type, scope_value) GROUP BY 1, 2)
"""
PRICED = scoped("w", "aw") + slots("aw", KEYS) + prices(KEYS) + PRICE_SUMMARY

RECORDS = INSIGHT + PRICE_SUMMARY + ads("aw", KEYS) + f"""
, ad1 AS (SELECT * FROM (SELECT {S}, title AS top_ad_title, ad_score AS top_ad_score,
   COUNT(*) OVER (PARTITION BY {S}) AS ad_candidates, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY {AD_ORDER}) AS rn FROM ads) WHERE rn = 1)
, records AS (SELECT {S}, label, period_start, period_end, total_tickets, total_revenue, avg_occupancy, growth_revenue,
   top_ad_title, top_ad_score, COALESCE(ad_candidates, 0) AS ad_candidates,
   COALESCE(recommended_changes, 0) AS recommended_changes, peak_time_slot, suggested_action AS top_price_action, title, description, recommendation, action_items,
   impact_level, category, 'fallback' AS ai_source, 'fallback-local' AS ai_model
   FROM insight LEFT JOIN ad1 USING (scope_type, scope_value) LEFT JOIN price_summary USING (scope_type, scope_value)
   LEFT JOIN (SELECT * FROM top_prices WHERE position = 1) tp USING (scope_type, scope_value))
"""

START2, END2 = "2024-02-12", "2024-02-25"


def later(query: str) -> str:
    """The same query over the 14 days after the window."""
    second = f"BETWEEN DATE '{START2}' AND DATE '{END2}'"
    return (
        query.replace(base.WINDOW, "@w")
        .replace(base.PREVIOUS, base.WINDOW)
        .replace("@w", second)
        .replace(f"'{START}' AS period_start, '{END}' AS period_end", f"'{START2}' AS period_start, '{END2}' AS period_end")
    )


FIRST = sql(RECORDS + "SELECT * FROM records")
RUN1, RUN2, RUN3 = "2024-02-12 03:00:00", "2024-02-26 03:00:00", "2024-02-26 04:00:00"
STORED = f"""WITH stored AS (
  SELECT *, '{RUN1}' AS created_at, '{RUN3}' AS updated_at FROM ({FIRST})
  UNION ALL SELECT *, '{RUN2}' AS created_at, '{RUN2}' AS updated_at FROM ({later(FIRST)}))
"""

RESPONSES = """
WITH base AS (SELECT event_id, event_type, value, event_id % 6 AS k FROM events)
SELECT event_id AS response_id,
  CASE WHEN k = 3 OR k = 4 OR event_type = '' THEN 'Fallback ' || event_type ELSE 'Insight ' || event_type END AS title,
  CASE WHEN k = 3 OR k = 4 THEN 'Fallback text' ELSE 'Text of ' || CAST(event_id AS VARCHAR) END AS description,
  'Fallback advice' AS recommendation,
  CASE WHEN k IN (0, 1) THEN 'first|second' ELSE 'review' END AS action_items,
  CASE WHEN k IN (0, 1) THEN 'high' WHEN k = 5 THEN 'low' ELSE 'medium' END AS impact_level,
  CASE WHEN k IN (0, 1, 2) THEN 'tickets' ELSE 'growth' END AS category,
  CAST(CASE WHEN k = 2 THEN 1 ELSE 0 END AS BIGINT) AS recommended_count FROM base
"""

QUERIES = {
    "scope_list": sql(SCOPES + "SELECT * FROM scopes"),
    "scope_expand": sql(
        scoped("(SELECT * FROM shows WHERE show_date " + base.WINDOW + ")", "sw")
        + SCOPES
        + f"SELECT schedule_id, {S}, label FROM sw JOIN scopes USING (scope_type, scope_value)"
    ),
    "scope_metrics": sql(SUMS + "SELECT * FROM metrics"),
    "scope_time_slots": sql(scoped("w", "aw") + slots("aw", KEYS) + "SELECT * FROM slots"),
    "scope_peak_quiet": sql(
        scoped("w", "aw")
        + slots("aw", KEYS)
        + f""", a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY revenue DESC, time_slot) AS hi,
          ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY revenue, time_slot) AS lo FROM slots)
        SELECT {S}, h.time_slot AS peak_time_slot, h.revenue AS peak_revenue, h.demand AS peak_demand,
        h.occupancy AS peak_occupancy, h.recommendation AS peak_recommendation, l.time_slot AS quiet_time_slot,
        l.revenue AS quiet_revenue, l.demand AS quiet_demand
        FROM (SELECT * FROM a WHERE hi = 1) h JOIN (SELECT * FROM a WHERE lo = 1) l USING (scope_type, scope_value)"""
    ),
    "scope_pricing": sql(ACTIONS + "SELECT * FROM top_prices"),
    "scope_ad_slots": sql(
        scoped("w", "aw")
        + ads("aw", KEYS)
        + f"""SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {S} ORDER BY {AD_ORDER}) AS position,
        COUNT(*) OVER (PARTITION BY {S}) AS total_candidates FROM ads) WHERE position <= 3"""
    ),
    "scope_pricing_summary": sql(PRICED + "SELECT * FROM price_summary"),
    "move_to_larger_studio": sql(ACTIONS + f"{PUBLIC} c_move"),
    "reduce_showtimes": sql(ACTIONS + f"{PUBLIC} c_reduce"),
    "promotion_opportunity": sql(ACTIONS + f"{PUBLIC} c_promo"),
    "premium_pricing": sql(ACTIONS + f"{PUBLIC} c_premium"),
    "candidate_actions": sql(ACTIONS + BEST + "SELECT * FROM best"),
    "scope_insight": sql(INSIGHT + "SELECT * FROM insight"),
    "insight_upsert": STORED + "SELECT * FROM stored",
    "stream_upsert": STORED + "SELECT * FROM stored",
    "insight_history": STORED
    + f"SELECT * FROM stored WHERE scope_type = 'city' AND period_start >= '{START}' AND period_end <= '{END2}'",
    "insight_history_count": STORED
    + f"""SELECT COUNT(*) AS total, CAST(CEIL(COUNT(*) / 3.0) AS BIGINT) AS total_pages FROM stored
        WHERE scope_type = 'city' AND period_start >= '{START}' AND period_end <= '{END2}'""",
    "insight_latest_page": STORED
    + f"SELECT * FROM stored WHERE period_end = '{END2}' ORDER BY updated_at DESC, scope_type, scope_value LIMIT 40 OFFSET 40",
    "insight_latest": STORED + f"SELECT * FROM stored WHERE period_end = '{END2}'",
    "insight_latest_counts": STORED
    + f"""SELECT COUNT(*) AS total_items, """
    + ", ".join(f"COUNT(CASE WHEN scope_type = '{k}' THEN 1 END) AS {k}_count" for k in ("global", "city", "cinema", "studio"))
    + f" FROM stored WHERE period_end = '{END2}'",
    "insight_payload_normalized": RESPONSES,
}
