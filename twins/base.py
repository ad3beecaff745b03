"""SQL pieces of the check queries: the base tables, the windows and rounding."""

from __future__ import annotations

START, END = "2024-01-29", "2024-02-11"
PREV_START, PREV_END = "2024-01-15", "2024-01-28"
AS_OF = "2024-02-25"

_FOLD = "DATE '2024-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST({c} AS DATE)) % 56 AS INTEGER)"


def r2(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 2) AS DOUBLE)"


def money(x: str) -> str:
    return r2(f"COALESCE({x}, 0)")


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END"


def rratio(a: str, b: str) -> str:
    return r2(ratio(a, b))


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {r2(f'CAST({a} AS DOUBLE) * 100.0 / CAST({b} AS DOUBLE)')} ELSE CAST(0 AS DOUBLE) END"


def growth(c: str, p: str) -> str:
    c, p = f"CAST({c} AS DOUBLE)", f"CAST({p} AS DOUBLE)"
    return (
        f"CASE WHEN {p} = 0 THEN CASE WHEN {c} > 0 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
        f"ELSE {r2(f'({c} - {p}) / {p} * 100.0')} END"
    )


def minmax(v: str, lo: str, hi: str) -> str:
    v, lo, hi = (f"CAST({x} AS DOUBLE)" for x in (v, lo, hi))
    return (
        f"CASE WHEN {hi} = {lo} THEN CASE WHEN {v} > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
        f"ELSE ({v} - {lo}) / ({hi} - {lo}) END"
    )


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def num(x: str) -> str:
    """A number with two digits, without closing zeros."""
    return f"regexp_replace(regexp_replace(printf('%.2f', {x}), '0+$', ''), '\\.$', '')"


WINDOW = f"BETWEEN DATE '{START}' AND DATE '{END}'"
PREVIOUS = f"BETWEEN DATE '{PREV_START}' AND DATE '{PREV_END}'"
SALE_WINDOW = f"CAST(trans_time AS DATE) {WINDOW}"

BASE = f"""
WITH cinema AS (
  SELECT CAST(n_nationkey AS BIGINT) AS cinema_id, n_name AS cinema_name, r_name AS city,
         n_name || ', ' || r_name AS address
  FROM nation JOIN region ON n_regionkey = r_regionkey
), studio AS (
  SELECT c_custkey AS studio_id, CAST(c_nationkey AS BIGINT) AS cinema_id, c_name AS studio_name,
         CAST(CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE 4 + (c_custkey % 5) * 2 END AS BIGINT) AS total_capacity,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS screen_type
  FROM customer
), movies AS (
  SELECT p_partkey AS movie_id, p_name || ' #' || CAST(p_partkey AS VARCHAR) AS title,
         CASE WHEN p_partkey % 16 = 0 THEN NULL
              WHEN p_partkey % 16 = 1 THEN replace(p_name, ' ', ', ') || ', '
              ELSE replace(p_name, ' ', ', ') END AS genre,
         CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'SU' WHEN 2 THEN '13+' WHEN 3 THEN '17+' ELSE '21+' END
           AS rating_usia,
         CAST(80 + p_size AS BIGINT) AS duration_min
  FROM part
), schedules AS (
  SELECT o_orderkey AS schedule_id, (o_orderkey * 7 + o_custkey) % CASE WHEN o_orderkey % 3 = 0 THEN 48 ELSE (SELECT COUNT(*) FROM part) END AS movie_id, o_custkey AS studio_id,
         {_FOLD.format(c='o_orderdate')} AS show_date,
         CAST(10 + 3 * (o_orderkey % 4) AS VARCHAR) || CASE WHEN o_custkey % 3 = 0 THEN ':30:00' ELSE ':00:00' END
           AS start_time,
         CAST(o_totalprice AS DECIMAL(18,4)) AS price,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'Cancelled'
              WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN 'canceled'
              WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN 'Delayed'
              WHEN o_orderstatus = 'O' THEN NULL ELSE 'scheduled' END AS status
  FROM orders
), tiket AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)
           || '-' || CAST(l_suppkey AS VARCHAR) AS tiket_id,
         l_orderkey AS schedule_id,
         CASE l_returnflag WHEN 'A' THEN 'Regular' WHEN 'N' THEN 'VIP' WHEN 'R' THEN 'Sweetbox' END AS seat_category,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS final_price,
         CAST({_FOLD.format(c='l_shipdate')} AS TIMESTAMP) + to_minutes(CAST(l_partkey % 1440 AS INTEGER))
           AS trans_time,
         CASE l_linenumber WHEN 1 THEN 'Cash' WHEN 2 THEN 'Debit Card' WHEN 3 THEN 'credit_card' WHEN 4 THEN 'QRIS'
              WHEN 5 THEN 'ewallet' WHEN 6 THEN 'voucher' END AS payment_type
  FROM lineitem
), shows AS (
  SELECT s.*, st.cinema_id, st.studio_name, st.total_capacity, st.screen_type, c.cinema_name, c.city, c.address,
         split_part(start_time, ':', 1) || ':00' AS time_slot,
         CAST(split_part(start_time, ':', 1) AS BIGINT) AS start_hour
  FROM schedules s JOIN studio st ON s.studio_id = st.studio_id JOIN cinema c ON st.cinema_id = c.cinema_id
), facts AS (
  SELECT schedule_id, movie_id, studio_id, show_date, start_time, price, status, cinema_id, studio_name,
         total_capacity, screen_type, cinema_name, city, address, time_slot, start_hour,
         COUNT(tiket_id) AS tickets, COALESCE(SUM(final_price), 0) AS revenue,
         {ratio('COUNT(tiket_id)', 'total_capacity')} AS seat_share
  FROM shows LEFT JOIN tiket USING (schedule_id)
  GROUP BY schedule_id, movie_id, studio_id, show_date, start_time, price, status, cinema_id, studio_name,
         total_capacity, screen_type, cinema_name, city, address, time_slot, start_hour
), w AS (SELECT * FROM facts WHERE show_date {WINDOW}),
p AS (SELECT * FROM facts WHERE show_date {PREVIOUS}),
sold AS (
  SELECT tiket.*, shows.* EXCLUDE (schedule_id, price, status), CAST(trans_time AS DATE) AS sale_date
  FROM tiket JOIN shows USING (schedule_id)
), sold_w AS (SELECT * FROM sold WHERE show_date {WINDOW}),
sold_txn AS (SELECT * FROM sold WHERE sale_date {WINDOW}),
genre_of AS (
  SELECT movie_id, trim(g) AS g FROM movies, unnest(string_split(COALESCE(genre, ''), ',')) AS u(g) WHERE trim(g) <> ''
)"""


def sql(body: str) -> str:
    """``body`` is either a SELECT or more CTEs (starting with a comma) and a SELECT."""
    return BASE + ("\n" if not body.lstrip().startswith(",") else "") + body


GENRE_TEXT = (
    "CASE WHEN COALESCE(genre, '') = '' THEN '' "
    "ELSE array_to_string(list_transform(string_split(genre, ','), lambda x: trim(x)), '|') END"
)
