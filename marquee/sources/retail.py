"""Views that give a retail star schema the shape of the base tables.

Customers are rooms, nations venues, regions cities, orders shows, order lines tickets
and parts titles. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.frames import attach
from marquee.schemas import EVENTS
from marquee.sources.tables import Tables

# Declared layouts: a read then needs no pass over the files to find them.
LAYOUT = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_size int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
    "l_discount double, l_returnflag string, l_shipdate timestamp_ntz",
}

# Titles that a third of all shows is spread over; the others are spread over all titles.
HOT_TITLES = 48


def _folded_day(column: str) -> str:
    """Move a date of several years into the 56 days that the shows are spread over."""
    return f"date_add(DATE'2024-01-01', CAST(datediff({column}, DATE'1995-01-01') % 56 AS INT))"


_LISTED = "replace(p_name, ' ', ', ')"

# What each base table takes from its source.
CINEMA = (
    "CAST(n_nationkey AS LONG) AS cinema_id",
    "n_name AS cinema_name",
    "r_name AS city",
    "concat_ws(', ', n_name, r_name) AS address",
)
STUDIO = (
    "c_custkey AS studio_id",
    "CAST(c_nationkey AS LONG) AS cinema_id",
    "c_name AS studio_name",
    "IF(c_custkey % 50 = 0, 0, 4 + (c_custkey % 5) * 2) AS total_capacity",
    "nullif(c_mktsegment, 'MACHINERY') AS screen_type",
)
MOVIES = (
    "p_partkey AS movie_id",
    "concat(p_name, ' #', p_partkey) AS title",
    f"CASE p_partkey % 16 WHEN 0 THEN NULL WHEN 1 THEN concat({_LISTED}, ', ') ELSE {_LISTED} END AS genre",
    "CASE p_partkey % 5 WHEN 1 THEN 'SU' WHEN 2 THEN '13+' WHEN 3 THEN '17+' WHEN 4 THEN '21+' END AS rating_usia",
    "CAST(80 + p_size AS LONG) AS duration_min",
)
SCHEDULES = (
    "o_orderkey AS schedule_id",
    f"(o_orderkey * 7 + o_custkey) % IF(o_orderkey % 3 = 0, {HOT_TITLES}, _titles) AS movie_id",
    "o_custkey AS studio_id",
    f"{_folded_day('o_orderdate')} AS show_date",
    "concat(10 + 3 * (o_orderkey % 4), IF(o_custkey % 3 = 0, ':30:00', ':00:00')) AS start_time",
    "CAST(o_totalprice AS DECIMAL(18,4)) AS price",
    """CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'Cancelled'
            WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN 'canceled'
            WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN 'Delayed'
            WHEN o_orderstatus <> 'O' THEN 'scheduled' END AS status""",
)
TIKET = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS tiket_id",
    "l_orderkey AS schedule_id",
    "CASE l_returnflag WHEN 'A' THEN 'Regular' WHEN 'N' THEN 'VIP' WHEN 'R' THEN 'Sweetbox' END AS seat_category",
    "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS final_price",
    f"CAST({_folded_day('l_shipdate')} AS TIMESTAMP) + make_dt_interval(0, 0, CAST(l_partkey % 1440 AS INT), 0)"
    " AS trans_time",
    """CASE l_linenumber WHEN 1 THEN 'Cash' WHEN 2 THEN 'Debit Card' WHEN 3 THEN 'credit_card' WHEN 4 THEN 'QRIS'
       WHEN 5 THEN 'ewallet' WHEN 6 THEN 'voucher' END AS payment_type""",
)


def read_retail(spark: SparkSession, root: str) -> Tables:
    def raw(name: str) -> DataFrame:
        return spark.read.schema(LAYOUT[name]).parquet(f"{root}/{name}.parquet")

    titles = raw("part").agg(F.count(F.lit(1)).alias("_titles"))
    return Tables(
        spark=spark,
        cinema=raw("nation").join(raw("region"), F.expr("n_regionkey = r_regionkey")).selectExpr(*CINEMA),
        studio=raw("customer").selectExpr(*STUDIO),
        movies=raw("part").selectExpr(*MOVIES),
        schedules=attach(raw("orders"), titles, "_titles").selectExpr(*SCHEDULES),
        tiket=raw("lineitem").selectExpr(*TIKET),
    )


def read_events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{root}/events.parquet")
