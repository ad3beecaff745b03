"""Schemas of the base tables and of stored data."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


MONEY = T.DecimalType(18, 4)

TIKET = _struct(
    ("tiket_id", T.StringType()),
    ("schedule_id", T.StringType()),
    ("seat_category", T.StringType()),
    ("final_price", MONEY),
    ("trans_time", T.TimestampType()),
    ("payment_type", T.StringType()),
)
SCHEDULES = _struct(
    ("schedule_id", T.StringType()),
    ("movie_id", T.StringType()),
    ("studio_id", T.StringType()),
    ("show_date", T.DateType()),
    ("start_time", T.StringType()),
    ("price", MONEY),
    ("status", T.StringType()),
)
MOVIES = _struct(
    ("movie_id", T.StringType()),
    ("title", T.StringType()),
    ("genre", T.StringType()),
    ("rating_usia", T.StringType()),
    ("duration_min", T.IntegerType()),
)
STUDIO = _struct(
    ("studio_id", T.StringType()),
    ("cinema_id", T.StringType()),
    ("studio_name", T.StringType()),
    ("total_capacity", T.IntegerType()),
    ("screen_type", T.StringType()),
)
CINEMA = _struct(
    ("cinema_id", T.StringType()),
    ("cinema_name", T.StringType()),
    ("city", T.StringType()),
    ("address", T.StringType()),
)
BASE_TABLES = {
    "tiket": TIKET,
    "schedules": SCHEDULES,
    "movies": MOVIES,
    "studio": STUDIO,
    "cinema": CINEMA,
}

# One stored insight per (scope_type, scope_value, period_start, period_end).
INSIGHT = _struct(
    ("scope_type", T.StringType()),
    ("scope_value", T.StringType()),
    ("scope_meta", T.StringType()),
    ("period_start", T.DateType()),
    ("period_end", T.DateType()),
    ("summary_snapshot", T.StringType()),
    ("ad_score_snapshot", T.StringType()),
    ("pricing_snapshot", T.StringType()),
    ("ai_payload", T.StringType()),
    ("title", T.StringType()),
    ("description", T.StringType()),
    ("recommendation", T.StringType()),
    ("action_items", T.StringType()),
    ("impact_level", T.StringType()),
    ("category", T.StringType()),
    ("ai_source", T.StringType()),
    ("ai_model", T.StringType()),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
)

# Layout of the generated insight text inside ``ai_payload``.
ACTION_PAYLOAD = _struct(
    ("action_type", T.StringType()),
    ("priority", T.StringType()),
    ("title", T.StringType()),
    ("description", T.StringType()),
    ("reason", T.StringType()),
    ("expected_impact", T.StringType()),
    ("city", T.StringType()),
    ("cinema_name", T.StringType()),
    ("studio_name", T.StringType()),
    ("movie_title", T.StringType()),
    ("schedule_time", T.StringType()),
    ("occupancy", T.DoubleType()),
    ("color", T.StringType()),
    ("icon", T.StringType()),
)
INSIGHT_PAYLOAD = _struct(
    ("title", T.StringType()),
    ("description", T.StringType()),
    ("recommendation", T.StringType()),
    ("action_items", T.ArrayType(T.StringType())),
    ("impact_level", T.StringType()),
    ("category", T.StringType()),
    ("recommended_actions", T.ArrayType(ACTION_PAYLOAD)),
)

READ_LOG = _struct(("notification_id", T.StringType()), ("read_at", T.TimestampType()))

EVENTS = _struct(
    ("event_id", T.LongType()),
    ("ts", T.TimestampNTZType()),
    ("user_id", T.LongType()),
    ("event_type", T.StringType()),
    ("value", T.DoubleType()),
    ("props", T.StringType()),
)
