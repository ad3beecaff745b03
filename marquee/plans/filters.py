"""The common parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(value: str | date | None) -> date | None:
    if value is None or value == "":
        return None
    return value if isinstance(value, date) else date.fromisoformat(value)


@dataclass(frozen=True)
class Filters:
    """Date window and scope. Every part is optional; an empty text switches a part off."""

    start: date | str | None = None
    end: date | str | None = None
    city: str | None = None
    cinema_id: object = None
    studio_id: object = None
    movie_id: object = None
    payment_type: str | None = None
    rating_usia: str | None = None
    as_of: date | str | None = None

    def __post_init__(self):
        for name in ("start", "end", "as_of"):
            object.__setattr__(self, name, parse_day(getattr(self, name)))
        if (self.start is None) != (self.end is None):
            raise ValueError("start and end must be given together")
        if self.start and self.start > self.end:
            raise ValueError("start must not be after end")

    @classmethod
    def period(cls, period: str, as_of: date | str, **scope) -> Filters:
        """The default window of a period name, counted back from ``as_of``."""
        days = {"daily": 0, "weekly": 7, "monthly": 30}
        if period not in days:
            raise ValueError(f"unknown period: {period}")
        day = parse_day(as_of)
        return cls(start=day - timedelta(days=days[period]), end=day, as_of=day, **scope)

    @classmethod
    def rolling(cls, as_of: date | str, days: int = 14, **scope) -> Filters:
        """The last ``days`` days, ``as_of`` included."""
        day = parse_day(as_of)
        return cls(start=day - timedelta(days=days - 1), end=day, as_of=day, **scope)

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def between(self, start: date, end: date) -> Filters:
        return replace(self, start=start, end=end)

    def previous(self) -> Filters:
        """The window of equal length that ends the day before this one starts."""
        return self.between(self.start - timedelta(days=self.days), self.start - timedelta(days=1))

    def with_previous(self) -> Filters:
        """One window over this one and the one before it, to scan both at once."""
        return self.between(self.previous().start, self.end)

    def without_dates(self) -> Filters:
        return replace(self, start=None, end=None)

    def scoped(self, **scope) -> Filters:
        return replace(self, **scope)

    # Predicates. Operators apply them to joined frames; Spark moves each one to its scan.

    def scope(self, *names: str) -> Column:
        """AND of the equality parts that are set, out of ``names``."""
        condition = F.lit(True)
        for name in names:
            value = getattr(self, name)
            if value not in (None, ""):
                condition = condition & (F.col(name) == F.lit(value))
        return condition

    def show_window(self, column: str = "show_date") -> Column:
        """Both ends belong to the window."""
        if self.start is None:
            return F.lit(True)
        return F.col(column).between(F.lit(self.start), F.lit(self.end))

    def in_window(self, column: str = "show_date") -> Column:
        return F.col(column).between(F.lit(self.start), F.lit(self.end))

    def sale_window(self, column: str = "trans_time") -> Column:
        """From the first moment of the first day to before the day after the last."""
        if self.start is None:
            return F.lit(True)
        low = F.lit(self.start).cast("timestamp")
        high = F.lit(self.end + timedelta(days=1)).cast("timestamp")
        return (F.col(column) >= low) & (F.col(column) < high)
