from __future__ import annotations

import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marquee import schemas  # noqa: E402
from marquee.session import local_session  # noqa: E402
from marquee.sources.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class House:
    """A small hand-made chain; tests add what they need."""

    def __init__(self, spark):
        self.spark = spark
        self.rows = {name: [] for name in schemas.BASE_TABLES}

    def cinema(self, key="C1", name="One", city="Jakarta"):
        self.rows["cinema"].append((key, name, city, f"{name} street"))
        return self

    def studio(self, key="S1", cinema="C1", capacity=10, name=None, screen="IMAX"):
        self.rows["studio"].append((key, cinema, name or f"Room {key}", capacity, screen))
        return self

    def movie(self, key="M1", title=None, genre="Drama, Action", rating="SU", minutes=100):
        self.rows["movies"].append((key, title or f"Title {key}", genre, rating, minutes))
        return self

    def show(self, key, day, movie="M1", studio="S1", start="19:00:00", status="scheduled", sold=0, price=10, **ticket):
        self.rows["schedules"].append((key, movie, studio, date.fromisoformat(day), start, Decimal(price), status))
        for i in range(sold):
            when = ticket.get("when") or datetime.fromisoformat(f"{day} 12:00:00")
            self.rows["tiket"].append(
                (f"{key}-{i}", key, ticket.get("seat", "Regular"), Decimal(price), when, ticket.get("pay", "Cash"))
            )
        return self

    def tables(self) -> Tables:
        frames = {n: self.spark.createDataFrame(self.rows[n], schemas.BASE_TABLES[n]) for n in schemas.BASE_TABLES}
        return Tables(spark=self.spark, **frames)


@pytest.fixture
def house(spark):
    return House(spark).cinema().studio().movie()


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by(frame, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in frame.collect()}
