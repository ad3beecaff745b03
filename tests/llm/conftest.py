from __future__ import annotations

import pytest

from marquee.llm.shipping import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def engine(spark):
    return ship(spark)


@pytest.fixture
def documents(engine):
    """Documents from ``(doc_id, text)`` pairs or whole rows."""

    def make(rows, lang="en"):
        full = [r if len(r) == 5 else (*r, lang, "src", len(r[1] or "")) for r in rows]
        return engine.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def small(engine):
    return lambda name: engine.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def clashing(frame, *names):
    """The frame with extra columns that are named as results and helpers are."""
    from pyspark.sql import functions as F

    for name in names:
        frame = frame.withColumn(name, F.lit("x"))
    return frame
