"""Stored insights: upsert, versions, older layouts, latest and history."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest

from marquee.operators import insights
from marquee.schemas import INSIGHT
from marquee.session import new_folder, shared_folder
from marquee.sources.snapshots import SnapshotStore, conform, merge
from tests.conftest import by

class FakeSession:
    """What the choice of the shared folder looks at."""

    def __init__(self, master, setting=None):
        self.conf = self
        self.setting = setting
        self.sparkContext = self
        self.master, self.applicationId = master, f"{master}-app"

    def get(self, key, default):
        return self.setting or default

    def getCheckpointDir(self):
        return None


def test_shared_folder():
    assert shared_folder(FakeSession("spark://host", "s3a://bucket/tmp/")) == "s3a://bucket/tmp"
    local = FakeSession("local[2]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(ValueError):
        shared_folder(FakeSession("spark://host"))


T1, T2, T3 = (datetime(2024, 3, d, 3) for d in (1, 2, 3))


def rows(spark, *items):
    names = INSIGHT.fieldNames()
    out = []
    for kind, value, start, title, at in items:
        row = dict.fromkeys(names)
        row.update(scope_type=kind, scope_value=value, period_start=date.fromisoformat(start), title=title)
        row.update(period_end=date.fromisoformat(start), created_at=at, updated_at=at)
        out.append(tuple(row[n] for n in names))
    return spark.createDataFrame(out, INSIGHT)


def test_merge(spark):
    old = rows(spark, ("city", "Jakarta", "2024-02-01", "old", T1), ("global", "", "2024-02-01", "kept", T1))
    new = rows(spark, ("city", "Jakarta", "2024-02-01", "new", T2), ("city", "Bandung", "2024-02-01", "added", T2))
    got = by(merge(old, new), "scope_type", "scope_value")
    assert len(got) == 3 and got[("global", "")]["title"] == "kept"
    changed = got[("city", "Jakarta")]
    assert (changed["title"], changed["created_at"], changed["updated_at"]) == ("new", T1, T2)


def test_merge_prefers_newer_then_incoming(spark):
    old = rows(spark, ("city", "A", "2024-02-01", "old", T2), ("city", "B", "2024-02-01", "old", T2))
    new = rows(spark, ("city", "A", "2024-02-01", "late", T1), ("city", "B", "2024-02-01", "same time", T2))
    got = by(merge(old, new), "scope_value")
    assert (got["A"]["title"], got["B"]["title"]) == ("old", "same time")
    assert got["A"]["created_at"] == T1


def test_store_versions(spark):
    store = SnapshotStore(spark, new_folder(spark, "store"))
    assert store.read().count() == 0
    assert store.upsert(rows(spark, ("city", "A", "2024-02-01", "one", T1))) == 1
    assert store.upsert(rows(spark, ("city", "A", "2024-02-01", "two", T2), ("global", "", "2024-02-01", "g", T2))) == 2
    assert by(store.read(), "scope_type")["city"]["title"] == "two"
    # the same batch once more changes nothing
    store.upsert(rows(spark, ("city", "A", "2024-02-01", "two", T2)))
    assert store.read().count() == 2
    # a version without a pointer is not seen
    rows(spark, ("city", "Z", "2024-02-01", "lost", T3)).write.partitionBy("period_end").parquet(f"{store.root}/data/version=9")
    assert by(store.read(), "scope_type").keys() == {"city", "global"}


def test_store_touches_only_the_periods_of_a_run(spark):
    store = SnapshotStore(spark, new_folder(spark, "store"))
    store.upsert(rows(spark, ("city", "A", "2024-02-01", "old", T1), ("city", "A", "2024-02-15", "kept", T1)))
    store.upsert(rows(spark, ("city", "A", "2024-02-01", "new", T2), ("city", "B", "2024-02-29", "added", T2)))
    assert store.upsert(rows(spark)) == 2
    got = by(store.read(), "period_end")
    assert {str(k): r["title"] for k, r in got.items()} == {
        "2024-02-01": "new",
        "2024-02-15": "kept",
        "2024-02-29": "added",
    }
    versions = {day: number for day, (number, _) in store._newest().items()}
    assert versions == {date(2024, 2, 1): 2, date(2024, 2, 15): 1, date(2024, 2, 29): 2}
    assert store.read({date(2024, 2, 15)}).count() == 1


def test_older_layout(spark):
    old = spark.createDataFrame([(None, None, date(2024, 2, 1), date(2024, 2, 2), "t")], "scope_type string, scope_value string, period_start date, period_end date, title string")
    row = conform(old).first()
    assert (row["scope_type"], row["scope_value"], row["title"], row["ai_model"]) == ("global", "", "t", None)
    assert conform(old).schema.fieldNames() == INSIGHT.fieldNames()


@pytest.fixture(scope="module")
def history(spark):
    return rows(
        spark,
        ("city", "A", "2024-02-01", "a1", T3),
        ("city", "A", "2024-02-15", "a2", T1),
        ("city", "B", "2024-02-15", "b", T1),
        ("global", "", "2024-02-01", "g", T2),
    )


def test_latest_is_by_period_first(history):
    assert by(insights.insight_latest(history), "scope_value")["A"]["title"] == "a2"
    assert insights.insight_latest(history, "global").count() == 1
    assert insights.insight_latest_counts(history).first().asDict() == {
        "total_items": 3,
        "global_count": 1,
        "city_count": 2,
        "cinema_count": 0,
        "studio_count": 0,
    }


def test_history(history):
    def titles(**k):
        return [r["title"] for r in insights.insight_history(history, page_number=1, **k).collect()]

    assert titles() == ["a2", "b", "a1", "g"]
    assert titles(scope_type="city", scope_value="A") == ["a2", "a1"]
    assert titles(start="2024-02-10") == ["a2", "b"]
    assert titles(end="2024-02-10") == ["a1", "g"]
    assert titles(limit=1) == ["a2"]


def test_records_are_json(house):
    house.show("A", "2024-03-05", sold=5).show("B", "2024-03-05", sold=1)
    stored = insights.insight_records(house.tables(), "2024-03-10", T3)
    row = by(stored, "scope_type")["global"]
    assert json.loads(row["summary_snapshot"])["total_tickets"] == 6
    payload = json.loads(row["ai_payload"])
    assert payload["source"] == "fallback" and payload["insight"]["recommended_actions"][0]["color"] == "red"
    assert json.loads(row["action_items"]) == [payload["insight"]["recommended_actions"][0]["title"]]
    assert json.loads(row["scope_meta"])["label"] == "Global"
    assert len(json.loads(row["ad_score_snapshot"])["top_slots"]) == 1


RAW = {
    "fenced": '```json\n{"title": " A ", "impact_level": "HIGH"}\n```',
    "prose": 'Sure: {"title": "B", "category": "Tickets", "action_items": [" x ", "", null]} done',
    "broken": '{"title": "C"',
    "array": "[1, 2]",
    "missing": None,
    "wrong": '{"title": "", "impact_level": "urgent", "category": "weather", "action_items": []}',
    "actions": '{"recommended_actions": [{"title": "t", "description": "d", "action_type": " Premium_Pricing ", '
    '"priority": "LOW", "occupancy": 81.456}, {"title": "t", "description": " "}]}',
}


def test_raw_responses(spark):
    fallback = ("F", "text", "advice", ["review"], "medium", "growth")
    responses = spark.createDataFrame(
        [(k, v, *fallback) for k, v in RAW.items()],
        "response_id string, raw_text string, title string, description string, recommendation string, "
        "action_items array<string>, impact_level string, category string",
    )
    got = by(insights.insight_payload_normalized(responses), "response_id")
    assert {k: r["title"] for k, r in got.items()} == {
        "fenced": "A", "prose": "B", "broken": "F", "array": "F", "missing": "F", "wrong": "F", "actions": "F",
    }
    assert got["fenced"]["impact_level"] == "high" and got["wrong"]["impact_level"] == "medium"
    assert got["prose"]["category"] == "tickets" and got["wrong"]["category"] == "growth"
    assert got["prose"]["action_items"] == ["x"] and got["wrong"]["action_items"] == ["review"]
    actions = got["actions"]["recommended_actions"]
    assert len(actions) == 1
    assert (actions[0]["action_type"], actions[0]["priority"], actions[0]["color"]) == ("premium_pricing", "low", "green")
    assert actions[0]["occupancy"] == 81.46 and actions[0]["city"] is None


def test_runs_share_one_rollup_and_give_the_records_of_each(spark, monkeypatch):
    from marquee.catalog import RUNS
    from marquee.plans import facts
    from marquee.sources.retail import read_retail

    t, built, once = read_retail(spark, "/root/testdata/sf0.001"), [], facts.with_rollup
    monkeypatch.setattr(facts, "with_rollup", lambda *given: built.append(1) or once(*given))
    together = [sorted(map(str, frame.collect())) for frame in insights.insight_runs(t, RUNS[:2])]
    assert len(built) == 1
    assert together == [sorted(map(str, insights.insight_records(t, *run).collect())) for run in RUNS[:2]]
    assert len(built) == 3


def test_ad_slots_of_few_scopes_stay_where_they_are(spark):
    """Only the extremes of rooms are joined by shuffling titles."""
    from marquee.operators import scopes
    from marquee.plans.filters import Filters
    from marquee.sources.retail import read_retail

    f = Filters.rolling("2024-02-11")
    plan = scopes.scope_ad_slots(read_retail(spark, "/root/testdata/sf0.001"), f)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 1 and "lineitem" not in plan
