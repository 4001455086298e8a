import json
from datetime import date

import pytest

from kerbside.operators import bronze_reports, incremental, serving, silver
from tests.conftest import reading

FACTS = (
    "sensor_key string, location_id int, date_key date, event_hour int, is_weekend boolean, "
    "day_of_week int, pedestrian_count bigint"
)
WEEKDAY, WEEKEND = date(2026, 3, 11), date(2026, 3, 14)


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        (key, location, day, hour, day == WEEKEND, 7 if day == WEEKEND else 4, (hour + 2) * scale)
        for key, location, scale in [("north", 3, 1), ("south", 4, 7)]
        for day in (WEEKDAY, WEEKEND)
        for hour in range(24)
        if not (day == WEEKEND and hour == 5)
    ]
    rows.append((None, None, WEEKDAY, 3, False, 4, 1000))
    return spark.createDataFrame(rows, FACTS)


def test_headline(facts):
    got = serving.headline_metrics(facts).first().asDict()
    assert got == {
        "total_readings": 95,
        "distinct_sensors": 2,
        "distinct_hours": 47,
        "peak_count": 1000,
    }


def test_busiest_sensors(facts):
    assert [r["sensor_key"] for r in serving.busiest_sensors(facts).collect()] == ["south", "north"]
    assert serving.busiest_sensors(facts, top_n=1).count() == 1


def test_average_by_hour_is_in_order(facts):
    rows = serving.average_by_hour(facts).collect()
    assert [r["event_hour"] for r in rows] == list(range(24))
    assert rows[0]["avg_count"] == 8.0


def test_profile_has_only_what_occurs(facts):
    rows = serving.hourly_profile(facts).collect()
    assert len(rows) == 47
    assert {r["day_type"] for r in rows} == {"weekday", "weekend"}


def test_dense_profile_has_zero_for_an_empty_hour(facts):
    got = {(r["event_hour"], r["day_type"]): r["avg_count"] for r in serving.dense_hourly_profile(facts).collect()}
    assert len(got) == 48
    assert (got[5, "weekend"], got[5, "weekday"], got[3, "weekday"]) == (0, 28, 346)


def test_current_is_the_mean_at_the_largest_hour_of_day(facts):
    got = {r["location_id"]: (r["total"], r["current"]) for r in serving.sensor_totals(facts).collect()}
    assert got == {3: (641, 25), 4: (641 * 7, 175)}


def test_latest_hour_is_by_date(spark):
    rows = [("k", 3, WEEKDAY, 23, False, 4, 50), ("k", 3, WEEKEND, 2, True, 7, 9)]
    frame = spark.createDataFrame(rows, FACTS)
    assert serving.latest_hour_counts(frame).first()["pedestrian_count"] == 9
    assert serving.sensor_totals(frame).first()["current"] == 50


def test_unknown_locations_are_dropped(spark):
    frame = spark.createDataFrame([(3, 1), (8, 2)], "location_id int, total int")
    rows = serving.located(frame, serving.sensor_locations(spark)).collect()
    assert [(r["location_id"], r["name"]) for r in rows] == [(3, "Melbourne Central")]


def test_load_bands(spark):
    frame = spark.createDataFrame([(1, 100), (2, 67), (3, 66), (4, 34), (5, 0)], "location_id int, current int")
    got = {r["location_id"]: r["band"] for r in serving.with_load(frame).collect()}
    assert got == {1: "high", 2: "high", 3: "medium", 4: "medium", 5: "low"}
    zero = serving.with_load(frame.filter("current = 0")).first()
    assert (zero["load"], zero["band"]) == (None, "low")


def test_joins_differ_on_retired_sensors(spark, facts):
    dim = spark.createDataFrame(
        [("north", 3, True), ("south", 4, False)], "sensor_key string, location_id int, is_current boolean"
    )
    slim = facts.drop("location_id")
    assert serving.facts_of_current_sensors(slim, dim).count() == 47
    kept = serving.facts_with_current_sensor(slim, dim)
    assert (kept.count(), kept.filter("location_id IS NULL").count()) == (95, 48)


def test_snapshot_document(spark, facts):
    row = serving.snapshot(facts, serving.sensor_locations(spark)).toJSON().first()
    got = json.loads(row)
    assert [s["id"] for s in got["sensors"]] == [3, 4]
    assert set(got["sensors"][0]) == {"id", "name", "lat", "lon", "total", "current"}
    assert [len(got["hourly"][d]) for d in ("weekday", "weekend")] == [24, 24]
    weekday = got["hourly"]["weekday"]
    assert got["forecast"] == {
        "from_hour": 15,
        "actual": weekday[9:16],
        "predicted": weekday[15:22],
    }
    assert got["meta"] == {"total_readings": 95, "gold_facts": 95, "sensor_versions": 2}


class TestBronzeReports:
    @pytest.fixture
    def rows(self, bronze):
        return bronze(
            reading(location_id=1, total_of_directions=5),
            reading(location_id=1, total_of_directions=5),
            reading(location_id=2, total_of_directions=10, dedupe_key=None),
            reading(location_id=3, total_of_directions=None, sensing_datetime="2026-03-11T02:31:00+00:00"),
        )

    def test_summary(self, rows):
        assert tuple(bronze_reports.summary(rows).first()) == (
            4, 3, "2026-03-11T02:30:00+00:00", "2026-03-11T02:31:00+00:00",
        )

    def test_busiest_breaks_ties_by_sensor(self, rows):
        got = [tuple(r) for r in bronze_reports.busiest(rows).collect()]
        assert got == [(1, 10, 2), (2, 10, 1), (3, None, 1)]

    def test_duplicates_count_missing_keys(self, rows):
        assert tuple(bronze_reports.duplicates(rows).first()) == (4, 2, 2)

    def test_latest_lag(self, rows):
        got = bronze_reports.latest_lag(rows, 1).first()
        assert (got["location_id"], got["lag_seconds"]) == (3, 540)


class TestIncrements:
    def test_the_mark_itself_is_not_new(self, spark, bronze):
        from datetime import datetime

        rows = bronze(*[reading(sensing_datetime=f"2026-03-11T0{h}:00:00+00:00") for h in (1, 2, 3)])
        timed = incremental.with_event_time(rows)
        got = incremental.filter_new(timed, datetime(2026, 3, 11, 2)).collect()
        assert [r["sensing_datetime"][11:13] for r in got] == ["03"]
        assert incremental.filter_new(timed, incremental.EPOCH).count() == 3

    def test_state_and_rolling_sums(self, bronze):
        rows = [
            reading(location_id=1, sensing_datetime=f"2026-03-11T02:{m:02d}:00+00:00", direction_1=m)
            for m in (0, 7, 59)
        ]
        clean, _ = silver.transform(bronze(*rows))
        assert incremental.current_state(clean).first()["direction_1"] == 59
        tumbling = incremental.rolling_counts(clean, slide=None).collect()
        assert [(r["pedestrians"], r["minutes_reported"]) for r in tumbling] == [(66 + 24, 3)]
        assert incremental.rolling_counts(clean).agg({"minutes_reported": "sum"}).first()[0] == 36
