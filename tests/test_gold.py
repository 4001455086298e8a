import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kerbside.operators import gold, quality, scd2, silver
from kerbside.plans import scd2 as scd2_plan
from kerbside.sources import versions
from tests.conftest import reading


@pytest.fixture
def stg(bronze):
    def make(*rows):
        return gold.staging_view(silver.transform(bronze(*rows))[0])

    return make


def minutes(location_id, start, count, **changes):
    first = datetime.fromisoformat(start)
    return [
        reading(
            location_id=location_id,
            sensing_datetime=(first + timedelta(minutes=n)).isoformat() + "+00:00",
            **changes,
        )
        for n in range(count)
    ]


class TestStar:
    def test_fact_has_one_row_per_sensor_and_hour(self, stg):
        rows = minutes(1, "2026-03-11T02:00:00", 90) + minutes(2, "2026-03-11T02:00:00", 15)
        fact = gold.star_schema(stg(*rows))["fact_footfall_hourly"]
        got = {
            (r["event_hour"], r["minutes_reported"], r["pedestrian_count"], r["reading_completeness"])
            for r in fact.collect()
        }
        assert got == {(13, 60, 780, 1.0), (14, 30, 390, 0.5), (13, 15, 195, 0.25)}
        assert fact.select("footfall_key").distinct().count() == 3

    def test_dimensions_agree_from_readings_and_from_hours(self, stg):
        rows = minutes(1, "2026-03-13T12:30:00", 95) + minutes(2, "2026-03-14T02:00:00", 5)
        view = stg(*rows)
        star = gold.star_schema(view)
        direct = gold.dim_sensor(gold.observe_sensors(view))
        assert sorted(map(str, star["dim_sensor"].collect())) == sorted(map(str, direct.collect()))
        assert sorted(map(str, star["dim_date"].collect())) == sorted(
            map(str, gold.dim_date(view).collect())
        )

    def test_date_dimension_counts_from_monday(self, stg):
        rows = [reading(sensing_datetime=f"2026-03-{d}T02:00:00+00:00") for d in (14, 15, 16)]
        got = {
            r["date_day"].day: (r["day_of_week"], r["is_weekend"])
            for r in gold.dim_date(stg(*rows)).collect()
        }
        assert got == {14: (6, True), 15: (7, True), 16: (1, False)}

    def test_folded_dst_hour_may_exceed_sixty_minutes(self, stg):
        fact = gold.star_schema(stg(*minutes(1, "2026-04-04T15:00:00", 120)))["fact_footfall_hourly"]
        assert [r["minutes_reported"] for r in fact.collect()] == [120]
        assert fact.filter(quality.too_many_minutes()).count() == 1
        assert fact.filter(quality.too_many_minutes(dst_aware=True)).count() == 0

    def test_unknown_sensor_keeps_its_facts(self, stg):
        hourly = gold.hourly_counts(stg(*minutes(1, "2026-03-11T02:00:00", 1)))
        dim = gold.dim_sensor(gold.observe_sensors_hourly(hourly)).filter("location_id = 99")
        assert gold.fact_hourly(hourly, dim).first()["sensor_key"] is None


START = datetime(2026, 1, 1)


def feed_frame(spark, rows):
    return spark.createDataFrame(rows, "location_id int, observed_ts timestamp, street string")


def expected_versions(rows):
    out = []
    for key in {r[0] for r in rows}:
        latest = {}
        for _, ts, street in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            latest[ts] = street
        runs = []
        for ts in sorted(latest):
            if not runs or runs[-1][1] != latest[ts]:
                runs.append((ts, latest[ts]))
        ends = [ts for ts, _ in runs[1:]] + [None]
        out += [(key, street, ts, end, end is None) for (ts, street), end in zip(runs, ends)]
    return sorted(out, key=str)


def version_rows(df):
    return sorted(
        (
            (r["location_id"], r["street"], r["valid_from"], r["valid_to"], r["is_current"])
            for r in df.collect()
        ),
        key=str,
    )


def random_feed(seed, size, hot=0.4):
    rng = random.Random(seed)
    return [
        (
            1 if rng.random() < hot else rng.randint(2, 6),
            START + timedelta(hours=rng.randint(0, 24 * 9)),
            rng.choice(["A", "B", "C"]),
        )
        for _ in range(size)
    ]


class TestVersions:
    def test_a_repeat_opens_no_version(self, spark):
        days = [(5, START + timedelta(days=d), s) for d, s in enumerate("AABA")]
        assert version_rows(scd2.build_versions(feed_frame(spark, days), ["street"])) == (
            expected_versions(days)
        )
        assert len(expected_versions(days)) == 3

    @pytest.mark.parametrize("chunk", ["hour", "day", "month"])
    def test_chunks_do_not_change_the_versions(self, spark, chunk):
        rows = random_feed(3, 300)
        built = scd2.build_versions(feed_frame(spark, rows), ["street"], chunk=chunk)
        assert version_rows(built) == expected_versions(rows)

    def test_keys_differ_within_one_second(self, spark):
        rows = [(1, START + timedelta(milliseconds=n), "AB"[n % 2]) for n in range(9)]
        built = scd2.build_versions(feed_frame(spark, rows), ["street"])
        assert built.select("sensor_key").distinct().count() == 9

    def test_merging_in_parts_equals_building_at_once(self, spark):
        rows = sorted(random_feed(4, 200), key=lambda r: r[1])
        first = scd2.build_versions(feed_frame(spark, rows[:120]), ["street"])
        seen, new = feed_frame(spark, rows[:120]), feed_frame(spark, rows[120:])
        merged = scd2.merge_versions(first, seen, new, ["street"])
        assert version_rows(merged) == expected_versions(rows)

    def test_late_rows_split_the_version_they_fall_in(self, spark):
        day = lambda n, state: (1, START + timedelta(days=n), state)
        rows = [day(1, "A"), day(2, "A"), day(4, "A"), day(5, "A"), day(10, "B")]
        other = [(2, START + timedelta(days=3), "A")]
        late = [day(3, "B")]
        built = scd2.build_versions(feed_frame(spark, rows + other), ["street"])
        seen = feed_frame(spark, rows + other)
        merged = scd2.merge_versions(built, seen, feed_frame(spark, late), ["street"])
        assert version_rows(merged) == expected_versions(rows + other + late)
        assert merged.filter("location_id = 1").count() == 4


class TestPointInTime:
    @pytest.fixture
    def frames(self, spark):
        versions = scd2.build_versions(feed_frame(spark, random_feed(5, 200)), ["street"])
        versions = versions.select("location_id", "street", "valid_from", "valid_to")
        # One version is closed early, leaving a gap after it.
        closed = F.when(
            (F.col("location_id") == 2) & F.col("valid_to").isNotNull(),
            F.col("valid_from") + F.expr("INTERVAL 1 MINUTE"),
        ).otherwise(F.col("valid_to"))
        versions = versions.withColumn("valid_to", closed)
        rng = random.Random(6)
        readings = [
            (n, rng.choice([1, 1, 2, 3, 9, None]), START + timedelta(hours=rng.randint(-30, 300)))
            for n in range(400)
        ] + [(400, 1, None)]
        frame = spark.createDataFrame(readings, "n int, location_id int, at_ts timestamp")
        return frame, versions

    def expected(self, frame, versions):
        known = versions.collect()
        out = []
        for r in frame.collect():
            hits = [
                v["street"]
                for v in known
                if v["location_id"] == r["location_id"]
                and r["at_ts"] is not None
                and v["valid_from"] <= r["at_ts"]
                and (v["valid_to"] is None or r["at_ts"] < v["valid_to"])
            ]
            assert len(hits) <= 1
            out.append((r["n"], hits[0] if hits else None))
        return sorted(out)

    @pytest.mark.parametrize("chunk", ["hour", "day", "month"])
    def test_time_line_join(self, spark, frames, chunk):
        got = scd2.point_in_time_join(*frames, "at_ts", "location_id", chunk)
        assert sorted((r["n"], r["street"]) for r in got.collect()) == self.expected(*frames)

    @pytest.mark.parametrize("more", [0, 40])
    def test_of_overlapping_versions_the_later_counts(self, spark, more):
        day = lambda n: START + timedelta(days=n)
        known = [(1, "a", day(1), day(32)), (1, "b", day(10), day(12))]
        known += [(1, f"x{n}", day(100 + n), day(101 + n)) for n in range(more)]
        versions = spark.createDataFrame(
            known, "location_id int, street string, valid_from timestamp, valid_to timestamp"
        )
        frame = spark.createDataFrame(
            [(n, 1, day(n)) for n in (0, 5, 11, 20)], "n int, location_id int, at_ts timestamp"
        )
        got = scd2.point_in_time_join(frame, versions, "at_ts")
        assert sorted((r["n"], r["street"]) for r in got.collect()) == [
            (0, None), (5, "a"), (11, "b"), (20, None)
        ]


class TestQuality:
    @pytest.fixture
    def tables(self, stg):
        view = stg(*minutes(1, "2026-03-11T02:00:00", 61), *minutes(2, "2026-03-11T02:00:00", 3))
        star = gold.star_schema(view)
        return {"silver_pedestrian": view, **star}

    def failed(self, tables):
        report = quality.run_checks(tables).collect()
        assert len(report) == 16
        return {(r["table_name"], r["rule"]): r["violations"] for r in report if not r["passed"]}

    def test_clean_tables_pass(self, tables):
        assert self.failed(tables) == {}
        quality.require_passed(quality.run_checks(tables))

    def test_each_kind_of_rule_can_fail(self, tables):
        fact, name = tables["fact_footfall_hourly"], "fact_footfall_hourly"
        broken = (
            fact.unionByName(fact)
            .withColumn("event_hour", F.when(F.col("event_hour") == 13, 24))
            .withColumn("minutes_reported", F.lit(61))
            .withColumn("date_key", F.lit("1999-01-01").cast("date"))
            .withColumn("sensor_key", F.when(F.col("event_hour") == 24, "nobody"))
        )
        assert self.failed({**tables, name: broken}) == {
            (name, "not_null_event_hour"): 2,
            (name, "range_event_hour"): 4,
            (name, "minutes_within_bounds"): 6,
            (name, "unique_footfall_key"): 3,
            (name, "reference_date_key"): 6,
            (name, "reference_sensor_key"): 4,
        }
        with pytest.raises(quality.QualityError, match="unique_footfall_key=3"):
            quality.require_passed(quality.run_checks({**tables, name: broken}))

    def test_null_points_nowhere(self, spark):
        child = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, "z")], "n int, k string")
        parent = spark.createDataFrame([("a",), (None,)], "id string")
        assert {r["n"] for r in quality.orphans(child, "k", parent, "id").collect()} == {3, 4}
        assert quality.orphan_keys(child, "k", parent, "id").collect() == [("z", 2)]

    def test_reconciliation_notices_lost_rows(self, bronze):
        rows = [reading(), reading(), reading(location_id=8), reading(location_id=None)]
        typed = silver.parse_and_type(bronze(*rows))
        clean = silver.transform(bronze(*rows))[0]
        good = quality.reconcile(typed, clean, silver.is_valid()).first()
        assert (good["duplicate_rows"], good["quarantined_rows"], good["reconciled"]) == (1, 1, True)
        short = quality.reconcile(typed, clean.filter("location_id = 8"), silver.is_valid()).first()
        assert short["reconciled"] is False

    def test_freshness(self, bronze):
        frame = bronze(reading(ingested_at="2026-03-11T02:40:00+00:00"))

        def state(mark, now):
            times = [F.lit(t).cast("timestamp") for t in (mark, now)]
            row = quality.freshness(frame, *times).first()
            return row["has_new_data"], row["waited_seconds"], row["is_stale"]

        assert state("2026-03-11 02:40:00", "2026-03-11 05:00:00") == (False, None, False)
        assert state("2026-03-11 02:00:00", "2026-03-11 02:55:00") == (True, 900, False)
        assert state("2026-03-11 02:00:00", "2026-03-11 02:55:01") == (True, 901, True)


class TestVersionLog:
    """Versions kept up in a root: any order of arrival, near days only."""

    def feed(self, spark, rows):
        return spark.createDataFrame(
            [(k, datetime(2026, 3, d, h), s) for k, d, h, s in rows],
            "location_id int, observed_ts timestamp, status string",
        )

    def seen(self, df):
        return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())

    def check(self, spark, root, rows):
        want = scd2.build_versions(self.feed(spark, rows), ["status"])
        got = scd2_plan.read_versions(spark, root, ["status"])
        assert self.seen(got) == self.seen(want)

    def test_any_order_equals_building_anew(self, spark, tmp_path):
        draw, root, so_far = random.Random(4), str(tmp_path / "log"), []
        rows = [
            (k, draw.choice([1, 2, 3, 9, 10, 28]), draw.randrange(24), draw.choice("ab"))
            for k in (1, 2, 3, 4)
            for _ in range(14)
        ]
        draw.shuffle(rows)
        rows += [(1, 2, 5, None), rows[0], (5, 20, 1, "a")]
        for at in range(0, len(rows), 20):
            so_far += rows[at : at + 20]
            scd2_plan.add_observations(
                spark, root, self.feed(spark, rows[at : at + 20]), ["status"]
            )
            self.check(spark, root, so_far)

    def test_a_late_row_splits_and_mends(self, spark, tmp_path):
        """Within a run, at the edge of a day, before the first and after the last
        observation, and on a day between; a load repeated changes nothing."""
        root = str(tmp_path / "log")
        rows = [(1, d, h, "open") for d in (5, 6, 12) for h in (0, 23)]
        late = [(1, 6, 12, "shut"), (1, 12, 0, "open"), (1, 8, 3, "shut"), (1, 1, 0, "shut"),
                (1, 28, 0, "open"), (1, 8, 3, "open")]
        scd2_plan.add_observations(spark, root, self.feed(spark, rows), ["status"])
        for row in (late[0], late[2], late[3]):
            rows.append(row)
            scd2_plan.add_observations(spark, root, self.feed(spark, [row]), ["status"])
            self.check(spark, root, rows)
        scd2_plan.add_observations(spark, root, self.feed(spark, [late[2]]), ["status"])
        rest = self.feed(spark, [*late, late[0]]).withColumn("extra", F.lit(1))
        scd2_plan.add_observations(spark, root, rest, ["status"])
        self.check(spark, root, rows + late)
        nothing = [(None, 1, 0, "open")]
        scd2_plan.add_observations(spark, root, self.feed(spark, nothing), ["status"])
        self.check(spark, root, rows + late)

    def test_rows_of_a_load_are_joined_by_shuffles(self, spark, tmp_path, monkeypatch):
        """Files of a load look small to Spark however many rows are in them."""
        root, plans = str(tmp_path / "log"), []
        kept, store = scd2_plan.FeedLoad._kept, scd2_plan.FeedLoad._store

        def watched(call, rows_at):
            def run(self, *args):
                plans.append(args[rows_at]._jdf.queryExecution().executedPlan().toString())
                return call(self, *args)

            return run

        rows = [(k, d, 12, "open") for k in (1, 2) for d in (3, 4, 9)]
        scd2_plan.add_observations(spark, root, self.feed(spark, rows), ["status"])
        monkeypatch.setattr(scd2_plan.FeedLoad, "_kept", watched(kept, 0))
        monkeypatch.setattr(scd2_plan.FeedLoad, "_store", watched(store, 2))
        late = [(1, 6, 12, "shut"), (2, 4, 13, "shut")]
        scd2_plan.add_observations(spark, root, self.feed(spark, late), ["status"])
        read = scd2_plan.read_versions(spark, root, ["status"])
        plans.append(read._jdf.queryExecution().executedPlan().toString())
        assert sum("SortMergeJoin" in plan for plan in plans) > 4
        assert not [plan for plan in plans if "BroadcastHashJoin" in plan]
        self.check(spark, root, rows + late)

    def test_a_load_reads_days_near_its_rows(self, spark, tmp_path, monkeypatch):
        root, asked = str(tmp_path / "log"), set()
        rows = [(k, d, 12, "open") for k in (1, 2) for d in range(1, 29)]
        scd2_plan.add_observations(spark, root, self.feed(spark, rows), ["status"])
        read = versions.read

        def watched(spark, root, name, parts=None, resolved=None):
            if name != scd2_plan.SPANS:
                asked.update(parts)
            return read(spark, root, name, parts, resolved)

        monkeypatch.setattr(versions, "read", watched)
        scd2_plan.add_observations(spark, root, self.feed(spark, [(1, 15, 18, "shut")]), ["status"])
        assert asked == {"2026-03-14", "2026-03-15", "2026-03-16"}
        monkeypatch.undo()
        self.check(spark, root, [*rows, (1, 15, 18, "shut")])
