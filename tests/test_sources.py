import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kerbside.plans import poll
from kerbside.sources import bronze as source
from tests.conftest import DEFAULT_READING, reading

API_FIELDS = {k: v for k, v in DEFAULT_READING.items() if k != "ingested_at"}


@pytest.fixture
def pages(spark):
    def make(*payloads):
        texts = [(p if isinstance(p, str) else json.dumps(p),) for p in payloads]
        return spark.createDataFrame(texts, "payload string")

    return make


def parsed(frame):
    good, skipped = source.parse_pages(frame)
    return [r.asDict() for r in good.collect()], skipped.first().asDict()


class TestPages:
    def test_values_are_kept(self, pages):
        rows, counts = parsed(pages({"total_count": 900, "results": [API_FIELDS]}))
        assert rows == [API_FIELDS] and counts == {"records": 1, "skipped": 0}

    def test_null_absent_and_empty_counts_are_zero(self, pages):
        absent = {k: v for k, v in API_FIELDS.items() if k != "total_of_directions"}
        rows, _ = parsed(pages({"results": [{**absent, "direction_1": None, "direction_2": ""}]}))
        assert [rows[0][c] for c in source.COUNT_FIELDS] == [0, 0, 0]

    def test_quoted_numbers_are_read(self, pages):
        rows, _ = parsed(pages({"results": [{**API_FIELDS, "location_id": "12", "direction_1": "3"}]}))
        assert (rows[0]["location_id"], rows[0]["direction_1"]) == (12, 3)

    @pytest.mark.parametrize(
        "damage",
        [{"location_id": None}, {"location_id": "north"}, {"direction_2": "many"}],
    )
    def test_a_bad_record_costs_only_itself(self, pages, damage):
        rows, counts = parsed(pages({"results": [{**API_FIELDS, **damage}, API_FIELDS]}))
        assert rows == [API_FIELDS] and counts == {"records": 2, "skipped": 1}

    @pytest.mark.parametrize("field", ["location_id", *source.TEXT_IDENTITY])
    def test_a_missing_identity_field_skips_the_record(self, pages, field):
        short = {k: v for k, v in API_FIELDS.items() if k != field}
        rows, counts = parsed(pages({"results": [short]}))
        assert rows == [] and counts["skipped"] == 1

    @pytest.mark.parametrize("payload", [{"results": []}, {}, {"results": None}, "{cut off"])
    def test_pages_without_records(self, pages, payload):
        rows, counts = parsed(pages(payload))
        assert rows == [] and counts == {"records": 0, "skipped": 0}

    def test_whole_numbers_of_every_json_kind(self, pages):
        """The id and the counts are what ``int`` makes of a value, and of a falsy
        count's 0, or the record is skipped."""
        values = [
            5, -7, 0, 3.7, -3.7, 0.0, 1e2, 2147483647, -2147483648, True, False, None, [], {}, [1],
            {"a": 1}, "", " ", "5", " 5\t", "+5", "-5", "5.0", "3.7", "1e2", "0x5", "1_000", "1__0",
            "_1", "1_", "five", "true", "\u0665", "\uff11\uff12", "\u00a05\u2003", "\x1f5", "5 5",
            "0005", "--5", "5\u0301", "\ufeff5", "null", "None",
        ]

        def whole(value):
            try:
                return int(value)
            except (TypeError, ValueError):
                return None

        for field, want in (
            ("location_id", [whole(v) for v in values]),
            ("direction_1", [whole(v or 0) for v in values]),
        ):
            found = source.coerce_records(
                source.explode_pages(pages(*[{"results": [{**API_FIELDS, field: v}]} for v in values]))
            ).collect()
            got = [None if r.is_malformed else r[field] for r in found]
            assert dict(zip(map(repr, values), got)) == dict(zip(map(repr, values), want))

    def test_numbers_beyond_an_int_skip_the_record(self, pages):
        rows, counts = parsed(pages({"results": [{**API_FIELDS, "direction_1": v}
                                                 for v in (2**31, 1e300, "99999999999")]}))
        assert rows == [] and counts["skipped"] == 3

    def test_odd_records_and_texts(self, pages):
        odd = {**API_FIELDS, "sensing_date": 20260311, "sensing_time": None}
        rows, counts = parsed(pages({"results": [odd, "text", 5, None, [], API_FIELDS]}))
        assert counts == {"records": 6, "skipped": 4}
        assert [(r["sensing_date"], r["sensing_time"]) for r in rows] == [
            ("20260311", None), (API_FIELDS["sensing_date"], API_FIELDS["sensing_time"]),
        ]

    def test_of_a_repeated_key_the_last_value_counts(self, pages):
        record = json.dumps(API_FIELDS)[:-1] + ', "direction_1": 99}'
        rows, _ = parsed(pages('{"results": [' + record + "]}"))
        assert [r["direction_1"] for r in rows] == [99]

    def test_records_carry_key_and_ingestion_time(self, pages):
        readings, _ = source.parse_pages(pages({"results": [API_FIELDS]}))
        at = F.lit("2026-03-11 03:00:00").cast("timestamp")
        row = source.to_records(readings, at).first()
        assert row["dedupe_key"] == "7#2026-03-11T02:30:00+00:00"
        assert row["ingested_at"] == "2026-03-11T03:00:00+00:00"
        line = source.to_ndjson(source.to_records(readings, at)).first()
        assert line["key"] == "7" and json.loads(line["value"]) == row.asDict()


class TestBronzeScan:
    @pytest.fixture
    def root(self, tmp_path):
        for day, hour, lines in [
            ("2026-03-10", "07", [json.dumps(reading(location_id=1))]),
            ("2026-03-11", "00", [json.dumps(reading(location_id=2)), "{broken"]),
            ("2026-03-14", "23", [json.dumps({**reading(location_id=3), "extra": 1, "direction_1": "x"})]),
        ]:
            folder = tmp_path / f"dt={day}" / f"hour={hour}"
            folder.mkdir(parents=True)
            (folder / "part.json").write_text("\n".join(lines) + "\n")
        return str(tmp_path)

    def test_partition_values_stay_text(self, spark, root):
        rows = source.read_bronze(spark, root).collect()
        assert {(r["dt"], r["hour"]) for r in rows} >= {("2026-03-10", "07"), ("2026-03-11", "00")}
        assert len(rows) == 4

    def test_only_declared_days_are_listed(self, spark, root):
        frame = source.read_bronze(spark, root, "2026-03-09", "2026-03-11")
        assert sorted({r["dt"] for r in frame.collect()}) == ["2026-03-10", "2026-03-11"]
        assert all("2026-03-14" not in f for f in frame.inputFiles())

    def test_no_folder_in_range_gives_no_rows(self, spark, root):
        assert source.read_bronze(spark, root, "2030-01-01", "2030-01-02").count() == 0

    def test_day_filter_prunes_partitions(self, spark, root):
        frame = source.on_arrival_day(source.read_bronze(spark, root), "2026-03-10")
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(dt" in plan
        assert [r["location_id"] for r in frame.collect()] == [1]

    def test_odd_values_become_null_and_broken_lines_are_kept_aside(self, spark, root):
        rows = source.read_bronze(spark, root, keep_corrupt=True).collect()
        odd = [r for r in rows if r["location_id"] == 3][0]
        assert odd["direction_1"] is None
        assert [r["_corrupt_record"] for r in rows if r["location_id"] is None] == ["{broken"]


class TestMark:
    def test_missing_and_unreadable_marks_mean_the_epoch(self, spark, tmp_path):
        assert poll.read_mark(spark, str(tmp_path / "none")) == poll.EPOCH
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "m.json").write_text('{"last_event_ts": "soon"}\nnot json\n')
        assert poll.read_mark(spark, str(tmp_path / "bad")) == poll.EPOCH

    def test_never_moves_back(self, spark, tmp_path):
        path = str(tmp_path / "mark")
        for hour in (5, 9, 7):
            poll.write_mark(spark, path, datetime(2026, 3, 11, hour), 1)
        assert poll.read_mark(spark, path) == datetime(2026, 3, 11, 9)

    def test_lands_what_is_new_once(self, spark, bronze, tmp_path):
        rows = bronze(*[reading(sensing_datetime=f"2026-03-11T0{h}:00:00+00:00") for h in (1, 2, 3)])
        mark, out = str(tmp_path / "mark"), str(tmp_path / "out")
        poll.write_mark(spark, mark, datetime(2026, 3, 11, 2), 1)

        def sink(df):
            df.write.mode("append").json(out)

        first = poll.land_new(spark, rows, mark, sink)
        assert (first["status"], first["fetched"], first["new"]) == ("ok", 3, 1)
        assert poll.read_mark(spark, mark) == datetime(2026, 3, 11, 3)
        second = poll.land_new(spark, rows, mark, sink)
        assert (second["status"], second["emitted"]) == ("no_new_data", 0)
        assert source.read_readings(spark, out).count() == 1

    def test_refused_readings_are_counted_and_offered_again(self, spark, bronze, tmp_path):
        out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
        rows = bronze(reading(location_id=1), reading(location_id=2), reading(location_id=3))

        def sink(df):
            df.filter("location_id < 3").write.mode("append").json(out)
            return df.count() - source.read_readings(spark, out).count()

        got = poll.land_new(spark, rows, mark, sink)
        assert got == {
            "status": "partial_failure", "fetched": 3, "new": 3, "emitted": 2, "failed": 1
        }
        assert poll.read_mark(spark, mark) == poll.EPOCH

    def test_mark_stays_when_the_sink_fails(self, spark, bronze, tmp_path):
        def sink(df):
            raise OSError("storage is away")

        with pytest.raises(OSError):
            poll.land_new(spark, bronze(reading()), str(tmp_path / "mark"), sink)
        assert poll.read_mark(spark, str(tmp_path / "mark")) == poll.EPOCH

    def test_unreadable_times_are_passed_on(self, spark, bronze, tmp_path):
        out = str(tmp_path / "out")
        poll.land_new(
            spark,
            bronze(reading(sensing_datetime="never"), reading()),
            str(tmp_path / "mark"),
            lambda df: df.write.json(out),
        )
        assert source.read_readings(spark, out).count() == 2

    @pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
    def test_pages_of_any_size_land_each_reading_once(self, spark, bronze, tmp_path, size):
        """Ties in time, copies of one reading and unreadable times, over a cut."""
        at = "2026-03-11T0{}:00:00+00:00".format
        rows = [reading(location_id=k, sensing_datetime=at(h)) for h in (1, 2) for k in (3, 1, 2)]
        rows += [reading(location_id=None, sensing_datetime=at(2))]
        rows += [rows[1], rows[1]]
        rows += [reading(location_id=k, sensing_datetime="never") for k in (5, 6)]
        mark, out = str(tmp_path / "mark"), str(tmp_path / "out")

        def sink(df):
            df.write.mode("append").json(out)

        pages = poll.land_pages(spark, bronze(*rows), mark, sink, size)
        assert sum(p["emitted"] for p in pages) == len(rows)
        assert all(p["new"] <= size + 2 for p in pages)
        later = [reading(location_id=9, sensing_datetime=at(3)), reading(sensing_datetime="soon")]
        poll.land_pages(spark, bronze(*rows, *later), mark, sink, size)
        assert poll.land_new(spark, bronze(*rows, *later), mark, sink)["status"] == "no_new_data"
        landed = source.read_readings(spark, out)
        got = sorted((r.location_id or 0, r.sensing_datetime) for r in landed.collect())
        assert got == sorted((r["location_id"] or 0, r["sensing_datetime"]) for r in rows + later)

    def test_a_sink_that_runs_no_job_does_not_hang(self, spark, bronze, tmp_path):
        got = poll.land_new(spark, bronze(reading()), str(tmp_path / "mark"), lambda df: 1)
        assert (got["status"], got["failed"]) == ("partial_failure", 1)
        assert poll.read_mark(spark, str(tmp_path / "mark")) == poll.EPOCH

    def test_a_refused_page_is_offered_again(self, spark, bronze, tmp_path):
        rows = bronze(*[reading(location_id=k, sensing_datetime="never") for k in (1, 2, 3)])
        mark, out = str(tmp_path / "mark"), str(tmp_path / "out")
        poll.land_new(spark, rows, mark, lambda df: 1, max_records=2)
        done = poll.land_pages(spark, rows, mark, lambda df: df.write.mode("append").json(out), 2)
        assert [p["new"] for p in done] == [2, 1]
        assert source.read_readings(spark, out).count() == 3
