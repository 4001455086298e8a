import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kerbside.operators import incremental, serving, silver
from kerbside.operators.quality import QualityError, RowRule, RuleSet
from kerbside.plans import forecast as forecast_plan
from kerbside.plans import gold as gold_plan
from kerbside.plans import silver as silver_plan
from kerbside.plans import snapshot as snapshot_plan
from kerbside.schemas import SOURCE_COLUMN
from kerbside.sources import sinks, versions
from kerbside.sources.bronze import read_bronze
from kerbside.streaming import landing, rolling
from kerbside.streaming import silver as silver_stream
from tests.conftest import reading


def at(day, hour=2, **changes):
    return reading(sensing_datetime=f"2026-03-{day}T{hour:02d}:30:00+00:00", **changes)


def land(root, dt, hour, rows):
    folder = root / f"dt={dt}" / f"hour={hour}"
    folder.mkdir(parents=True, exist_ok=True)
    name = f"part-{len(list(folder.iterdir()))}.json"
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def failing(*_, **__):
    raise RuntimeError("driver lost")


def content(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.fixture
def paths(tmp_path):
    names = ["bronze", "silver", "gold", "checkpoint"]
    return {n: str(tmp_path / n) for n in names} | {"root": tmp_path / "bronze"}


def rebuild(spark, paths):
    return silver_plan.rebuild_silver(spark, paths["bronze"], paths["silver"])


def add(spark, paths, day):
    return silver_plan.add_arrivals(spark, paths["bronze"], paths["silver"], day, day)


def tables(spark, root):
    return content(silver_plan.read_silver(spark, root)), content(
        silver_plan.read_quarantine(spark, root)
    )


def files_of(spark, root, name):
    """The data files readers use, by part."""
    found = {}
    for row in versions.live(spark, root):
        if row.name == name and row.part is not None:
            folder = Path(versions._folder(root, row.load, name)) / f"{versions.PART}={row.part}"
            found[row.part] = sorted(p.name for p in folder.glob("*.parquet"))
    return found


class TestSilverJobs:
    @pytest.fixture(autouse=True)
    def landed(self, paths):
        land(paths["root"], "2026-03-11", "02", [at(11), at(11, 3), at(12), reading(location_id=None)])
        land(paths["root"], "2026-03-12", "01", [
            at(11, direction_1=50, ingested_at="2026-03-12T01:00:00+00:00"),
            at(11, 4),
            at(14),
            reading(location_id=-1),
            reading(location_id=-1),
        ])

    def test_rebuild_counts_and_repeats(self, spark, paths):
        assert rebuild(spark, paths) == {"bronze_rows": 9, "quarantined_rows": 3}
        first, bad = tables(spark, paths["silver"])
        rebuild(spark, paths)
        assert tables(spark, paths["silver"]) == (first, bad)
        assert (len(first), len(bad)) == (5, 3)

    def test_tables_equal_the_operators(self, spark, paths):
        rebuild(spark, paths)
        want, unusable = silver.transform(read_bronze(spark, paths["bronze"], keep_corrupt=True))
        assert content(silver_plan.read_silver(spark, paths["silver"])) == content(want)
        kept = silver_plan.read_quarantine(spark, paths["silver"]).drop(SOURCE_COLUMN)
        assert content(kept) == content(unusable.select(*kept.columns))

    def test_bronze_is_scanned_once(self, spark, paths, capsys):
        bronze = read_bronze(spark, paths["bronze"], keep_corrupt=True, with_source=True)
        rows = silver.silver_and_quarantine(bronze, silver_plan.QUARANTINE_SCHEMA)
        sinks.in_silver_layout(rows, "table", "day").explain("formatted")
        assert capsys.readouterr().out.count("Scan json") == 2  # in the tree, and its details

    def test_no_bad_rows_no_quarantine_parts(self, spark, tmp_path):
        land(tmp_path / "clean", "2026-03-11", "02", [at(11)])
        silver_plan.rebuild_silver(spark, str(tmp_path / "clean"), str(tmp_path / "s"))
        assert silver_plan.read_quarantine(spark, str(tmp_path / "s")).count() == 0
        assert silver_plan.read_silver(spark, str(tmp_path / "s")).count() == 1

    def test_reading_before_any_commit_is_an_error(self, spark, paths):
        with pytest.raises(ValueError, match="no version"):
            silver_plan.read_silver(spark, paths["silver"])

    def test_adding_days_equals_rebuilding(self, spark, paths):
        for day in ("2026-03-11", "2026-03-12", "2026-03-12"):
            add(spark, paths, day)
        added = tables(spark, paths["silver"])
        rebuild(spark, paths)
        assert tables(spark, paths["silver"]) == added

    def test_days_without_arrivals_change_nothing(self, spark, paths):
        rebuild(spark, paths)
        before = tables(spark, paths["silver"])
        add(spark, paths, "2031-01-01")
        assert tables(spark, paths["silver"]) == before

    def test_parts_are_days_and_untouched_ones_keep_their_files(self, spark, paths):
        rebuild(spark, paths)
        silver_parts = files_of(spark, paths["silver"], "silver")
        assert set(silver_parts) == {"2026-03-11", "2026-03-12", "2026-03-14"}
        assert set(files_of(spark, paths["silver"], "quarantine")) == {"2026-03-11"}
        add(spark, paths, "2026-03-12")
        after = files_of(spark, paths["silver"], "silver")
        assert after["2026-03-12"] == silver_parts["2026-03-12"]
        assert after["2026-03-11"] != silver_parts["2026-03-11"]

    def test_filters_on_the_event_date_prune_parts(self, spark, paths, capsys):
        rebuild(spark, paths)
        rows = silver_plan.read_silver(spark, paths["silver"]).filter("event_date = '2026-03-14'")
        assert rows.count() == 1
        rows.explain("formatted")
        assert "PartitionFilters: [isnotnull(part_of" in capsys.readouterr().out

    @pytest.mark.parametrize("step", ["write_tables", "written_parts", "commit", "_append"])
    def test_a_rebuild_that_dies_changes_nothing(self, spark, paths, monkeypatch, step):
        """Whatever step it dies in, a day added after it gives a clean run."""
        add(spark, paths, "2026-03-11")
        before = tables(spark, paths["silver"])
        with monkeypatch.context() as patch:
            patch.setattr(versions, step, failing)
            with pytest.raises(RuntimeError, match="driver lost"):
                rebuild(spark, paths)
        assert tables(spark, paths["silver"]) == before
        add(spark, paths, "2026-03-12")
        after = tables(spark, paths["silver"])
        rebuild(spark, paths)
        assert tables(spark, paths["silver"]) == after

    @pytest.mark.parametrize("step", ["write", "commit"])
    def test_a_load_that_dies_is_repeated(self, spark, paths, monkeypatch, step):
        add(spark, paths, "2026-03-11")
        before = tables(spark, paths["silver"])
        with monkeypatch.context() as patch:
            patch.setattr(versions, step, failing)
            with pytest.raises(RuntimeError):
                add(spark, paths, "2026-03-12")
        assert tables(spark, paths["silver"]) == before
        add(spark, paths, "2026-03-12")
        want = silver.transform(read_bronze(spark, paths["bronze"]))[0]
        assert content(silver_plan.read_silver(spark, paths["silver"])) == content(want)

    def test_a_rebuild_replaces_what_was_there(self, spark, paths, tmp_path):
        rebuild(spark, paths)
        land(tmp_path / "less", "2026-03-11", "02", [at(11)])
        silver_plan.rebuild_silver(spark, str(tmp_path / "less"), paths["silver"])
        assert silver_plan.read_silver(spark, paths["silver"]).count() == 1
        assert silver_plan.read_quarantine(spark, paths["silver"]).count() == 0

    def test_vacuum_keeps_what_readers_use(self, spark, paths):
        rebuild(spark, paths)
        add(spark, paths, "2026-03-11")
        rebuild(spark, paths)
        want = tables(spark, paths["silver"])
        open_reader = silver_plan.read_silver(spark, paths["silver"])
        assert versions.vacuum(spark, paths["silver"], keep=1) > 0
        assert tables(spark, paths["silver"]) == want
        assert content(open_reader) == want[0]
        assert versions.commits(spark, paths["silver"]).select("version").distinct().count() == 1
        assert versions.vacuum(spark, paths["silver"]) == 0
        add(spark, paths, "2026-03-12")
        assert tables(spark, paths["silver"]) == want
        assert versions.vacuum(spark, paths["gold"]) == 0

    def test_vacuum_clears_what_no_commit_names(self, spark, paths, monkeypatch):
        rebuild(spark, paths)
        with monkeypatch.context() as patch:
            patch.setattr(versions, "commit", failing)
            with pytest.raises(RuntimeError):
                rebuild(spark, paths)
        gold_plan.publish_gold(spark, paths["silver"], paths["gold"])
        want = tables(spark, paths["silver"]), content(
            gold_plan.read_marts(spark, paths["gold"])["fact_footfall_hourly"]
        )
        assert versions.vacuum(spark, paths["silver"]) == 2  # both tables of the load that died
        assert versions.vacuum(spark, paths["gold"]) == 2  # hourly sums and the report
        assert want == (tables(spark, paths["silver"]), content(
            gold_plan.read_marts(spark, paths["gold"])["fact_footfall_hourly"]
        ))

    def test_rows_without_key_are_the_same_by_every_road(self, spark, paths, tmp_path):
        root = tmp_path / "keyless"
        for day in (11, 12, 13):
            rows = [at(day, dedupe_key=None), at(day, location_id=9)]
            land(root, f"2026-03-{day}", "02", rows)
        silver_plan.rebuild_silver(spark, str(root), str(tmp_path / "a"))
        rebuilt = content(silver_plan.read_silver(spark, str(tmp_path / "a")))
        for day in (12, 11, 13):
            silver_plan.add_arrivals(
                spark, str(root), str(tmp_path / "b"), f"2026-03-{day}", f"2026-03-{day}"
            )
        assert content(silver_plan.read_silver(spark, str(tmp_path / "b"))) == rebuilt
        assert len(rebuilt) == 6


class TestGoldJobs:
    @pytest.fixture(autouse=True)
    def landed(self, spark, paths):
        land(paths["root"], "2026-03-11", "02", [at(11), at(11, 3), at(12), at(14), at(11, 4)])
        rebuild(spark, paths)

    def marts(self, spark, paths):
        return {n: content(m) for n, m in gold_plan.read_marts(spark, paths["gold"]).items()}

    def test_gold_is_published_and_guarded(self, spark, paths, tmp_path, capsys):
        args = (paths["silver"], paths["gold"])
        report = gold_plan.publish_gold(spark, *args)
        assert report.count() == 16
        marts = gold_plan.read_marts(spark, paths["gold"])
        assert {n: m.count() for n, m in marts.items()} == {
            "dim_date": 3, "dim_sensor": 1, "fact_footfall_hourly": 5,
        }
        assert spark.table("stg_pedestrian").count() == 5

        before = self.marts(spark, paths)
        never = RuleSet(rows=[RowRule("fact_footfall_hourly", "never", F.lit(True))])
        with pytest.raises(QualityError):
            gold_plan.publish_gold(spark, *args, rules=never)
        assert self.marts(spark, paths) == before

        document = snapshot_plan.export_snapshot(spark, paths["gold"], str(tmp_path / "snap"))
        assert document.first()["meta"]["gold_facts"] == 5
        facts = serving.facts_with_current_sensor(marts["fact_footfall_hourly"], marts["dim_sensor"])
        whole = serving.snapshot(facts, serving.sensor_locations(spark))
        assert whole.toJSON().first() == document.toJSON().first()
        summary = serving.fact_summary(facts)
        summary.explain()
        assert capsys.readouterr().out.count("FileScan") == 2  # the fact and its dimension
        fact = gold_plan.read_marts(spark, paths["gold"])["fact_footfall_hourly"]
        assert forecast_plan.fact_slice(fact).columns == forecast_plan.FACT_COLUMNS

    def test_marts_are_all_old_or_all_new(self, spark, paths, monkeypatch):
        """Publication dies at each of its writes, at its gate and at its commit."""
        gold_plan.publish_gold(spark, paths["silver"], paths["gold"])
        old = self.marts(spark, paths)
        land(paths["root"], "2026-03-12", "02", [at(20), at(21, location_id=8)])
        rebuild(spark, paths)
        write, died = versions.write, 0
        for fatal in range(5):  # hourly sums, three marts, the report
            calls = []

            def dying(*args, **kwargs):
                calls.append(args)
                return failing() if len(calls) == fatal + 1 else write(*args, **kwargs)

            with monkeypatch.context() as patch:
                patch.setattr(versions, "write", dying)
                with pytest.raises(RuntimeError):
                    gold_plan.publish_gold(spark, paths["silver"], paths["gold"])
            died += 1
        for owner, name in ((gold_plan, "require_passed"), (versions, "_append")):
            with monkeypatch.context() as patch:
                patch.setattr(owner, name, failing)
                with pytest.raises(RuntimeError):
                    gold_plan.publish_gold(spark, paths["silver"], paths["gold"])
            died += 1
        assert died == 7 and self.marts(spark, paths) == old
        gold_plan.publish_gold(spark, paths["silver"], paths["gold"])
        assert {n: len(rows) for n, rows in self.marts(spark, paths).items()} == {
            "dim_date": 5, "dim_sensor": 2, "fact_footfall_hourly": 7,
        }

    def test_marts_have_names_in_sql(self, spark, paths):
        gold_plan.publish_gold(spark, paths["silver"], paths["gold"])
        gold_plan.register_marts(spark, paths["gold"], paths["silver"])
        joined = spark.sql(
            "SELECT sum(pedestrian_count) AS n FROM fact_footfall_hourly "
            "JOIN dim_sensor USING (sensor_key) JOIN dim_date ON date_day = date_key"
        )
        assert joined.first().n == spark.sql(
            "SELECT sum(total_of_directions) AS n FROM silver_pedestrian"
        ).first().n


class TestStreams:
    def test_landing_separates_broken_lines(self, spark, tmp_path):
        lines = tmp_path / "lines"
        lines.mkdir()
        rows = [json.dumps(at(11)), "{cut", json.dumps(at(12)), ""]
        (lines / "a.txt").write_text("\n".join(rows) + "\n")
        root = str(tmp_path / "landed")
        for _ in range(2):  # a restart lands nothing twice
            source = landing.read_lines(spark, str(lines))
            landing.land(source, root, str(tmp_path / "c"), once=True).awaitTermination()
        landed = read_bronze(spark, landing.bronze_folder(root), with_source=True)
        assert landed.count() == 2 and landed.filter("dt IS NULL OR hour IS NULL").count() == 0
        assert "batch" not in landed.columns
        files = list((tmp_path / "landed").rglob("*.txt.gz"))
        assert files and all(f.parent.name.startswith("batch=") for f in files)
        bad = {r["value"] for r in landing.read_errors(spark, root).collect()}
        assert "{cut" in bad and bad <= {"{cut", "", None}

    def test_a_batch_that_dies_is_landed_again_in_its_place(self, spark, tmp_path, monkeypatch):
        """Killed with only one sink written, and with both, before it is done."""
        lines, root = tmp_path / "lines", str(tmp_path / "landed")
        lines.mkdir()
        texts = [json.dumps(at(11, h)) for h in range(5)] + ["{cut", "{torn"]
        (lines / "a.txt").write_text("\n".join(texts) + "\n")
        write = landing.write_batch

        def run():
            source = landing.read_lines(spark, str(lines))
            landing.land(source, root, str(tmp_path / "c"), once=True).awaitTermination()

        for reached in ("sink = 'bronze'", "true"):
            with monkeypatch.context() as patch:
                patch.setattr(landing, "write_batch", lambda batch, n, to: (
                    write(batch.filter(reached), n, to), failing()))
                with pytest.raises(Exception, match="driver lost"):
                    run()
        (lines / "b.txt").write_text(json.dumps(at(12)) + "\n{late\n")
        run()
        landed = [r.sensing_datetime for r in read_bronze(spark, landing.bronze_folder(root)).collect()]
        assert sorted(landed) == [at(11, h)["sensing_datetime"] for h in range(5)] + [
            at(12)["sensing_datetime"]
        ]
        bad = sorted(r.value for r in landing.read_errors(spark, root).collect())
        assert bad == ["{cut", "{late", "{torn"]

    def stream(self, spark, paths):
        silver_stream.stream_silver(
            silver_stream.read_bronze_stream(spark, paths["bronze"], files_per_trigger=1),
            paths["silver"],
            paths["checkpoint"],
            once=True,
        ).awaitTermination()

    def test_silver_keeps_the_latest_copy_across_batches(self, spark, paths):
        later = dict(ingested_at="2026-03-12T09:00:00+00:00", direction_1=70)
        land(paths["root"], "2026-03-11", "02", [at(11), at(12), reading(location_id=None)])
        self.stream(spark, paths)
        land(paths["root"], "2026-03-12", "09", [at(11, **later), at(11, 5)])
        land(paths["root"], "2026-03-12", "10", [at(11, ingested_at="2026-03-11T02:31:00+00:00")])
        self.stream(spark, paths)
        got = silver_plan.read_silver(spark, paths["silver"])
        want = silver.transform(read_bronze(spark, paths["bronze"]))[0]
        assert content(got) == content(want)
        assert got.filter("direction_1 = 70").count() == 1
        assert silver_plan.read_quarantine(spark, paths["silver"]).count() == 1

    def test_stream_and_batch_quarantine_the_same_rows_once(self, spark, paths, tmp_path):
        land(paths["root"], "2026-03-11", "02", [at(11), reading(location_id=None)])
        (paths["root"] / "dt=2026-03-11" / "hour=02" / "cut.json").write_text('{"location_id": 7,\n')
        land(paths["root"], "2026-03-12", "02", [reading(location_id=-1), at(12)])
        self.stream(spark, paths)
        streamed = tables(spark, paths["silver"])
        bad = silver_plan.read_quarantine(spark, paths["silver"])
        assert bad.filter(F.col("_corrupt_record").contains("location_id")).count() == 1
        add(spark, paths, "2026-03-11")  # batch and stream over the same files
        assert tables(spark, paths["silver"]) == streamed
        silver_plan.rebuild_silver(spark, paths["bronze"], str(tmp_path / "rebuilt"))
        assert tables(spark, str(tmp_path / "rebuilt")) == streamed
        assert len(streamed[1]) == 3

    def test_rolling_sums_close_behind_the_watermark(self, spark, paths, tmp_path):
        land(paths["root"], "2026-03-11", "02", [at(11), at(11), at(11, 3)])
        land(paths["root"], "2026-03-11", "09", [at(11, 9)])
        readings = rolling.typed_stream(
            silver_stream.read_bronze_stream(spark, paths["bronze"], files_per_trigger=1)
        )
        out = rolling.stream_rolling(readings, slide=None)
        (
            out.writeStream.format("memory").queryName("closed").outputMode("append")
            .option("checkpointLocation", paths["checkpoint"]).trigger(availableNow=True)
            .start().awaitTermination()
        )
        got = {r["window_start"].hour: r["minutes_reported"] for r in spark.table("closed").collect()}
        assert got == {2: 1, 3: 1}

    def test_windows_are_kept_up_in_a_table(self, spark, paths, tmp_path):
        land(paths["root"], "2026-03-11", "02", [at(11), at(11, 3)])
        land(paths["root"], "2026-03-11", "03", [at(11, location_id=9), at(11, 3, location_id=9)])
        readings = rolling.typed_stream(
            silver_stream.read_bronze_stream(spark, paths["bronze"], files_per_trigger=1)
        )
        windows = rolling.stream_rolling(readings, delay="3 hours", slide=None)
        root = str(tmp_path / "windows")
        rolling.stream_rolling_table(windows, root, paths["checkpoint"], once=True).awaitTermination()
        got = [(r.location_id, r.window_start.hour) for r in rolling.read_windows(spark, root).collect()]
        assert sorted(got) == [(7, 2), (7, 3), (9, 2), (9, 3)]

    @pytest.mark.parametrize(("slide", "batches"), [(None, 10), ("15 minutes", 4)])
    def test_untouched_days_keep_their_files(self, spark, paths, tmp_path, slide, batches):
        root, days, seen = str(tmp_path / "windows"), range(10, 15), {}
        for batch in range(batches):
            day = days[batch // 2]
            rows = [at(day, 2 + batch % 2), at(day, 9 + batch % 2)]
            land(paths["root"], f"2026-03-{day}", f"{batch:02d}", rows)
            readings = rolling.typed_stream(
                silver_stream.read_bronze_stream(spark, paths["bronze"], files_per_trigger=1)
            )
            windows = rolling.stream_rolling(readings, delay="2 days", slide=slide)
            rolling.stream_rolling_table(
                windows, root, paths["checkpoint"], once=True
            ).awaitTermination()
            files = files_of(spark, root, "windows")
            today = f"2026-03-{day}"
            assert {d: f for d, f in files.items() if d != today} == {
                d: f for d, f in seen.items() if d != today
            }
            assert files[today] != seen.get(today)
            seen = files
        rows = silver_plan.upsert(
            spark, read_bronze(spark, paths["bronze"], keep_corrupt=True, with_source=True),
            paths["silver"],
        ) and silver_plan.read_silver(spark, paths["silver"])
        want = incremental.rolling_counts(rows, slide=slide)
        assert content(rolling.read_windows(spark, root)) == content(want)

    def test_final_windows_come_once(self, spark, paths, tmp_path):
        root = str(tmp_path / "windows")
        for hour in (2, 3, 9):
            land(paths["root"], "2026-03-11", f"{hour:02d}", [at(11, hour)])
        readings = rolling.typed_stream(
            silver_stream.read_bronze_stream(spark, paths["bronze"], files_per_trigger=1)
        )
        windows = rolling.stream_rolling(readings, slide=None)
        rolling.stream_rolling_table(
            windows, root, paths["checkpoint"], once=True, final=True
        ).awaitTermination()
        got = [r.window_start.hour for r in rolling.read_windows(spark, root).collect()]
        assert sorted(got) == [2, 3]

    def test_state_follows_the_newest_reading(self, spark, paths, tmp_path):
        root, sensors = str(tmp_path / "state"), range(1, 21)

        def run():
            readings = rolling.typed_stream(
                silver_stream.read_bronze_stream(spark, paths["bronze"], files_per_trigger=1)
            )
            rolling.stream_state(
                readings, root, paths["checkpoint"], once=True, buckets=8
            ).awaitTermination()
            return {r.location_id: r.event_ts_utc.hour for r in rolling.read_state(spark, root).collect()}

        land(paths["root"], "2026-03-11", "02", [at(11, 5, location_id=k) for k in sensors])
        land(paths["root"], "2026-03-11", "03", [at(11, 4, location_id=1), at(11, 6, location_id=2)])
        assert run() == {k: 6 if k == 2 else 5 for k in sensors}
        before = files_of(spark, root, "state")
        land(paths["root"], "2026-03-11", "04", [at(11, 8, location_id=7)])
        assert run()[7] == 8
        after = files_of(spark, root, "state")
        assert sum(after[k] != before[k] for k in before) == 1  # one bucket of eight


def test_checkpoint_folder_is_the_one_named(spark):
    from kerbside.session import ensure_checkpoint_dir

    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
