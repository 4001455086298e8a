import math
import random
from datetime import date, timedelta
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kerbside.operators import features, forecast
from kerbside.schemas import TARGET_COLUMN, feature_columns
from tests.support import duck

SLICE = (
    "sensor_key string, date_key date, event_hour int, day_of_week int, is_weekend boolean, "
    "pedestrian_count bigint"
)
DAY = date(2026, 1, 30)
FOLDER = "/root/testdata/sf0.001"


def hours(sensor, count, value, skip=()):
    rows = []
    for n in range(count):
        if n in skip:
            continue
        day = DAY + timedelta(days=n // 24)
        number = day.isoweekday() % 7 + 1
        rows.append((sensor, day, n % 24, number, number in (1, 7), value(n)))
    return rows


def as_pandas(rows):
    names = [c.split()[0] for c in SLICE.split(", ")]
    return pd.DataFrame(rows, columns=names)


def expected(rows):
    """Lags, means and target the way pandas gives them."""
    frame = as_pandas(rows).dropna(subset=["sensor_key"])
    frame = frame.sort_values(["sensor_key", "date_key", "event_hour"])
    counts = frame.groupby("sensor_key")["pedestrian_count"]
    for n in (1, 2, 3, 24):
        frame[f"lag_{n}h"] = counts.shift(n)
    for w in (3, 6):
        frame[f"roll_mean_{w}h"] = counts.transform(lambda s, w=w: s.shift(1).rolling(w).mean())
    frame[TARGET_COLUMN] = counts.shift(-1)
    return frame


VALUES = [f"lag_{n}h" for n in (1, 2, 3, 24)] + ["roll_mean_3h", "roll_mean_6h", TARGET_COLUMN]


def keyed(records):
    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9)

    return {
        (r["sensor_key"], r["date_key"], r["event_hour"]): [plain(r[c]) for c in VALUES]
        for r in records
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    gaps = set(rng.sample(range(30 * 24), 200))
    nulls = set(rng.sample(range(100), 5))
    return (
        hours("long", 30 * 24, lambda n: rng.randint(0, 500), gaps)
        + hours("short", 30, lambda n: n * 10)
        + hours("sparse", 90 * 24, lambda n: n, {n for n in range(90 * 24) if n % 50})
        + hours("holes", 100, lambda n: None if n in nulls else n)
        + hours(None, 40, lambda n: n)
    )


class TestFeatures:
    def test_lags_means_and_target(self, spark, rows):
        frame = features.add_target(features.add_lag_features(spark.createDataFrame(rows, SLICE)))
        assert keyed(r.asDict() for r in frame.collect()) == keyed(expected(rows).to_dict("records"))

    @pytest.mark.parametrize("chunk", ["day", "week", "month"])
    def test_chunked_windows_give_the_same(self, spark, rows, chunk):
        frame = features.add_lag_features(spark.createDataFrame(rows, SLICE), chunk=chunk)
        assert keyed(r.asDict() for r in frame.collect()) == keyed(expected(rows).to_dict("records"))

    def test_calendar_lags_are_null_across_a_gap(self, spark):
        frame = spark.createDataFrame(hours("s", 9, lambda n: n, skip={2, 3, 4}), SLICE)
        by_row = {r["event_hour"]: r["lag_1h"] for r in features.add_lag_features(frame).collect()}
        clock = features.add_target(features.add_lag_features(frame, calendar=True), calendar=True)
        by_clock = {r["event_hour"]: r for r in clock.collect()}
        assert by_row[5] == 1
        assert (by_clock[5]["lag_1h"], by_clock[1][TARGET_COLUMN]) == (None, None)
        assert (by_clock[8]["lag_3h"], by_clock[8]["roll_mean_3h"]) == (5, 6.0)

    def test_hour_lies_on_a_circle(self, spark):
        frame = features.add_time_features(spark.createDataFrame(hours("s", 24, lambda n: 1), SLICE))
        for r in frame.collect():
            assert math.isclose(math.hypot(r["hour_sin"], r["hour_cos"]), 1.0)
            assert r["is_weekend"] in (0, 1)
            if r["event_hour"] == 6:
                assert math.isclose(r["hour_sin"], 1.0)

    def test_complete_rows_only(self, spark, rows):
        built = features.build_features(spark.createDataFrame(rows, SLICE))
        want = expected(rows).dropna(subset=VALUES)
        assert built.count() == len(want)
        assert set(feature_columns()) < set(built.columns)
        assert "pedestrian_count" not in feature_columns()

    def test_one_shuffle_for_all_windows(self, spark, rows):
        built = features.build_features(spark.createDataFrame(rows, SLICE))
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


class TestSplit:
    @pytest.mark.parametrize("fraction", [0.8, 0.5, 0.0, 1.0, 0.37])
    def test_exact_sizes_in_order(self, spark, fraction):
        rng = random.Random(2)
        rows = [
            (f"{rng.getrandbits(64):016x}", DAY + timedelta(days=h // 24), h % 24, h)
            for h in range(5)
            for _ in range(h * 31 + 7)
        ]
        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, "sensor_key string, date_key date, event_hour int, n int")
        train, test = forecast.time_split(frame, fraction)

        def keys(df):
            return sorted((r["date_key"], r["event_hour"], r["sensor_key"]) for r in df.collect())

        ordered = sorted((r[1], r[2], r[0]) for r in rows)
        cut = int(len(ordered) * fraction)
        assert (keys(train), keys(test)) == (ordered[:cut], ordered[cut:])

    def test_one_hour_for_all(self, spark):
        rows = [(f"k{n:03d}", DAY, 3) for n in range(101)]
        frame = spark.createDataFrame(rows, "sensor_key string, date_key date, event_hour int")
        counts = {r["split"]: r["count"] for r in forecast.with_split(frame).groupBy("split").count().collect()}
        assert counts == {"train": 80, "test": 21}


class TestMetrics:
    def test_clipping(self, spark):
        rows = [("test", 10, -4.0), ("test", 0, 0.2), ("test", 4, 6.0), ("train", 9, 900.0)]
        scored = spark.createDataFrame(rows, f"split string, {TARGET_COLUMN} bigint, prediction double")
        got = forecast.error_metrics(scored, lambda test: test).first()
        assert math.isclose(got["mae"], (10 + 0.2 + 2) / 3)
        assert math.isclose(got["mape"], (0.9 + 0.0 + 0.5) / 3)
        assert (got["n_train"], got["n_test"]) == (1, 3)


@pytest.fixture(scope="module")
def fitted(spark):
    def value(n):
        return int(200 + 180 * math.sin(2 * math.pi * (n % 24) / 24) + (n * 7919) % 13)

    rows = hours("a", 24 * 16, value) + hours("b", 24 * 16, lambda n: value(n) * 3)
    built = features.build_features(spark.createDataFrame(rows, SLICE)).cache()
    return built, forecast.train(built, max_iter=8, stepSize=0.3, maxDepth=4)


class TestModel:
    def test_beats_the_mean(self, fitted):
        built, (_, metrics) = fitted
        marked = forecast.with_split(built)
        mean = marked.filter("split = 'train'").agg(F.avg(TARGET_COLUMN)).first()[0]
        flat = forecast.error_metrics(marked, lambda t: t.withColumn("prediction", F.lit(mean))).first()
        got = metrics.first()
        assert 0 < got["mae"] < flat["mae"] / 2
        assert got["n_train"] == int(built.count() * 0.8)

    def test_forecasts_are_finite_and_not_negative(self, fitted):
        built, (model, _) = fitted
        low, high = forecast.score(model, built).agg(F.min("prediction"), F.max("prediction")).first()
        assert 0 <= low <= high < 10_000

    def test_saved_model_gives_the_same_forecast(self, fitted, tmp_path):
        built, (model, _) = fitted
        forecast.save_model(model, str(tmp_path / "model"))
        loaded = forecast.load_model(str(tmp_path / "model"))

        def total(m):
            return forecast.score(m, built).agg(F.round(F.sum("prediction"), 6)).first()[0]

        assert total(loaded) == total(model)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
def test_registered_model_is_the_whole_one(spark, monkeypatch):
    """The query asks for all trees and rows, and its errors are those of its
    predictions by SQL. Only here the fit itself is shortened."""
    asked, scored = [], []
    make, score = forecast.boosted_trees, forecast.score

    def fewer(max_iter=300, **params):
        asked.append((max_iter, params))
        return make(2, **params)

    def kept(model, rows):
        scored.append(score(model, rows))
        return scored[-1]

    monkeypatch.setattr(forecast, "boosted_trees", fewer)
    monkeypatch.setattr(forecast, "score", kept)
    found = entry.queries()["gbt_metrics"](spark, FOLDER).first()
    assert asked == [(300, {})]
    test = scored[0].select(TARGET_COLUMN, "prediction").toPandas()
    con = duckdb.connect()
    con.register("test", test)
    n, usable, mae, mape = con.execute(f"""
        SELECT count(*), count(*) FILTER (isfinite(prediction) AND prediction >= 0),
            avg(abs({TARGET_COLUMN} - prediction)),
            avg(abs(greatest({TARGET_COLUMN}, 1) - greatest(prediction, 1))
                / greatest({TARGET_COLUMN}, 1))
        FROM test""").fetchone()
    sizes = duck(FOLDER).execute(entry.oracle_sql()["split_sizes"]).fetchall()
    assert dict(sizes) == {"train": found.n_train, "test": found.n_test}
    assert n == usable == found.n_test > 0
    assert found.mae == pytest.approx(mae) and found.mape == pytest.approx(mape)


def test_trees_are_fitted_on_rows_cut_off_from_their_plan(spark, tmp_path, monkeypatch):
    """Every task of a fit reports the metrics of all its rows' lineage."""
    facts = spark.createDataFrame(hours("a", 300, lambda n: 100 + n % 24), SLICE)
    features.build_features(facts).write.parquet(str(tmp_path / "rows"))
    rows, plans = spark.read.parquet(str(tmp_path / "rows")), []
    fit = forecast.Pipeline.fit

    def watched(self, given, *params):
        plans.append(given._jdf.queryExecution().executedPlan().toString())
        return fit(self, given, *params)

    monkeypatch.setattr(forecast.Pipeline, "fit", watched)
    _, metrics = forecast.train(rows, max_iter=2)
    [plan] = plans
    assert "ExistingRDD" in plan and "FileScan" not in plan and "Subquery" not in plan
    found, n = metrics.first(), rows.count()
    assert (found.n_train, found.n_test) == (n * 8 // 10, n - n * 8 // 10)
