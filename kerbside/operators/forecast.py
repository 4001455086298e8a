"""Chronological split, error measures, and the gradient-boosted model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.columns import at_least
from kerbside.schemas import TARGET_COLUMN, feature_columns
from kerbside.session import ensure_checkpoint_dir

# Fixed value: the share of rows to train on.
TRAIN_FRACTION = 0.8
KEY_PREFIX = 4


def _bucket_at(counts: DataFrame, bucket: list[str], target: Column) -> DataFrame:
    """The bucket in which the ``target``-th row lies, and how many rows of it
    come up to that row. ``counts`` holds one row per bucket, so the running
    sum over it is short whatever the number of rows counted."""
    upto = F.sum("rows").over(
        Window.partitionBy(F.lit(0)).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        counts.withColumn("upto", upto)
        .filter((F.col("upto") >= target) & (F.col("upto") - F.col("rows") < target))
        .select(*bucket, (target - (F.col("upto") - F.col("rows"))).alias("taken"))
    )


def cut_point(df: DataFrame, train_fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Date, hour and sensor of the last training row, as one row.

    The order is (date, hour, sensor). Rather than sort all rows, rows are
    counted per hour, then within the hour of the cut per prefix of the sensor
    key, and only the keys under that one prefix are ranked.
    """
    hours = df.groupBy("date_key", "event_hour").agg(F.count("*").alias("rows"))
    total = hours.agg(F.sum("rows")).scalar()
    target = F.floor(total * F.lit(train_fraction))
    hour = _bucket_at(hours, ["date_key", "event_hour"], target)

    in_hour = df.select("date_key", "event_hour", "sensor_key").join(
        F.broadcast(hour.withColumnRenamed("taken", "hour_taken")), ["date_key", "event_hour"]
    )
    prefixed = in_hour.withColumn("prefix", F.substring("sensor_key", 1, KEY_PREFIX))
    prefixes = prefixed.groupBy("prefix").agg(F.count("*").alias("rows"))
    prefix = _bucket_at(prefixes, ["prefix"], hour.select("taken").scalar())

    ranked = prefixed.join(F.broadcast(prefix), "prefix").withColumn(
        "rank", F.row_number().over(Window.partitionBy("prefix").orderBy("sensor_key"))
    )
    return ranked.filter(F.col("rank") == F.col("taken")).select(
        "date_key", "event_hour", "sensor_key"
    )


def with_split(df: DataFrame, train_fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Marks rows ``train`` up to the cut and ``test`` after it.

    Exactly ``floor(n * train_fraction)`` rows train, given one row per sensor
    and hour. Marking is a comparison with one row; the data is not moved.
    """
    cut = cut_point(df, train_fraction).select(
        F.struct("date_key", "event_hour", "sensor_key")
    ).scalar()
    position = F.struct("date_key", "event_hour", "sensor_key")
    return df.withColumn("split", F.when(position <= cut, "train").otherwise("test"))


def time_split(
    df: DataFrame, train_fraction: float = TRAIN_FRACTION
) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, train_fraction)
    return (
        marked.filter(F.col("split") == "train").drop("split"),
        marked.filter(F.col("split") == "test").drop("split"),
    )


# --- error measures --------------------------------------------------------------


def absolute_error(actual: str, predicted: str) -> Column:
    return F.abs(F.col(actual) - at_least(predicted, 0.0))


def percentage_error(actual: str, predicted: str) -> Column:
    """Both sides counted as at least one pedestrian."""
    truth = at_least(actual, 1.0)
    return F.abs(truth - at_least(predicted, 1.0)) / truth


def error_metrics(
    marked: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    actual: str = TARGET_COLUMN,
    predicted: str = "prediction",
) -> DataFrame:
    """Errors on the test rows and both split sizes; only test rows are scored."""
    scored = predict(marked.filter(F.col("split") == "test"))
    train_rows = marked.filter(F.col("split") == "train").agg(F.count("*")).scalar()
    return scored.agg(
        F.avg(absolute_error(actual, predicted)).alias("mae"),
        F.avg(percentage_error(actual, predicted)).alias("mape"),
        F.count("*").alias("n_test"),
    ).select("mae", "mape", train_rows.alias("n_train"), "n_test")


def split_sizes(marked: DataFrame) -> DataFrame:
    return marked.groupBy("split").agg(F.count("*").alias("rows"))


def seasonal_naive(df: DataFrame) -> DataFrame:
    """Baseline forecast: the count 24 rows ago."""
    return df.withColumn("prediction", F.col("lag_24h").cast("double"))


# --- model -----------------------------------------------------------------------


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=feature_columns(), outputCol="features")


def boosted_trees(max_iter: int = 300, **params: object) -> GBTRegressor:
    """Trees on the logarithm of the count, so that errors are relative."""
    settings = {
        "maxDepth": 6,
        "stepSize": 0.05,
        "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8",
        "seed": 42,
        **params,
    }
    return GBTRegressor(
        featuresCol="features",
        labelCol="log_target",
        predictionCol="log_prediction",
        maxIter=max_iter,
        **settings,
    )


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Next-hour forecast in pedestrians, never negative."""
    scored = model.transform(df)
    return scored.withColumn("prediction", at_least(F.expm1("log_prediction"), 0.0)).drop(
        "features", "log_prediction"
    )


def training_rows(marked: DataFrame) -> DataFrame:
    """What the trees are fitted on, cut off from how it was made.

    Every task of every level of every tree reports the metrics of the whole
    lineage to the driver; with the plan of the split these are 60 kB a task.
    """
    ensure_checkpoint_dir(marked.sparkSession)
    log_target = F.log1p(F.col(TARGET_COLUMN).cast("double"))
    rows = marked.filter(F.col("split") == "train").withColumn("log_target", log_target)
    return rows.select(*feature_columns(), "log_target").checkpoint()


def train(
    features: DataFrame, max_iter: int = 300, **params: object
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the earlier rows; metrics on the later ones as a one-row frame.

    Pass features that are stored, since fitting reads them more than once.
    """
    marked = with_split(features)
    fitted = Pipeline(stages=[assembler(), boosted_trees(max_iter, **params)]).fit(
        training_rows(marked)
    )
    return fitted, error_metrics(marked, lambda test: score(fitted, test))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
