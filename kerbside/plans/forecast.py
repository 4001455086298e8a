"""Gold fact to features, model and metrics."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from kerbside.operators.features import build_features
from kerbside.operators.forecast import save_model, train
from kerbside.plans.gold import FACT, read_marts
from kerbside.sources.sinks import write_table

FACT_COLUMNS = [
    "sensor_key",
    "date_key",
    "event_hour",
    "day_of_week",
    "is_weekend",
    "pedestrian_count",
]


def fact_slice(fact: DataFrame) -> DataFrame:
    """The six fact columns features are made of."""
    return fact.select(*FACT_COLUMNS)


def store_features(
    spark: SparkSession, gold_root: str, features_path: str, **options: object
) -> DataFrame:
    """Features as a table: the split and the model read them several times."""
    features = build_features(fact_slice(read_marts(spark, gold_root)[FACT]), **options)
    write_table(features, features_path)
    return spark.read.schema(features.schema).parquet(features_path)


def train_from_gold(
    spark: SparkSession,
    gold_root: str,
    features_path: str,
    model_path: str,
    max_iter: int = 300,
    **params: object,
) -> tuple[PipelineModel, DataFrame]:
    features = store_features(spark, gold_root, features_path)
    model, metrics = train(features, max_iter, **params)
    save_model(model, model_path)
    return model, metrics
