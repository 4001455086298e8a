"""Session settings that the timestamp rules and long jobs depend on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app_name: str, **conf: str) -> SparkSession:
    """A session with the settings every operator here relies on.

    ANSI mode stays at its default (on); malformed input is handled with
    ``try_`` functions, never by switching ANSI off.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return pin_utc(builder.getOrCreate())


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps in UTC whatever zone the host is in, and JSON read in full."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Of a key that a JSON object repeats the last value counts.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that cuts lineage: the one the cluster names.

    ``spark.checkpoint.dir`` is shared storage on a cluster and always wins.
    Only a local master, where the driver is the sole machine, falls back to a
    temporary folder; a cluster without the setting is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kerbside-checkpoint-"))
    return context.getCheckpointDir()
