"""Streaming Silver: micro-batches merged into the event-date parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kerbside.plans.silver import upsert
from kerbside.schemas import CORRUPT_COLUMN
from kerbside.sources.bronze import bronze_schema, with_source_file


def read_bronze_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed files as they come, with the text of malformed lines and the file
    of each row, as the batch reader gives them."""
    reader = (
        spark.readStream.schema(bronze_schema(partitioned=True, keep_corrupt=True))
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .option("maxFilesPerTrigger", files_per_trigger)
    )
    return with_source_file(reader.json(root))


def stream_silver(
    bronze: DataFrame,
    root: str,
    checkpoint: str,
    once: bool = False,
    every: str = "1 hour",
) -> StreamingQuery:
    """Keep the latest copy of each reading, whichever batch brings it.

    A batch rewrites the dates it touches, today's above all, so batches should
    be few and large: hourly unless told otherwise. A replayed batch changes
    nothing, and rows that a batch job has quarantined before are replaced, since
    both know them by the file they came in.
    """

    def merge(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, batch, root)

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return (
        bronze.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
