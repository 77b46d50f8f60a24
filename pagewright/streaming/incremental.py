"""Result files as a stream: each is matched once, however often the job runs; an extension.

The checkpoint takes the place of a list of files already done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from pagewright import schemas
from pagewright.operators.extraction import extract
from pagewright.sources.readers import detections


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """New files of whole results; a page is never split over files, so matching needs no state."""
    return spark.readStream.schema(schemas.RESULT).option("multiLine", True).json(path)


def extract_new(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Match the items of all new files, add them to the table at ``out``, and stop."""

    def write(batch: DataFrame, number: int) -> None:
        extract(detections(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    return read_results(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
