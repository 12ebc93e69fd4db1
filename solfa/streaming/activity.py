"""Activity as a stream: repeats collapsed by session windows, and a log that is only appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAP, LATE = "30 minutes", "1 hour"


def collapse(log: DataFrame, keys: list[str], late: str = LATE, ts: str = "ts") -> DataFrame:
    """keys, first, last and n of each run of repeats within half an hour of the one before.

    A run is given once the watermark (late behind the newest entry) has passed its last entry by the gap; state holds open
    runs only. Entries later than that are left out, and those without a time too."""
    runs = log.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, GAP).alias("run"))
    return runs.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def append(rows: DataFrame, path: str, checkpoint: str) -> None:
    """What has come since the last call, appended to path once each: a daily job calls it with the same checkpoint."""
    query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder or pattern as a stream, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
