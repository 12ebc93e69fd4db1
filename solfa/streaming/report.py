"""The daily report: what each file has stored so far, kept between runs of a scheduled job.

A run reads what the commit log has gained, adds it to the totals of the run before, and writes them as the table of its batch.
A batch that is run again after a failure starts from the same totals and writes the same table, so every entry counts once.
Each table holds a row a file; the one before stays for such a repeat, older ones go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOTALS = "file_id bigint, stored bigint, commits bigint, last timestamp"


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def batches(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose tables are whole."""
    fs, path = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and fs.exists(_fs(spark, f"{folder}/{n}/_SUCCESS")[1]))


def totals(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The totals of the last batch, or of the last one before a batch."""
    held = [b for b in batches(spark, folder) if before is None or b < before]
    return spark.read.schema(TOTALS).parquet(f"{folder}/batch-{held[-1]}") if held else spark.createDataFrame([], TOTALS)


def add(batch: DataFrame, number: int, folder: str) -> None:
    """The totals after a batch of commits (file_id, inserted, updated, ts). Entries without a file are left out; nulls count as 0."""
    spark = batch.sparkSession
    stored = F.coalesce("inserted", F.lit(0)) + F.coalesce("updated", F.lit(0))
    new = batch.filter("file_id IS NOT NULL").groupBy("file_id").agg(F.sum(stored).cast("bigint").alias("stored"), F.count(F.lit(1)).alias("commits"), F.max("ts").alias("last"))
    both = totals(spark, folder, number).unionByName(new).groupBy("file_id").agg(F.sum("stored").alias("stored"), F.sum("commits").alias("commits"), F.max("last").alias("last"))
    both.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
    for old in [b for b in batches(spark, folder) if b < number][:-1]:
        fs, path = _fs(spark, f"{folder}/batch-{old}")
        fs.delete(path, True)


def run(log: DataFrame, folder: str, checkpoint: str) -> None:
    """One run of the job: all that the log (a stream) has gained since the last one."""
    log.writeStream.foreachBatch(lambda batch, number: add(batch, number, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def report(files: DataFrame, held: DataFrame) -> DataFrame:
    """files (file_id and what is shown of them) with what each has stored and its last commit; 0 and null without commits."""
    found = files.join(held, "file_id", "left")
    return found.select(*files.columns, F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("commits", F.lit(0)).alias("commits"), "last")
