"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset in local mode (tests). A cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(spark.sparkContext, "_solfa_folder", None) or tempfile.mkdtemp(prefix="solfa-")
        spark.sparkContext._solfa_folder = path
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: worked out once, with a short plan and no lineage to recompute."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """df, dealt by key to so many parts, stored and read back as it is dealt: a table in as many buckets, so that what groups or
    joins by key needs no exchange again."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).option("path", f"{shared_folder(df.sparkSession)}/{table}").saveAsTable(table)
    return df.sparkSession.table(table)
