"""Helpers that several operators use: shared storage, Arrow batches, bounded text chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset in local mode (tests).
    A cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(spark.sparkContext, "_solfa_shared", None) or tempfile.mkdtemp(prefix="solfa-")
        spark.sparkContext._solfa_shared = path
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/solfa-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, one: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply one() to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = one(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts have about limit bytes together; a longer text stands alone."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def key_schema(df: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = dict(df.select(*keys).dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def packed(df: DataFrame, *without: str) -> DataFrame:
    """The column rest: a structure of df's columns but those named, which no name of an operator can clash with."""
    return df.withColumn("rest", F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in without)))


def rows_needed(df: DataFrame, per_part: int) -> int:
    """How many parts of per_part rows the rows of df fill, at least one."""
    return max(1, -(-df.select(F.count(F.lit(1))).first()[0] // per_part))
