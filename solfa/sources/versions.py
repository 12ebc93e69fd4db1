"""A master table in versions: Parquet parts by bucket of the fingerprint, and a manifest a version.

A commit reads and writes only the buckets that its rows touch; the others' parts are listed again as they are, so every
version stays readable. A manifest appears whole, by a rename, after its number was claimed by a file that must not exist: a
commit on a version that is no longer the last, or two at once, is refused and leaves the table as it was. The manifest is a
line for each bucket, never rows. Defined results: a commit of no rows makes a version with the same parts; a null
fingerprint is refused."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.master import numbered, upsert
from .storage import stored


class StaleVersion(RuntimeError):
    """The table has moved on since the version that a commit is based on."""


class VersionedMaster:
    """Records (id, branch_id, file_id, attributes, fingerprint) under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.schema, self.buckets = spark, folder.rstrip("/"), schema, buckets

    def _path(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        """last_id and the parts of a version, by bucket; version 0 is the empty table."""
        if not version:
            return {"last_id": 0, "buckets": self.buckets, "parts": {}}
        text = self.spark.read.text(f"{self.folder}/manifests/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The records of a version (the last one), or of some of its buckets only."""
        version = max(self.versions(), default=0) if version is None else version
        parts = self.manifest(version)["parts"]
        paths = [f"{self.folder}/data/{p}" for b, p in sorted(parts.items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def commit(self, new: DataFrame, base: int, make: Callable[[DataFrame, DataFrame], DataFrame] = upsert) -> int:
        """Store rows (row_index, attributes, fingerprint, branch_id, file_id) over version base; the number of the next one."""
        if base != max(self.versions(), default=0):
            raise StaleVersion(f"version {base} is not the last")
        old = self.manifest(base)
        bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(old["buckets"])).cast("int")
        rows = stored(new.withColumn("bucket", F.when(F.col("fingerprint").isNotNull(), bucket).otherwise(F.raise_error(F.lit("a record without fingerprint"))).cast("int")), "commit")
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
        stock = self.read(base, touched)
        after = stored(make(rows.drop("bucket"), stock), "next")
        # ids by the first row of each new record
        first = rows.groupBy("fingerprint").agg(F.min("row_index").alias("_first"))
        fresh = numbered(after.filter("id IS NULL").drop("id").join(first, "fingerprint"), "_first", old["last_id"])
        named = after.filter("id IS NOT NULL").unionByName(fresh.select(*after.columns))
        made = uuid.uuid4().hex
        named.withColumn("bucket", bucket).repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{made}")
        last = fresh.agg(F.max("id")).first()[0] or old["last_id"]
        self._publish(base + 1, {"last_id": last, "buckets": old["buckets"], "parts": old["parts"] | {str(b): f"{made}/bucket={b}" for b in touched}})
        return base + 1

    def _publish(self, version: int, manifest: dict) -> None:
        fs, claim = self._path("manifests", f"{version}.claim")
        try:
            fs.create(claim, False).close()
        except Exception as e:  # the file exists: another commit has the number
            raise StaleVersion(f"version {version} is taken") from e
        _, temporary = self._path("manifests", f".{version}.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(temporary, self._path("manifests", f"{version}.json")[1]):
            raise StaleVersion(f"version {version} could not be published")
