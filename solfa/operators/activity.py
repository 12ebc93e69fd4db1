"""Activity logs: repeats collapsed, joined to users, and rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = "INTERVAL 30 MINUTES"
#: Rank of each state of a file.
RANKS = {"uploaded": 1, "mapped": 2, "cleaned": 3, "committed": 4}


def collapse(log: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """One entry for each run of repeats within half an hour of the one before: keys, first, last and n."""
    order = Window.partitionBy(*keys).orderBy(ts)
    new = F.coalesce(F.col(ts) > F.lag(ts).over(order) + F.expr(WINDOW), F.lit(True))
    runs = log.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*keys, "_run").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def with_users(log: DataFrame, users: DataFrame) -> DataFrame:
    """log with the role of its user, null for users that are gone."""
    return log.join(users.select("user_id", "role"), "user_id", "left")


def branch_rollup(branches: DataFrame, files: DataFrame) -> DataFrame:
    """branch_id, files and progress (the furthest state's rank) of every branch; 0 and 0 without files."""
    rank = F.create_map(*(F.lit(x) for p in RANKS.items() for x in p))[F.col("status")]
    rolled = files.groupBy("branch_id").agg(F.count(F.lit(1)).alias("files"), F.max(rank).alias("progress"))
    out = branches.select("branch_id").join(rolled, "branch_id", "left")
    return out.select("branch_id", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("progress", F.lit(0)).alias("progress"))


def dashboard(rollup: DataFrame) -> DataFrame:
    p = F.col("progress")
    return rollup.agg(F.count(F.lit(1)).alias("total"), F.count_if((p >= 1) & (p < 4)).alias("active"), F.count_if(p >= 4).alias("done"))


def stored_by_file(commits: DataFrame, files: DataFrame) -> DataFrame:
    """file_id and the records its commits stored, 0 if none."""
    sums = commits.groupBy("file_id").agg(F.sum(F.col("inserted") + F.col("updated")).alias("stored"))
    return files.select("file_id").join(sums, "file_id", "left").select("file_id", F.coalesce("stored", F.lit(0)).cast("long").alias("stored"))


def report_totals(report: DataFrame, columns: list[str]) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("n_rows"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns))
