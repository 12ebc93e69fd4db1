"""Checks of a result: what is expected, what was found, and who is at fault, counted in full and shown in part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 3


def judged(rows: DataFrame, checks: dict[str, tuple[Column, Column, Column]], order: str, shown: int = SHOWN) -> DataFrame:
    """check, expected, found, n_faults, faults and ok. checks: name -> (expected, found: aggregates over rows; faults: an array of
    texts for each row, empty or null where it is sound). faults holds the first `shown` by order and text; all are counted. A
    check is ok if both numbers agree and nothing is at fault, so faults that cancel out are seen too.

    No task holds more faults of a check than it shows: a rank limit is applied before rows are shuffled, and again after."""
    names = list(checks)
    size = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c))
    sums = rows.agg(*(c.cast("long").alias(f"{k}{i}") for i, (e, f, bad) in enumerate(checks.values()) for k, c in zip("efb", (e, f, F.sum(size(bad))))))
    numbers = lambda i: (F.coalesce(f"{k}{i}", F.lit(0)).alias(a) for k, a in zip("efb", ("expected", "found", "n_faults")))
    each = sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), *numbers(i)) for i, n in enumerate(names)))).alias("c")).select("c.*")
    named = lambda n, bad: F.transform(F.coalesce(bad, F.array().cast("array<string>")), lambda x: F.struct(F.lit(n).alias("check"), x.alias("fault")))
    listed = F.flatten(F.array(*(named(n, bad) for n, (_, _, bad) in checks.items())))
    faults = rows.select(F.col(order).alias("at"), F.explode(listed).alias("x")).select("at", "x.*")
    first = faults.withColumn("nth", F.row_number().over(Window.partitionBy("check").orderBy("at", "fault"))).filter(F.col("nth") <= shown)
    few = first.groupBy("check").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "fault"))), lambda x: x["fault"]), ", ").alias("faults"))
    out = each.join(F.broadcast(few), "check", "left")  # a row a check
    return out.select("check", "expected", "found", "n_faults", F.coalesce("faults", F.lit("")).alias("faults"), ((F.col("expected") == F.col("found")) & (F.col("n_faults") == 0)).alias("ok"))
