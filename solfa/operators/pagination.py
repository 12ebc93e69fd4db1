"""Works dealt to parts of limited size, in order, without one task that walks a whole file.

Where a work lands depends on all before it, but only through how full the open part is. So a block of works is a function
from that fill to the fill it leaves and the parts it opens: a table of `limit` entries, whatever the block's size. Tables
compose, so a scan over a tree of blocks gives the state in which each block begins, and blocks place their works side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

LIMIT = 299
BLOCK, FAN = 200_000, 64
_STATE = "struct<fill:int,opened:bigint>"


def _chain(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """Running totals, and for a part opened at each work: where the next one opens (len(sizes): not here), the fill that
    the block leaves, and how many parts are opened after it."""
    n, total = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    after = np.maximum(np.searchsorted(total, total[:-1] + limit, "right") - 1, np.arange(1, n + 1)).tolist()
    fill, opened = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j = after[i]
        if j < n:
            fill[i], opened[i] = fill[j], opened[j] + 1
        else:
            left = int(total[n] - total[i])
            fill[i], opened[i] = (left, 0) if left < limit else (0, 1)
    return total, after, fill, opened


def transitions(sizes: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """What a block makes of each fill from 0 to limit - 1: the fill it leaves, and the parts it opens."""
    total, _, fill, opened = _chain(sizes, limit)
    n, fills, counts = len(sizes), [fill[0]], [opened[0]]
    for used in range(1, limit):
        j = int(np.searchsorted(total, limit - used, "right")) - 1
        left = used + int(total[n])
        fills.append(fill[j] if j < n else left if left < limit else 0)
        counts.append(opened[j] + 1 if j < n else int(left >= limit))
    return fills, counts


def place(sizes: np.ndarray, limit: int, used: int = 0, part: int = 1) -> np.ndarray:
    """The part of each work of a block that begins in the open part `part`, filled by `used`. A work stays whole: it opens a
    part if it doesn't fit, and one larger than the limit has a part of its own."""
    total, after, _, _ = _chain(sizes, limit)
    opens = np.zeros(len(sizes), dtype=np.int64)
    j = int(np.searchsorted(total, limit - used, "right")) - 1 if used else after[0]
    while j < len(sizes):
        opens[j] = 1
        j = after[j]
    return part + np.cumsum(opens)


def _begins(blocks: DataFrame, n: int) -> DataFrame:
    """file, block, fill and part in which each of the blocks (file, block below n, steps) begins."""
    step = lambda at, steps: F.struct(F.get(steps, at["fill"])["fill"].alias("fill"), (at["opened"] + F.get(steps, at["fill"])["opened"]).alias("opened"))
    groups = blocks.groupBy("file", F.floor(F.col("block") / FAN).cast("int").alias("above"))
    families = groups.agg(F.sort_array(F.collect_list(F.struct("block", "steps"))).alias("held"))  # FAN blocks at most
    if n <= FAN:
        begun = families.withColumn("at", F.struct(F.lit(0).alias("fill"), F.lit(1).cast("bigint").alias("opened")).cast(_STATE))
    else:
        families = stored(families, "families")
        whole = F.aggregate(F.slice("held", 2, FAN), F.get("held", F.lit(0))["steps"], lambda acc, x: F.transform(acc, lambda s: step(s, x["steps"])).cast(f"array<{_STATE}>"))
        upper = _begins(families.select("file", F.col("above").alias("block"), whole.alias("steps")), -(-n // FAN))
        begun = families.alias("x").join(upper.alias("u"), F.col("x.file").eqNullSafe(F.col("u.file")) & (F.col("x.above") == F.col("u.block")))
        begun = begun.select("x.file", "x.held", F.struct(F.col("u.fill"), F.col("u.part").alias("opened")).cast(_STATE).alias("at"))
    walked = F.aggregate("held", F.array("at"), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x["steps"]).cast(_STATE))))
    each = F.explode(F.arrays_zip(F.transform("held", lambda x: x["block"]).alias("block"), F.slice(walked, 1, F.size("held")).alias("at")))
    return begun.select("file", each.alias("e")).select("file", "e.block", "e.at.fill", F.col("e.at.opened").alias("part"))


def parts(rows: DataFrame, file: str = "file", limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """file, work_seq and part (from 1) of each work of rows, a row a writer. Works go by work_seq, null first; rows without a
    file are a file of their own; an empty table gives no rows. A file of any size is split into blocks of about `block` works."""
    kinds = dict(rows.dtypes)
    sizes = rows.groupBy(F.col(f"`{file}`").alias("file"), "work_seq").agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes, "sizes")
    n = max(1, -(-sizes.count() // block))
    # the block is a column of a written table, so both passes see the same blocks
    dealt = stored(sizes.repartitionByRange(n, "file", "work_seq").withColumn("block", F.spark_partition_id()), "dealt")
    key, work = f"file {kinds[file]}, block int", f"work_seq {kinds['work_seq']}"

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        fills, counts = transitions(_ordered(pdf)["n"].to_numpy(), limit)
        made = [{"fill": f, "opened": c} for f, c in zip(fills, counts)]
        return pd.DataFrame({"file": pdf["file"].iloc[:1], "block": pdf["block"].iloc[:1], "steps": [made]})

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        part = place(pdf["n"].to_numpy(), limit, int(pdf["fill"].iloc[0]), int(pdf["part"].iloc[0]))
        return pdf[["file", "work_seq"]].assign(part=part)

    blocks = dealt.groupBy("file", "block").applyInPandas(steps, f"{key}, steps array<{_STATE}>")
    begun = _begins(blocks, n)
    met = dealt.alias("d").join(begun.alias("b"), F.col("d.file").eqNullSafe(F.col("b.file")) & (F.col("d.block") == F.col("b.block")))
    met = met.select("d.file", "d.block", "d.work_seq", "d.n", "b.fill", "b.part")
    out = met.groupBy("file", "block").applyInPandas(settle, f"file {kinds[file]}, {work}, part int")
    return out.withColumnRenamed("file", file)


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values("work_seq", na_position="first", kind="stable")
