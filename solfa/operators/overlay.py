"""A reviewer's changes as tables beside a cleaned dataset: corrections, dropped and accepted rows.

Corrections are a log (row_index, col, value, is_merge, seq) that is only appended to; the last entry of a cell holds. Values
in long form have row_index, col and value, and issues also action, tag, original and cosmetic. Every change is a join
or a union on row_index, so the cost is that of the changed rows. Nulls in value count as blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edit(log: DataFrame, edits: DataFrame, rows: DataFrame, is_merge: bool = False) -> DataFrame:
    """log with edits (row_index, col, value, seq) of rows that exist; others are left out. An edit by hand undoes the
    mark of a merge before it, as its entry is later."""
    new = edits.join(rows.select("row_index").distinct(), "row_index", "left_semi")
    return log.unionByName(new.select("row_index", "col", F.coalesce("value", F.lit("")).alias("value"), F.lit(is_merge).alias("is_merge"), "seq"))


def current(log: DataFrame) -> DataFrame:
    """The last correction of each cell."""
    last = log.groupBy("row_index", "col").agg(F.max_by(F.struct("value", "is_merge"), "seq").alias("last"))
    return last.select("row_index", "col", "last.*")


def united(marked: DataFrame, rows: DataFrame) -> DataFrame:
    """Dropped or accepted rows with more of them."""
    return marked.select("row_index").unionByName(rows.select("row_index")).distinct()


def without(marked: DataFrame, rows: DataFrame) -> DataFrame:
    """Dropped rows without those restored; corrections and acceptances without rows that are reverted."""
    return marked.join(rows.select("row_index"), "row_index", "left_anti")


def split_dropped(rows: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the deleted ones."""
    return rows.join(dropped, "row_index", "left_anti"), rows.join(dropped, "row_index", "left_semi")


def tagged(issues: DataFrame, tag: str) -> DataFrame:
    """Rows with an issue of tag."""
    return issues.filter(F.col("tag") == tag).select("row_index").distinct()


def accept(issues: DataFrame, accepted: DataFrame) -> DataFrame:
    """issues without the errors of accepted rows."""
    errors = issues.filter("action = 'error'").join(accepted, "row_index", "left_anti")
    return errors.unionByName(issues.filter("action <> 'error'"))


def bulk_set(issues: DataFrame, tag: str, value: str, column: str | None = None) -> DataFrame:
    """Edits (row_index, col, value) of all cells with an issue of tag, or of one column in all such rows."""
    hit = issues.filter(F.col("tag") == tag)
    cells = hit.select("row_index", "col" if column is None else F.lit(column).alias("col")).distinct()
    return cells.withColumn("value", F.lit(value))


def remapped(values: DataFrame, column: str, new: Column) -> DataFrame:
    """Edits (row_index, col, value) of the cells of column that new, an expression over value, changes."""
    own = values.filter(F.col("col") == column).withColumn("new", new)
    return own.filter("new <> value").select("row_index", "col", F.col("new").alias("value"))


def signature(log: DataFrame) -> DataFrame:
    """One digest of the corrections that hold, whatever their order: rows that share the first two digits of theirs are
    joined, then these 256 digests."""
    one = current(log).select(F.sha2(F.concat_ws("\x02", F.col("row_index").cast("string"), "col", "value"), 256).alias("h"))
    return _digest(one)


def values_fingerprint(values: DataFrame) -> DataFrame:
    """One digest of each column's values and how often each occurs."""
    counts = values.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    return _digest(counts.select("col", F.sha2(F.concat_ws("\x02", "value", F.col("n").cast("string")), 256).alias("h")), "col")


def _digest(rows: DataFrame, *by: str) -> DataFrame:
    join = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ","), 256)
    return rows.groupBy(*by, F.substring("h", 1, 2).alias("part")).agg(join("h").alias("h")).groupBy(*by).agg(join("h").alias("digest"))


def first_appearance(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """key and the seq it appears at first, which orders works as they come."""
    return rows.groupBy(key).agg(F.min(seq).alias("first"))


def newest(rows: DataFrame, user: int | None, limit: int) -> DataFrame:
    """The latest entries, of one user or of all; of equal times those of the greatest id."""
    own = rows if user is None else rows.filter(F.col("user_id") == user)
    return own.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit)


def next_position(rows: DataFrame, position: str) -> DataFrame:
    return rows.agg((F.coalesce(F.max(position), F.lit(0)) + 1).alias("position"))


def worst_columns(profile: DataFrame, limit: int = 5) -> DataFrame:
    """Columns by most errors, then least completeness, then name."""
    order = [F.col("errors").desc(), F.col("completeness"), F.col("col")]
    return profile.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))
