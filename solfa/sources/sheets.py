"""Sheets in CSV files as text columns: the first row with a cell is the header, blank rows go, ragged rows are evened.

A file is parsed by Spark's reader, quotes doubled inside quotes and line ends inside cells allowed, so one file is one
task (an upload has at most 20 MB); a folder's files are read side by side."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_COLUMNS = 1000


class SheetError(ValueError):
    """A sheet that can't be read: no header, no data, too many columns, or files of one folder with unlike headers."""


def _stripped(cell: Column) -> Column:
    return F.regexp_replace(cell, "(?U)^\\s+|\\s+$", "")


def _width(spark: SparkSession, path: str) -> int:
    """No row has more cells: the most commas of a line, and one."""
    most = spark.read.text(path).agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))))).first()[0]
    return min(MOST_COLUMNS, most or 0) + 1


def _rows(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Rows with a cell that isn't white space: file, at (its order), c0, c1, ... Missing cells are ''."""
    names = [f"c{i}" for i in range(width)]
    rows = spark.read.csv(path, schema=", ".join(f"{c} string" for c in names), header=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", encoding="UTF-8")
    rows = rows.select(F.input_file_name().alias("file"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in names))
    rows = rows.withColumn("c0", F.regexp_replace("c0", "^\ufeff", ""))
    return rows.filter(F.exists(F.array(*names), lambda x: _stripped(x) != "")).withColumn("at", F.monotonically_increasing_id())


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The one header of the files of path, without blank cells at its end: each file's first row with a cell. A file without
    such a row has none and no say; files with unlike headers are refused, as cells would stand under wrong names."""
    width = _width(spark, path)
    cells = F.array(*(_stripped(F.col(f"c{i}")) for i in range(width)))
    first = _rows(spark, path, width).groupBy("file").agg(F.min_by(cells, "at").alias("cells"))
    last = F.array_max(F.transform("cells", lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    found = [r["cells"] for r in first.select(F.slice("cells", F.lit(1), last).alias("cells")).distinct().limit(2).collect()]
    if not found:
        raise SheetError("No column headers were found.")
    if len(found) > 1:
        raise SheetError("The files have unlike headers.")
    if len(found[0]) > MOST_COLUMNS:
        raise SheetError("The file has too many columns.")
    return found[0]


def repeated_headers(header: list[str]) -> list[str]:
    """Headers that occur more than once."""
    return [h for h, n in Counter(header).items() if h and n > 1]


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, row_index (from 0 in each file) and a text column for each header of path, a file or a folder of files with one
    header. Columns without a header and repeats of one are named by their place. Cells beyond the header are left out."""
    header, taken = header_of(spark, path), {"file", "row_index"}
    names = []
    for i, h in enumerate(header):
        names.append(h if h and h.lower() not in taken else f"column_{i + 1}")
        taken.add(names[-1].lower())
    rows = _rows(spark, path, len(header))
    place = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    rows = rows.withColumn("row_index", (place - 2).cast("long")).filter("row_index >= 0")
    return rows.select("file", "row_index", *(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
