"""Headers as tokens, detectors of what a column's values are, and types of exported text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import parse_date

#: Words of a header that say nothing by themselves, and spellings of the vocal column.
NOISE = ("the", "of", "a", "an", "name", "no", "number", "code", "id")
VOCAL = ("vocal", "vocals", "v", "instrumental", "instru", "inst")
SAMPLE = 150


def header_text(header: Column) -> Column:
    """Lower case, words apart at changes of case and digits, one space for all else. Null is ''."""
    apart = F.regexp_replace(F.coalesce(header, F.lit("")), "(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.trim(F.regexp_replace(F.lower(apart), "[^a-z0-9]+", " "))


def singular(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(F.left(token, n - 3), F.lit("y")))
        .when((n > 4) & token.endswith("ses"), F.left(token, n - 2))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), F.left(token, n - 1))
        .otherwise(token)
    )


def header_tokens(header: Column, content: bool = False) -> Column:
    """The set of singular words of a header, sorted; content: without noise."""
    found = F.transform(F.filter(F.split(header_text(header), " "), lambda x: x != ""), singular)
    found = F.array_sort(F.array_distinct(found))
    return F.filter(found, lambda x: ~x.isin(*NOISE)) if content else found


def detectors(value: Column) -> dict[str, Column]:
    """Whether a trimmed value is of each type."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    share = F.trim(F.regexp_replace(value, "%$", ""))
    number = F.when(share.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"), share).try_cast("double")
    return {
        "isrc": F.replace(F.upper(bare), F.lit("-"), F.lit("")).rlike("^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"),
        "upc": bare.rlike("^[0-9]{12,13}$"),
        "date": F.coalesce(parse_date(value), parse_date(F.split(value, " ")[0])).isNotNull(),
        "duration": value.rlike("^\\d{1,2}:\\d{2}(:\\d{2})?$"),
        "vocal_instrumental": F.lower(value).isin(*VOCAL),
        "percent": F.coalesce(number.between(0, 100) & (value.endswith("%") | F.contains(share, F.lit("."))), F.lit(False)),
    }


#: Rows of a stretch, within which cells are counted before any are ranked.
STRETCH = 1024


def first_cells(cells: DataFrame, keys: list[str], sample: int) -> DataFrame:
    """The first sample rows of each key (a column of a sheet) by row_index, with nth (from 1).

    Counts by stretch of row_index tell where the last of them lies, so only rows up to that stretch are ranked: no task
    sorts a column. Counting needs a few bytes for each STRETCH rows of a column."""
    stretch = F.floor(F.col("row_index") / STRETCH)
    counts = cells.groupBy(*keys, stretch.alias("stretch")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before", before).filter(F.col("before") < sample).groupBy(*keys).agg(F.max("stretch").alias("last"))
    near = cells.join(F.broadcast(last), keys).filter(stretch <= F.col("last")).drop("last")  # one row a column
    return near.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("row_index"))).filter(F.col("nth") <= sample)


def type_hits(values: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """col, type and the share of the first sample values of each column (row_index, col, value) that aren't blank."""
    rows = values.select("row_index", "col", F.trim("value").alias("value")).filter("value <> ''")
    first = first_cells(rows, ["col"], sample)
    hits = first.groupBy("col").agg(*(F.avg(hit.cast("int")).alias(kind) for kind, hit in detectors(F.col("value")).items()))
    return hits.unpivot("col", list(detectors(F.col("value"))), "type", "fraction")


def text_type(value: Column) -> Column:
    """How an export writes a value: int, float, or text (as all with a leading zero)."""
    s = F.coalesce(value, F.lit(""))
    return (
        F.when(s.rlike("^0[^.]"), "text").when(s.rlike("^-?\\d+$"), "int").when(s.rlike("^-?\\d*\\.\\d+$"), "float").otherwise("text")
    )
