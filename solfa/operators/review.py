"""Review: views, filters, sorting, pages, profiles and value panels of a cleaned dataset."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import GRADES, TYPES
from ..functions.text import merge_key, pieces
from .cleaning import status

STRIP, CAP = 1800, 1000


def view(cleaned: DataFrame, which: str = "all", manual: DataFrame | None = None) -> DataFrame:
    """all, error, clean, auto_clean or manual_clean rows. manual: row_index of rows a reviewer touched."""
    if which == "all":
        return cleaned
    rows = cleaned.filter(status() == ("error" if which == "error" else "clean"))
    if which in ("auto_clean", "manual_clean"):
        touched = manual if manual is not None else cleaned.select("row_index").limit(0)
        rows = rows.join(touched.select("row_index").distinct(), "row_index", "left_semi" if which == "manual_clean" else "left_anti")
    return rows


def with_tags(cleaned: DataFrame, *tags: str) -> DataFrame:
    return cleaned.filter(F.exists("issues", lambda x: x["tag"].isin(*tags)))


def is_name(column: str) -> bool:
    return TYPES.get(column, "text") == "name"


def with_values(cleaned: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """Rows that hold, in every column, one of its values exactly (a name of a joined cell, else the whole value)."""
    for column, values in filters.items():
        wanted = F.transform(F.array(*map(F.lit, values)), merge_key)
        own = F.transform(pieces(F.coalesce(F.col("values")[column], F.lit("")), is_name(column)), merge_key)
        cleaned = cleaned.filter(F.arrays_overlap(own, wanted))
    return cleaned


def parse_filters(raw: str | None) -> dict[str, list[str]]:
    """Filters of a JSON object of columns and values; anything malformed is no filter."""
    try:
        data = json.loads(raw or "{}")
    except ValueError:
        return {}
    lists = {c: [v] if isinstance(v, str) else v for c, v in data.items()} if isinstance(data, dict) else {}
    kept = {c: [str(x) for x in v if str(x).strip()] for c, v in lists.items() if isinstance(v, (list, tuple))}
    return {c: v for c, v in kept.items() if v}


def with_text(cleaned: DataFrame, needle: str) -> DataFrame:
    low = needle.strip().lower()
    return cleaned.filter(F.exists(F.map_values("values"), lambda v: F.contains(F.lower(v), F.lit(low)))) if low else cleaned


def with_blanks(cleaned: DataFrame, column: str = "*") -> DataFrame:
    if column == "*":
        return cleaned.filter(F.exists(F.map_values("values"), lambda v: F.trim(v) == ""))
    return cleaned.filter(F.trim(F.coalesce(F.col("values")[column], F.lit(""))) == "")


def page(cleaned: DataFrame, column: str | None, descending: bool, number: int, size: int) -> DataFrame:
    """Page `number` (from 0) by one column, case aside, ties in row order."""
    key = F.lower(F.trim(F.coalesce(F.col("values")[column], F.lit("")))) if column else F.col("row_index")
    return cleaned.orderBy(key.desc() if descending else key, "row_index").offset(number * size).limit(size)


def profile(cleaned: DataFrame) -> DataFrame:
    """Each column's filled, blank, distinct (values) and named (single names), fixed, normalized, errors, completeness."""
    total = cleaned.agg(F.count(F.lit(1)).alias("total"))
    cells = cleaned.select(F.explode("values").alias("col", "raw")).withColumn("value", F.trim("raw"))
    names = [c for c, t in TYPES.items() if t == "name"]
    own = F.when(F.col("value") == "", F.array().cast("array<string>")).when(F.col("col").isin(*names), pieces(F.col("value"))).otherwise(F.array("value"))
    per_cell = cells.groupBy("col").agg(F.count_if(F.col("value") != "").alias("filled"), F.count_distinct(F.when(F.col("value") != "", F.col("value"))).alias("n_distinct"))
    per_name = cells.select("col", F.explode(own).alias("name")).groupBy("col").agg(F.count_distinct("name").alias("n_names"))
    found = cleaned.select(F.explode("issues").alias("i")).select("i.*").groupBy(F.col("column").alias("col")).agg(
        F.count_if(F.col("action") == "error").alias("errors"),
        F.count_if((F.col("action") == "fixed") & ~F.col("cosmetic")).alias("fixed"),
        F.count_if((F.col("action") == "fixed") & F.col("cosmetic")).alias("normalized"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = per_cell.join(per_name, "col", "left").join(found, "col", "left").join(F.broadcast(total))  # one row
    return out.select("col", "filled", (F.col("total") - F.col("filled")).alias("blank"), "n_distinct", zero("n_names"), zero("fixed"), zero("normalized"), zero("errors"), F.bround(F.col("filled") / F.col("total"), 4).alias("completeness"))


def top_values(cleaned: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of each column, ties by first appearance."""
    cells = cleaned.select("row_index", F.explode("values").alias("col", "raw")).withColumn("value", F.trim("raw")).filter("value <> ''")
    counts = cells.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first"))
    order = Window.partitionBy("col").orderBy(F.col("n").desc(), "first")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("col", "place", "value", "n")


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][0], GRADES[0][1])
    for cut, letter in GRADES[1:]:
        out = out.when(score >= cut, letter)
    return out.otherwise("F")


def quality(cleaned: DataFrame, columns: int) -> DataFrame:
    """score (0 to 100) and grade of a dataset of so many columns."""
    wrong = F.size(F.filter("issues", lambda x: x["action"] == "error"))
    totals = cleaned.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size(F.filter(F.map_values("values"), lambda v: F.trim(v) != ""))).alias("filled"),
        F.sum(wrong).alias("errors"),
        F.count_if(status() == "clean").alias("clean"),
    )
    cells = F.col("n") * columns
    score = F.bround(100 * (0.5 * (1 - F.col("errors") / cells) + 0.3 * (F.col("clean") / F.col("n")) + 0.2 * (F.col("filled") / cells)))
    bounded = F.when(F.col("n") == 0, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), score))).cast("int")
    return totals.select(bounded.alias("score")).withColumn("grade", grade(F.col("score")))


def ribbon(cleaned: DataFrame, total: int) -> DataFrame:
    """pixel and worst (0 clean, 1 corrected, 2 error) of at most STRIP stretches of rows; row_index is dense."""
    scale = max(1, -(-total // STRIP))
    kind = F.transform("issues", lambda x: F.when(x["action"] == "error", 2).when(x["cosmetic"], 0).otherwise(1))
    worst = F.coalesce(F.array_max(kind), F.lit(0))
    return cleaned.groupBy(F.floor(F.col("row_index") / scale).alias("pixel")).agg(F.max(worst).alias("worst"))


def value_counts(cleaned: DataFrame, column: str) -> DataFrame:
    """value and n: single names of a name column, else whole values."""
    own = pieces(F.coalesce(F.col("values")[column], F.lit("")), is_name(column))
    return cleaned.select(F.explode(own).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def unique_values(cleaned: DataFrame, column: str, needle: str = "", cap: int = CAP) -> DataFrame:
    """The most frequent values (ties by value), up to cap, of those that contain needle."""
    counts = value_counts(cleaned, column)
    if needle.strip():
        counts = counts.filter(F.contains(F.lower("value"), F.lit(needle.strip().lower())))
    return counts.orderBy(F.col("n").desc(), "value").limit(cap)


def remap(value: Column, column: str, alias: dict[str, str]) -> Column:
    """A cell with the values of alias replaced: each name of a name column, else the whole value."""
    if not alias:
        return value
    table = F.create_map(*(x for k, v in alias.items() for x in (merge_key(F.lit(k)), F.lit(v))))
    own = pieces(value, is_name(column))
    new = F.transform(own, lambda p: F.coalesce(table[merge_key(p)], p))
    if is_name(column):
        replaced = F.array_join(F.array_distinct(F.flatten(F.transform(new, lambda x: pieces(x)))), " | ")
    else:
        replaced = F.get(new, F.lit(0))
    return F.when(F.size(own) == 0, value).otherwise(replaced)
