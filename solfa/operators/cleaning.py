"""Datasets cleaned by a compiled mapping: one struct a column, and the issues of each row.

A cleaned dataset has row_index, values (map of column to text) and issues (array of structs), in the order cells,
required columns, constants, lead artist; every step is a Column expression, so a whole sheet is a chain of projections."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import clean_cell, clean_value
from ..functions.schema import CREDITS, REQUIRED
from ..functions.text import distinct_by_lower, joined, pieces, side_by_side, staging

ISSUE = "struct<column:string,action:string,tag:string,message:string,value:string,original:string,cosmetic:boolean,related_rows:array<bigint>>"
LEAD = "Lead Artist"


def issue(column: str | Column, action: str, tag: str | Column, message: Column | str, value: Column, original: Column, cosmetic: Column | bool = False, related: Column | None = None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    related = F.lit(None) if related is None else related
    return F.struct(
        text(column).alias("column"), text(action).alias("action"), text(tag).alias("tag"), text(message).alias("message"),
        text(value).alias("value"), text(original).alias("original"), text(cosmetic).alias("cosmetic"), related.cast("array<bigint>").alias("related_rows"),
    ).cast(ISSUE)


def lead_artist(value: Column | None, credits: list[Column]) -> Column:
    """Lead artists and credited names together, each name once, in order."""
    sources = ([value] if value is not None else []) + credits
    return joined(distinct_by_lower(F.flatten(F.array(*(pieces(s) for s in sources)))))


def clean_dataset(raw: DataFrame, mapping: dict[str, list[str]], constants: dict[str, str] | None = None, as_of: int = 2026, ascii_only: bool = False) -> DataFrame:
    """row_index, values, issues of raw (row_index and text columns) by mapping (canonical column -> source columns).
    Source columns that raw lacks count as blank. constants fill blank cells."""
    present = tuple((c, tuple((s, s in raw.columns) for s in sources)) for c, sources in mapping.items())
    stages, cells, out, lead, final = _compiled(raw.sparkSession.sparkContext.applicationId, present, tuple((constants or {}).items()), as_of, ascii_only)
    rows = raw
    for level in stages:
        rows = rows.select("*", *level)
    rows = rows.select("row_index", *cells).select("row_index", *out)
    return (rows.select("*", *lead) if lead else rows).select("row_index", *final)


@lru_cache(maxsize=16)
def _compiled(application: str, mapping: tuple, constants: tuple, as_of: int, ascii_only: bool) -> tuple[list[Column], ...]:
    """The columns of each step, which name their inputs only. They are thousands of small expressions, so a session
    builds those of a mapping once."""
    options = {"as_of": as_of, "ascii_only": ascii_only}
    found = {c: [F.coalesce(F.col(f"`{s}`"), F.lit("")) if held else F.lit("") for s, held in sources] for c, sources in mapping}
    with staging() as stages:
        made = side_by_side([lambda c=c, raws=raws: clean_value(c, raws, **options) for c, raws in found.items()])
    cells = [cell.alias(f"c{i}") for i, cell in enumerate(made)]
    value: dict[str, Column] = {c: F.col(f"c{i}.value") for i, c in enumerate(found)}
    issues: list[Column] = []
    for i, c in enumerate(found):
        cell = F.col(f"c{i}")
        issues.append(F.when(cell["action"] != "ok", issue(c, cell["action"], cell["tag"], cell["message"], cell["value"], cell["original"], cell["cosmetic"])))
        if c in REQUIRED:
            issues.append(F.when(cell["value"] == "", issue(c, "error", "missing_required", f"{c} is required but empty.", F.lit(""), cell["original"])))
    for c, constant in constants:
        filled = clean_cell(c, F.lit(constant), **options)
        blank = value[c] == "" if c in value else F.lit(True)
        fill = issue(c, "fixed", "filled_constant", "Filled this blank cell with the column value you set.", filled["value"], F.lit(""))
        wrong = issue(c, "error", filled["tag"], filled["message"], filled["value"], filled["original"], filled["cosmetic"])
        issues.append(F.when(blank, F.when(filled["action"] == "error", wrong).when(filled["value"] != "", fill)))
        value[c] = F.when(blank, filled["value"]).otherwise(value[c]) if c in value else filled["value"]
    out = [F.filter(F.array(*issues), lambda x: x.isNotNull()).alias("issues"), *(v.alias(c) for c, v in value.items())]
    values, lead, last = {c: F.col(f"`{c}`") for c in value}, [], F.col("issues")
    if any(c in values for c in (*CREDITS, LEAD)):
        lead = [lead_artist(values.get(LEAD), [values[c] for c in CREDITS if c in values]).alias("_lead")]
        had = values.get(LEAD, F.lit(""))
        blocked = F.exists("issues", lambda x: (x["column"] == LEAD) & (x["action"] == "error"))
        fill = ~blocked & (F.col("_lead") != had)
        others = F.filter("issues", lambda x: ~((x["column"] == LEAD) & (x["action"] == "fixed")))
        note = issue(LEAD, "fixed", "derived_lead_artist", "Filled from Singer / Composer / Lyricist (duplicates removed).", F.col("_lead"), had)
        last = F.when(fill, F.array_append(others, note)).otherwise(F.col("issues"))
        values[LEAD] = F.when(fill, F.col("_lead")).otherwise(had)
    pairs = F.create_map(*(x for c, v in values.items() for x in (F.lit(c), v)))
    return stages.levels, cells, out, lead, [pairs.alias("values"), last.alias("issues")]


def status() -> Column:
    return F.when(F.exists("issues", lambda x: x["action"] == "error"), "error").otherwise("clean")


def issue_histogram(cleaned: DataFrame) -> DataFrame:
    """action, tag and the number of issues; a fix without a tag counts as trimmed."""
    rows = cleaned.select(F.explode_outer("issues").alias("i")).filter("i is not null").select("i.action", F.coalesce("i.tag", F.lit("trimmed")).alias("tag"))
    return rows.groupBy("action", "tag").agg(F.count(F.lit(1)).alias("n"))


def summary(cleaned: DataFrame, manual: DataFrame | None = None, deleted: int = 0) -> DataFrame:
    """Totals of a cleaned dataset. manual: row_index of rows a reviewer touched."""
    rows = cleaned.withColumn("status", status())
    if manual is not None:
        rows = rows.join(manual.select("row_index").distinct().withColumn("touched", F.lit(True)), "row_index", "left")
    else:
        rows = rows.withColumn("touched", F.lit(None).cast("boolean"))
    clean, touched = F.col("status") == "clean", F.coalesce("touched", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(clean).alias("clean"),
        F.count_if(clean & ~touched).alias("auto_clean"),
        F.count_if(clean & touched).alias("manual_clean"),
        F.count_if(~clean).alias("errors"),
        F.coalesce(F.sum(F.size(F.filter("issues", lambda x: x["action"] == "fixed"))), F.lit(0)).cast("long").alias("auto_fixed"),
        F.lit(deleted).cast("long").alias("deleted"),
    )
