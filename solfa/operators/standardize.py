"""A sheet of any layout brought into the canonical columns: packed credits taken apart, headers matched, values made ready
and cleaned.

Roles of packed credits are headers like others, and are matched as rows of a table: however many different roles free text
holds, only those that fill a column come to the driver, and only they become columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import first_cells, type_hits
from ..functions.schema import COLUMNS, CREDITS, SEPARATOR
from . import matching
from .cleaning import LEAD, clean_dataset, lead_artist

SAMPLE, PACKED_SHARE, MOST_SOURCES = 150, 0.6, 500
DURATION, NUMBER = "Audio Duration (mm:sec)", "Record #"
_SEGMENT = "^\\s*([A-Za-z][A-Za-z ./&-]{0,30}?)\\s*:\\s*(.+?)\\s*$"


def segments(cell: Column) -> Column:
    """(role, value) pairs of a cell like 'composer: X | singer: Y', roles in small letters."""
    parts = F.filter(F.split(F.coalesce(cell, F.lit("")), "\\s*[|;\\n]+\\s*"), lambda p: p.rlike(_SEGMENT))
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_replace(F.lower(F.trim(F.regexp_extract(p, _SEGMENT, 1))), "\\s+", " ").alias("role"), F.regexp_extract(p, _SEGMENT, 2).alias("value")))
    return F.filter(pairs, lambda s: (s["role"] != "") & (s["value"] != ""))


def packed_columns(rows: DataFrame) -> DataFrame:
    """col, place, seen and hits: of the first SAMPLE cells of each column that aren't blank, in row order, those that hold two
    segments or more. One pass counts the cells of all columns, one ranks those of the first stretches. Blank columns have no row."""
    names = [c for c in rows.columns if c != "row_index"]
    cells = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("col"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(names)))
    filled = rows.select("row_index", F.explode(cells).alias("c")).select("row_index", "c.*").filter(F.trim("value") != "")
    first = first_cells(filled, ["place", "col"], SAMPLE)
    return first.groupBy("col", "place").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.size(segments(F.col("value"))) >= 2).alias("hits"))


def packed_names(rows: DataFrame) -> list[str]:
    """Columns most of whose sampled cells are packed, in their order."""
    found = packed_columns(rows).filter(F.col("hits") / F.col("seen") >= PACKED_SHARE)
    return [r["col"] for r in found.orderBy("place").select("col").collect()]  # one row a column


def _of_role(pairs: Column, role: Column | str) -> Column:
    """The values that pairs give a role, each once, joined."""
    return F.array_join(F.array_distinct(F.transform(F.filter(pairs, lambda s: s["role"] == role), lambda s: s["value"])), SEPARATOR)


def explode_packed(rows: DataFrame, column: str, roles: list[str]) -> DataFrame:
    """rows with a column for each of roles (values joined by ' | ', each once) in place of the packed column."""
    rows = rows.withColumn("_pairs", segments(F.col(column)))
    return rows.select(*[c for c in rows.columns if c not in (column, "_pairs")], *(_of_role(F.col("_pairs"), r).alias(r) for r in roles))


def visible(value: Column) -> Column:
    return F.regexp_replace(value, "[\\u200b\\u200c\\u200d\\u2060\\ufeff]", "")


def seconds_as_minutes(value: Column) -> Column:
    """A bare number of seconds as m:ss, halves to even; anything else without invisible characters."""
    s = visible(value)
    total = F.bround(F.when(F.trim(s).rlike("^\\d+(\\.\\d+)?$"), F.trim(s)).try_cast("decimal(20,6)"), 0).cast("long")
    text = F.concat(F.floor(total / 60).cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0"))
    return F.coalesce(text, s)


def numbered(rows: DataFrame, column: str = "Record #") -> DataFrame:
    """Blank record numbers filled with the row's place, from 1."""
    own = F.col(f"`{column}`")
    return rows.withColumn(column, F.when(own == "", (F.col("row_index") + 1).cast("string")).otherwise(own))


def _headers(rows: DataFrame, packed: list[str], pairs: Column) -> tuple[DataFrame, DataFrame]:
    """Headers (file, place, header; roles after the columns, by where they first occur) and what their values look like in the
    first SAMPLE rows (file, place, type, fraction)."""
    kept = [c for c in rows.columns if c != "row_index" and c not in packed]
    place = lambda *xs: F.struct(*(x.cast("long").alias(n) for x, n in zip(xs, ("part", "row", "nth"))))
    known = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(kept)], "i int, header string")
    heads = known.select(F.lit("sheet").alias("file"), place(F.lit(0), F.col("i"), F.lit(0)).alias("place"), "header")
    sample = rows.orderBy("row_index").limit(SAMPLE)
    cells = [F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("value")) for c in kept]
    if packed:
        taken = [F.lit(" ".join(c.lower().split())) for c in rows.columns]
        each = rows.select("row_index", F.posexplode(pairs).alias("nth", "pair")).select("row_index", "nth", "pair.*")
        # the first column with a role comes before the first row, and that before the first segment
        order = F.min(place(F.col("part"), F.col("row_index"), F.col("nth")))
        roles = each.filter(~F.col("role").isin(*taken)).groupBy(F.col("role").alias("header")).agg(order.alias("place"))
        heads = heads.unionByName(roles.select(F.lit("sheet").alias("file"), "place", "header"))
    values = sample.select("row_index", F.explode(F.array(*cells)).alias("c")).select("row_index", "c.*") if cells else None
    if packed:
        named = sample.select("row_index", pairs.alias("pairs")).select("row_index", "pairs", F.explode(F.array_distinct(F.transform("pairs", lambda s: s["role"]))).alias("col"))
        own = named.select("row_index", "col", _of_role(F.col("pairs"), F.col("col")).alias("value"))
        values = values.unionByName(own) if values is not None else own
    hits = type_hits(values).join(heads.select(F.col("header").alias("col"), "file", "place"), "col").select("file", "place", "type", "fraction")
    return heads, hits


def sources(rows: DataFrame, packed: list[str] | None = None) -> tuple[DataFrame, Column]:
    """What fills each canonical column of a sheet (row_index and text columns), as matching.assign gives it and tightened, and
    the credits of a row as (part, role, value)."""
    packed = packed_names(rows) if packed is None else packed
    parts = [F.transform(segments(F.col(f"`{c}`")), lambda s, i=i: F.struct(F.lit(i + 1).alias("part"), s["role"].alias("role"), s["value"].alias("value"))) for i, c in enumerate(packed)]
    pairs = F.flatten(F.array(*parts)) if parts else F.lit(None)
    heads, hits = _headers(rows, packed, pairs)
    scores = matching.header_scores(heads, matching.targets(rows.sparkSession))
    return matching.tighten(matching.assign(matching.with_content(scores, hits))), pairs


def standardized(rows: DataFrame, as_of: int = 2026, ascii_only: bool = False) -> tuple[DataFrame, dict[str, list[str]]]:
    """row_index and the canonical columns of a sheet (row_index, from 0 without gaps, and text columns), and the headers or
    roles that fill each column, main one first.

    Packed columns give way to their roles. Values lose invisible characters, bare seconds become minutes, then all is cleaned;
    what can't be mended stays as it is. Lead artists take in all credits, and blank record numbers are the rows' places.
    Blank cells, nulls and columns that nothing fills are ''. More than MOST_SOURCES sources raise ValueError."""
    found, pairs = sources(rows)
    main = found.select("target", "header", "position", "nth").orderBy("position", "nth").limit(MOST_SOURCES + 1).collect()
    if len(main) > MOST_SOURCES:
        raise ValueError(f"More than {MOST_SOURCES} headers fill columns.")
    filled: dict[str, list[str]] = {}
    for r in main:
        filled.setdefault(r["target"], []).append(r["header"])
    cells, mapping = [], {}
    for target, headers in filled.items():
        for h in headers:
            raw = F.col(f"`{h}`") if h in rows.columns else _of_role(F.col("_pairs"), h)
            mapping.setdefault(target, []).append(f"s{len(cells)}")
            cells.append((seconds_as_minutes(raw) if target == DURATION else visible(raw)).alias(f"s{len(cells)}"))
    table = rows.withColumn("_pairs", pairs).select("row_index", *cells)
    values = lambda c: F.coalesce(F.col("values")[c], F.lit(""))
    if mapping:
        table = clean_dataset(table, mapping, as_of=as_of, ascii_only=ascii_only)
    else:
        table = table.withColumn("values", F.lit(None).cast("map<string,string>"))
    own = {c: values(c) for c in COLUMNS} | {LEAD: lead_artist(values(LEAD), [values(c) for c in CREDITS])}
    return numbered(table.select("row_index", *(v.alias(c) for c, v in own.items())), NUMBER), filled
