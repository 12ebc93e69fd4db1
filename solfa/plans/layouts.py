"""Sheets of any layout in the canonical columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.schema import COLUMNS
from ..operators import standardize
from . import duck_cells as duck
from .catalog import _lead
from .fixtures import RAW_LAYOUT, duck_table, spark_table, spread

#: What RAW_LAYOUT's headers and roles mean, for the twin.
MEANING = {
    "Record #": ["record_no"], "ISRC": ["isrc_code"], "UPC": ["barcode"], "Album Name": ["album"], "Track Name": ["song_title"], "Singer": ["singer"],
    "Audio Duration (mm:sec)": ["seconds"], "Language": ["language"], "Lyricist": ["lyricist"], "Composer": ["composer"],
}


def packed_columns(spark, sf_dir):
    """How packed the cells of each column of a sheet are."""
    found = standardize.packed_columns(spread(spark_table(spark, sf_dir, RAW_LAYOUT)))
    return found.select("col", "seen", "hits", (F.col("hits") / F.col("seen") >= standardize.PACKED_SHARE).alias("packed"))


def standardized_sheet(spark, sf_dir):
    """Every row of a sheet in the canonical columns, by headers and roles that the engine matched itself."""
    return standardize.standardized(spread(spark_table(spark, sf_dir, RAW_LAYOUT)), ascii_only=True)[0]


QUERIES = {"packed_columns": packed_columns, "standardized_sheet": standardized_sheet}

_SEGMENT = r"^\s*([A-Za-z][A-Za-z ./&-]*?)\s*:\s*(.+?)\s*$"
_CUT = r"regexp_split_to_array({c}, '\s*[|;]\s*')"
_TEXTS = ["record_no", "isrc_code", "barcode", "song_title", "album", "audio_credits", "more_credits", "duration", "language", "zz_unknown"]
#: The sheet with roles as columns, and its values made ready.
_READY = rf"""lay AS ({duck_table(RAW_LAYOUT)}),
seg AS (SELECT row_index, c, i, lower(regexp_extract(p, '{_SEGMENT}', 1)) AS role, regexp_extract(p, '{_SEGMENT}', 2) AS v FROM (
  SELECT row_index, 1 AS c, unnest({_CUT.format(c='audio_credits')}) AS p, generate_subscripts({_CUT.format(c='audio_credits')}, 1) AS i FROM lay
  UNION ALL SELECT row_index, 2, unnest({_CUT.format(c='more_credits')}), generate_subscripts({_CUT.format(c='more_credits')}, 1) FROM lay)),
lists AS (SELECT row_index, role, list(v ORDER BY c, i) AS l FROM seg WHERE role <> '' GROUP BY ALL),
roles AS (SELECT row_index, role, array_to_string({duck.ordered_distinct('l')}, ' | ') AS t FROM lists),
took AS (SELECT row_index, {', '.join(f"max(t) FILTER (role = '{r}') AS {r}" for r in ('singer', 'lyricist', 'composer'))} FROM roles GROUP BY row_index),
bare AS (SELECT row_index, regexp_matches(trim(duration), '^[0-9]+(\.[0-9]+)?$') AS s, CAST(round_even(TRY_CAST(trim(duration) AS DOUBLE), 0) AS BIGINT) AS n FROM lay),
ready AS (SELECT row_index, record_no, isrc_code, barcode, replace(song_title, '⁠', '') AS song_title, album, language, coalesce(singer, '') AS singer, coalesce(lyricist, '') AS lyricist, coalesce(composer, '') AS composer,
  CASE WHEN s THEN n // 60 || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') ELSE duration END AS seconds FROM lay LEFT JOIN took USING (row_index) JOIN bare USING (row_index))"""
_FULL = f"WITH {_READY}, {duck.cells(MEANING, 'SELECT * FROM ready')}, {duck.merged()}, {_lead()}"


def _picked(column: str) -> str:
    if column in MEANING:
        value = f"coalesce(max(value) FILTER (col = '{column}'), '')"
        return f"CASE WHEN {value} = '' THEN CAST(row_index + 1 AS VARCHAR) ELSE {value} END" if column == standardize.NUMBER else value
    return "coalesce(max(lead), '')" if column == "Lead Artist" else "''"


_COLUMNS = ", ".join(f'{_picked(c)} AS "{c}"' for c in COLUMNS)
_PACKED = " UNION ALL ".join(f"SELECT row_index, '{c}' AS col, {c} AS v FROM lay" for c in _TEXTS)
ORACLES = {
    "packed_columns": rf"""WITH lay AS ({duck_table(RAW_LAYOUT)}), f AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY row_index) AS nth FROM ({_PACKED}) WHERE trim(v) <> ''),
  n AS (SELECT col, len(list_filter({_CUT.format(c='v')}, lambda p: regexp_matches(p, '{_SEGMENT}'))) AS n FROM f WHERE nth <= 150)
  SELECT col, count(*) AS seen, count(*) FILTER (n >= 2) AS hits, count(*) FILTER (n >= 2) / count(*) >= 0.6 AS packed FROM n GROUP BY col""",
    "standardized_sheet": f"""{_FULL} SELECT row_index, {_COLUMNS} FROM (SELECT c.row_index, col, c.value, l.value AS lead FROM cell c LEFT JOIN lead l USING (row_index)) GROUP BY row_index""",
}
