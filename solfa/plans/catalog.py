"""Cell cleaning and dataset cleaning over the raw catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import clean_cell
from ..operators import cleaning
from . import duck_cells as duck
from .fixtures import CATALOG_MAPPING, RAW_CATALOG, spark_table, spread


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet. It is one small file that Spark reads in one task, and its cells are dear to make and to clean: its rows go to
    all cores before they are made. The join may deal them by size, so they are dealt once more."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    return spread(spark_table(spark, sf_dir, RAW_CATALOG, part=part))


def cleaned(spark: SparkSession, sf_dir: str, constants: dict[str, str] | None = None) -> DataFrame:
    return cleaning.clean_dataset(catalog(spark, sf_dir), CATALOG_MAPPING, constants, ascii_only=True)


def _cell_query(column: str, source: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = catalog(spark, sf_dir).select("row_index", clean_cell(column, F.col(source), ascii_only=True).alias("c"))
        return rows.select("row_index", "c.value", "c.action", "c.tag", "c.cosmetic")

    return run


#: query -> (canonical column, source)
CELLS = {
    "clean_isrc": ("ISRC", "isrc_code"), "clean_upc": ("UPC", "barcode"), "clean_code": ("Album cat. No.", "cat_no"),
    "clean_path": ("Audio folder (path)", "audio_path"), "clean_text": ("Mood", "mood"), "clean_label": ("Label", "record_label"),
    "clean_language": ("Language", "lang"), "clean_vocal": ("Vocal / Instrumental", "vocals"), "clean_title": ("Track Name", "song_title"),
    "clean_name": ("Singer", "artist_2"), "clean_percent": ("Revenue Split", "rev_split"),
    "clean_duration": ("Audio Duration (mm:sec)", "length_"), "clean_date": ("Release Date", "release_dt"),
}


def _cell_oracle(column: str, source: str) -> str:
    return f"WITH {duck.cells({column: [source]})} SELECT row_index, value, action, tag, cosmetic FROM cells"


def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cleaned value in long form."""
    named = [x for c in (*CATALOG_MAPPING, cleaning.LEAD) for x in (F.lit(c), F.col("values")[c])]
    return cleaned(spark, sf_dir).select("row_index", F.stack(F.lit(len(named) // 2), *named).alias("col", "value"))


def clean_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    # outer: for an inner one Spark adds a test of the issues before it, with every cleaner in it once more
    rows = cleaned(spark, sf_dir).select("row_index", F.explode_outer("issues").alias("i")).filter("i is not null")
    return rows.select("row_index", F.col("i.column").alias("col"), "i.action", "i.tag", "i.value", "i.original", "i.cosmetic")


def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.issue_histogram(cleaned(spark, sf_dir))


def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.summary(cleaned(spark, sf_dir))


def _lead() -> str:
    names = "list_filter(list_transform(flatten(list(string_split(value, ' | ') ORDER BY CASE col WHEN 'Singer' THEN 1 WHEN 'Composer' THEN 2 ELSE 3 END)), lambda x: trim(x)), lambda x: x <> '')"
    return f"""credits AS (SELECT row_index, {names} AS names FROM cell WHERE col IN ('Singer', 'Composer', 'Lyricist') GROUP BY row_index),
lead AS (SELECT row_index, array_to_string(list_filter(names, lambda x, i: list_position(list_transform(names, lambda y: lower(y)), lower(x)) = i), ' | ') AS value FROM credits)"""


#: vals(row_index, col, value) and issues(row_index, col, action, tag, value, original, cosmetic)
DATASET = f"""{duck.cells()}, {duck.merged()}, {_lead()},
vals AS (SELECT row_index, col, value FROM cell UNION ALL SELECT row_index, 'Lead Artist', value FROM lead),
issues AS (
  SELECT row_index, col, action, tag, value, original, cosmetic FROM cell WHERE action <> 'ok'
  UNION ALL SELECT row_index, col, 'error', 'missing_required', '', original, false FROM cell WHERE col IN ('ISRC', 'Track Name') AND value = ''
  UNION ALL SELECT row_index, 'Lead Artist', 'fixed', 'derived_lead_artist', value, '', false FROM lead WHERE value <> ''),
state AS (SELECT row_index, CASE WHEN bool_or(coalesce(action = 'error', false)) THEN 'error' ELSE 'clean' END AS status, count(*) FILTER (action = 'fixed') AS fixed
  FROM raw LEFT JOIN issues USING (row_index) GROUP BY row_index)"""

QUERIES = {
    **{name: _cell_query(*x) for name, x in CELLS.items()},
    "clean_values": clean_values,
    "clean_issues": clean_issues,
    "issue_histogram": issue_histogram,
    "clean_summary": clean_summary,
}
ORACLES = {
    **{name: _cell_oracle(*x) for name, x in CELLS.items()},
    "clean_values": f"WITH {DATASET} SELECT row_index, col, value FROM vals",
    "clean_issues": f"WITH {DATASET} SELECT row_index, col, action, tag, value, original, cosmetic FROM issues",
    "issue_histogram": f"WITH {DATASET} SELECT action, tag, count(*) AS n FROM issues GROUP BY ALL",
    "clean_summary": f"""WITH {DATASET} SELECT count(*) AS total, count(*) FILTER (status = 'clean') AS clean, count(*) FILTER (status = 'clean') AS auto_clean,
  CAST(0 AS BIGINT) AS manual_clean, count(*) FILTER (status = 'error') AS errors, CAST(sum(fixed) AS BIGINT) AS auto_fixed, CAST(0 AS BIGINT) AS deleted FROM state""",
}
