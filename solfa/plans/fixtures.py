"""Input shapes derived from the driver's tables. Each recipe is SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

#: A messy catalogue sheet: one row for each part.
RAW_CATALOG = """
SELECT i AS row_index,
  CASE i % 9 WHEN 1 THEN 'in-a01-19-' || lpad(CAST(k % 100000 AS STRING), 5, '0') WHEN 4 THEN 'INA01' || lpad(CAST(k % 1000000 AS STRING), 6, '0')
    WHEN 7 THEN '' ELSE 'INA01' || lpad(CAST(k AS STRING), 7, '0') END AS isrc_code,
  CASE i % 8 WHEN 3 THEN '890- ' || lpad(CAST(m AS STRING), 9, '0') WHEN 5 THEN lpad(CAST(m AS STRING), 10, '0')
    ELSE CAST(890000000000 + m AS STRING) END AS barcode,
  p_type || ' hits ' || CAST(CASE WHEN i % 13 = 0 THEN m + 1 ELSE m END AS STRING) AS album,
  CASE i % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name WHEN 2 THEN 'N/A' WHEN 3 THEN p_name || ' $$' ELSE p_name END AS song_title,
  lower(c_mktsegment) || ' ' || split_part(p_name, ' ', 1) AS artist_1,
  CASE i % 4 WHEN 0 THEN '' WHEN 1 THEN upper(lower(c_mktsegment) || ' ' || split_part(p_name, ' ', 1)) WHEN 2 THEN 'A' || p_size || ' & B and C' ELSE 'DemoName' END AS artist_2,
  lower(c_mktsegment) || ' ' || split_part(p_name, ' ', 2) AS music_director,
  CASE WHEN i % 3 = 0 THEN '' ELSE lower(c_mktsegment) || ' ' || split_part(p_name, ' ', 1) END AS lyrics_by,
  CASE i % 6 WHEN 0 THEN lpad(CAST(1 + i % 28 AS STRING), 2, '0') || '/' || lpad(CAST(1 + i % 12 AS STRING), 2, '0') || '/2019'
    WHEN 1 THEN '2018-' || lpad(CAST(1 + i % 12 AS STRING), 2, '0') || '-15' WHEN 2 THEN CAST(1 + i % 28 AS STRING) || CASE WHEN i % 4 = 0 THEN '-Jan-69' ELSE '-Feb-68' END
    WHEN 3 THEN '2020-03-09 00:00:00' WHEN 4 THEN '31/02/2020' ELSE '1901-01-01' END AS release_dt,
  CASE i % 6 WHEN 0 THEN CAST(60 + i % 500 AS STRING) WHEN 1 THEN '3:' || lpad(CAST(i % 60 AS STRING), 2, '0') WHEN 2 THEN '0:04:' || lpad(CAST(i % 60 AS STRING), 2, '0')
    WHEN 3 THEN '4:75' WHEN 4 THEN '0' ELSE 'abc' END AS length_,
  p_type || ', & ' || p_brand || ',' AS record_label,
  CASE i % 4 WHEN 0 THEN 'hin' WHEN 1 THEN 'TAM' WHEN 2 THEN 'english' ELSE '-' END AS lang,
  CASE i % 4 WHEN 0 THEN '60% | 40%' WHEN 1 THEN '120%' WHEN 2 THEN 'abc' ELSE '12.50' END AS rev_split,
  CASE i % 4 WHEN 0 THEN 'v' WHEN 1 THEN 'INST' WHEN 2 THEN 'Vocal' ELSE 'other' END AS vocals,
  'ab ' || CAST(i AS STRING) AS cat_no,
  'C:' || chr(92) || 'music' || chr(92) || CAST(i AS STRING) AS audio_path,
  split_part(p_name, ' ', 1) AS mood
FROM (SELECT p_partkey AS i, CAST(floor(p_partkey / 3) AS BIGINT) AS k, CAST(floor(p_partkey / 4) AS BIGINT) AS m, p_name, p_type, p_brand, CAST(p_size AS STRING) AS p_size,
        p_partkey % (SELECT count(*) FROM {customer}) AS c FROM {part}) p
JOIN {customer} ON c_custkey = c
"""

#: Canonical column -> source columns of RAW_CATALOG. Mood is no canonical column.
CATALOG_MAPPING = {
    "ISRC": ["isrc_code"], "UPC": ["barcode"], "Album cat. No.": ["cat_no"], "Album Name": ["album"], "Track Name": ["song_title"],
    "Release Date": ["release_dt"], "Singer": ["artist_1", "artist_2"], "Audio Duration (mm:sec)": ["length_"],
    "Vocal / Instrumental": ["vocals"], "Language": ["lang"], "Lyricist": ["lyrics_by"], "Composer": ["music_director"],
    "Audio folder (path)": ["audio_path"], "Revenue Split": ["rev_split"], "Label": ["record_label"], "Mood": ["mood"],
}

#: Interested parties of works: one row for each line of an order. The columns, and the lines with what they are joined with.
PARTY_LIST = """
SELECT seq, CASE WHEN l_orderkey % 97 = 0 THEN '  ' ELSE 'W' || CAST(l_orderkey AS STRING) END AS work_key,
  'work ' || CAST(l_orderkey AS STRING) AS title, l_returnflag AS territory,
  CASE l_orderkey % 3 WHEN 0 THEN '3:25' WHEN 1 THEN '205' ELSE '0:03:25.5' END AS duration,
  '2019-0' || CAST(1 + l_orderkey % 9 AS STRING) || '-1' || CAST(l_orderkey % 10 AS STRING) AS publ_date,
  CASE WHEN l_orderkey % 2 = 0 THEN '2026071' ELSE '202601A' END AS dist_ref,
  CASE WHEN l_linenumber % 2 = 0 THEN upper(p_type) || ', ' || upper(p_name) ELSE s_name END AS name,
  CASE WHEN l_suppkey % 50 = 0 THEN '' ELSE CASE l_linenumber WHEN 1 THEN 'C' WHEN 2 THEN 'CA' WHEN 3 THEN 'A' WHEN 4 THEN 'E' WHEN 5 THEN 'E' WHEN 6 THEN 'SE' ELSE 'AR' END END AS role,
  CAST(l_suppkey AS STRING) AS ipi, '052:' || n_name AS society
"""
RAW_PARTIES = f"""{PARTY_LIST}FROM (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM {{lineitem}}) l
JOIN {{part}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{nation}} ON n_nationkey = s_nationkey
"""

#: One row for each work, with writers side by side.
RAW_WORKS = """
SELECT o_orderkey AS work_seq, 'song ' || CAST(o_orderkey AS STRING) AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'aka ' || o_orderpriority ELSE '' END AS alt_title,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Traditional - 39657154' WHEN o_orderkey % 11 = 0 THEN '' ELSE c_mktsegment || ' ' || o_orderstatus || ' Khan' END AS composer_1,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS STRING) ELSE '' END AS composer_1_cae,
  CASE WHEN o_orderkey % 9 = 0 THEN c_mktsegment || ' ' || o_orderstatus || ' Khan' WHEN o_orderkey % 4 = 0 THEN 'Mono' || CAST(o_custkey % 7 AS STRING) ELSE '' END AS composer_2,
  CASE WHEN o_orderkey % 9 = 0 THEN '7' || CAST(o_custkey AS STRING) ELSE '' END AS composer_2_cae,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN lower(c_mktsegment) || '  ' || o_orderstatus || ' khan' ELSE 'Lyric Writer ' || CAST(o_custkey % 13 AS STRING) END AS lyricist_1,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_custkey AS STRING) ELSE CAST(o_custkey + 1 AS STRING) END AS lyricist_1_cae,
  c_name AS singer_1, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE c_mktsegment END AS singer_2, 'INA01' || lpad(CAST(o_orderkey AS STRING), 7, '0') AS isrc,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS music_label
FROM {orders} JOIN {customer} ON c_custkey = o_custkey
"""

#: A sheet whose credits share one cell.
RAW_PACKED = """
SELECT p_partkey AS row_index, p_name AS title,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'composer: ' || p_brand || ' | singer: ' || p_type || '; lyricist: ' || p_name
    WHEN 2 THEN 'Singer: ' || p_type || ' | singer: ' || p_name || ' | singer: ' || p_type WHEN 3 THEN 'composer: ' || p_name ELSE 'lyricist : ' || p_name || ';composer:' || p_brand || ';nothing' END AS credits,
  CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) || '.5' WHEN 1 THEN CAST(p_size * 10 AS STRING) ELSE '3:0' || CAST(p_size % 10 AS STRING) END AS seconds
FROM {part}
"""

#: A sheet of another layout: credits of all kinds in two columns, bare seconds, invisible characters (word joiners), blank record numbers.
RAW_LAYOUT = """
SELECT i AS row_index, CASE WHEN i % 3 = 0 THEN '' ELSE CAST(i + 5000 AS STRING) END AS record_no, 'in-a01-19-' || lpad(CAST(i % 100000 AS STRING), 5, '0') AS isrc_code, CAST(890000000000 + i AS STRING) AS barcode,
  CASE WHEN i % 4 = 0 THEN '\u2060' || p_name ELSE p_name END AS song_title, p_type || ' hits' AS album,
  CASE i % 7 WHEN 0 THEN '' WHEN 1 THEN 'Singer: ' || p_brand || ' | Composer : ' || p_type || '; mixed by: ' || p_mfgr WHEN 2 THEN 'singer: ' || p_type || ' | singer: ' || p_brand || ' | Singer: ' || p_type
    ELSE 'composer: ' || p_name || ';producer: ' || p_mfgr || ' | lyricist: ' || p_type END AS audio_credits,
  CASE WHEN i % 5 = 0 THEN 'lyricist: ' || p_name ELSE 'lyricist: ' || p_brand || ' | mastered by: ' || p_mfgr END AS more_credits,
  CASE i % 4 WHEN 0 THEN CAST(60 + i % 500 AS STRING) WHEN 1 THEN CAST(60 + i % 400 AS STRING) || '.5' WHEN 2 THEN '3:' || lpad(CAST(i % 60 AS STRING), 2, '0') ELSE ' ' || CAST(100 + i % 90 AS STRING) || '.25' END AS duration,
  CASE i % 3 WHEN 0 THEN 'hin' WHEN 1 THEN 'TAM' ELSE 'english' END AS language, p_container AS zz_unknown
FROM (SELECT p_partkey - (SELECT min(p_partkey) FROM {part}) AS i, p_name, p_type, p_brand, p_brand || ' studio' AS p_mfgr, 'qq ' || CAST(p_size AS STRING) AS p_container FROM {part})
"""

#: Records with a bag of JSON whose keys differ in type and in case; some bags are broken. chr(123) and chr(125) are braces.
RAW_BAGS = """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'kept' END AS x_mood,
  CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN chr(123) || '"Mood": "' || event_type || '", "k": "' || event_type || '"' || chr(125)
    WHEN 2 THEN chr(123) || '"Mood": null, "ISWC No": ' || CAST(event_id AS STRING) || '.5, "n": ' || CAST(user_id AS STRING) || chr(125)
    WHEN 3 THEN chr(123) || '"deep": ' || chr(123) || '"a": [1, ' || CAST(user_id AS STRING) || ']' || chr(125) || ', "flag": true' || chr(125)
    WHEN 4 THEN chr(123) || '"mood": "low ' || event_type || '", "flag": false, "ISWC No": 7' || chr(125) WHEN 5 THEN '[' || props || ']' ELSE left(props, length(props) - 1) END AS extras
FROM {events}
"""

#: Scores of pairs of headers (place) and targets (position) of sheets (file), with ties, repeats and weak fuzzy ones.
RAW_SCORES = """
SELECT 's' || CAST(l_suppkey AS STRING) AS file, CAST(l_partkey % 40 AS INT) AS place, 'h' || CAST(l_partkey % 40 AS STRING) AS header, CAST(l_orderkey % 30 AS INT) AS position,
  't' || CAST(l_orderkey % 30 AS STRING) AS target, max(CAST((l_partkey * 7 + l_orderkey * 3) % 21 AS DOUBLE) / 20) AS score, min(CASE WHEN (l_partkey + l_orderkey) % 3 = 0 THEN 'fuzzy' ELSE 'synonym' END) AS method
FROM {lineitem} GROUP BY l_suppkey, l_partkey % 40, l_orderkey % 30
"""


def spark_table(spark: SparkSession, sf_dir: str, recipe: str, **given: DataFrame) -> DataFrame:
    """recipe over the tables, or over those given in their place."""
    names = set(re.findall(r"\{(\w+)\}", recipe))
    return spark.sql(recipe, **{t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def spread(rows: DataFrame, key: str = "row_index") -> DataFrame:
    """rows dealt to all cores by key: a small file, or one row group, is read by one task."""
    return rows.repartition(max(8, rows.sparkSession.sparkContext.defaultParallelism), key)


def duck_table(recipe: str) -> str:
    """recipe over DuckDB's views of the tables."""
    return re.sub(r"\{(\w+)\}", r"\1", recipe)
