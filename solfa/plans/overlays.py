"""A reviewer's changes, header tokens and value types over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers
from ..functions.schema import CREDITS, TYPES
from ..operators import cleaning, master, overlay, recleaning, review
from ..sources.sheets import scan_csv
from ..sources.storage import shared_folder, stored
from . import duck_cells as duck
from .catalog import DATASET, catalog, cleaned
from .entities import FIELDS, FLAGS, UPSERT, _master, column_profile, silver
from .entities import ORACLES as ENTITY_ORACLES
from .fixtures import CATALOG_MAPPING, RAW_CATALOG, RAW_PACKED, RAW_PARTIES, duck_table, spark_table

#: Corrections by hand and by merges, some of rows that don't exist, some of one cell twice.
EDITS = """SELECT p_partkey AS row_index, 'Language' AS col, CASE WHEN p_partkey % 10 = 0 THEN 'Hindi' ELSE p_type END AS value, p_partkey * 4 AS seq FROM {part} WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 'Mood', 'second ' || p_type, p_partkey * 4 + 1 FROM {part} WHERE p_partkey % 7 = 0
UNION ALL SELECT p_partkey, 'Mood', 'third', p_partkey * 4 + 2 FROM {part} WHERE p_partkey % 21 = 0
UNION ALL SELECT p_partkey, 'UPC', CASE WHEN p_partkey % 4 = 0 THEN '89 0123-456789' ELSE 'twelve' END, p_partkey * 4 FROM {part} WHERE p_partkey % 6 = 0
UNION ALL SELECT p_partkey, 'Composer', CASE WHEN p_partkey % 8 = 0 THEN 'new name | ' || p_size || ' Brown' ELSE 'respelled ' || p_type END, p_partkey * 4 FROM {part} WHERE p_partkey % 8 IN (0, 3)
UNION ALL SELECT p_partkey, 'Track Name', CASE WHEN p_partkey % 2 = 0 THEN 'n/a' ELSE 'a track' END, p_partkey * 4 FROM {part} WHERE p_partkey % 13 = 4
UNION ALL SELECT p_partkey, 'Lead Artist', 'typed BY hand', p_partkey * 4 FROM {part} WHERE p_partkey % 16 = 3
UNION ALL SELECT p_partkey, 'Genre', 'n.a.', p_partkey * 4 FROM {part} WHERE p_partkey % 17 = 1
UNION ALL SELECT p_partkey + 1000000000, 'Mood', 'nowhere', p_partkey * 4 + 3 FROM {part} WHERE p_partkey % 50 = 0"""
ALIAS = {"Demoname": "Demo Name", "B": "Building Almond"}


def _long(spark, sf_dir) -> DataFrame:
    return silver(spark, sf_dir).select("row_index", F.explode("values").alias("col", "value"))


def _issues(spark, sf_dir) -> DataFrame:
    rows = silver(spark, sf_dir).select("row_index", F.explode("issues").alias("i"))
    return rows.select("row_index", F.col("i.column").alias("col"), "i.action", "i.tag", "i.value", "i.original", "i.cosmetic")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "row_index long, col string, value string, is_merge boolean, seq long")
    values = _long(spark, sf_dir)
    merges = overlay.remapped(values, "Singer", review.remap(F.col("value"), "Singer", ALIAS)).withColumn("seq", F.lit(0).cast("long"))
    return overlay.edit(overlay.edit(empty, merges, values, True), spark_table(spark, sf_dir, EDITS), values)


def overlay_corrections(spark, sf_dir):
    return overlay.current(_log(spark, sf_dir))


_RECLEANED: dict[tuple[str, str], DataFrame] = {}


def corrected(spark, sf_dir) -> DataFrame:
    """The cleaned catalogue with its corrections, worked out once for a session and its tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RECLEANED:
        log = stored(overlay.current(_log(spark, sf_dir)), "corrections")
        _RECLEANED[key] = stored(recleaning.recleaned(silver(spark, sf_dir), log, ascii_only=True), "corrected")
    return _RECLEANED[key]


def _issues_of(rows: DataFrame) -> DataFrame:
    long = rows.select("row_index", F.explode("issues").alias("i"))
    return long.select("row_index", F.col("i.column").alias("col"), "i.action", "i.tag", "i.value", "i.original", "i.cosmetic")


def overlay_values(spark, sf_dir):
    """Corrected cells: what cleaning gave before, and what it gives of the correction."""
    final = corrected(spark, sf_dir).select("row_index", F.explode("values").alias("col", "value"))
    own = overlay.current(_log(spark, sf_dir)).select("row_index", "col", "is_merge")
    before = _long(spark, sf_dir).withColumnRenamed("value", "was")
    return own.join(final, ["row_index", "col"]).join(before, ["row_index", "col"], "left")


def overlay_issues(spark, sf_dir):
    return _issues_of(corrected(spark, sf_dir))


def lead_reflow(spark, sf_dir):
    """Rows whose lead artist a correction changed."""
    lead = lambda rows, name: rows.select("row_index", F.col("values")["Lead Artist"].alias(name))
    both = lead(silver(spark, sf_dir), "was").join(lead(corrected(spark, sf_dir), "now"), "row_index")
    return both.filter("was <> now")


def _review(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    issues = _issues(spark, sf_dir)
    dropped = overlay.united(overlay.tagged(issues, "implausible_date"), issues.filter("row_index % 11 = 3"))
    accepted = issues.filter("row_index % 9 = 1").select("row_index").distinct()
    return recleaning.reviewed(silver(spark, sf_dir), overlay.current(_log(spark, sf_dir)), dropped, accepted, FIELDS, ascii_only=True)


def review_chain(spark, sf_dir):
    """Each row after the whole review: kept or deleted, its status, and its issues by column and tag."""
    kept, deleted = _review(spark, sf_dir)
    listed = F.array_join(F.array_sort(F.transform("issues", lambda x: F.concat_ws(":", x["column"], x["action"], x["tag"]))), ",")
    rows = kept.withColumn("state", F.lit("kept")).unionByName(deleted.withColumn("state", F.lit("deleted")))
    return rows.select("row_index", "state", cleaning.status().alias("status"), listed.alias("issues"))


def review_totals(spark, sf_dir):
    """The summary after the whole review; rows with a correction count as touched."""
    kept, deleted = _review(spark, sf_dir)
    touched = overlay.current(_log(spark, sf_dir)).select("row_index")
    return cleaning.summary(stored(kept, "kept"), touched, deleted.count())


def overlay_signature(spark, sf_dir):
    return overlay.signature(_log(spark, sf_dir))


def values_fingerprint(spark, sf_dir):
    return overlay.values_fingerprint(_long(spark, sf_dir))


def drop_restore(spark, sf_dir):
    """Rows kept and deleted after a drop by tag, a drop of rows, and a restore."""
    rows, issues = silver(spark, sf_dir), _issues(spark, sf_dir)
    dropped = overlay.united(overlay.tagged(issues, "invalid_upc"), rows.filter("row_index % 6 = 0"))
    kept, deleted = overlay.split_dropped(rows, overlay.without(dropped, rows.filter("row_index % 4 = 0")))
    return kept.select("row_index", F.lit("kept").alias("state")).unionByName(deleted.select("row_index", F.lit("deleted").alias("state")))


def accept_rows(spark, sf_dir):
    """Errors that are left after all rows of one tag and some others were accepted."""
    issues = _issues(spark, sf_dir)
    accepted = overlay.united(overlay.tagged(issues, "implausible_date"), issues.filter("row_index % 9 = 1"))
    return overlay.accept(issues, accepted).filter("action = 'error'").select("row_index", "col", "tag")


def revert_rows(spark, sf_dir):
    """Corrections that are left after some rows were reverted."""
    return overlay.current(overlay.without(_log(spark, sf_dir), silver(spark, sf_dir).filter("row_index % 3 = 0")))


def bulk_fix(spark, sf_dir):
    issues = _issues(spark, sf_dir)
    every = overlay.bulk_set(issues, "invalid_duration", "00:03:00")
    return every.unionByName(overlay.bulk_set(issues, "suspect_value", "Various", "Singer"))


def constant_fill(spark, sf_dir):
    """Blank cells that a column's constant fills."""
    rows = cleaned(spark, sf_dir, {"Lyricist": "Traditional Air"}).select("row_index", F.explode_outer("issues").alias("i"))
    return rows.filter("i.tag = 'filled_constant'").select("row_index", F.col("i.column").alias("col"), "i.action", "i.value")


def commit_clean(spark, sf_dir):
    """Outcomes of a commit, which takes clean rows only."""
    rows = silver(spark, sf_dir).withColumn("status", cleaning.status()).filter("status = 'clean'").drop("status")
    return master.upsert_outcomes(master.records(rows), _master(spark, sf_dir))


def worst_columns(spark, sf_dir):
    return overlay.worst_columns(column_profile(spark, sf_dir)).select("place", "col", "errors", "completeness")


def master_page(spark, sf_dir):
    return _master(spark, sf_dir).orderBy("id").offset(20).limit(50).select("id", "track_name")


def activity_of_user(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return overlay.newest(events, 7, 20)


def file_owners(spark, sf_dir):
    """Files with their branch and its owner; either may be missing."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    branches = read("customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("branch_id"), F.col("c_name").alias("branch"), "c_nationkey")
    owners = read("nation").filter("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("owner"))
    files = read("orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("branch_id"))
    return files.join(branches, "branch_id", "left").join(F.broadcast(owners), "c_nationkey", "left").select("file_id", F.coalesce("branch", F.lit("")).alias("branch"), F.coalesce("owner", F.lit("")).alias("owner"))


def first_appearance(spark, sf_dir):
    return overlay.first_appearance(spark_table(spark, sf_dir, RAW_PARTIES), "work_key", "seq")


_HEADERS = "SELECT DISTINCT replace(replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN 'Names' ELSE '_of_' END), 'l', 'L2') || CASE WHEN p_size % 3 = 0 THEN 'Series' WHEN p_size % 3 = 1 THEN ' classes Ids' ELSE ' Boss' END AS header FROM {part}"


def header_tokens(spark, sf_dir):
    rows = spark_table(spark, sf_dir, _HEADERS)
    h = F.col("header")
    return rows.select("header", headers.header_text(h).alias("text"), F.array_join(headers.header_tokens(h), ",").alias("tokens"), F.array_join(headers.header_tokens(h, True), ",").alias("content"))


_SOURCES = ["isrc_code", "barcode", "release_dt", "length_", "vocals", "rev_split", "album"]


def type_hits(spark, sf_dir):
    raw = catalog(spark, sf_dir).select("row_index", *_SOURCES)
    hits = headers.type_hits(raw.unpivot("row_index", _SOURCES, "col", "value"))
    return hits.select("col", "type", F.round("fraction", 6).alias("fraction"))


_TYPED = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '0' || p_size WHEN 1 THEN '-' || p_size WHEN 2 THEN '0.' || p_size WHEN 3 THEN '.' || p_size WHEN 4 THEN p_type ELSE CAST(p_size AS STRING) END AS value FROM {part}"


def text_types(spark, sf_dir):
    return spark_table(spark, sf_dir, _TYPED).select("id", "value", headers.text_type(F.col("value")).alias("kind"))


def csv_scan(spark, sf_dir):
    """The packed sheet, written as CSV and read back as text."""
    path = f"{shared_folder(spark)}/sheet-{uuid.uuid4().hex}"
    rows = spark_table(spark, sf_dir, RAW_PACKED).coalesce(1).sortWithinPartitions("row_index")
    rows.drop("row_index").write.csv(path, header=True, escape='"', quoteAll=True)
    return scan_csv(spark, path).select("row_index", "title", "credits", "seconds")


_NAMES = ["csv_scan", "overlay_corrections", "overlay_values", "overlay_issues", "lead_reflow", "review_chain", "review_totals", "overlay_signature", "values_fingerprint", "drop_restore", "accept_rows", "revert_rows", "bulk_fix",
    "constant_fill", "commit_clean", "worst_columns", "master_page", "activity_of_user", "file_owners", "first_appearance", "header_tokens", "type_hits", "text_types"]
QUERIES = {name: globals()[name] for name in _NAMES}
_W = f"WITH {DATASET}"
_MERGE = f"flatten(list_transform(string_split(value, ' | '), lambda x: CASE x {' '.join(f"WHEN '{k}' THEN ['{v}']" for k, v in ALIAS.items())} ELSE [x] END))"
LOG = f"""elog AS (SELECT row_index, col, array_to_string({duck.ordered_distinct('l')}, ' | ') AS value, true AS is_merge, 0 AS seq FROM (SELECT row_index, col, value AS was, {_MERGE} AS l FROM vals WHERE col = 'Singer' AND value <> '') WHERE array_to_string({duck.ordered_distinct('l')}, ' | ') <> was
  UNION ALL SELECT row_index, col, value, false, seq FROM ({duck_table(EDITS)}) WHERE row_index IN (SELECT row_index FROM vals)),
corr AS (SELECT row_index, col, arg_max(value, seq) AS value, arg_max(is_merge, seq) AS is_merge FROM elog GROUP BY row_index, col)"""
_KINDS = [*CATALOG_MAPPING, "Lead Artist", "Genre"]
_PIECES = lambda x: f"list_filter(list_transform(string_split(coalesce({x}, ''), '|'), lambda x: trim(x)), lambda x: x <> '')"
_LOWER = lambda x: f"list_transform({x}, lambda x: lower(x))"
_CREDIT = [c.lower() for c in CREDITS]
_PAIRS = ", ".join(f"CASE WHEN len(w_{c}) = len(v_{c}) THEN list_filter(list_transform(list_zip(w_{c}, v_{c}), lambda z: {{'k': lower(z[1]), 'v': z[2]}}), lambda z: z.k <> lower(z.v)) ELSE [] END" for c in _CREDIT)
#: fvals (row_index, col, value) and fissues: the dataset after corrections, from elog and corr
RECLEANED = f"""touched AS (SELECT DISTINCT row_index FROM corr),
rlong AS (SELECT row_index, col, {duck.kind_of(_KINDS)} AS kind, v.value AS was, c.value AS new, c.is_merge, coalesce(c.value, v.value, '') AS r
  FROM (SELECT * FROM vals WHERE row_index IN (SELECT row_index FROM touched)) v FULL JOIN corr c USING (row_index, col)),
{duck.cleaned_cells('rlong', {TYPES.get(c, 'text') for c in _KINDS}, 'r', 'was, new, is_merge')},
rrow AS (SELECT row_index, {', '.join(f"{_PIECES(f"max(was) FILTER (col = '{c}')")} AS w_{c.lower()}, {_PIECES(f"max(value) FILTER (col = '{c}')")} AS v_{c.lower()}" for c in CREDITS)},
  max(value) FILTER (col = 'Lead Artist') AS lead, bool_or(col = 'Lead Artist' AND new IS NOT NULL) AS by_hand, bool_or(col = 'Lead Artist' AND action = 'error') AS blocked FROM rcells GROUP BY row_index),
rstale AS (SELECT *, list_filter({_LOWER(f"list_concat({', '.join(f'w_{c}' for c in _CREDIT)})")}, lambda y: NOT list_contains({_LOWER(f"list_concat({', '.join(f'v_{c}' for c in _CREDIT)})")}, y)) AS stale, list_concat({_PAIRS}) AS renamed FROM rrow),
rhad AS (SELECT *, CASE WHEN by_hand OR len(stale) = 0 THEN lead ELSE array_to_string(flatten(list_transform({_PIECES('lead')}, lambda q: CASE WHEN NOT list_contains(stale, lower(q)) THEN [q]
  WHEN len(list_filter(renamed, lambda z: z.k = lower(q))) > 0 THEN [list_filter(renamed, lambda z: z.k = lower(q))[-1].v] ELSE [] END)), ' | ') END AS had FROM rstale),
rall AS (SELECT *, list_concat({_PIECES('had')}, {', '.join(f'v_{c}' for c in _CREDIT)}) AS names FROM rhad),
rlead AS (SELECT row_index, had, by_hand, NOT by_hand AND NOT blocked AND derived <> had AS fill, CASE WHEN by_hand OR blocked THEN had ELSE derived END AS value
  FROM (SELECT *, array_to_string(list_filter(names, lambda x, i: list_position({_LOWER('names')}, lower(x)) = i), ' | ') AS derived FROM rall)),
rvals AS (SELECT row_index, col, CASE WHEN col = 'Lead Artist' THEN l.value ELSE c.value END AS value, was, new, is_merge FROM rcells c JOIN rlead l USING (row_index)),
rissues AS (SELECT row_index, col, action, tag, c.value, original, cosmetic FROM rcells c JOIN rlead USING (row_index) WHERE action <> 'ok' AND NOT (col = 'Lead Artist' AND action = 'fixed' AND fill)
  UNION ALL SELECT row_index, col, 'error', 'missing_required', '', original, false FROM rcells WHERE col IN ('ISRC', 'Track Name') AND value = ''
  UNION ALL SELECT row_index, 'Lead Artist', 'fixed', 'derived_lead_artist', value, had, false FROM rlead WHERE fill),
rch AS (SELECT * FROM rvals WHERE new IS NOT NULL AND value <> coalesce(was, '')),
fissues AS (SELECT * FROM issues WHERE row_index NOT IN (SELECT row_index FROM touched)
  UNION ALL SELECT * FROM rissues WHERE action = 'error' OR (row_index, col) NOT IN (SELECT (row_index, col) FROM rch)
  UNION ALL SELECT row_index, col, 'fixed', CASE WHEN is_merge THEN 'merged' ELSE 'corrected' END, value, coalesce(was, ''), false FROM rch WHERE (row_index, col) NOT IN (SELECT (row_index, col) FROM rissues WHERE action = 'error')),
fvals AS (SELECT row_index, col, value FROM vals WHERE row_index NOT IN (SELECT row_index FROM touched) UNION ALL SELECT row_index, col, value FROM rvals)"""
#: After RECLEANED: kissues, the issues of rows that stay with their duplicates, and accepted rows' errors cleared
REVIEWED = f"""gone AS (SELECT DISTINCT row_index FROM issues WHERE tag = 'implausible_date' OR row_index % 11 = 3),
kvals AS (SELECT * FROM fvals WHERE row_index NOT IN (SELECT row_index FROM gone)),
kstate AS (SELECT row_index, CASE WHEN row_index IN (SELECT row_index FROM fissues WHERE action = 'error') THEN 'error' ELSE 'clean' END AS status FROM raw WHERE row_index NOT IN (SELECT row_index FROM gone)),
{FLAGS.replace('FROM vals', 'FROM kvals').replace('JOIN state', 'JOIN kstate')},
kissues AS (SELECT row_index, col, action, tag FROM (SELECT row_index, col, action, tag FROM fissues WHERE row_index NOT IN (SELECT row_index FROM gone) UNION ALL SELECT row_index, col, 'error', tag FROM flags)
  WHERE NOT (action = 'error' AND row_index % 9 = 1 AND row_index IN (SELECT row_index FROM issues))),
gissues AS (SELECT * FROM kissues UNION ALL SELECT row_index, col, action, tag FROM fissues WHERE row_index IN (SELECT row_index FROM gone))"""
_DIGEST = "SELECT {by} sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM (SELECT {by} substr(h, 1, 2) AS part, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM ({rows}) GROUP BY ALL) {group}"
_DROPPED = "(row_index IN (SELECT row_index FROM issues WHERE tag = 'invalid_upc') OR row_index % 6 = 0) AND row_index % 4 <> 0"
_TEXT = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(header, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_SINGULAR = "CASE WHEN length(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN length(x) > 4 AND x LIKE '%ses' THEN x[:-3] WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN x[:-2] ELSE x END"
_HITS = {
    "isrc": "regexp_matches(replace(replace(upper(v), ' ', ''), '-', ''), '^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$')",
    "upc": "regexp_matches(replace(v, ' ', ''), '^[0-9]{12,13}$')",
    "date": f"(coalesce({duck.date('v')}, {duck.date('split_part(v, chr(32), 1)')}) IS NOT NULL)",
    "duration": r"regexp_matches(v, '^\d{1,2}:\d{2}(:\d{2})?$')",
    "vocal_instrumental": f"lower(v) IN {headers.VOCAL}",
    "percent": "coalesce(TRY_CAST(trim(regexp_replace(v, '%$', '')) AS DOUBLE) BETWEEN 0 AND 100 AND (v LIKE '%\\%' ESCAPE '\\' OR contains(v, '.')), false)",
}
_HIT_ROWS = " UNION ALL ".join(f"SELECT row_index, '{c}' AS col, trim({c}) AS v FROM ({duck_table(RAW_CATALOG)})" for c in _SOURCES)
ORACLES = {
    "csv_scan": f"SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, title, credits, seconds FROM ({duck_table(RAW_PACKED)})",
    "overlay_corrections": f"{_W}, {LOG} SELECT * FROM corr",
    "overlay_values": f"{_W}, {LOG}, {RECLEANED} SELECT row_index, col, is_merge, value, was FROM rvals WHERE new IS NOT NULL",
    "overlay_issues": f"{_W}, {LOG}, {RECLEANED} SELECT row_index, col, action, tag, value, original, cosmetic FROM fissues",
    "lead_reflow": f"{_W}, {LOG}, {RECLEANED} SELECT row_index, v.value AS was, f.value AS now FROM vals v JOIN fvals f USING (row_index, col) WHERE col = 'Lead Artist' AND v.value <> f.value",
    "review_chain": f"""{_W}, {LOG}, {RECLEANED}, {REVIEWED} SELECT row_index, CASE WHEN row_index IN (SELECT row_index FROM gone) THEN 'deleted' ELSE 'kept' END AS state,
  CASE WHEN bool_or(coalesce(action = 'error', false)) THEN 'error' ELSE 'clean' END AS status, coalesce(string_agg(col || ':' || action || ':' || tag, ',' ORDER BY col || ':' || action || ':' || tag), '') AS issues
  FROM raw LEFT JOIN gissues USING (row_index) GROUP BY row_index""",
    "review_totals": f"""{_W}, {LOG}, {RECLEANED}, {REVIEWED}, t AS (SELECT row_index, row_index IN (SELECT row_index FROM kissues WHERE action = 'error') AS bad, row_index IN (SELECT row_index FROM touched) AS hand FROM raw WHERE row_index NOT IN (SELECT row_index FROM gone))
  SELECT count(*) AS total, count(*) FILTER (NOT bad) AS clean, count(*) FILTER (NOT bad AND NOT hand) AS auto_clean, count(*) FILTER (NOT bad AND hand) AS manual_clean, count(*) FILTER (bad) AS errors,
  (SELECT count(*) FROM kissues WHERE action = 'fixed') AS auto_fixed, (SELECT count(*) FROM gone) AS deleted FROM t""",
    "overlay_signature": f"{_W}, {LOG} " + _DIGEST.format(by="", group="", rows="SELECT sha256(concat_ws(chr(2), CAST(row_index AS VARCHAR), col, value)) AS h FROM corr"),
    "values_fingerprint": f"{_W} " + _DIGEST.format(by="col,", group="GROUP BY col", rows="SELECT col, sha256(concat_ws(chr(2), value, CAST(count(*) AS VARCHAR))) AS h FROM vals GROUP BY col, value"),
    "drop_restore": f"{_W} SELECT row_index, CASE WHEN {_DROPPED} THEN 'deleted' ELSE 'kept' END AS state FROM raw",
    "accept_rows": f"{_W} SELECT row_index, col, tag FROM issues WHERE action = 'error' AND row_index NOT IN (SELECT row_index FROM issues WHERE tag = 'implausible_date' OR row_index % 9 = 1)",
    "revert_rows": f"{_W}, {LOG} SELECT * FROM corr WHERE row_index % 3 <> 0",
    "bulk_fix": f"{_W} SELECT DISTINCT row_index, col, '00:03:00' AS value FROM issues WHERE tag = 'invalid_duration' UNION ALL SELECT DISTINCT row_index, 'Singer', 'Various' FROM issues WHERE tag = 'suspect_value'",
    "constant_fill": f"{_W} SELECT row_index, col, 'fixed' AS action, 'Traditional Air' AS value FROM vals WHERE col = 'Lyricist' AND value = ''",
    "commit_clean": f"{_W}, {UPSERT.replace('FROM new UNION', "FROM new WHERE row_index IN (SELECT row_index FROM state WHERE status = 'clean') UNION").replace('(SELECT fingerprint FROM new)', "(SELECT fingerprint FROM new WHERE row_index IN (SELECT row_index FROM state WHERE status = 'clean'))")} SELECT row_index, outcome FROM outcomes",
    "worst_columns": f"SELECT CAST(row_number() OVER (ORDER BY errors DESC, completeness, col) AS INTEGER) AS place, col, errors, completeness FROM ({ENTITY_ORACLES['column_profile']}) ORDER BY 1 LIMIT 5",
    "master_page": f"{_W}, {UPSERT} SELECT id, track_name FROM mas ORDER BY id LIMIT 50 OFFSET 20",
    "activity_of_user": "SELECT event_id, user_id, ts FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20",
    "file_owners": "SELECT o_orderkey AS file_id, coalesce(c_name, '') AS branch, coalesce(n_name, '') AS owner FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON n_nationkey = c_nationkey",
    "first_appearance": f"SELECT work_key, min(seq) AS first FROM ({duck_table(RAW_PARTIES)}) GROUP BY work_key",
    "header_tokens": f"""WITH h AS (SELECT header, {_TEXT} AS text FROM ({duck_table(_HEADERS)})), t AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: {_SINGULAR}))) AS l FROM h)
  SELECT header, text, array_to_string(l, ',') AS tokens, array_to_string(list_filter(l, lambda x: x NOT IN {headers.NOISE}), ',') AS content FROM t""",
    "type_hits": f"""WITH r AS ({_HIT_ROWS}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY row_index) AS place FROM r WHERE v <> '') WHERE place <= 150),
  p AS (SELECT col, {', '.join(f"avg(CAST({hit} AS INTEGER)) AS {kind}" for kind, hit in _HITS.items())} FROM f GROUP BY col)
  SELECT col, "type", round(fraction, 6) AS fraction FROM (UNPIVOT p ON {', '.join(_HITS)} INTO NAME "type" VALUE fraction)""",
    "text_types": rf"SELECT *, CASE WHEN regexp_matches(value, '^0[^.]') THEN 'text' WHEN regexp_matches(value, '^-?\d+$') THEN 'int' WHEN regexp_matches(value, '^-?\d*\.\d+$') THEN 'float' ELSE 'text' END AS kind FROM ({duck_table(_TYPED)})",
}
