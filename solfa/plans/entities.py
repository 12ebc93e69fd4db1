"""Duplicates, review questions and the master table over the cleaned catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import ATTRIBUTES, COLUMNS, GRADES, IDENTITY
from ..operators import cleaning, duplicates, master, review
from ..sources.storage import shared_folder, stored
from ..sources.versions import VersionedMaster
from . import duck_cells as duck
from .catalog import DATASET, cleaned
from .fixtures import CATALOG_MAPPING

_SILVER: dict[tuple[str, str], DataFrame] = {}
FIELDS = [*CATALOG_MAPPING, "Lead Artist"]


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned catalogue, worked out once for a session and its tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SILVER:
        _SILVER[key] = stored(cleaned(spark, sf_dir), "silver")
    return _SILVER[key]


def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flag with its class and all other rows of the class."""
    rows = duplicates.related(*duplicates.found(silver(spark, sf_dir), FIELDS))
    return rows.select("row_index", F.col("column").alias("col"), "tag", "value", "class_id", "n_rows", "related")


def duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = duplicates.classes(duplicates.flags(silver(spark, sf_dir), FIELDS))
    return rows.select(F.col("column").alias("col"), "tag", "class_id", "n_rows", F.array_join("differing", ",").alias("differing"), "n_flags")


def duplicate_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partners of the flags on the first page of flags."""
    flags, members = duplicates.found(silver(spark, sf_dir), FIELDS)
    shown = stored(flags.orderBy("row_index", "column", "tag").limit(50), "shown")
    return duplicates.partners(shown, members).select("row_index", F.col("column").alias("col"), "tag", "partner")


def marked_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.summary(duplicates.mark_duplicates(silver(spark, sf_dir), FIELDS))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("row_index")


def value_filter(spark, sf_dir):
    return _rows(review.with_values(silver(spark, sf_dir), {"Language": ["Hindi", "Tamil"], "Vocal / Instrumental": ["Vocal"]}))


def tag_filter(spark, sf_dir):
    return _rows(review.with_tags(silver(spark, sf_dir), "invalid_isrc", "suspect_value"))


def review_view_error(spark, sf_dir):
    return _rows(review.view(silver(spark, sf_dir), "error"))


def review_view_manual(spark, sf_dir):
    rows = silver(spark, sf_dir)
    return _rows(review.view(rows, "manual_clean", rows.filter("row_index % 7 = 0").select("row_index")))


def text_search(spark, sf_dir):
    return _rows(review.with_text(silver(spark, sf_dir), "BUILDING"))


def blank_filter(spark, sf_dir):
    return _rows(review.with_blanks(silver(spark, sf_dir), "Lyricist"))


def sorted_page(spark, sf_dir):
    rows = review.page(silver(spark, sf_dir), "Track Name", True, 2, 50)
    return rows.select("row_index", F.col("values")["Track Name"].alias("track"))


def column_profile(spark, sf_dir):
    return review.profile(silver(spark, sf_dir))


def top_values(spark, sf_dir):
    return review.top_values(silver(spark, sf_dir))


def quality_score(spark, sf_dir):
    return review.quality(silver(spark, sf_dir), len(FIELDS))


def health_ribbon(spark, sf_dir):
    rows = silver(spark, sf_dir)
    return review.ribbon(rows, rows.count())


def unique_values(spark, sf_dir):
    return review.unique_values(silver(spark, sf_dir), "Lead Artist", "a", 40)


def remap_preview(spark, sf_dir):
    old = F.col("values")["Singer"]
    rows = silver(spark, sf_dir).select("row_index", old.alias("was"), review.remap(old, "Singer", {"B": "Building Almond | C", "Demoname": "Demo Name"}).alias("now"))
    return rows.filter("was <> now")


def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = master.records(silver(spark, sf_dir)).filter("row_index % 2 = 0").drop("fingerprint")
    rows = rows.withColumn("label", F.when(F.col("row_index") % 14 == 0, "Other Label").otherwise(F.col("label")))
    rows = rows.withColumn("composer", F.when(F.col("row_index") % 10 == 0, "Other Composer").otherwise(F.col("composer")))
    rows = rows.withColumn("fingerprint", master.fingerprint(lambda c: F.col(ATTRIBUTES[c])))
    return rows.withColumnRenamed("row_index", "id").withColumn("branch_id", F.col("id") % 5)


def fingerprints(spark, sf_dir):
    return master.records(silver(spark, sf_dir)).select("row_index", "fingerprint")


def master_upsert(spark, sf_dir):
    return master.upsert_outcomes(master.records(silver(spark, sf_dir)), _master(spark, sf_dir))


def commit_counters(spark, sf_dir):
    return master_upsert(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def batch(spark, sf_dir) -> DataFrame:
    """A file's records, a third of them again with a number and sometimes other owners, some a third time."""
    source = lambda branch, file: {"branch_id": F.lit(branch).cast("long"), "file_id": F.lit(file).cast("long")}
    rows = master.records(silver(spark, sf_dir)).withColumns(source(7, 2))
    n = F.col("row_index")
    later = {"row_index": n + 10_000_000, "record_no": F.concat(F.lit("R"), n), "label": F.when(n % 2 == 0, "Later Label").otherwise(F.col("label"))}
    last = {"row_index": n + 20_000_000, "record_no": F.concat(F.lit("S"), n)}
    return rows.unionByName(rows.filter("row_index % 3 = 0").withColumns(later | source(8, 3))).unionByName(rows.filter("row_index % 9 = 0").withColumns(last | source(9, 4)))


def stock(spark, sf_dir) -> DataFrame:
    return _master(spark, sf_dir).withColumn("file_id", F.lit(1).cast("long"))


def master_snapshot(spark, sf_dir):
    """The whole table after a file was stored; new records have no id yet."""
    return master.upsert(batch(spark, sf_dir), stock(spark, sf_dir))


def master_commits(spark, sf_dir):
    """Two commits to an empty table in versions, and the records of either version."""
    held = stock(spark, sf_dir)
    kinds = ", ".join(f"{a} string" for a in ATTRIBUTES.values())
    table = VersionedMaster(spark, f"{shared_folder(spark)}/master-{uuid.uuid4().hex}", f"id long, branch_id long, file_id long, {kinds}, fingerprint string", buckets=16)
    first = table.commit(held.withColumnRenamed("id", "row_index"), 0)
    second = table.commit(batch(spark, sf_dir), first)
    version = lambda v: table.read(v).withColumn("version", F.lit(v))
    return version(first).unionByName(version(second))


def master_conflicts(spark, sf_dir):
    found = master.conflicts(master.records(silver(spark, sf_dir)), _master(spark, sf_dir))
    return found.select("row_index", "master_id", F.array_join("differences", ",").alias("differences"))


def master_filter(spark, sf_dir):
    return master.search(_master(spark, sf_dir), {("singer", "composer", "lead_artist"): ["almond", "blue"], ("language",): ["hin"], ("genre",): [" "]}).select("id")


def tenancy_scope(spark, sf_dir):
    owned = spark.createDataFrame([(1,), (3,), (3,)], "branch_id long")
    return master.search(_master(spark, sf_dir), {}, owned).select("id", "branch_id")


def master_verify(spark, sf_dir):
    return master.verify(_master(spark, sf_dir), ["singer", "lead_artist"], ["Almond", "nobody", "Demo"])


def master_suggest(spark, sf_dir):
    return master.suggest(_master(spark, sf_dir), ["singer", "composer"], "al", 15)


def _pivot(where: str = "") -> str:
    columns = ", ".join(f"max(value) FILTER (col = '{c}') AS {a}" if c in FIELDS else f"'' AS {a}" for c, a in ATTRIBUTES.items())
    return f"SELECT row_index, {columns} FROM vals {where} GROUP BY row_index"


_FP = "sha256(array_to_string([" + ", ".join(f"'{c}' || chr(2) || {duck.norm(ATTRIBUTES[c])}" for c in IDENTITY) + "], chr(1)))"
NEW = f"recs AS ({_pivot()}), new AS (SELECT *, {_FP} AS fingerprint FROM recs)"
_CHANGED = ", ".join(
    f"CASE WHEN row_index % 14 = 0 THEN 'Other Label' ELSE label END AS {a}" if a == "label" else f"CASE WHEN row_index % 10 = 0 THEN 'Other Composer' ELSE composer END AS {a}" if a == "composer" else a
    for a in ATTRIBUTES.values()
)
MASTER = f"{NEW}, chg AS (SELECT row_index AS id, row_index % 5 AS branch_id, {_CHANGED} FROM recs WHERE row_index % 2 = 0), mas AS (SELECT *, {_FP} AS fingerprint FROM chg)"
_OWN = f"{duck.norm('label')} || chr(1) || {duck.norm('distributor')}"
UPSERT = f"""{MASTER}, seqs AS (SELECT fingerprint, row_index, {_OWN} AS owners FROM new UNION ALL SELECT fingerprint, -1, {_OWN} FROM mas WHERE fingerprint IN (SELECT fingerprint FROM new)),
outcomes AS (SELECT * FROM (SELECT row_index, CASE WHEN lag(owners) OVER w IS NULL THEN 'inserted' WHEN lag(owners) OVER w <> owners THEN 'updated' ELSE 'duplicate' END AS outcome
  FROM seqs WINDOW w AS (PARTITION BY fingerprint ORDER BY row_index)) WHERE row_index >= 0)"""
_A = ", ".join(ATTRIBUTES.values())
#: batch (row_index, attributes, fingerprint, branch_id, file_id, owners) and mas1, the table before it
BATCH = f"""{MASTER}, mas1 AS (SELECT id, branch_id, 1 AS file_id, {_A}, fingerprint FROM mas),
batch AS (SELECT *, {_OWN} AS owners FROM (SELECT row_index, {_A}, fingerprint, 7 AS branch_id, 2 AS file_id FROM new
  UNION ALL SELECT * REPLACE (row_index + 10000000 AS row_index, 'R' || row_index AS record_no, CASE WHEN row_index % 2 = 0 THEN 'Later Label' ELSE label END AS label) FROM (SELECT row_index, {_A}, fingerprint, 8, 3 FROM new) WHERE row_index % 3 = 0
  UNION ALL SELECT * REPLACE (row_index + 20000000 AS row_index, 'S' || row_index AS record_no) FROM (SELECT row_index, {_A}, fingerprint, 9, 4 FROM new) WHERE row_index % 9 = 0))"""


def _stored(before: str, after: str, new_id: str) -> str:
    """CTE after: the table before with batch stored, row by row; new_id of records without one, by first row."""
    n = ", ".join(f"n.{a}" for a in ATTRIBUTES.values())
    return f"""{after}_seq AS (SELECT fingerprint, row_index, owners FROM batch UNION ALL SELECT fingerprint, -1, {_OWN} FROM {before}),
{after}_run AS (SELECT *, coalesce(lag(owners) OVER (PARTITION BY fingerprint ORDER BY row_index) <> owners, true) AS changes FROM {after}_seq),
{after}_last AS (SELECT fingerprint, max(row_index) FILTER (changes) AS row_index, min(row_index) AS first FROM {after}_run GROUP BY fingerprint),
{after} AS (SELECT m.* FROM {before} m JOIN {after}_last l USING (fingerprint) WHERE row_index < 0
  UNION ALL SELECT coalesce(id, {new_id}) AS id, n.branch_id, n.file_id, {n}, fingerprint FROM {after}_last l JOIN batch n USING (fingerprint, row_index) LEFT JOIN (SELECT fingerprint, id FROM {before}) USING (fingerprint))"""


_DIFF = "list_filter([" + ", ".join(f"CASE WHEN {duck.norm(f'n.{ATTRIBUTES[c]}')} <> {duck.norm(f'm.{ATTRIBUTES[c]}')} THEN '{c}' END" for c in COLUMNS if c != "Record #") + "], lambda x: x IS NOT NULL)"
_N = lambda a: duck.norm(a)
CONFLICTS = f"""{MASTER}, met AS (SELECT n.row_index, m.id AS master_id, n.fingerprint = m.fingerprint AS exact, {_DIFF} AS d FROM new n JOIN mas m ON
  (CASE WHEN {_N('n.isrc')} <> '' THEN {_N('n.isrc')} = {_N('m.isrc')}
        WHEN {_N('n.upc')} <> '' AND {_N('n.track_name')} <> '' THEN {_N('n.upc')} = {_N('m.upc')} AND {_N('n.track_name')} = {_N('m.track_name')}
        WHEN {_N('n.track_name')} <> '' AND {_N('n.album_name')} <> '' AND ({_N('n.singer')} <> '' OR {_N('n.lead_artist')} <> '')
          THEN {_N('n.track_name')} = {_N('m.track_name')} AND {_N('n.album_name')} = {_N('m.album_name')} AND ({_N('n.singer')} = {_N('m.singer')} OR {_N('n.lead_artist')} = {_N('m.lead_artist')}) END)),
best AS (SELECT *, bool_or(exact) OVER (PARTITION BY row_index) AS any_exact, row_number() OVER (PARTITION BY row_index ORDER BY len(d) = 0, len(d), master_id) AS rn FROM met)"""

_FIELDS = [f for f in ("ISRC", "UPC", "Label", "Album Name", "Track Name", "Singer", "Composer", "Lyricist", "Language")]
_DIFFERING = ", ".join(f"CASE WHEN min(f{i}) <> max(f{i}) THEN '{f}' END" for i, f in enumerate(_FIELDS))
FLAGS = f"""ids AS (SELECT row_index, {', '.join(f"max({duck.norm('value')}) FILTER (col = '{f}') AS f{i}, max(value) FILTER (col = '{f}') AS v{i}" for i, f in enumerate(_FIELDS))} FROM vals GROUP BY row_index),
own AS (SELECT *, status = 'error' AS real, array_to_string([{', '.join(f'f{i}' for i in range(len(_FIELDS)))}], chr(1)) AS sig FROM ids JOIN state USING (row_index)),
placed AS (SELECT *, min(row_index) OVER (PARTITION BY f0, sig) AS first, count(*) OVER (PARTITION BY f0, sig) AS copies FROM own WHERE f0 <> ''),
exact AS (SELECT row_index, first AS class_id, copies AS n_rows FROM placed WHERE row_index <> first),
reps AS (SELECT * FROM placed WHERE row_index = first),
groups AS (SELECT f0, list(row_index ORDER BY row_index) AS members, array_to_string(list_filter([{_DIFFERING}], lambda x: x IS NOT NULL), ',') AS differing FROM reps GROUP BY f0 HAVING count(*) > 1),
rest AS (SELECT * FROM own WHERE row_index NOT IN (SELECT row_index FROM exact) AND f1 <> '' AND f3 <> ''),
g1 AS (SELECT f1, list(row_index ORDER BY row_index) AS members FROM rest GROUP BY f1 HAVING count(DISTINCT f3) > 1),
m1 AS (SELECT row_index, v3 AS value, members FROM rest JOIN g1 USING (f1) WHERE NOT real),
g2 AS (SELECT f3, list(row_index ORDER BY row_index) AS members FROM rest GROUP BY f3 HAVING count(DISTINCT f1) > 1),
m2 AS (SELECT row_index, v1 AS value, members FROM rest JOIN g2 USING (f3) WHERE NOT real AND row_index NOT IN (SELECT row_index FROM m1)),
listed AS (SELECT row_index, 'ISRC' AS col, 'possible_duplicate' AS tag, v0 AS value, members, differing FROM reps JOIN groups USING (f0) WHERE NOT real
  UNION ALL SELECT row_index, 'Album Name', 'upc_album_mismatch', value, members, 'Album Name' FROM m1
  UNION ALL SELECT row_index, 'UPC', 'upc_album_mismatch', value, members, 'UPC' FROM m2),
flags AS (SELECT row_index, 'ISRC' AS col, 'duplicate' AS tag, '' AS value, class_id, n_rows, '' AS differing, [] AS members FROM exact
  UNION ALL SELECT row_index, col, tag, value, members[1], len(members), differing, members FROM listed)"""  # fmt: skip

_GRADE = "CASE " + " ".join(f"WHEN score >= {cut} THEN '{g}'" for cut, g in GRADES) + " ELSE 'F' END"
_NAMES = "('Singer', 'Composer', 'Lyricist', 'Lead Artist')"
_PIECES = "CASE WHEN trim(value) = '' THEN [] WHEN col IN ('Singer', 'Composer', 'Lyricist', 'Lead Artist') THEN string_split(value, ' | ') ELSE [trim(value)] END"

_NAMES_OF = ["duplicate_flags", "duplicate_classes", "duplicate_partners", "marked_summary", "value_filter", "tag_filter", "review_view_error", "review_view_manual", "text_search", "blank_filter",
    "sorted_page", "column_profile", "top_values", "quality_score", "health_ribbon", "unique_values", "remap_preview", "fingerprints", "master_upsert",
    "commit_counters", "master_snapshot", "master_commits", "master_conflicts", "master_filter", "tenancy_scope", "master_verify", "master_suggest"]
QUERIES = {name: globals()[name] for name in _NAMES_OF}
_W = f"WITH {DATASET}"
ORACLES = {
    "duplicate_flags": f"{_W}, {FLAGS} SELECT row_index, col, tag, value, class_id, n_rows, array_to_string(list_transform(list_filter(members, lambda x: x <> row_index), lambda x: CAST(x + 1 AS VARCHAR)), ',') AS related FROM flags",
    "duplicate_classes": f"{_W}, {FLAGS} SELECT col, tag, class_id, any_value(n_rows) AS n_rows, any_value(differing) AS differing, count(*) AS n_flags FROM flags GROUP BY col, tag, class_id",
    "duplicate_partners": f"""{_W}, {FLAGS}, shown AS (SELECT * FROM flags ORDER BY row_index, col, tag LIMIT 50), each AS (SELECT row_index, col, tag, unnest(members) AS other FROM shown)
  SELECT row_index, col, tag, other + 1 AS partner FROM each WHERE other <> row_index""",
    "marked_summary": f"""{_W}, {FLAGS}, marked AS (SELECT row_index, status = 'clean' AND row_index NOT IN (SELECT row_index FROM flags) AS clean, fixed FROM state)
  SELECT count(*) AS total, count(*) FILTER (clean) AS clean, count(*) FILTER (clean) AS auto_clean, CAST(0 AS BIGINT) AS manual_clean, count(*) FILTER (NOT clean) AS errors,
  CAST(sum(fixed) AS BIGINT) AS auto_fixed, CAST(0 AS BIGINT) AS deleted FROM marked""",
    "value_filter": f"{_W} SELECT row_index FROM vals WHERE col = 'Language' AND value IN ('Hindi', 'Tamil') AND row_index IN (SELECT row_index FROM vals WHERE col = 'Vocal / Instrumental' AND value = 'Vocal')",
    "tag_filter": f"{_W} SELECT DISTINCT row_index FROM issues WHERE tag IN ('invalid_isrc', 'suspect_value')",
    "review_view_error": f"{_W} SELECT row_index FROM state WHERE status = 'error'",
    "review_view_manual": f"{_W} SELECT row_index FROM state WHERE status = 'clean' AND row_index % 7 = 0",
    "text_search": f"{_W} SELECT DISTINCT row_index FROM vals WHERE contains(lower(value), 'building')",
    "blank_filter": f"{_W} SELECT row_index FROM vals WHERE col = 'Lyricist' AND trim(value) = ''",
    "sorted_page": f"{_W} SELECT row_index, value AS track FROM vals WHERE col = 'Track Name' ORDER BY lower(trim(value)) DESC, row_index LIMIT 50 OFFSET 100",
    "column_profile": f"""{_W}, c AS (SELECT col, count(*) AS total, count(*) FILTER (trim(value) <> '') AS filled, count(DISTINCT trim(value)) FILTER (trim(value) <> '') AS n_distinct FROM vals GROUP BY col),
  p AS (SELECT col, count(DISTINCT name) AS n_names FROM (SELECT col, unnest({_PIECES}) AS name FROM vals) GROUP BY col),
  e AS (SELECT col, count(*) FILTER (action = 'error') AS errors, count(*) FILTER (action = 'fixed' AND NOT cosmetic) AS fixed, count(*) FILTER (action = 'fixed' AND cosmetic) AS normalized FROM issues GROUP BY col)
  SELECT col, filled, total - filled AS blank, n_distinct, coalesce(n_names, 0) AS n_names, coalesce(fixed, 0) AS fixed, coalesce(normalized, 0) AS normalized, coalesce(errors, 0) AS errors, round_even(filled / total, 4) AS completeness
  FROM c LEFT JOIN p USING (col) LEFT JOIN e USING (col)""",
    "top_values": f"""{_W} SELECT col, CAST(place AS INTEGER) AS place, value, n FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, first) AS place
  FROM (SELECT col, trim(value) AS value, count(*) AS n, min(row_index) AS first FROM vals WHERE trim(value) <> '' GROUP BY 1, 2)) WHERE place <= 5""",
    "quality_score": f"""{_W}, t AS (SELECT (SELECT count(*) FROM state) AS n, (SELECT count(*) FROM vals WHERE trim(value) <> '') AS filled, (SELECT count(*) FROM issues WHERE action = 'error') AS errors, (SELECT count(*) FROM state WHERE status = 'clean') AS clean),
  s AS (SELECT CAST(greatest(0, least(100, round_even(100 * (0.5 * (1 - errors / (n * {len(FIELDS)})) + 0.3 * (clean / n) + 0.2 * (filled / (n * {len(FIELDS)}))), 0))) AS INTEGER) AS score FROM t) SELECT score, {_GRADE} AS grade FROM s""",
    "health_ribbon": f"""{_W}, w AS (SELECT r.row_index, coalesce(max(CASE WHEN action = 'error' THEN 2 WHEN cosmetic THEN 0 WHEN action IS NULL THEN 0 ELSE 1 END), 0) AS worst FROM raw r LEFT JOIN issues i ON i.row_index = r.row_index GROUP BY r.row_index)
  SELECT CAST(floor(row_index / greatest(1, ceil((SELECT count(*) FROM raw) / 1800))) AS BIGINT) AS pixel, CAST(max(worst) AS INTEGER) AS worst FROM w GROUP BY 1""",
    "unique_values": f"{_W} SELECT value, count(*) AS n FROM (SELECT unnest(string_split(value, ' | ')) AS value FROM vals WHERE col = 'Lead Artist' AND value <> '') WHERE contains(lower(value), 'a') GROUP BY value ORDER BY n DESC, value LIMIT 40",
    "remap_preview": f"""{_W}, o AS (SELECT row_index, value AS was, flatten(list_transform(string_split(value, ' | '), lambda x: CASE x WHEN 'B' THEN ['Building Almond', 'C'] WHEN 'Demoname' THEN ['Demo Name'] ELSE [x] END)) AS l FROM vals WHERE col = 'Singer' AND value <> '')
  SELECT row_index, was, array_to_string({duck.ordered_distinct('l')}, ' | ') AS now FROM o WHERE was <> array_to_string({duck.ordered_distinct('l')}, ' | ')""",
    "fingerprints": f"{_W}, {NEW} SELECT row_index, fingerprint FROM new",
    "master_upsert": f"{_W}, {UPSERT} SELECT row_index, outcome FROM outcomes",
    "commit_counters": f"{_W}, {UPSERT} SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome",
    "master_snapshot": f"{_W}, {BATCH}, {_stored('mas1', 'after', 'NULL')} SELECT * FROM after",
    "master_commits": f"""{_W}, {BATCH}, v1 AS (SELECT * REPLACE (row_number() OVER (ORDER BY id) AS id) FROM mas1),
  {_stored('v1', 'v2', "(SELECT max(id) FROM v1) + row_number() OVER (PARTITION BY id IS NULL ORDER BY first)")} SELECT *, 1 AS version FROM v1 UNION ALL SELECT *, 2 FROM v2""",
    "master_conflicts": f"{_W}, {CONFLICTS} SELECT row_index, master_id, array_to_string(d, ',') AS differences FROM best WHERE rn = 1 AND NOT any_exact AND len(d) > 0",
    "master_filter": f"{_W}, {MASTER} SELECT id FROM mas WHERE (singer ILIKE '%almond%' OR composer ILIKE '%almond%' OR lead_artist ILIKE '%almond%' OR singer ILIKE '%blue%' OR composer ILIKE '%blue%' OR lead_artist ILIKE '%blue%') AND language ILIKE '%hin%'",
    "tenancy_scope": f"{_W}, {MASTER} SELECT id, branch_id FROM mas WHERE branch_id IN (1, 3)",
    "master_verify": f"{_W}, {MASTER} SELECT v AS value, (SELECT count(*) FROM mas WHERE singer ILIKE '%' || v || '%' OR lead_artist ILIKE '%' || v || '%') AS n FROM (SELECT unnest(['Almond', 'nobody', 'Demo']) AS v)",
    "master_suggest": f"""{_W}, {MASTER}, c AS (SELECT id, unnest(list_filter(list_concat(string_split(singer, ' | '), string_split(composer, ' | ')), lambda x: x <> '')) AS value FROM mas)
  SELECT min(value) AS value, count(DISTINCT id) AS n FROM c WHERE contains(lower(value), 'al') GROUP BY lower(value) ORDER BY n DESC, lower(value) LIMIT 15""",
}
