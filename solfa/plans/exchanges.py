"""Sheets in and out, matching of headers, commits with decisions, and activity as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import type_hits
from ..functions.schema import ATTRIBUTES, PRESETS
from ..operators import custom, exchange, expansion, master, matching, pagination
from ..operators.cleaning import ISSUE
from ..sources import workbooks
from ..sources.storage import shared_folder, stored
from ..streaming import activity
from ..streaming import report as daily
from . import duck_cells as duck
from .catalog import DATASET, catalog
from .entities import BATCH, FIELDS, MASTER, _master, batch, silver, stock
from .fixtures import CATALOG_MAPPING, RAW_CATALOG, RAW_PACKED, RAW_SCORES, RAW_WORKS, duck_table, spark_table, spread
from .reshapes import PARTS, WRITER, WRITER_COLUMNS, _writer_rows, work_head


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def workbook_scan(spark, sf_dir):
    """The packed sheet as workbooks of 500 rows and back."""
    rows = spark_table(spark, sf_dir, RAW_PACKED).withColumn("book", F.floor(F.col("row_index") / 500))
    books = stored(workbooks.as_workbooks(rows, "book", "row_index", ["title", "credits", "seconds"]), "workbooks")
    return workbooks.as_table(stored(workbooks.sheet_rows(books), "sheet-rows"))


def writer_workbooks(spark, sf_dir):
    """Writers of works as workbooks, one for each part of 299 rows at most, read back."""
    rows = stored(_writer_rows(spark, sf_dir).withColumn("file", F.floor(F.col("work_seq") / 5000).cast("int")), "writers")
    placed = pagination.parts(rows)
    named = rows.join(placed, ["file", "work_seq"]).withColumn("book", F.concat_ws("-", "file", "part"))
    columns = ["work_seq", "writer_seq", "title", "last", "first", "ipi", "role"]
    texts = named.select("book", (F.col("work_seq") * 1000 + F.col("writer_seq")).alias("at"), *(F.col(c).cast("string").alias(c) for c in columns))
    books = stored(workbooks.as_workbooks(texts, "book", "at", columns), "workbooks")
    back = workbooks.as_table(stored(workbooks.sheet_rows(books, strict=False), "sheet-rows"))
    return back.select(F.col("work_seq").cast("long").alias("work_seq"), F.col("writer_seq").cast("int").alias("writer_seq"), "title", "last", "first", "ipi", "role")


def _headers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    raw = catalog(spark, sf_dir)
    names = [c for c in raw.columns if c != "row_index"]
    heads = spark.createDataFrame([("sheet", i, c) for i, c in enumerate(names)], "file string, place int, header string")
    hits = type_hits(raw.unpivot("row_index", names, "col", "value")).withColumnRenamed("col", "header")
    return heads, hits.join(heads, "header").drop("header")


def mapping_suggestion(spark, sf_dir):
    """Which header of the sheet fills which canonical column."""
    heads, hits = _headers(spark, sf_dir)
    known = matching.targets(spark)
    found = matching.assign(matching.with_content(matching.header_scores(heads, known), hits))
    return matching.suggestion(found, known).select("position", "target", "header", "confidence", "method", "needs_review", F.array_join("extras", ",").alias("extras"))


def header_assignment(spark, sf_dir):
    """Pairs of headers and targets dealt best first, with the sources that ride along."""
    scores = spark_table(spark, sf_dir, RAW_SCORES).withColumn("header_score", F.col("score"))
    return matching.assign(scores).select("file", "target", "header", "confidence", "method", "nth")


def header_matches(spark, sf_dir):
    """Headers that name a canonical column in full: themselves, by a synonym, or within more words."""
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    head = F.when(F.col("p_size") % 3 == 0, F.concat_ws(" ", F.lit("Genre"), "p_name")).when(F.col("p_size") % 3 == 1, "LABEL  name").otherwise(F.lit("isrc"))
    heads = parts.select(F.lit("sheet").alias("file"), F.col("p_partkey").cast("int").alias("place"), head.alias("header"))
    found = matching.header_scores(heads, matching.targets(spark)).filter("score >= 0.92")
    return found.groupBy("place").agg(F.max_by("target", F.struct("score", "target")).alias("target"), F.max("score").alias("score"))


def mapping_preview(spark, sf_dir):
    rows = exchange.preview(catalog(spark, sf_dir), CATALOG_MAPPING, 40)
    return rows.select("row_index", "ISRC", "Singer", "Mood")


def _noted(spark, sf_dir):
    mark = F.struct(F.lit("Mood").alias("column"), F.lit("fixed").alias("action"), F.lit("corrected").alias("tag"), F.lit("").alias("message"), F.col("values")["Mood"].alias("value"), F.lit("old").alias("original"), F.lit(False).alias("cosmetic"), F.lit(None).cast("array<bigint>").alias("related_rows")).cast(ISSUE)
    bare = F.transform("issues", lambda x: x.withField("message", F.lit("")))
    rows = silver(spark, sf_dir).withColumn("issues", F.when(F.col("row_index") % 5 == 0, F.array_append(bare, mark)).otherwise(bare))
    cells = rows.filter("row_index % 7 = 0").select("row_index", F.explode(F.array(F.lit("Mood"), F.lit("ISRC"))).alias("col"))
    return exchange.review_notes(rows, cells, rows.filter("row_index % 11 = 0"))


def review_notes(spark, sf_dir):
    keys = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",")
    return _noted(spark, sf_dir).select("row_index", keys("edited").alias("edited"), keys("errored").alias("errored"), F.array_join(F.array_sort(F.split("notes", "; ")), "; ").alias("notes"))


def review_export(spark, sf_dir):
    """Rows with errors, as an export writes them, read back."""
    rows = exchange.review_export(_noted(spark, sf_dir).filter("size(errored) > 0"), FIELDS)
    path = _fresh(spark, "export")
    rows.repartitionByRange("Row").sortWithinPartitions("Row").write.parquet(path)
    return spark.read.parquet(path).select("Row", "ISRC", "Singer", "Mood", F.size(F.split("Issues", "; ")).alias("n_issues"))


def master_export(spark, sf_dir):
    rows = exchange.master_export(_master(spark, sf_dir), PRESETS["PDL"], {("singer", "lead_artist"): ["building", "demo"]})
    path = _fresh(spark, "master")
    rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
    return spark.read.parquet(path).select("id", "ISRC", "Track Name", "Singer")


def branch_delete(spark, sf_dir):
    return exchange.without_branches(_master(spark, sf_dir), spark.createDataFrame([(2,), (4,), (4,)], "branch_id long")).select("id", "branch_id")


def _decided(spark, sf_dir):
    records = batch(spark, sf_dir)
    kind = F.when(F.col("row_index") % 4 == 1, "master").when(F.col("row_index") % 4 == 3, "cleaned").otherwise("both")
    target = F.when(F.col("row_index") % 8 == 7, F.col("row_index") + 10_000_000).otherwise(F.col("row_index") - 1)
    decisions = records.filter("row_index % 3 = 0 AND row_index < 10000000").select("row_index", kind.alias("decision"), target.alias("master_id"))
    held = stock(spark, sf_dir)
    return exchange.decided(records, held, decisions), held


def commit_decisions(spark, sf_dir):
    return _decided(spark, sf_dir)[0].select("row_index", "outcome")


def decided_snapshot(spark, sf_dir):
    """The whole table after a commit with decisions."""
    found, held = _decided(spark, sf_dir)
    return exchange.snapshot(stored(found, "decided"), held)


def custom_columns(spark, sf_dir):
    """Custom columns of the master, two of one slug, filled from new records where they are blank."""
    registry = custom.promoted({}, ["Mood", "ISRC", " mood", "Mood!"])
    stock = custom.widened(_master(spark, sf_dir), registry)
    stock = stock.withColumn("x_mood", F.when(F.col("id") % 8 == 0, "kept").otherwise(F.col("x_mood")))
    mood = silver(spark, sf_dir).select("row_index", F.col("values")["Mood"].alias("x_mood"), F.lit(" ").alias("x_mood_1"))
    new = master.records(silver(spark, sf_dir)).select("row_index", "fingerprint").join(mood, "row_index")
    return custom.filled(stock, new, registry).select("id", "x_mood", "x_mood_1")


def writer_checks(spark, sf_dir):
    """The rows of writers and their parts checked against the works, with the first works at fault."""
    rows = stored(_writer_rows(spark, sf_dir).withColumn("file", F.floor(F.col("work_seq") / 5000).cast("int")), "writers")
    placed = stored(pagination.parts(rows), "parts")
    works = expansion.compared(spark_table(spark, sf_dir, RAW_WORKS), WRITER_COLUMNS, work_head(), rows, placed)
    sizes = rows.join(placed, ["file", "work_seq"]).groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"))
    return expansion.expansion_checks(stored(works, "compared"), sizes)


def _events(spark, sf_dir) -> DataFrame:
    events = activity.log_files(spark, f"{sf_dir}/event[s].parquet")  # a pattern may match a file or a folder
    return events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def activity_stream(spark, sf_dir):
    """Runs of repeats that are over, from the log as a stream."""
    path = _fresh(spark, "activity")
    activity.append(activity.collapse(_events(spark, sf_dir), ["user_id", "event_type"]), f"{path}/rows", f"{path}/checkpoint")
    rows = spark.read.parquet(f"{path}/rows")
    return rows.select("user_id", "event_type", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def daily_report(spark, sf_dir):
    """The report of the third day over a log that grew by a third each day, files without commits included."""
    path = _fresh(spark, "report")
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("bigint").alias("file_id"), (F.col("event_id") % 5).alias("inserted"), (F.col("event_id") % 3).alias("updated"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).alias("day"))
    for day in range(3):
        log.filter(F.col("day") == day).drop("day").write.mode("append").parquet(f"{path}/log")
        daily.run(activity.log_files(spark, f"{path}/log"), f"{path}/totals", f"{path}/checkpoint")
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("file_id"), F.col("c_name").alias("name"))
    return daily.report(files, daily.totals(spark, f"{path}/totals")).withColumn("last", F.col("last").cast("timestamp_ntz"))


def activity_log(spark, sf_dir):
    """The log appended by two runs of a job, of which the second finds nothing new."""
    path = _fresh(spark, "log")
    for _ in range(2):
        activity.append(_events(spark, sf_dir), f"{path}/rows", f"{path}/checkpoint")
    rows = spark.read.parquet(f"{path}/rows")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").cast("timestamp_ntz").alias("last"))


_NAMES = ["workbook_scan", "writer_workbooks", "mapping_suggestion", "header_assignment", "header_matches", "mapping_preview", "review_notes", "review_export", "master_export", "branch_delete",
    "commit_decisions", "decided_snapshot", "custom_columns", "writer_checks", "activity_stream", "activity_log", "daily_report"]
QUERIES = {name: globals()[name] for name in _NAMES}
_W = f"WITH {DATASET}"
_SINGERS = "list_filter([artist_1, artist_2], lambda x: trim(x) <> '')"
_NOTED = """iss AS (SELECT row_index, col, action, tag, value, original FROM issues UNION ALL SELECT row_index, 'Mood', 'fixed', 'corrected', value, 'old' FROM vals WHERE col = 'Mood' AND row_index % 5 = 0),
told AS (SELECT row_index, col, action = 'error' AS wrong, CASE WHEN action = 'error' THEN col || ': ' || tag || ' (unresolved)' ELSE col || ': ''' || original || ''' -> ''' || value || ''' (manually corrected)' END AS note FROM iss WHERE action = 'error' OR tag IN ('corrected', 'merged')),
sets AS (SELECT row_index, col, false AS wrong, col || ': set to ''' || value || ''' by a reviewer (same as the cleaned value, so nothing changed)' AS note FROM vals WHERE col IN ('Mood', 'ISRC') AND row_index % 7 = 0 AND (row_index, col) NOT IN (SELECT (row_index, col) FROM told)),
every AS (SELECT * FROM told UNION ALL SELECT * FROM sets),
noted AS (SELECT r.row_index, coalesce(string_agg(DISTINCT col, ',' ORDER BY col) FILTER (NOT wrong), '') AS edited, coalesce(string_agg(DISTINCT col, ',' ORDER BY col) FILTER (wrong), '') AS errored, count(note) AS n,
  coalesce(string_agg(note, '; ' ORDER BY note), CASE WHEN r.row_index % 11 = 0 THEN 'Kept as-is by a reviewer (values unchanged)' ELSE '' END) AS notes FROM raw r LEFT JOIN every e ON e.row_index = r.row_index GROUP BY r.row_index)"""
_VALUE = lambda c: f"(SELECT value FROM vals v WHERE v.row_index = x.row_index AND v.col = '{c}')"
_OWN = f"{duck.norm('label')} || chr(1) || {duck.norm('distributor')}"
#: What each identity stands for, then every row by what was decided.
_DECIDED = f"""{BATCH}, dec AS (SELECT row_index, CASE row_index % 4 WHEN 1 THEN 'master' WHEN 3 THEN 'cleaned' ELSE 'both' END AS decision, CASE WHEN row_index % 8 = 7 THEN row_index + 10000000 ELSE row_index - 1 END AS target
  FROM batch WHERE row_index % 3 = 0 AND row_index < 10000000),
lines AS (SELECT b.*, coalesce(decision, 'both') AS decision, t.id AS target FROM batch b LEFT JOIN dec USING (row_index) LEFT JOIN mas1 t ON t.id = dec.target),
firsts AS (SELECT fingerprint, min(row_index) AS since, arg_min(CASE WHEN decision = 'cleaned' THEN target END, row_index) AS taken, arg_min(decision = 'cleaned' AND target IS NOT NULL, row_index) AS over FROM lines WHERE decision <> 'master' GROUP BY fingerprint),
marked AS (SELECT l.*, coalesce(m.id, CASE WHEN over THEN taken END) AS record, m.id IS NOT NULL OR coalesce(since < l.row_index, false) AS clash FROM lines l LEFT JOIN firsts USING (fingerprint) LEFT JOIN (SELECT fingerprint, id FROM mas1) m USING (fingerprint)),
judged AS (SELECT *, decision = 'cleaned' AND coalesce(target = record, false) AS takes FROM marked),
chain AS (SELECT *, decision = 'cleaned' AND NOT takes AND clash AS lost, coalesce(CAST(record AS VARCHAR), fingerprint) AS thing FROM judged),
steps AS (SELECT thing, row_index, owners, decision <> 'master' AND NOT lost AS counts FROM chain UNION ALL SELECT CAST(id AS VARCHAR), -1, {_OWN}, true FROM mas1 WHERE id IN (SELECT record FROM chain)),
seen AS (SELECT thing, row_index, last_value(CASE WHEN counts THEN owners END IGNORE NULLS) OVER (PARTITION BY thing ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM steps),
settled AS (SELECT c.*, CASE WHEN decision = 'master' THEN 'skipped' WHEN takes THEN 'updated' WHEN lost THEN 'duplicate' WHEN before IS NULL THEN 'inserted' WHEN before <> owners THEN 'updated' ELSE 'duplicate' END AS outcome FROM chain c JOIN seen USING (thing, row_index)),
finals AS (SELECT thing, max(record) AS record, max(row_index) AS row_index, arg_max(fingerprint, row_index) FILTER (takes) AS taken, min(fingerprint) AS own FROM settled WHERE outcome IN ('inserted', 'updated') GROUP BY thing)"""
_FIELDS_OF = ", ".join(f"b.{a}" for a in ATTRIBUTES.values())
ORACLES = {
    "workbook_scan": f"SELECT CAST(row_index // 500 AS VARCHAR) AS file, row_number() OVER (PARTITION BY row_index // 500 ORDER BY row_index) - 1 AS row_index, title, credits, seconds FROM ({duck_table(RAW_PACKED)})",
    "writer_workbooks": f"""WITH {WRITER} SELECT w.work_seq, CAST(writer_seq AS INTEGER) AS writer_seq, CASE WHEN writer_seq = 1 THEN title ELSE '' END AS title,
  CASE WHEN len(words) = 1 THEN words[1] ELSE array_to_string(words[2:], ' ') END AS "last", words[1] AS "first", ipi2 AS ipi, role2 AS role FROM wr w JOIN works USING (work_seq)""",
    "header_assignment": f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, place, position) AS i FROM ({duck_table(RAW_SCORES)}) WHERE score > 0),
  walk AS (SELECT file, 0::BIGINT AS i, []::INT[] AS places, []::INT[] AS positions, false AS took FROM p GROUP BY file
    UNION ALL SELECT n.file, n.i, CASE WHEN t THEN list_append(places, place) ELSE places END, CASE WHEN t THEN list_append(positions, position) ELSE positions END, t FROM
      (SELECT w.places, w.positions, p.*, NOT list_contains(w.places, p.place) AND NOT list_contains(w.positions, p.position) AND (method <> 'fuzzy' OR score >= 0.55) AS t FROM walk w JOIN p ON p.file = w.file AND p.i = w.i + 1) n),
  main AS (SELECT p.* FROM p JOIN walk USING (file, i) WHERE took),
  ride AS (SELECT file, place, min(i) AS i FROM p WHERE score >= 0.85 AND (file, position) IN (SELECT (file, position) FROM main) AND (file, place) NOT IN (SELECT (file, place) FROM main) GROUP BY ALL),
  dealt AS (SELECT *, 0 AS nth FROM main UNION ALL SELECT p.*, CAST(row_number() OVER (PARTITION BY file, position ORDER BY i) AS INTEGER) FROM p JOIN (SELECT file, i FROM ride) USING (file, i))
  SELECT file, target, header, score AS confidence, method, nth FROM dealt""",
    "header_matches": """SELECT CAST(p_partkey AS INTEGER) AS place, CASE p_size % 3 WHEN 0 THEN 'Genre' WHEN 1 THEN 'Label' ELSE 'ISRC' END AS target, CASE p_size % 3 WHEN 0 THEN 0.92 WHEN 1 THEN 0.96 ELSE 1.0 END AS score FROM part""",
    "mapping_preview": f"""SELECT row_index, isrc_code AS "ISRC", array_to_string({duck.ordered_distinct(_SINGERS)}, ' | ') AS "Singer", mood AS "Mood" FROM ({duck_table(RAW_CATALOG)}) ORDER BY row_index LIMIT 40""",
    "review_notes": f"{_W}, {_NOTED} SELECT row_index, edited, errored, notes FROM noted",
    "review_export": f"""{_W}, {_NOTED} SELECT row_index + 1 AS "Row", {', '.join(f'{_VALUE(c)} AS "{c}"' for c in ('ISRC', 'Singer', 'Mood'))}, CAST(n AS INTEGER) AS n_issues FROM noted x WHERE errored <> ''""",
    "master_export": f"""{_W}, {MASTER} SELECT id, isrc AS "ISRC", track_name AS "Track Name", singer AS "Singer" FROM mas WHERE singer ILIKE '%building%' OR lead_artist ILIKE '%building%' OR singer ILIKE '%demo%' OR lead_artist ILIKE '%demo%'""",
    "branch_delete": f"{_W}, {MASTER} SELECT id, branch_id FROM mas WHERE branch_id NOT IN (2, 4)",
    "commit_decisions": f"{_W}, {_DECIDED} SELECT row_index, outcome FROM settled",
    "decided_snapshot": f"""{_W}, {_DECIDED} SELECT * FROM mas1 WHERE id NOT IN (SELECT record FROM finals WHERE record IS NOT NULL)
  UNION ALL SELECT f.record AS id, b.branch_id, b.file_id, {_FIELDS_OF}, coalesce(f.taken, m.fingerprint, f.own) AS fingerprint FROM finals f JOIN batch b ON b.row_index = f.row_index LEFT JOIN mas1 m ON m.id = f.record""",
    "custom_columns": f"""{_W}, {MASTER}, f AS (SELECT fingerprint, arg_min(value, row_index) AS mood FROM new JOIN vals USING (row_index) WHERE col = 'Mood' AND trim(value) <> '' GROUP BY fingerprint)
  SELECT id, CASE WHEN id % 8 = 0 THEN 'kept' ELSE coalesce(mood, '') END AS x_mood, '' AS x_mood_1 FROM mas LEFT JOIN f USING (fingerprint)""",
    "writer_checks": f"""WITH RECURSIVE {WRITER}, {PARTS}, c AS (SELECT w.work_seq, title, (trim(composer_1) <> '')::INT + (trim(composer_2) <> '')::INT + (trim(lyricist_1) <> '')::INT AS cells, coalesce(n, 0) AS n, coalesce(merged, 0) AS merged
    FROM works w LEFT JOIN (SELECT work_seq, count(*) AS n, count(*) FILTER (role2 = 'CA') AS merged FROM wr GROUP BY 1) USING (work_seq)),
  clash AS (SELECT n.work_seq, n.name || ' (' || title || ')' AS fault FROM nth n JOIN giv g ON g.work_seq = n.work_seq AND g.person = n.person JOIN works w ON w.work_seq = n.work_seq WHERE role <> lead_role AND n.ipi <> '' AND n.ipi <> given),
  t AS (SELECT CAST(sum(cells) AS BIGINT) AS cells, CAST(sum(n + merged) AS BIGINT) AS made, CAST(sum(n) AS BIGINT) AS n, CAST(sum(merged) AS BIGINT) AS merged, count(*) AS w, count(*) FILTER (n > 0) AS v FROM c),
  k AS (SELECT 'a row for each writer' AS "check", cells AS expected, made AS found FROM t UNION ALL SELECT 'both roles in one row', merged, merged FROM t UNION ALL SELECT unnest(['no blank writers', 'fields without a source left blank']), n, n FROM t
    UNION ALL SELECT unnest(['work written once', 'writers in order', 'roles as in the columns', 'identifiers copied', 'names split', 'singers as the recording artist', 'work in one part']), v, v FROM t
    UNION ALL SELECT 'identifiers stripped from names', count(*), count(*) FROM ent e JOIN works USING (work_seq) WHERE place = 0 AND regexp_matches(trim(composer_1), '\\d{{5,}}$')
    UNION ALL SELECT 'parts within the limit', count(*), count(*) FILTER (s <= 299) FROM (SELECT sum(n) AS s FROM placed_parts JOIN c USING (work_seq) GROUP BY file, part)
    UNION ALL SELECT 'one identifier for a merged writer', 0, count(*) FROM clash UNION ALL SELECT 'works with a writer', w, v FROM t),
  f AS (SELECT 'one identifier for a merged writer' AS "check", work_seq, fault FROM clash UNION ALL SELECT 'works with a writer', work_seq, title FROM c WHERE n = 0),
  few AS (SELECT "check", count(*) AS n_faults, array_to_string(list(fault ORDER BY work_seq, fault)[:3], ', ') AS faults FROM f GROUP BY 1)
  SELECT "check", CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS found, coalesce(n_faults, 0) AS n_faults, coalesce(faults, '') AS faults, expected = found AND n_faults IS NULL AS ok FROM k LEFT JOIN few USING ("check")""",
    "daily_report": """SELECT c_custkey AS file_id, c_name AS name, CAST(coalesce(sum(event_id % 5 + event_id % 3), 0) AS BIGINT) AS stored, count(event_id) AS commits, max(ts) AS last
  FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY ALL""",
    "activity_stream": """WITH e AS (SELECT user_id, event_type, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS run FROM e), g AS (SELECT user_id, event_type, min(ts) AS "first", max(ts) AS "last", count(*) AS n FROM r GROUP BY user_id, event_type, run)
  SELECT * FROM g WHERE "last" + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "activity_log": "SELECT event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY event_type",
}
