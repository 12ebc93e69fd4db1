"""Royalty, writer, packed-credit, activity and text queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cells import clean_cell
from ..functions.text import norm
from ..operators import activity, backfill, exchange, pagination, royalty, similar, standardize, writers
from ..sources.storage import shared_folder, stored, stored_by
from . import duck_cells as duck
from .fixtures import PARTY_LIST, RAW_BAGS, RAW_PACKED, RAW_PARTIES, RAW_WORKS, duck_table, spark_table

PARTY_COLUMNS = ["work_key", "title", "territory", "duration", "publ_date", "dist_ref", "name", "role", "ipi", "society"]
WIDE_GROUPS = ["C", "A", "AR", "E", "SE", "UNSPECIFIED"]
#: Example values of a publisher.
PUBLISHER = {"pub_number": "P000XX", "pub_name": "EXAMPLE PUBLISHING", "pub_ipi": "000000000", "collection_share": "100"}
DEFAULT_LABEL = "Example Label"
FIELDS = {"name": "Name", "role": "Role", "ipi": "IPI Number", "society": "Performance Society", "share": "Performance Share"}


def royalty_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parties(_report(spark, sf_dir)[0])


def _parties(report: DataFrame) -> DataFrame:
    return royalty.once(report.select("seq", *(royalty_change(c).alias(c) for c in PARTY_COLUMNS)), PARTY_COLUMNS)


def _report(spark, sf_dir) -> tuple[DataFrame, int]:
    """The rows of RAW_PARTIES that have a key, trimmed, and to how many parts they are dealt by work; there is no other exchange
    of lines but that of a join with a table too large to broadcast.

    Lines meet parts and suppliers before they are dealt and numbered, so they carry a list of those found, empty or not: a line
    without any counts in seq, and one with two becomes two rows after that."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    n = royalty.parts_of(lines, lines.count())  # of the file's footers
    parts = table("part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.collect_list(F.struct("p_type", "p_name")).alias("_part"))
    suppliers = table("supplier").groupBy(F.col("s_suppkey").alias("l_suppkey")).agg(F.collect_list(F.struct("s_name", "s_nationkey")).alias("_supplier"))
    met = lines.join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left")
    unknown = {c: F.lit(None) for c in ("seq", "p_type", "p_name", "s_name", "n_name")}  # no key depends on these
    keyed = spark.sql(f"{PARTY_LIST}, * FROM {{lines}}", lines=met.withColumns(unknown)).select(F.trim("work_key").alias("_work"), *met.columns).filter("_work <> ''")
    order = Window.partitionBy("_work", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # an order has one key
    dealt = keyed.repartition(n, "_work").withColumn("seq", F.col("l_orderkey") * 1000 + F.row_number().over(order))
    rows = dealt.select("*", F.inline("_part")).select("*", F.inline("_supplier")).join(table("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return spark.sql(f"{PARTY_LIST}, _work FROM {{lines}}", lines=rows).select("seq", F.col("_work").alias("work_key"), *PARTY_COLUMNS[1:]), n


def royalty_shares(spark, sf_dir):
    return royalty.allocate(royalty_parties(spark, sf_dir)).select("seq", "work_key", "role", "share")


def royalty_issues(spark, sf_dir):
    return royalty.issues(royalty_parties(spark, sf_dir))


def royalty_budget(spark, sf_dir):
    return royalty.budget(royalty_parties(spark, sf_dir))


def royalty_slots(spark, sf_dir):
    return royalty.slotted(royalty_parties(spark, sf_dir)).select("seq", "work_key", "grp", "slot")


def royalty_groups(spark, sf_dir):
    rows = royalty.slotted(royalty_parties(spark, sf_dir))
    return rows.groupBy("grp").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.max("slot").alias("blocks"), F.count(F.lit(1)).alias("parties"))


def royalty_wide(spark, sf_dir):
    report, n = _report(spark, sf_dir)
    rows = stored_by(royalty.allocate(_parties(report)), "shares", "work_key", n)
    moved = royalty.demoted(rows, ["title", "territory", "duration", "publ_date", "dist_ref"])
    works = [c for c in ("title", "territory", "duration", "publ_date", "dist_ref") if c not in moved]
    table = royalty.blocks(rows, works, [*FIELDS, *moved])  # columns that vary in a work are their parties'
    text = lambda parties: F.array_join(F.transform(parties, lambda p: F.concat_ws(" | ", *(p[c] for c in (*FIELDS, *moved)))), "; ")
    groups = [F.coalesce(text(F.col("parties")[g]), F.lit("")).alias(f"grp_{g.lower()}") for g in WIDE_GROUPS]
    return table.select("work_key", *works, *groups, "issue", F.lit(",".join(moved)).alias("moved"))


_WORK_COLUMNS = ["title", "territory", "duration", "publ_date", "dist_ref"]


def royalty_checks(spark, sf_dir):
    """The consolidation checked against the report: a row a check, what is expected and what was found."""
    report, n = _report(spark, sf_dir)
    raw = stored_by(report, "report", "work_key", n)
    shares = stored_by(royalty.allocate(_parties(raw)), "shares", "work_key", n)
    moved = royalty.demoted(shares, _WORK_COLUMNS)
    works, fields = [c for c in _WORK_COLUMNS if c not in moved], [*FIELDS, *moved]
    table = stored_by(royalty.blocks(shares, works, fields), "blocks", "work_key", n)
    whole = F.sha2(F.concat_ws("\x01", "work_key", *(royalty_change(c) for c in PARTY_COLUMNS[1:])), 256)
    source = raw.select("work_key", "name", "society", royalty_change("name").alias("new_name"), royalty_change("society").alias("new_society"), whole.alias("whole"))
    kinds = set(table.schema["parties"].dataType.valueType.elementType.names)
    return consolidation_checks(royalty.compared(shares, table, works, fields), royalty.source_checks(source, shares, "work_key"), royalty.evenly_held(shares), fields, moved, kinds)


def royalty_change(c: str):
    changed = {"duration": royalty.report_duration, "publ_date": royalty.report_date, "dist_ref": royalty.distribution_ref, "name": royalty.party_name, "society": royalty.society}
    return changed[c](F.col(c)) if c in changed else F.col(c)


def consolidation_checks(compared: DataFrame, source: DataFrame, pools: DataFrame, fields: list[str], moved: list[str], kinds: set[str]) -> DataFrame:
    """check, expected, found, ok. kinds: the fields that parties of the consolidated works have."""
    works, one = F.count_if("in_rows"), F.count(F.lit(1))
    checks = exchange.check_rows(compared, {
        "every work once": (works, F.count_if(F.col("in_rows") & (F.col("written") == 1)) - F.count_if(~F.col("in_rows"))),
        "every party once": (F.sum("parties"), F.sum("back")),
        "party fields as they were": (works, F.count_if("set_same")),
        "party order as it was": (works, F.count_if("order_same")),
        "no party at another work": (F.sum("parties"), F.sum("placed")),
        "work columns once a work": (works, F.count_if("head_same")),
        "share written": (F.sum("parties"), F.sum("shared")),
        "100 percent in every work": (works, F.count_if(F.col("full") & (F.col("total") == 100))),
        "combined composers in the composers' block": (F.sum("combined"), F.sum("routed")),
        "fields of parties": (F.lit(len(fields)), F.lit(len(kinds.intersection(fields)))),
        "varying columns moved to parties": (F.lit(len(moved)), F.lit(len(kinds.intersection(moved)))),
    })
    about = exchange.check_rows(source, {
        "repeats removed": (F.sum("repeats"), F.sum("removed")),
        "names turned": (F.sum("commas"), F.sum("turned")),
        "society prefixes stripped": (F.sum("prefixed"), F.sum("stripped")),
    })
    return checks.unionByName(about).unionByName(exchange.check_rows(pools, {"shares even parts of pools": (one, F.count_if("near"))}))


WRITER_COLUMNS = [("C", "composer_1", "composer_1_cae"), ("C", "composer_2", "composer_2_cae"), ("A", "lyricist_1", "lyricist_1_cae")]


def work_head():
    title, aka = F.trim("title"), F.trim("alt_title")
    return {
        "title": title, "aka_title": aka, "aka_type": F.when(aka != "", "AT").otherwise(""), **{a: F.lit(v) for a, v in PUBLISHER.items()},
        "rec_title": title, "rec_artist": F.array_join(F.filter(F.array(F.trim("singer_1"), F.trim("singer_2")), lambda x: x != ""), ", "),
        "rec_isrc": F.trim("isrc"), "rec_label": F.when(F.trim("music_label") == "", DEFAULT_LABEL).otherwise(F.trim("music_label")),
    }


def _writer_rows(spark, sf_dir):
    return writers.writer_rows(spark_table(spark, sf_dir, RAW_WORKS), WRITER_COLUMNS, work_head())


def writer_rows(spark, sf_dir):
    return _writer_rows(spark, sf_dir).select("work_seq", "writer_seq", "title", "aka_type", "rec_artist", "rec_label", "last", "first", "ipi", "role")


def writer_counts(spark, sf_dir):
    return _writer_rows(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def writer_parts(spark, sf_dir):
    rows = _writer_rows(spark, sf_dir).withColumn("file", (F.col("work_seq") / 5000).cast("int"))
    return pagination.parts(rows)


def packed_explode(spark, sf_dir):
    rows = standardize.explode_packed(spark_table(spark, sf_dir, RAW_PACKED), "credits", ["composer", "lyricist", "singer"])
    return rows.select("row_index", "composer", "lyricist", "singer")


def standardize_durations(spark, sf_dir):
    rows = spark_table(spark, sf_dir, RAW_PACKED).select("row_index", standardize.seconds_as_minutes(F.col("seconds")).alias("text"))
    return rows.select("row_index", "text", clean_cell("Audio Duration (mm:sec)", F.col("text"), ascii_only=True)["value"].alias("value"))


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity_sessions(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return activity.collapse(events, ["user_id", "event_type"])


def activity_join(spark, sf_dir):
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role")).filter("user_id % 3 <> 0")
    return activity.with_users(_table(spark, sf_dir, "events").select("event_id", "user_id"), users).select("event_id", "user_id", "role")


def _files(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "uploaded").otherwise("cleaned")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("branch_id"), state.alias("status"))


def branch_rollup(spark, sf_dir):
    return activity.branch_rollup(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("branch_id")), _files(spark, sf_dir))


def dashboard(spark, sf_dir):
    return activity.dashboard(branch_rollup(spark, sf_dir))


def stored_by_file(spark, sf_dir):
    commits = _table(spark, sf_dir, "lineitem").filter("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("inserted"), (F.col("l_partkey") % 5).alias("updated"))
    return activity.stored_by_file(commits, _files(spark, sf_dir))


def report_totals(spark, sf_dir):
    return activity.report_totals(stored_by_file(spark, sf_dir), ["stored"])


def documents_exact_dups(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(norm(F.col("text")), 256).alias("key"))
    groups = docs.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return docs.join(groups, "key").filter("doc_id <> first").select("doc_id", "first", "copies")


def json_props(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


def bag_layout(spark, sf_dir):
    """The keys of the bags and the type that all values of each share."""
    kinds = backfill.layout(spark_table(spark, sf_dir, RAW_BAGS), "extras")
    return spark.createDataFrame(list(kinds.items()), "key string, type string")


def bag_columns(spark, sf_dir):
    """Values of the bags by the types of their keys."""
    rows = spark_table(spark, sf_dir, RAW_BAGS)
    wide = backfill.columns(rows, "extras", backfill.layout(rows, "extras"))
    return wide.select("event_id", *(F.col("bag")[k].alias(a) for k, a in (("ISWC No", "iswc"), ("Mood", "mood"), ("mood_2", "small"), ("deep", "deep"), ("flag", "flag"), ("k", "k"), ("n", "n"))))


def bag_backfill(spark, sf_dir):
    """Custom columns filled from the bags, of which one had values of its own."""
    return backfill.backfilled(spark_table(spark, sf_dir, RAW_BAGS), "extras", {"Mood": "x_mood"})[0]


def _part_names(spark, sf_dir):
    return _table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def similar_values(spark, sf_dir):
    return similar.similar_values(_part_names(spark, sf_dir), "small anvil", 0.6)


def similar_counts(spark, sf_dir):
    return similar.similar_counts(_part_names(spark, sf_dir))


def similar_cache(spark, sf_dir):
    """A scan, the same again, one of another file, one after an edit, and one of the first values again: whether each was
    stored, its rows, and how many of them are those of the first."""
    names = stored(_part_names(spark, sf_dir), "names")
    edited = names.withColumn("n", F.col("n") + F.when(F.col("value") == names.agg(F.min("value")).first()[0], 1).otherwise(0))
    folder, out, first = f"{shared_folder(spark)}/similar-{uuid.uuid4().hex}", [], None
    for step, (file_id, values) in enumerate([(1, names), (1, names), (2, names), (1, edited), (2, names), (1, names)]):
        found, hit = similar.cached_counts(values, folder, file_id, "Track Name")
        found = stored(found, "found")
        first = found if first is None else first
        both = found.withColumn("mine", F.lit(1)).unionByName(first.withColumn("mine", F.lit(0))).groupBy(*found.columns).agg(F.max("mine").alias("mine"), F.min("mine").alias("other"))
        counts = both.agg(F.coalesce(F.sum("mine"), F.lit(0)).cast("long").alias("n"), F.count_if((F.col("mine") == 1) & (F.col("other") == 0)).alias("same"))
        out.append(counts.select(F.lit(step).alias("step"), F.lit(hit).alias("hit"), "n", "same"))
    return reduce(DataFrame.unionByName, out)


def similar_bound(spark, sf_dir):
    """Pairs of names of parts whose shared characters allow a ratio of 0.8."""
    names = _part_names(spark, sf_dir)
    return similar.candidates(names, names.orderBy(F.col("n").desc(), "value").limit(similar.CAP), 0.8).select("base", "value")


_TITLE = duck.title
_PARTY = rf"""CASE WHEN NOT contains(trim(name), ',') THEN trim(name) ELSE {_TITLE("trim(concat_ws(' ', trim(regexp_replace(trim(name), '^[^,]*,', '')), trim(split_part(trim(name), ',', 1))))")} END"""
PARTIES = f"""p0 AS ({duck_table(RAW_PARTIES)}),
p1 AS (SELECT seq, trim(work_key) AS work_key, title, territory,
  CASE WHEN regexp_matches(duration, '^\\d+$') THEN printf('%02d:%02d:%02d', CAST(duration AS BIGINT) // 3600, CAST(duration AS BIGINT) % 3600 // 60, CAST(duration AS BIGINT) % 60) WHEN duration = '3:25' THEN '00:03:25' ELSE '00:03:25' END AS duration,
  strftime(CAST(publ_date AS DATE), '%d-%m-%Y') AS publ_date,
  CASE WHEN regexp_matches(substr(dist_ref, 7), '^[1-9]$') THEN '0' || substr(dist_ref, 7) ELSE '01' END || '-' || substr(dist_ref, 5, 2) || '-' || substr(dist_ref, 1, 4) AS dist_ref,
  {_PARTY} AS name, role, ipi, trim(regexp_replace(society, '^[^:]*:', '')) AS society FROM p0 WHERE trim(work_key) <> ''),
parties AS (SELECT min(seq) AS seq, {', '.join(PARTY_COLUMNS)} FROM p1 GROUP BY {', '.join(PARTY_COLUMNS)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY work_key, grp ORDER BY seq) AS slot FROM
  (SELECT *, CASE WHEN role = '' THEN 'UNSPECIFIED' WHEN contains(role, 'C') THEN 'C' ELSE role END AS grp FROM parties)),
pools AS (SELECT seq, work_key, unnest(CASE WHEN role = 'CA' THEN ['C', 'A'] WHEN role IN ('C', 'A', 'E') THEN [role] ELSE [] END) AS pool FROM parties),
cut AS (SELECT *, CASE pool WHEN 'E' THEN 50 ELSE 25 END AS total, count(*) OVER w AS n, row_number() OVER (PARTITION BY work_key, pool ORDER BY seq) AS place FROM pools WINDOW w AS (PARTITION BY work_key, pool)),
shares AS (SELECT seq, sum(CAST(CASE WHEN place = n THEN total - round_even(total / n, 4) * (n - 1) ELSE round_even(total / n, 4) END AS DECIMAL(20, 4))) AS share FROM cut GROUP BY seq)"""
_SHARE = r"regexp_replace(regexp_replace(CAST(coalesce(share, 0.0000) AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', '')"
_ID = r"CASE WHEN regexp_matches(v, '^(.*?\S)\s*-\s*(\d{{5,}})$') THEN regexp_extract(v, '^(.*?\S)\s*-\s*(\d{{5,}})$', {g}) ELSE {e} END"
WRITER = rf"""works AS ({duck_table(RAW_WORKS)}),
ent AS (SELECT work_seq, place, role, {_ID.format(g=1, e='v')} AS name, CASE WHEN cae <> '' THEN cae ELSE {_ID.format(g=2, e="''")} END AS ipi FROM (
  SELECT work_seq, 0 AS place, 'C' AS role, trim(composer_1) AS v, trim(composer_1_cae) AS cae FROM works UNION ALL SELECT work_seq, 1, 'C', trim(composer_2), trim(composer_2_cae) FROM works
  UNION ALL SELECT work_seq, 2, 'A', trim(lyricist_1), trim(lyricist_1_cae) FROM works) WHERE v <> ''),
per AS (SELECT *, {duck.norm('name')} AS person FROM ent),
nth AS (SELECT *, count(DISTINCT role) OVER (PARTITION BY work_seq, person) > 1 AS both_roles, row_number() OVER (PARTITION BY work_seq, person ORDER BY place) AS nth,
  first_value(role) OVER (PARTITION BY work_seq, person ORDER BY place) AS lead_role FROM per),
giv AS (SELECT work_seq, person, arg_min(ipi, place) FILTER (ipi <> '' AND (nth = 1 OR role <> lead_role)) AS given FROM nth GROUP BY ALL),
wr AS (SELECT n.*, row_number() OVER (PARTITION BY n.work_seq ORDER BY place) AS writer_seq, CASE WHEN both_roles AND nth = 1 THEN coalesce(given, '') ELSE ipi END AS ipi2,
  CASE WHEN both_roles AND nth = 1 THEN 'CA' ELSE role END AS role2, regexp_split_to_array(trim(name), '\s+') AS words
  FROM nth n JOIN giv g ON g.work_seq = n.work_seq AND g.person = n.person WHERE NOT both_roles OR nth = 1 OR role = lead_role)"""
#: Files of works and their parts, one work after another.
PARTS = """sizes AS (SELECT work_seq // 5000 AS file, work_seq, count(*) AS n, row_number() OVER (PARTITION BY work_seq // 5000 ORDER BY work_seq) AS i FROM wr GROUP BY work_seq),
walk AS (SELECT file, work_seq, i, CASE WHEN n >= 299 THEN 0 ELSE n END AS used, 1 AS part, CASE WHEN n >= 299 THEN 2 ELSE 1 END AS open FROM sizes WHERE i = 1
  UNION ALL SELECT s.file, s.work_seq, s.i, CASE WHEN t >= 299 THEN 0 ELSE t END, p, CASE WHEN t >= 299 THEN p + 1 ELSE p END FROM
    (SELECT s.*, CASE WHEN used > 0 AND used + n > 299 THEN open + 1 ELSE open END AS p, CASE WHEN used > 0 AND used + n > 299 THEN n ELSE used + n END AS t FROM walk w JOIN sizes s ON s.file = w.file AND s.i = w.i + 1) s),
placed_parts AS (SELECT CAST(file AS INTEGER) AS file, work_seq, CAST(part AS INTEGER) AS part FROM walk)"""
_BAGS = f"""b AS ({duck_table(RAW_BAGS)}), g AS (SELECT event_id, x_mood, CASE WHEN json_valid(extras) AND left(extras, 1) = chr(123) THEN extras END AS bag FROM b)"""
_IN_BAG = lambda key: f"json_extract_string(bag, '$.\"{key}\"')"

_NAMES = ["royalty_shares", "royalty_issues", "royalty_budget", "royalty_slots", "royalty_groups", "royalty_wide", "royalty_checks", "writer_rows", "writer_counts", "writer_parts",
    "packed_explode", "standardize_durations", "activity_sessions", "activity_join", "branch_rollup", "dashboard", "stored_by_file", "report_totals", "documents_exact_dups",
    "json_props", "bag_layout", "bag_columns", "bag_backfill", "similar_values", "similar_counts", "similar_cache", "similar_bound", "royalty_parties"]
QUERIES = {name: globals()[name] for name in _NAMES}
_ISSUES = """h AS (SELECT work_key, list_filter(['Composer', 'Author', 'Publisher'], lambda x: NOT list_contains(coalesce(held, []), x)) AS m FROM (SELECT DISTINCT work_key FROM parties)
  LEFT JOIN (SELECT work_key, list(CASE pool WHEN 'C' THEN 'Composer' WHEN 'A' THEN 'Author' ELSE 'Publisher' END) AS held FROM pools GROUP BY work_key) USING (work_key)),
i AS (SELECT work_key, CASE len(m) WHEN 0 THEN '' WHEN 1 THEN m[1] || ' share not allocated' WHEN 2 THEN m[1] || ' and ' || m[2] || ' share not allocated' ELSE 'Composer, Author and Publisher share not allocated' END AS issue FROM h)"""
_ROLLUP = """f AS (SELECT o_custkey AS branch_id, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 1 ELSE 3 END AS rank FROM orders),
r AS (SELECT c_custkey AS branch_id, count(rank) AS files, coalesce(max(rank), 0) AS progress FROM customer LEFT JOIN f ON f.branch_id = c_custkey GROUP BY c_custkey)"""
_STORED = "SELECT o_orderkey AS file_id, CAST(coalesce(s, 0) AS BIGINT) AS stored FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_linenumber + l_partkey % 5) AS s FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey"
_SHARED = """v AS (SELECT p_name AS value, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS x, count(*) AS n FROM part GROUP BY p_name),
c AS (SELECT value, b, count(*) AS c FROM (SELECT value, unicode(unnest(string_split(x, ''))) % 64 AS b FROM v) GROUP BY ALL), m AS (SELECT value, sum(greatest(c - 8, 0)) AS more FROM c GROUP BY value),
base AS (SELECT value FROM v WHERE x <> '' ORDER BY n DESC, value LIMIT 1000), o AS (SELECT p.value AS base, q.value, sum(least(p.c, q.c, 8)) AS o FROM c p JOIN c q USING (b) WHERE p.value IN (SELECT value FROM base) GROUP BY 1, 2)"""
ORACLES = {
    "similar_cache": """SELECT step, step IN (1, 4) AS hit, n, n AS same FROM (SELECT CAST(unnest(range(6)) AS INTEGER) AS step, (SELECT least(1000, count(DISTINCT p_name)) FROM part) AS n)""",
    "similar_bound": f"""WITH {_SHARED} SELECT base, o.value FROM o JOIN v p ON p.value = base JOIN v q ON q.value = o.value JOIN m r ON r.value = base JOIN m s ON s.value = o.value
  WHERE trim(p.value) <> trim(q.value) AND 2 * least(length(p.x), length(q.x)) >= 0.8 * (length(p.x) + length(q.x)) AND 2 * (o + least(r.more, s.more)) >= 0.8 * (length(p.x) + length(q.x))""",
    "royalty_parties": f"WITH {PARTIES} SELECT seq, {', '.join(PARTY_COLUMNS)} FROM parties",
    "royalty_shares": f"WITH {PARTIES} SELECT seq, work_key, role, {_SHARE} AS share FROM parties LEFT JOIN shares USING (seq)",
    "royalty_issues": f"WITH {PARTIES}, {_ISSUES} SELECT work_key, issue FROM i",
    "royalty_budget": f"WITH {PARTIES} SELECT grp, max(slot) AS slots FROM placed GROUP BY grp",
    "royalty_slots": f"WITH {PARTIES} SELECT seq, work_key, grp, CAST(slot AS INTEGER) AS slot FROM placed",
    "royalty_groups": f"WITH {PARTIES} SELECT grp, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, CAST(max(slot) AS INTEGER) AS blocks, count(*) AS parties FROM placed GROUP BY grp",
    "royalty_checks": f"""WITH {PARTIES}, {_ISSUES}, w AS (SELECT work_key, sum(share) AS total, count(*) AS n, count(*) FILTER (grp = 'C' AND upper(trim(role)) <> 'C') AS combined FROM (SELECT p.*, share FROM placed p LEFT JOIN shares USING (seq)) GROUP BY work_key),
  k AS (SELECT (SELECT count(*) FROM w) AS works, (SELECT count(*) FROM parties) AS parties, (SELECT count(*) FROM p1) AS n, (SELECT CAST(sum(combined) AS BIGINT) FROM w) AS combined,
    (SELECT count(*) FROM w JOIN i USING (work_key) WHERE issue = '' AND total = 100) AS allocated, (SELECT count(*) FROM p0 WHERE trim(work_key) <> '' AND contains(trim(name), ',')) AS commas,
    (SELECT count(*) FROM p0 WHERE trim(work_key) <> '' AND regexp_matches(trim(society), '^\\d+\\s*:')) AS prefixed,
    (SELECT {' + '.join(f"max(CAST(v_{c} AS INT))" for c in ('title', 'territory', 'duration', 'publ_date', 'dist_ref'))} FROM (SELECT {', '.join(f"min({c}) <> max({c}) AS v_{c}" for c in ('title', 'territory', 'duration', 'publ_date', 'dist_ref'))} FROM parties GROUP BY work_key)) AS moved),
  c AS (SELECT unnest(['every work once', 'party fields as they were', 'party order as it was', 'work columns once a work']) AS "check", works AS expected, works AS found FROM k
  UNION ALL SELECT unnest(['every party once', 'no party at another work', 'share written']), parties, parties FROM k UNION ALL SELECT '100 percent in every work', works, allocated FROM k
  UNION ALL SELECT 'combined composers in the composers'' block', combined, combined FROM k UNION ALL SELECT 'fields of parties', 5 + moved, 5 + moved FROM k UNION ALL SELECT 'varying columns moved to parties', moved, moved FROM k
  UNION ALL SELECT 'repeats removed', n - parties, n - parties FROM k UNION ALL SELECT 'names turned', commas, commas FROM k UNION ALL SELECT 'society prefixes stripped', prefixed, prefixed FROM k UNION ALL SELECT 'shares even parts of pools', count(*), count(*) FROM (SELECT DISTINCT seq FROM pools))
  SELECT "check", CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS found, expected = found AS ok FROM c""",
    "royalty_wide": f"""WITH {PARTIES}, {_ISSUES}, t AS (SELECT p.*, p.grp AS g, {_SHARE} AS text_share FROM placed p LEFT JOIN shares USING (seq)),
  moved AS (SELECT array_to_string(list_filter(['title', 'territory', 'duration', 'publ_date', 'dist_ref'], lambda c: list_contains(m, c)), ',') AS moved, m FROM
    (SELECT list_concat({' , '.join(f"CASE WHEN bool_or(v_{c}) THEN ['{c}'] ELSE [] END" for c in ('title', 'territory', 'duration', 'publ_date', 'dist_ref'))}) AS m FROM
      (SELECT work_key, {', '.join(f"min({c}) <> max({c}) AS v_{c}" for c in ('title', 'territory', 'duration', 'publ_date', 'dist_ref'))} FROM parties GROUP BY work_key))),
  b AS (SELECT work_key, {', '.join(f"arg_min({c}, seq) AS {c}" for c in ('title', 'duration', 'publ_date', 'dist_ref'))},
    {', '.join(f"coalesce(string_agg(concat_ws(' | ', name, role, ipi, society, text_share, territory), '; ' ORDER BY slot) FILTER (g = '{x}'), '') AS grp_{x.lower()}" for x in WIDE_GROUPS)} FROM t GROUP BY work_key)
  SELECT b.*, issue, moved.moved FROM b JOIN i USING (work_key), moved""",
    "writer_rows": f"""WITH {WRITER} SELECT w.work_seq, CAST(writer_seq AS INTEGER) AS writer_seq, CASE WHEN writer_seq = 1 THEN title ELSE '' END AS title, CASE WHEN writer_seq = 1 AND alt_title <> '' THEN 'AT' ELSE '' END AS aka_type,
  CASE WHEN writer_seq = 1 THEN array_to_string(list_filter([singer_1, singer_2], lambda x: x <> ''), ', ') ELSE '' END AS rec_artist, CASE WHEN writer_seq > 1 THEN '' WHEN music_label = '' THEN '{DEFAULT_LABEL}' ELSE music_label END AS rec_label,
  CASE WHEN len(words) = 1 THEN words[1] ELSE array_to_string(words[2:], ' ') END AS "last", words[1] AS "first", ipi2 AS ipi, role2 AS role FROM wr w JOIN works USING (work_seq)""",
    "writer_counts": f"WITH {WRITER} SELECT role2 AS role, count(*) AS n FROM wr GROUP BY 1",
    "writer_parts": f"WITH RECURSIVE {WRITER}, {PARTS} SELECT file, work_seq, part FROM placed_parts",
    "packed_explode": f"""WITH r AS ({duck_table(RAW_PACKED)}), s AS (SELECT row_index, i, lower(trim(regexp_extract(p, '^\\s*([A-Za-z][A-Za-z ./&-]*?)\\s*:\\s*(.+?)\\s*$', 1))) AS role, regexp_extract(p, '^\\s*([A-Za-z][A-Za-z ./&-]*?)\\s*:\\s*(.+?)\\s*$', 2) AS v
    FROM (SELECT row_index, unnest(regexp_split_to_array(credits, '\\s*[|;]\\s*')) AS p, generate_subscripts(regexp_split_to_array(credits, '\\s*[|;]\\s*'), 1) AS i FROM r)),
  g AS (SELECT row_index, role, list(v ORDER BY i) AS l FROM s WHERE role <> '' GROUP BY ALL), d AS (SELECT row_index, role, array_to_string({duck.ordered_distinct('l')}, ' | ') AS t FROM g)
  SELECT row_index, coalesce(max(t) FILTER (role = 'composer'), '') AS composer, coalesce(max(t) FILTER (role = 'lyricist'), '') AS lyricist, coalesce(max(t) FILTER (role = 'singer'), '') AS singer FROM r LEFT JOIN d USING (row_index) GROUP BY row_index""",
    "standardize_durations": f"""WITH r AS ({duck_table(RAW_PACKED)}), t AS (SELECT row_index, CASE WHEN contains(seconds, ':') THEN seconds ELSE CAST(CAST(round_even(CAST(seconds AS DOUBLE), 0) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(round_even(CAST(seconds AS DOUBLE), 0) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS text FROM r),
  n AS (SELECT *, CAST(split_part(text, ':', 1) AS BIGINT) * 60 + CAST(split_part(text, ':', 2) AS BIGINT) AS s FROM t)
  SELECT row_index, text, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS value FROM n""",
    "activity_sessions": """WITH e AS (SELECT user_id, event_type, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS run FROM e) SELECT user_id, event_type, min(ts) AS "first", max(ts) AS "last", count(*) AS n FROM r GROUP BY user_id, event_type, run""",
    "activity_join": "SELECT event_id, user_id, c_mktsegment AS role FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = user_id",
    "branch_rollup": f"WITH {_ROLLUP} SELECT branch_id, files, progress FROM r",
    "dashboard": f"WITH {_ROLLUP} SELECT count(*) AS total, count(*) FILTER (progress BETWEEN 1 AND 3) AS active, count(*) FILTER (progress >= 4) AS done FROM r",
    "stored_by_file": _STORED,
    "report_totals": f"SELECT count(*) AS n_rows, CAST(sum(stored) AS BIGINT) AS stored FROM ({_STORED})",
    "documents_exact_dups": rf"""WITH d AS (SELECT doc_id, sha256({duck.norm('text')}) AS key FROM documents), g AS (SELECT key, min(doc_id) AS first, count(*) AS copies FROM d GROUP BY key HAVING count(*) > 1)
  SELECT doc_id, "first", copies FROM d JOIN g USING (key) WHERE doc_id <> "first" """,
    "bag_layout": f"""WITH {_BAGS}, k AS (SELECT bag, unnest(json_keys(bag)) AS key FROM g WHERE bag IS NOT NULL), t AS (SELECT key, json_type(bag, '$."' || key || '"') AS t FROM k),
  c AS (SELECT key, list(DISTINCT CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' WHEN t IN ('DOUBLE', 'BOOLEAN') THEN t ELSE 'STRING' END) FILTER (t <> 'NULL') AS kinds FROM t GROUP BY key)
  SELECT key, CASE WHEN len(kinds) = 1 THEN kinds[1] WHEN list_contains(kinds, 'STRING') OR list_contains(kinds, 'BOOLEAN') THEN 'STRING' ELSE 'DOUBLE' END AS type FROM c""",
    "bag_columns": f"""WITH {_BAGS} SELECT event_id, CAST({_IN_BAG('ISWC No')} AS DOUBLE) AS iswc, {_IN_BAG('Mood')} AS mood, {_IN_BAG('mood')} AS small, {_IN_BAG('deep')} AS deep, CAST({_IN_BAG('flag')} AS BOOLEAN) AS flag, {_IN_BAG('k')} AS k, CAST({_IN_BAG('n')} AS BIGINT) AS n FROM g""",
    "bag_backfill": f"""WITH {_BAGS} SELECT event_id, coalesce({_IN_BAG('Mood')}, {_IN_BAG('mood')}, x_mood) AS x_mood, {', '.join(f"coalesce({_IN_BAG(k)}, '') AS {a}" for k, a in (('ISWC No', 'x_iswc_no'), ('deep', 'x_deep'), ('flag', 'x_flag'), ('k', 'x_k'), ('n', 'x_n')))} FROM g""",
    "json_props": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events",
}
