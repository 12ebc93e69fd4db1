"""The master table: identity fingerprints, upsert, near conflicts, and queries on stored records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import ATTRIBUTES, COLUMNS, IDENTITY, OWNERSHIP
from ..functions.text import norm, pieces
from ..sources.storage import stored


def fingerprint(value) -> Column:
    """SHA-256 of the identity columns. value(column) gives a column's text."""
    parts = [F.concat(F.lit(c + "\x02"), norm(value(c))) for c in IDENTITY]
    return F.sha2(F.concat_ws("\x01", *parts), 256)


def of_values(values: Column):
    return lambda c: F.coalesce(values[c], F.lit(""))


def records(cleaned: DataFrame) -> DataFrame:
    """Cleaned rows as row_index, the attributes of all canonical columns, and fingerprint."""
    value = of_values(F.col("values"))
    flat = cleaned.select("row_index", *(value(c).alias(a) for c, a in ATTRIBUTES.items()))
    return flat.withColumn("fingerprint", fingerprint(lambda c: F.col(ATTRIBUTES[c])))


def _owners() -> Column:
    return F.concat_ws("\x01", *(norm(F.col(ATTRIBUTES[c])) for c in OWNERSHIP if c in ATTRIBUTES))


def upsert_outcomes(new: DataFrame, master: DataFrame) -> DataFrame:
    """row_index and outcome (inserted, updated, duplicate) of storing new records, in row order, over master.

    A record is inserted if its fingerprint is new; a later one updates if its owners differ from the record before it
    (or from the stored one), else it is a duplicate."""
    old = master.select("fingerprint", F.lit(-1).cast("long").alias("row_index"), _owners().alias("owners"))
    rows = new.select("fingerprint", "row_index", _owners().alias("owners")).unionByName(old.join(new.select("fingerprint"), "fingerprint", "left_semi"))
    before = F.lag("owners").over(Window.partitionBy("fingerprint").orderBy("row_index"))
    outcome = F.when(before.isNull(), "inserted").when(before != F.col("owners"), "updated").otherwise("duplicate")
    return rows.withColumn("outcome", outcome).filter("row_index >= 0").select("row_index", "outcome")


def changing_rows(new: DataFrame, master: DataFrame) -> DataFrame:
    """The row of new that settles each record that new inserts or updates: the last one whose owners differ from those before
    it, which is the first after the last row with other owners. Groups only, so that a crowded identity is no task's burden."""
    own = new.select("fingerprint", "row_index", _owners().alias("owners"))
    old = master.select("fingerprint", F.lit(-1).cast("long").alias("row_index"), _owners().alias("owners")).join(own.select("fingerprint"), "fingerprint", "left_semi")
    every = own.unionByName(old)
    runs = every.groupBy("fingerprint", "owners").agg(F.max("row_index").alias("until"))
    last = runs.groupBy("fingerprint").agg(F.max_by("owners", "until").alias("final"))
    other = runs.join(last, "fingerprint").filter("owners <> final").groupBy("fingerprint").agg(F.max("until").alias("since"))
    settled = every.join(last.join(other, "fingerprint", "left"), "fingerprint").filter((F.col("owners") == F.col("final")) & (F.col("row_index") > F.coalesce("since", F.lit(-2))))
    first = settled.groupBy("fingerprint").agg(F.min("row_index").alias("row_index"))
    return new.join(first.filter("row_index >= 0"), ["fingerprint", "row_index"], "left_semi")


def upsert(new: DataFrame, master: DataFrame) -> DataFrame:
    """The next snapshot of master. A record takes all attributes, and what else new and master share (branch and file), from
    the row that settles it; a record without such a row stays. New records have no id yet."""
    shared = [c for c in master.columns if c in new.columns and c not in ("row_index", "id", "fingerprint")]
    row = changing_rows(new, master).select(F.col("fingerprint").alias("_fp"), F.struct(*shared).alias("_new"))
    both = master.join(row, F.col("fingerprint") == F.col("_fp"), "full_outer")
    pick = lambda c: F.when(F.col("_fp").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in shared else F.coalesce(c, "_fp") if c == "fingerprint" else F.col(c)
    return both.select(*(pick(c).alias(c) for c in master.columns))


def numbered(rows: DataFrame, by: str, after: int, name: str = "id", per_part: int = 200_000) -> DataFrame:
    """rows with a number in the order of by (no two alike), from after + 1 on: parts are ranges of by, and each counts on
    from the sum of those before it."""
    parts = max(1, -(-rows.count() // per_part))
    placed = stored(rows.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return placed.withColumn("_place", place).join(counts.select("_part", before.alias("_before")), "_part").withColumn(name, F.lit(after).cast("long") + F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def conflicts(new: DataFrame, master: DataFrame) -> DataFrame:
    """row_index, master_id and differences: new records that share an anchor (ISRC; else barcode and track; else track,
    album and an artist) with a stored one without being the same, with the closest (then least id) of those."""
    n = lambda side, a: norm(F.col(f"{side}.{a}"))
    own, old = new.alias("n"), master.alias("m")
    has = lambda a: norm(F.col(f"n.{a}")) != ""
    same = lambda a: n("n", a) == n("m", a)
    by_isrc = own.filter(has("isrc")).join(old, same("isrc"))
    by_upc = own.filter(~has("isrc") & has("upc") & has("track_name")).join(old, same("upc") & same("track_name"))
    third = ~has("isrc") & ~(has("upc") & has("track_name")) & has("track_name") & has("album_name") & (has("singer") | has("lead_artist"))
    by_track = own.filter(third).join(old, same("track_name") & same("album_name")).filter(same("singer") | same("lead_artist"))
    differ = F.array_compact(F.array(*(F.when(~same(ATTRIBUTES[c]), c) for c in COLUMNS if c != "Record #")))
    picked = [F.col("n.row_index").alias("row_index"), F.col("m.id").alias("master_id"), (F.col("n.fingerprint") == F.col("m.fingerprint")).alias("exact"), differ.alias("differences")]
    met = reduce(DataFrame.unionByName, (x.select(*picked) for x in (by_isrc, by_upc, by_track)))
    best = met.groupBy("row_index").agg(F.max("exact").alias("exact"), F.min(F.when(F.size("differences") > 0, F.struct(F.size("differences").alias("n"), "master_id", "differences"))).alias("best"))
    return best.filter(~F.col("exact") & F.col("best").isNotNull()).select("row_index", "best.master_id", "best.differences")


def contains_any(columns: list[str], values: list[str]) -> Column:
    """Any column contains any value, case aside (% and _ are wildcards, as in the stored queries)."""
    return reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{v}%") for c in columns for v in values))


def search(master: DataFrame, filters: dict[tuple[str, ...], list[str]], branches: DataFrame | None = None) -> DataFrame:
    """Records that match every filter (columns -> values; blank values are ignored), of owned branches only if given."""
    out = master
    for columns, values in filters.items():
        if wanted := [v for v in values if v.strip()]:
            out = out.filter(contains_any(list(columns), wanted))
    return out if branches is None else out.join(branches.select("branch_id").distinct(), "branch_id", "left_semi")


def verify(master: DataFrame, columns: list[str], values: list[str]) -> DataFrame:
    """value and the number of records that hold it, for each value: one pass over the table."""
    counts = master.agg(*(F.count_if(contains_any(columns, [v])).alias(f"v{i}") for i, v in enumerate(values)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(f"v{i}").alias("n")) for i, v in enumerate(values)))).alias("x")).select("x.*")


def suggest(master: DataFrame, columns: list[str], needle: str, limit: int = 20) -> DataFrame:
    """Names in columns that contain needle, with the number of records that hold them; most frequent first."""
    cells = master.select("id", F.explode(F.flatten(F.array(*(pieces(F.col(c)) for c in columns)))).alias("value")).filter(F.contains(F.lower("value"), F.lit(needle.lower())))
    grouped = cells.groupBy(F.lower("value").alias("key")).agg(F.min("value").alias("value"), F.count_distinct("id").alias("n"))
    return grouped.orderBy(F.col("n").desc(), "key").limit(limit).select("value", "n")
