"""What goes out and what is decided on the way in: previews, review notes, exports, and commits with decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import ATTRIBUTES, COLUMNS, OWNERSHIP, PRESETS
from .master import _owners, search, upsert

PREVIEW = 50


def preview(raw: DataFrame, mapping: dict[str, list[str]], n: int = PREVIEW) -> DataFrame:
    """The first n rows (1 to PREVIEW) by mapping, before cleaning: different source cells that aren't blank, joined.
    Sources that raw lacks count as blank."""
    held = {c: [F.coalesce(F.col(f"`{s}`"), F.lit("")) for s in sources if s in raw.columns] for c, sources in mapping.items()}
    cell = lambda texts: F.array_join(F.array_distinct(F.filter(F.array(*texts, F.lit("")), lambda x: F.trim(x) != "")), " | ")
    first = raw.orderBy("row_index").limit(max(1, min(n, PREVIEW)))
    return first.select("row_index", *(cell(texts).alias(c) for c, texts in held.items()))


def checked_mapping(mapping: dict[str, list[str]], headers: list[str]) -> dict[str, list[str]]:
    """mapping with each source once and blank ones left out, so that the first further source takes the place of a missing
    main one. Raises ValueError for sources that aren't headers."""
    if unknown := sorted({s for sources in mapping.values() for s in sources if s and s not in headers}):
        raise ValueError(f"No such headers: {', '.join(unknown)}")
    return {c: list(dict.fromkeys(s for s in sources if s)) for c, sources in mapping.items()}


def review_notes(cleaned: DataFrame, corrections: DataFrame | None = None, kept: DataFrame | None = None) -> DataFrame:
    """cleaned with edited and errored (maps of column to note) and notes, one line for each row.

    corrections (row_index, col): cells a reviewer set, told of even where cleaning gives the same. kept (row_index): rows
    kept as they are, told of if there is nothing else. The last note of a cell is the one its map has."""
    rows = cleaned
    if corrections is not None:
        cells = corrections.groupBy("row_index").agg(F.array_sort(F.collect_set("col")).alias("_set"))
        rows = rows.join(cells, "row_index", "left")
    else:
        rows = rows.withColumn("_set", F.lit(None).cast("array<string>"))
    if kept is not None:
        rows = rows.join(kept.select("row_index").distinct().withColumn("_kept", F.lit(True)), "row_index", "left")
    else:
        rows = rows.withColumn("_kept", F.lit(False))
    some = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)
    message = lambda x: some(x["message"], some(x["tag"], F.lit("error")))
    change = lambda x: F.concat(F.lit("'"), F.coalesce(x["original"], F.lit("")), F.lit("' -> '"), F.coalesce(x["value"], F.lit("")), F.lit("'"))
    own = F.filter("issues", lambda x: F.coalesce(x["column"], F.lit("")) != "")
    hand = F.filter(own, lambda x: (x["action"] != "error") & x["tag"].isin("corrected", "merged"))
    wrong = F.filter(own, lambda x: x["action"] == "error")
    as_map = lambda cells, note: F.map_from_entries(F.transform(F.filter(cells, lambda x, i: ~F.exists(F.slice(cells, i + 2, F.size(cells)), lambda y: y["column"] == x["column"])), lambda x: F.struct(x["column"], note(x))))
    rows = rows.withColumn("_hand", hand).withColumn("_wrong", wrong)
    rows = rows.withColumn("errored", as_map(F.col("_wrong"), message)).withColumn("_edited", as_map(F.col("_hand"), change))
    told = F.concat(F.map_keys("errored"), F.map_keys("_edited"))
    rows = rows.withColumn("_set", F.array_except(F.coalesce("_set", F.array().cast("array<string>")), told))
    set_to = lambda c: F.concat(F.lit("set to '"), F.coalesce(F.col("values")[c], F.lit("")), F.lit("' by a reviewer"))
    edited = F.map_concat("_edited", F.map_from_entries(F.transform("_set", lambda c: F.struct(c, set_to(c)))))
    line = lambda x: F.when(x["action"] == "error", F.concat(x["column"], F.lit(": "), message(x), F.lit(" (unresolved)"))).otherwise(
        F.concat(x["column"], F.lit(": "), change(x), F.when(x["tag"] == "merged", " (merged value)").otherwise(" (manually corrected)"))
    )
    shown = F.filter(own, lambda x: (x["action"] == "error") | x["tag"].isin("corrected", "merged"))
    lines = F.concat(F.transform(shown, line), F.transform("_set", lambda c: F.concat(c, F.lit(": "), set_to(c), F.lit(" (same as the cleaned value, so nothing changed)"))))
    as_is = F.when(F.coalesce("_kept", F.lit(False)) & (F.size(lines) == 0), "Kept as-is by a reviewer (values unchanged)")
    return rows.select(*cleaned.columns, edited.alias("edited"), "errored", F.coalesce(as_is, F.array_join(lines, "; ")).alias("notes"))


def review_export(noted: DataFrame, columns: list[str]) -> DataFrame:
    """Row (from 1), columns, Issues of rows with notes; the columns as the sheet names them."""
    value = lambda c: F.coalesce(F.col("values")[c], F.lit("")).alias(c)
    return noted.select((F.col("row_index") + 1).alias("Row"), *map(value, columns), F.col("notes").alias("Issues"))


def leftovers(preset: str) -> list[str]:
    """Columns that may be added to a preset."""
    return [c for c in COLUMNS if c not in PRESETS[preset]]


def master_export(master: DataFrame, columns: list[str], filters: dict[tuple[str, ...], list[str]] | None = None, branches: DataFrame | None = None) -> DataFrame:
    """id and columns, by their canonical names, of the records that match. Raises ValueError for unknown columns.
    Parquet or CSV written from it in ranges of id keeps their order without one task for all."""
    if unknown := [c for c in columns if c not in ATTRIBUTES]:
        raise ValueError(f"Unknown columns: {', '.join(unknown)}")
    rows = search(master, filters or {}, branches)
    return rows.select("id", *(F.coalesce(F.col(ATTRIBUTES[c]), F.lit("")).alias(c) for c in columns))


def without_branches(table: DataFrame, branches: DataFrame) -> DataFrame:
    """table without what belongs to deleted branches; rows without a branch stay."""
    return table.join(branches.select("branch_id").distinct(), "branch_id", "left_anti")


def decided(new: DataFrame, master: DataFrame, decisions: DataFrame) -> DataFrame:
    """new with master_id, record (the id of the stored record it stands for, null for a new one), overwrites and outcome of a
    commit, in row order, with a reviewer's decisions (row_index, decision, master_id).

    master: the stored record stays, the row is skipped. cleaned: the row overwrites the stored record, unless another record
    or an earlier row has its identity, which makes it a duplicate; without such a record it is stored like any other.
    both, anything else and no decision: inserted, updated or duplicate as in upsert_outcomes. An identity stands for the stored record that has it,
    or else for what its first row stands for; an overwritten record still answers to its old identity in this commit, and
    later rows are compared with what it has become. Of several decisions on a row the least (by name, then id) holds."""
    one = decisions.groupBy("row_index").agg(F.min(F.struct("decision", "master_id")).alias("d")).select("row_index", "d.*")
    held = master.select(F.col("id").alias("master_id"), F.lit(True).alias("_held"))
    rows = new.join(one, "row_index", "left").join(held, "master_id", "left").withColumn("_owners", _owners())
    cleaned = F.coalesce(F.col("decision") == "cleaned", F.lit(False))
    rows = rows.withColumn("_over", cleaned & F.coalesce("_held", F.lit(False))).withColumn("_skip", F.coalesce(F.col("decision") == "master", F.lit(False)))
    old = master.groupBy("fingerprint").agg(F.max("id").alias("_stored"))
    first = rows.filter(~F.col("_skip")).groupBy("fingerprint").agg(F.min(F.struct("row_index", "_over", "master_id")).alias("_first"))
    names = first.join(old, "fingerprint", "left").withColumn("record", F.coalesce("_stored", F.when(F.col("_first._over"), F.col("_first.master_id"))))
    met = rows.join(names, "fingerprint", "left")
    takes = F.coalesce(F.col("_over") & (F.col("record") == F.col("master_id")), F.lit(False))
    clash = F.col("_stored").isNotNull() | (F.col("_first.row_index") < F.col("row_index"))
    met = met.withColumn("_takes", takes & ~F.col("_skip")).withColumn("_lost", cleaned & ~takes & F.coalesce(clash, F.lit(False)))
    chain = met.withColumn("_effect", ~F.col("_skip") & ~F.col("_lost"))
    touched = met.select(F.col("record").alias("id")).distinct()
    start = master.join(touched, "id", "left_semi").select(F.col("id").alias("record"), F.lit(-1).cast("long").alias("row_index"), _owners().alias("_owners"), F.lit(True).alias("_effect"))
    chain = chain.unionByName(start, allowMissingColumns=True).withColumn("_object", F.coalesce(F.col("record").cast("string"), "fingerprint"))
    before = Window.partitionBy("_object").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("_effect"), F.col("_owners")), ignorenulls=True).over(before)
    outcome = (
        F.when(F.col("_skip"), "skipped").when(F.col("_takes"), "updated").when(F.col("_lost"), "duplicate").when(F.col("_latest").isNull(), "inserted")
        .when(F.col("_latest") != F.col("_owners"), "updated").otherwise("duplicate")
    )
    out = chain.withColumn("_latest", latest).filter("row_index >= 0").withColumn("outcome", outcome)
    return out.select(*new.columns, "master_id", "record", F.col("_takes").alias("overwrites"), "outcome")


def snapshot(found: DataFrame, master: DataFrame) -> DataFrame:
    """The next snapshot of master after decided(). A record takes all attributes (and branch and file, where both have them) of
    its last row that changed it, and the identity of the last row that overwrote it. New records have no id yet."""
    shared = [c for c in master.columns if c in found.columns and c not in ("row_index", "id", "fingerprint")]
    events = found.filter("outcome IN ('inserted', 'updated')").withColumn("_object", F.coalesce(F.col("record").cast("string"), "fingerprint"))
    last = events.groupBy("_object").agg(
        F.max("record").alias("_id"), F.max_by(F.struct(*shared), "row_index").alias("_new"), F.min("fingerprint").alias("_own"),
        F.max_by("fingerprint", F.when(F.col("overwrites"), F.col("row_index"))).alias("_fp"),
    )
    both = master.join(last, F.col("id") == F.col("_id"), "full_outer")

    def pick(c: str) -> Column:
        if c in shared:
            return F.when(F.col("_object").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c))
        return F.coalesce("_fp", c, "_own") if c == "fingerprint" else F.col(c)

    return both.select(*(pick(c).alias(c) for c in master.columns))


def check_rows(rows: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """check, expected, found and ok of each check (a name and two aggregates over rows), in one pass."""
    sums = rows.agg(*(c.cast("long").alias(f"{k}{i}") for i, pair in enumerate(checks.values()) for k, c in zip("ef", pair)))
    each = F.array(*(F.struct(F.lit(name).alias("check"), F.coalesce(f"e{i}", F.lit(0)).alias("expected"), F.coalesce(f"f{i}", F.lit(0)).alias("found")) for i, name in enumerate(checks)))
    return sums.select(F.explode(each).alias("c")).select("c.*", (F.col("c.expected") == F.col("c.found")).alias("ok"))
