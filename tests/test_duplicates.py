"""Classes of rows in conflict: flags, members, partners, and a crowded class whose size isn't squared."""

from __future__ import annotations

from pyspark.sql import functions as F

from solfa.operators import duplicates
from solfa.operators.cleaning import ISSUE

FIELDS = ["ISRC", "UPC", "Album Name", "Track Name"]


def dataset(spark, rows):
    """rows: (ISRC, UPC, album, track, has an error)."""
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_index long, a string, b string, c string, d string, bad boolean")
    error = F.struct(F.lit("Track Name").alias("column"), F.lit("error").alias("action"), F.lit("junk").alias("tag"), F.lit("").alias("message"), F.lit("").alias("value"), F.lit("").alias("original"), F.lit(False).alias("cosmetic"), F.lit(None).cast("array<bigint>").alias("related_rows")).cast(ISSUE)
    values = F.create_map(*(x for f, c in zip(FIELDS, "abcd") for x in (F.lit(f), F.col(c))))
    return table.select("row_index", values.alias("values"), F.when(F.col("bad"), F.array(error)).otherwise(F.array().cast(f"array<{ISSUE}>")).alias("issues"))


def test_classes_members_and_partners(spark):
    rows = [
        ("I1", "1", "A", "x", False), ("I1", "1", "A", " X ", False), ("I1", "1", "A", "y", False), ("I1", "1", "A", "z", True),
        ("I2", "2", "B", "p", False), ("I2", "3", "B", "p", False), ("I3", "4", "C", None, False), (None, "4", "D", "", False), ("", "", "", "", False),
    ]
    flags, members = duplicates.found(dataset(spark, rows), FIELDS)
    found = {(r["row_index"], r["column"], r["tag"]): (r["class_id"], r["n_rows"], r["message"]) for r in flags.collect()}
    confirm = "Compare and confirm it isn't a duplicate."
    assert found == {
        (1, "ISRC", "duplicate"): (0, 2, "Exact duplicate of row 1."),
        (0, "ISRC", "possible_duplicate"): (0, 3, f"Same ISRC as row 4 and 1 more but Track Name differs. {confirm}"),
        (2, "ISRC", "possible_duplicate"): (0, 3, f"Same ISRC as row 1 and 1 more but Track Name differs. {confirm}"),
        (4, "ISRC", "possible_duplicate"): (4, 2, f"Same ISRC as row 6 but UPC differs. {confirm}"),
        (5, "ISRC", "possible_duplicate"): (4, 2, f"Same ISRC as row 5 but UPC differs. {confirm}"),
        (4, "UPC", "upc_album_mismatch"): (4, 2, "Row 6 shares Album Name but the UPC differs (got “2”). Please reconcile."),
        (5, "UPC", "upc_album_mismatch"): (4, 2, "Row 5 shares Album Name but the UPC differs (got “3”). Please reconcile."),
        (6, "Album Name", "upc_album_mismatch"): (6, 2, "Row 8 shares UPC but the Album Name differs (got “C”). Please reconcile."),
        (7, "Album Name", "upc_album_mismatch"): (6, 2, "Row 7 shares UPC but the Album Name differs (got “D”). Please reconcile."),
    }
    shown = duplicates.partners(flags.filter("row_index in (0, 1, 5)"), members).collect()
    assert {(r["row_index"], r["column"], r["partner"]) for r in shown} == {(0, "ISRC", 3), (0, "ISRC", 4), (5, "ISRC", 5), (5, "UPC", 5)}
    sums = {(r["column"], r["class_id"], r["tag"]): (r["n_rows"], r["n_flags"]) for r in duplicates.classes(flags).collect()}
    assert sums["ISRC", 0, "possible_duplicate"] == (3, 2) and sums["ISRC", 0, "duplicate"] == (2, 1) and len(sums) == 5


def test_a_crowded_class_grows_with_its_rows(spark):
    rows = spark.range(20_000).select(F.col("id").alias("row_index"), F.create_map(F.lit("ISRC"), F.lit("HOT"), F.lit("Track Name"), F.col("id").cast("string")).alias("values"), F.array().cast(f"array<{ISSUE}>").alias("issues"))
    flags, members = duplicates.found(rows, ["ISRC", "Track Name"])
    assert flags.count() == members.count() == 20_000
    assert flags.agg(F.max(F.length("message"))).first()[0] < 120
    assert duplicates.partners(flags.filter("row_index = 7"), members).count() == 19_999


def test_no_rules_and_no_rows(spark):
    none = dataset(spark, [("I", "1", "A", "x", False)]).limit(0)
    for fields in (FIELDS, ["Track Name"], ["ISRC"], ["UPC", "Album Name"]):
        flags, members = duplicates.found(none, fields)
        assert flags.collect() == [] and members.collect() == [] and duplicates.mark_duplicates(none, fields).collect() == []


def test_every_flag_lists_all_rows_of_its_class(spark):
    rows = [("I1", "1", "A", "x", False), ("I1", "1", "A", "x", False), ("I1", "1", "A", "y", True), ("I1", "1", "A", "z", False), ("I2", "2", "B", "p", False), ("I3", "2", "C", "q", False)]
    found = duplicates.related(*duplicates.found(dataset(spark, rows), FIELDS)).collect()
    # row 3 has an error of its own, so it carries no flag, but belongs to the class
    assert {(r["row_index"], r["column"], r["tag"], r["related"]) for r in found} == {
        (0, "ISRC", "possible_duplicate", "3,4"), (1, "ISRC", "duplicate", ""), (3, "ISRC", "possible_duplicate", "1,3"),
        (4, "Album Name", "upc_album_mismatch", "6"), (5, "Album Name", "upc_album_mismatch", "5"),
    }
