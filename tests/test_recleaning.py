"""Corrected rows cleaned again: cases worked by hand."""

from __future__ import annotations

import pytest

from solfa.operators import cleaning, overlay, recleaning
from pyspark.sql import functions as F

MAPPING = {"ISRC": ["isrc"], "UPC": ["upc"], "Track Name": ["track"], "Album Name": ["album"], "Singer": ["singer"], "Composer": ["composer"], "Lyricist": ["lyricist"], "Mood": ["mood"]}


def dataset(spark, rows):
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_index long, isrc string, upc string, track string, album string, singer string, composer string, lyricist string, mood string")
    return cleaning.clean_dataset(raw, MAPPING)


def corrected(spark, rows, edits):
    log = spark.createDataFrame([(*e, False, i) if len(e) == 3 else (*e, i) for i, e in enumerate(edits)], "row_index long, col string, value string, is_merge boolean, seq long")
    out = recleaning.recleaned(dataset(spark, rows), overlay.current(log)).collect()
    return {r["row_index"]: (r["values"], {(x["column"], x["action"], x["tag"]) for x in r["issues"]}) for r in out}


GOOD = ("INA011234567", "890123456789", "A Track", "An Album", "Asha Rao", "Ravi Sen", "", "calm")


def test_a_correction_mends_and_makes_errors(spark):
    rows = [(GOOD[0], "12", *GOOD[2:]), GOOD, GOOD]
    out = corrected(spark, rows, [(0, "UPC", "8901 2345 6789"), (1, "UPC", "none at all"), (1, "Track Name", ""), (7, "UPC", "1")])
    values, issues = out[0]
    assert values["UPC"] == "890123456789" and ("UPC", "fixed", "corrected") in issues
    assert not any(a == "error" for _, a, _ in issues)
    assert out[1][0]["Track Name"] == ""
    assert {("UPC", "error", "invalid_upc"), ("Track Name", "error", "missing_required")} <= out[1][1]
    assert out[2] == ({**dict(zip(MAPPING, GOOD)), "Lead Artist": "Asha Rao | Ravi Sen"}, {("Lead Artist", "fixed", "derived_lead_artist")})
    assert set(out) == {0, 1, 2}


@pytest.mark.parametrize(
    "edits, lead",
    [
        ([("Composer", "Ravi Senn")], "Asha Rao | Ravi Senn"),  # respelled in its place
        ([("Singer", "Asha Raa"), ("Composer", "Ravi Senn")], "Asha Raa | Ravi Senn"),
        ([("Singer", "asha rao")], "Asha Rao | Ravi Sen"),  # case alone is no new name
        ([("Singer", "")], "Ravi Sen"),  # collapsed: the name goes
        ([("Singer", "New One | Asha Rao")], "Asha Rao | Ravi Sen | New One"),  # added: at the end
        ([("Singer", "New One | Other Two")], "Ravi Sen | New One | Other Two"),  # numbers differ: no rename
        ([("Lead Artist", "Typed By Hand"), ("Composer", "Ravi Senn")], "Typed By Hand"),
    ],
)
def test_lead_artist_follows_the_credits(spark, edits, lead):
    values, _ = corrected(spark, [GOOD], [(0, *e) for e in edits])[0]
    assert values["Lead Artist"] == lead


def test_names_that_no_credit_had_stay(spark):
    before = {"Singer": F.lit("a | b"), "Composer": F.lit("C"), "Lyricist": F.lit(None).cast("string")}
    after = {"Singer": F.lit("A | x"), "Composer": F.lit("c | d"), "Lyricist": F.lit("")}
    got = spark.range(1).select(recleaning.reflowed(F.lit("own | b | a | C"), before, after).alias("lead")).first()["lead"]
    assert got == "own | x | a | C"


def test_marks(spark):
    out = corrected(spark, [GOOD], [(0, "Mood", "  wild "), (0, "Singer", "Asha Rai", True), (0, "Album Name", "An Album"), (0, "Genre", None)])
    values, issues = out[0]
    assert values["Mood"] == "wild" and values["Genre"] == ""
    assert {("Mood", "fixed", "corrected"), ("Singer", "fixed", "merged")} <= issues
    assert not any(c in ("Album Name", "Genre") for c, _, _ in issues)


def test_other_than_ascii_and_nulls(spark):
    out = corrected(spark, [(None,) * 8, GOOD], [(0, "Track Name", "Ｔｅｓｔ café"), (1, "Singer", "éva díaz")])
    assert out[0][0]["Track Name"] == "Test Café"
    assert out[1][0]["Singer"] == "Éva Díaz" and out[1][0]["Lead Artist"] == "Éva Díaz | Ravi Sen"


def test_whole_review(spark):
    rows = [GOOD, GOOD, (*GOOD[:2], "Other", *GOOD[3:]), ("bad", *GOOD[1:])]
    log = spark.createDataFrame([(1, "Track Name", "Other", False, 0)], "row_index long, col string, value string, is_merge boolean, seq long")
    number = lambda *x: spark.createDataFrame([(i,) for i in x], "row_index long")
    kept, deleted = recleaning.reviewed(dataset(spark, rows), overlay.current(log), number(0), number(3, 3), [*MAPPING, "Lead Artist"])
    tags = {r["row_index"]: {x["tag"] for x in r["issues"] if x["action"] == "error"} for r in kept.collect()}
    assert tags == {1: set(), 2: {"duplicate"}, 3: set()}  # row 0 is gone; 2 repeats the corrected row 1; 3 is accepted
    assert [r["row_index"] for r in deleted.collect()] == [0]


def test_nothing_to_correct(spark):
    assert corrected(spark, [GOOD], [(9, "UPC", "1")])[0][0]["UPC"] == GOOD[1]
    assert corrected(spark, [], [(0, "UPC", "1")]) == {}
