"""Sheets of any layout in the canonical columns, by hand-worked cases."""

import pytest

from solfa.operators import standardize
from solfa.sources import sheets


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [
        (0, "Song One", "Singer: Asha Rao | composer: Ravi Das; mixed by: Someone", "352.11", None),
        (1, "\u2060Song Two", "singer: Asha Rao | singer: ASHA RAO | Lyricist : Nila Sen", "3:05", "77"),
        (2, None, "singer: Mina Roy | composer: Mina Roy", "0.5", ""),
        (3, "Song Four", None, "", "  "),
    ]
    return spark.createDataFrame(rows, "row_index long, `Song Title` string, `Audio Credits` string, Duration string, `Sr No` string")


def test_roles_become_sources(sheet):
    out, filled = standardize.standardized(sheet)
    assert filled == {"Record #": ["Sr No"], "Track Name": ["Song Title"], "Singer": ["singer"], "Audio Duration (mm:sec)": ["Duration"], "Lyricist": ["lyricist"], "Composer": ["composer"]}
    assert out.columns[0] == "row_index" and len(out.columns) == 31
    rows = {r["row_index"]: r.asDict() for r in out.collect()}
    assert [rows[i]["Track Name"] for i in range(4)] == ["Song One", "Song Two", "", "Song Four"]
    assert [rows[i]["Audio Duration (mm:sec)"] for i in range(2)] == ["00:05:52", "00:03:05"]
    assert [rows[i]["Record #"] for i in range(4)] == ["1", "77", "3", "4"]
    assert [rows[i]["Singer"] for i in range(4)] == ["Asha Rao", "Asha Rao", "Mina Roy", ""]
    assert [rows[i]["Lead Artist"] for i in range(4)] == ["Asha Rao | Ravi Das", "Asha Rao | Nila Sen", "Mina Roy", ""]
    assert rows[3]["Genre"] == "" and None not in rows[2].values()


def test_packed_share_of_first_cells(spark):
    # 90 of the first 150 cells that aren't blank are packed; what comes after them has no say
    cells = ["", *("a: x | b: y" for _ in range(90)), *("plain" for _ in range(60)), *("plain" for _ in range(300))]
    rows = spark.createDataFrame([(i, c, "a: only one") for i, c in enumerate(cells)], "row_index long, credits string, other string").repartition(5)
    assert {r["col"]: (r["seen"], r["hits"]) for r in standardize.packed_columns(rows).collect()} == {"credits": (150, 90), "other": (150, 0)}
    assert standardize.packed_names(rows) == ["credits"]


def test_roles_that_are_headers_are_left_out(spark):
    rows = spark.createDataFrame([(0, "Old Name", "singer: New Name | composer: Ravi Das")], "row_index long, Singer string, credits string")
    out, filled = standardize.standardized(rows)
    assert filled == {"Singer": ["Singer"], "Composer": ["composer"]}
    assert out.select("Singer", "Composer").first() == ("Old Name", "Ravi Das")


def test_nothing_matches(spark):
    out, filled = standardize.standardized(spark.createDataFrame([(0, "?")], "row_index long, zzqx string"))
    row = out.first().asDict()
    assert filled == {} and row.pop("Record #") == "1" and row.pop("row_index") == 0 and set(row.values()) == {""}


def test_empty_sheet(spark):
    out, _ = standardize.standardized(spark.createDataFrame([], "row_index long, isrc string, credits string"))
    assert out.count() == 0


def test_from_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Song Title,Credits\nOne,singer: Asha Rao | composer: Ravi Das\n\nTwo,singer: Mina Roy | lyricist: Nila Sen\n")
    out, _ = standardize.standardized(sheets.scan_csv(spark, str(tmp_path / "s.csv")))
    assert [tuple(r) for r in out.orderBy("row_index").select("Record #", "Track Name", "Lead Artist").collect()] == [("1", "One", "Asha Rao | Ravi Das"), ("2", "Two", "Mina Roy | Nila Sen")]
