"""CSV sheets: byte-order marks, blank and ragged rows, quotes, repeated headers."""

import pytest

from solfa.sources.sheets import SheetError, header_of, repeated_headers, scan_csv


def test_golden_sheet(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿\n ,\nTitle,Title,,Note,\n"a ""b"", c",x,1\n,,\n"two\nlines",y,2,z,w,v\n'.encode())
    rows = scan_csv(spark, str(tmp_path / "a.csv")).orderBy("row_index")
    assert rows.columns == ["file", "row_index", "Title", "column_2", "column_3", "Note"]
    assert [tuple(r)[1:] for r in rows.collect()] == [(0, 'a "b", c', "x", "1", ""), (1, "two\nlines", "y", "2", "z")]
    assert repeated_headers(header_of(spark, str(tmp_path / "a.csv"))) == ["Title"]


def test_folder_and_empty(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(f"k\n{name}1\n\n{name}2\n")
    assert sorted((r["row_index"], r["k"]) for r in scan_csv(spark, str(tmp_path)).collect()) == [(0, "a1"), (0, "b1"), (1, "a2"), (1, "b2")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.csv").write_text(" , \n")
    with pytest.raises(SheetError):
        header_of(spark, str(tmp_path / "none"))


def test_unlike_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,isrc\na,1\n")
    (tmp_path / "b.csv").write_text("isrc,title\n2,b\n")
    with pytest.raises(SheetError):
        scan_csv(spark, str(tmp_path))


def test_blank_is_any_white_space_however_long(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\t,\u00a0\n" * 400 + " k\t,l,,\n\t,\n1,2\n\u3000,x\n")
    rows = scan_csv(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["file", "row_index", "k", "l"]
    assert [(r["k"], r["l"]) for r in rows.orderBy("row_index").collect()] == [("1", "2"), ("\u3000", "x")]


def test_too_many_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(f"c{i}" for i in range(1001)) + "\n1\n")
    with pytest.raises(SheetError):
        header_of(spark, str(tmp_path / "a.csv"))
