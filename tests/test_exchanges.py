"""Workbooks, matching of headers, commits with decisions, and the activity stream on small fixtures."""

import datetime
import random
import io
import zipfile

import pytest

from solfa.operators import custom, exchange, matching
from solfa.functions.schema import ATTRIBUTES, COLUMNS, PRESETS
from solfa.sources.versions import StaleVersion, VersionedMaster
from solfa.sources import workbooks
from solfa.sources.sheets import SheetError
from solfa.streaming import activity

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(sheet: str, shared: str = "", styles: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in workbooks._PARTS.items():
            z.writestr(name, text)
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_NS}>{sheet}</worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>{shared}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {_NS}>{styles}</styleSheet>")
    return out.getvalue()


def text(v):
    return f'<c t="inlineStr"><is><t>{v}</t></is></c>'


def scan(spark, content, strict=True):
    return workbooks.sheet_rows(spark.createDataFrame([("a.xlsx", content)], "path string, content binary"), strict)


def test_golden_workbook(spark, tmp_path):
    """Blank rows above and between, shared and rich texts, numbers, dates, times, flags, gaps and ragged rows."""
    sheet = """<sheetData><row r="1"/><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t> </t></is></c></row>
      <row r="3"><c r="A3"><v>890000000001</v></c><c r="C3" s="1"><v>43899</v></c><c r="D3"><v>7</v></c></row><row r="4"><c r="A4"/></row>
      <row r="5"><c r="A5"><v>2.5</v></c><c r="B5" s="1"><v>0.5</v></c><c r="C5" t="b"><v>1</v></c></row><row r="6"><c r="B6" s="2"><v>43899.25</v></c><c r="C6" t="str"><v>x &amp; y</v></c></row></sheetData>"""
    shared = "<si><t>UPC</t></si><si><r><t>Da</t></r><r><t>te</t></r></si>"
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs>'
    (tmp_path / "a.xlsx").write_bytes(book(sheet, shared, styles))
    rows = workbooks.load_table(spark, str(tmp_path / "a.xlsx"))
    assert rows.columns == ["file", "row_index", "UPC", "Date", "column_3"]
    found = [tuple(r)[1:] for r in rows.orderBy("row_index").collect()]
    assert found == [(0, "890000000001", "", "2020-03-09 00:00:00"), (1, "2.5", "12:00:00", "True"), (2, "", "2020-03-09 06:00:00", "x & y")]
    warned = workbooks.header_warnings(workbooks.sheet_rows(workbooks.workbook_files(spark, str(tmp_path / "a.xlsx"))))
    assert [r["message"] for r in warned.collect()] == ["Duplicate headers found: Date."]


@pytest.mark.parametrize(
    "content, code",
    [
        (b"no zip", "corrupted"),
        (None, "corrupted"),
        (book("<sheetData/>"), "no_data"),
        (book(f"<sheetData><row>{text('a')}</row></sheetData>"), "no_data"),
        (book(f'<sheetData><row r="1">{text("a")}</row><row r="2">{text("b")}</row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells>'), "merged_header"),
        (book(f"<sheetData><row>{text('a')}{text('')}{text('b')}</row><row>{text('c')}</row></sheetData>"), "empty_header"),
        (book(f"<sheetData><row>{''.join(text(f'h{i}') for i in range(1001))}</row></sheetData>"), "too_large"),
    ],
)
def test_refused_workbooks(spark, content, code):
    rows = scan(spark, content)
    assert [r["code"] for r in rows.filter("code IS NOT NULL").collect()] == [code]
    with pytest.raises(SheetError):
        workbooks.as_table(rows)


def test_zip_bomb(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", " " * 4_000_000)
    assert scan(spark, out.getvalue()).first()["code"] == "too_large"


def test_lenient_scan_and_endings(spark):
    gap = book(f"<sheetData><row>{text('a')}{text('')}{text('b')}</row><row>{text('c')}</row></sheetData>")
    rows = workbooks.as_table(scan(spark, gap, strict=False))
    assert rows.columns == ["file", "row_index", "a", "column_2", "b"] and [tuple(r)[2:] for r in rows.collect()] == [("c", "", "")]
    with pytest.raises(SheetError):
        workbooks.load_table(spark, "a.pdf")


def test_workbook_round_trip(spark):
    values = ["007", "12", "-3", "1.50", "", None, " a\r\n<b>&", "99999999999999999999", "é"]
    rows = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "i int, v string, w string").selectExpr("*", "'f' AS f")
    back = workbooks.as_table(workbooks.sheet_rows(workbooks.as_workbooks(rows, "f", "i", ["v", "w"])))
    assert [r["v"] for r in back.orderBy("row_index").collect()] == [v or "" for v in values]


def suggested(spark, names, hits=None):
    heads = spark.createDataFrame([("f", i, h) for i, h in enumerate(names)], "file string, place int, header string")
    known = matching.targets(spark)
    found = matching.assign(matching.with_content(matching.header_scores(heads, known), hits))
    return heads, known, found


def test_header_scores(spark):
    _, known, found = suggested(spark, ["isrc", "Song  Title", "Genre of the music", "Singer 1", "Singer 2", "Zzzz", "", None])
    rows = {r["header"]: r for r in found.collect()}
    assert (rows["isrc"]["target"], rows["isrc"]["confidence"], rows["isrc"]["method"]) == ("ISRC", 1.0, "exact")
    assert (rows["Song  Title"]["target"], rows["Song  Title"]["confidence"], rows["Song  Title"]["method"]) == ("Track Name", 0.96, "synonym")
    assert (rows["Genre of the music"]["target"], rows["Genre of the music"]["confidence"], rows["Genre of the music"]["method"]) == ("Genre", 0.92, "fuzzy")
    assert [(rows[h]["target"], rows[h]["nth"]) for h in ("Singer 1", "Singer 2")] == [("Singer", 0), ("Singer", 1)]
    assert set(rows) == {"isrc", "Song  Title", "Genre of the music", "Singer 1", "Singer 2"}
    table = matching.suggestion(found, known)
    assert matching.lineage(table).filter("target = 'Singer'").first()["sources"] == ["Singer 1", "Singer 2"]
    assert matching.lineage(table).filter("NOT matched AND size(sources) = 0").count() == len(COLUMNS) - 4
    assert table.count() == len(COLUMNS) and table.filter("target = 'Singer'").first()["extras"] == ["Singer 2"]


def test_content_outweighs_weak_headers(spark):
    hits = spark.createDataFrame([("f", 0, "isrc", 1.0), ("f", 1, "upc", 0.5)], "file string, place int, type string, fraction double")
    heads, known, found = suggested(spark, ["qqq", "www"], hits)
    assert [(r["target"], r["confidence"], r["method"]) for r in found.collect()] == [("ISRC", 0.98, "content")]
    assert [r["header"] for r in matching.unused(heads, found).collect()] == ["www"]
    counts = matching.summary(matching.suggestion(found, known), heads).first()
    assert (counts["headers"], counts["matched"], counts["review"], counts["unmatched"]) == (2, 1, 0, len(COLUMNS) - 1)


def test_tighten(spark):
    rows = [("f", "Singer", 10, "a", 0, 0.6, 0.6, "fuzzy", 0), ("f", "Singer", 10, "b", 1, 0.9, 0.9, "fuzzy", 1), ("f", "ISRC", 3, "c", 2, 0.98, 0.1, "content", 0), ("f", "ISRC", 3, "d", 3, 0.98, 0.2, "content", 1)]
    found = spark.createDataFrame(rows, "file string, target string, position int, header string, place int, confidence double, header_score double, method string, nth int")
    assert [r["header"] for r in matching.tighten(found).collect()] == ["c"]


def test_no_headers(spark):
    heads, known, found = suggested(spark, [])
    assert found.count() == matching.suggestion(found, known).count() == matching.unused(heads, found).count() == 0


def test_mapping_update():
    assert exchange.checked_mapping({"ISRC": ["", "a", "b", "a"], "UPC": []}, ["a", "b"]) == {"ISRC": ["a", "b"], "UPC": []}
    with pytest.raises(ValueError):
        exchange.checked_mapping({"ISRC": ["z"]}, ["a"])


def test_presets():
    assert len(PRESETS["PDL"]) == 27 and PRESETS["SVF"] == COLUMNS and exchange.leftovers("SVF") == []
    assert exchange.leftovers("PDL") == ["JPG folder (path)", "LRC File (path)", "Lyrical Video (path)"]


def stock(spark, rows):
    """rows: (key, value, fingerprint, label)."""
    key = "id" if rows and rows[0][1] is None else "row_index"
    fields = ", ".join(f"{a} string" for a in ATTRIBUTES.values())
    data = [(k, *(label if a == "label" else f"t{k}" if a == "track_name" else "" for a in ATTRIBUTES.values()), fp) for k, _, fp, label in rows]
    return spark.createDataFrame(data, f"{key} long, {fields}, fingerprint string")


def test_decisions(spark):
    master = stock(spark, [(1, None, "A", "x"), (2, None, "B", "x")])
    new = stock(spark, [(0, 0, "A", "y"), (1, 0, "C", "x"), (2, 0, "C", "x"), (3, 0, "D", "x"), (4, 0, "B", "x"), (5, 0, "E", "x"), (6, 0, "E", "z"), (7, 0, "F", "x")])
    decisions = spark.createDataFrame([(0, "master", 1), (1, "cleaned", 1), (2, "cleaned", 2), (3, "cleaned", 99), (4, "cleaned", 2), (5, "both", None)], "row_index long, decision string, master_id long")
    found = exchange.decided(new, master, decisions)
    assert {r["row_index"]: r["outcome"] for r in found.collect()} == {0: "skipped", 1: "updated", 2: "duplicate", 3: "inserted", 4: "updated", 5: "inserted", 6: "updated", 7: "inserted"}
    after = {r["fingerprint"]: (r["id"], r["track_name"], r["label"]) for r in exchange.snapshot(found, master).collect()}
    assert after == {"C": (1, "t1", "x"), "B": (2, "t4", "x"), "D": (None, "t3", "x"), "E": (None, "t6", "z"), "F": (None, "t7", "x")}


def one_by_one(new, master, decisions):
    """The rule row by row: records are shared objects, found by identities that change as rows overwrite them."""
    stored = {k: {"id": k, "label": label, "fp": fp, "row": f"t{k}"} for k, _, fp, label in master}
    by, pending, out = {r["fp"]: r for r in stored.values()}, {}, {}
    for i, _, fp, label in new:
        choice, target = decisions.get(i, (None, None))
        clash = by.get(fp) or pending.get(fp)
        if choice == "master":
            out[i] = "skipped"
            continue
        if choice == "cleaned":
            record = stored.get(target)
            if record is not None and (clash is None or clash is record):
                record.update(label=label, fp=fp, row=f"t{i}")
                by[fp] = record
                out[i] = "updated"
                continue
            if clash is not None:
                out[i] = "duplicate"
                continue
        if clash is None:
            pending[fp] = {"id": None, "label": label, "fp": fp, "row": f"t{i}"}
            out[i] = "inserted"
        elif clash["label"] != label:
            clash.update(label=label, row=f"t{i}")
            out[i] = "updated"
        else:
            out[i] = "duplicate"
    every = [*stored.values(), *pending.values()]
    return out, sorted((r["id"] or 0, r["fp"], r["label"], r["row"]) for r in every)


@pytest.mark.parametrize("seed", range(6))
def test_decisions_row_by_row(spark, seed):
    rng = random.Random(seed)
    master = [(k, None, f"F{k}", rng.choice("xy")) for k in range(1, 6)]
    new = [(i, 0, f"F{rng.randint(1, 12)}", rng.choice("xyz")) for i in range(40)]
    decisions = {i: (rng.choice(["master", "cleaned", "cleaned", "both"]), rng.choice([1, 2, 3, 9])) for i in rng.sample(range(40), 18)}
    table = spark.createDataFrame([(i, *d) for i, d in decisions.items()], "row_index long, decision string, master_id long")
    found = exchange.decided(stock(spark, new), stock(spark, master), table)
    rows, records = one_by_one(new, master, decisions)
    assert {r["row_index"]: r["outcome"] for r in found.collect()} == rows
    after = exchange.snapshot(found, stock(spark, master)).collect()
    assert sorted((r["id"] or 0, r["fingerprint"], r["label"], r["track_name"]) for r in after) == records
    plain, records = one_by_one(new, master, {})
    from solfa.operators import master as own

    after = own.upsert(stock(spark, new), stock(spark, master)).collect()
    assert sorted((r["id"] or 0, r["fingerprint"], r["label"], r["track_name"]) for r in after) == records


def test_versions(spark, tmp_path):
    fields = ", ".join(f"{a} string" for a in ATTRIBUTES.values())
    from pyspark.sql import functions as F

    source = lambda rows, branch: stock(spark, rows).withColumns({"branch_id": F.lit(branch).cast("long"), "file_id": F.lit(branch * 10).cast("long")})
    table = VersionedMaster(spark, str(tmp_path / "master"), f"id long, branch_id long, file_id long, {fields}, fingerprint string", buckets=4)
    assert table.versions() == [] and table.read().count() == 0
    first = [(i, 0, f"F{i % 7}", "x" if i < 7 else "y") for i in range(10)]
    assert table.commit(source(first, 1), 0) == 1
    seen = lambda v=None: sorted((r["id"], r["fingerprint"], r["label"], r["track_name"], r["branch_id"], r["file_id"]) for r in table.read(v).collect())
    one = [(k + 1, f"F{k}", "y" if k < 3 else "x", f"t{k + 7 if k < 3 else k}", 1, 10) for k in range(7)]
    assert seen() == one
    assert table.commit(source([(0, 0, "F6", "z"), (1, 0, "NEW", "x"), (2, 0, "F1", "y")], 2), 1) == 2
    two = sorted([*(r for r in one if r[1] != "F6"), (7, "F6", "z", "t0", 2, 20), (8, "NEW", "x", "t1", 2, 20)])
    assert seen() == two and seen(1) == one
    parts = [table.manifest(v)["parts"] for v in (1, 2)]
    assert any(parts[0][b] == parts[1][b] for b in parts[0])  # untouched buckets are listed as they were
    with pytest.raises(StaleVersion):
        table.commit(source(first, 3), 1)
    with pytest.raises(StaleVersion):
        table._publish(2, {})
    assert table.commit(source([], 4), 2) == 3 and seen() == two


def test_stream_over_several_runs(spark, tmp_path):
    """Runs of repeats that reach over two files; what is open stays in state; a run that follows without news adds nothing."""
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    write = lambda rows: spark.createDataFrame(rows, "u int, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        activity.append(activity.collapse(activity.log_files(spark, str(tmp_path / "in")), ["u"]), str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted((r["u"], r["first"], r["last"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    write([(1, at(0)), (1, at(20)), (2, at(5)), (3, None)])
    assert run() == []
    write([(1, at(45)), (1, at(200)), (2, at(36))])
    expected = [(1, at(0), at(45), 3), (2, at(5), at(5), 1), (2, at(36), at(36), 1)]
    assert run() == expected and run() == expected


def test_custom_columns(spark):
    registry = custom.promoted({"Mood": "x_mood"}, ["MOOD", "Mood?", "Label", "***", "y" * 80])
    assert registry == {"Mood": "x_mood", "Mood?": "x_mood_1", "***": "x", "y" * 80: "x_" + "y" * 61}
    assert custom.attribute("y" * 80, {"x_" + "y" * 61}) == "x_" + "y" * 59 + "_1"
    with pytest.raises(ValueError):
        custom.promoted({}, [" "])
    master = spark.createDataFrame([("A", " "), ("B", "old"), ("C", None)], "fingerprint string, x_mood string")
    new = spark.createDataFrame([("A", 0, None), ("A", 1, " "), ("A", 2, "m"), ("A", 3, "n"), ("B", 4, "p")], "fingerprint string, row_index long, x_mood string")
    out = custom.filled(master, new, {"Mood": "x_mood"})
    assert sorted(tuple(r) for r in out.collect()) == [("A", "m"), ("B", "old"), ("C", "")]
