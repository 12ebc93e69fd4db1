"""Bags of JSON laid out as columns: differing types, odd keys, broken bags."""

import pytest

from solfa.operators import backfill

BAGS = [
    '{"Mood": "calm", "k": 1, "on": true, "x": 1.5}', '{"Mood": null, "k": "two", "on": false, "x": 2}', '{"mood": "late", "Mood": "own"}', '{"mood": "late"}',
    '{"it\'s": {"a": [1, "b"]}, "a.b": "dot", "": "blank", "ISRC": "canonical"}', "[1]", "7", "broken", "", None, "{}", '{"a": 1, "a": 2}',
]


def bags(spark, values):
    return spark.createDataFrame([(i, "kept", v) for i, v in enumerate(values)], "id long, x_mood string, extras string")


def test_values_replace_cells(spark):
    out, registry = backfill.backfilled(bags(spark, BAGS), "extras", {"Mood": "x_mood"})
    assert registry == {"Mood": "x_mood", "a.b": "x_a_b", "it's": "x_it_s", "k": "x_k", "on": "x_on", "x": "x_x"}
    assert "extras" not in out.columns and len(out.columns) == 7
    rows = {r["id"]: r for r in out.collect()}
    assert [rows[i]["x_mood"] for i in range(12)] == ["calm", "kept", "own", "late", *["kept"] * 8]
    assert [rows[i]["x_k"] for i in range(3)] == ["1", "two", ""] and [rows[i]["x_on"] for i in range(3)] == ["true", "false", ""]
    assert rows[4]["x_it_s"] == '{"a":[1,"b"]}' and rows[4]["x_a_b"] == "dot"


def test_layout_and_columns(spark):
    rows = bags(spark, BAGS)
    kinds = backfill.layout(rows, "extras")
    assert kinds == {"": "STRING", "ISRC": "STRING", "Mood": "STRING", "a.b": "STRING", "it's": "STRING", "k": "STRING", "mood": "STRING", "on": "BOOLEAN", "x": "DOUBLE"}
    got = {r["id"]: r["bag"] for r in backfill.columns(rows, "extras", kinds).collect()}
    assert got[0]["x"] == 1.5 and got[0]["k"] == "1" and got[1]["x"] == 2.0 and got[1]["on"] is False and got[9]["x"] is None
    assert got[2]["Mood"] == "own" and got[2]["mood_2"] == "late"
    assert backfill.field_names(["A", "a", "a_2", "b"]) == {"A": "A", "a": "a_3", "a_2": "a_2", "b": "b"}


def test_text_after_an_object_is_ignored(spark):
    assert backfill.layout(bags(spark, ['{"k": 1},', '{"k": 2']), "extras") == {"k": "BIGINT"}


def test_bounds(spark):
    many = bags(spark, [f'{{"k{i}": 1}}' for i in range(9)])
    assert len(backfill.keys(many, "extras", 9)) == 9
    with pytest.raises(backfill.TooManyKeys):
        backfill.keys(many, "extras", 8)
    with pytest.raises(ValueError):
        backfill.keys(bags(spark, ['{"a\'\\"b": 1}']), "extras")
    none = bags(spark, ["x"]).limit(0)
    assert backfill.keys(none, "extras") == [] and backfill.layout(none, "extras") == {}
    assert backfill.backfilled(none, "extras", {"Mood": "x_mood"})[0].columns == ["id", "x_mood"]
