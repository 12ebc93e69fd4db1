"""Each check of an expansion on a sound one, and with a fault planted for it; samples of faults are bounded, their counts are not."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from solfa.operators import checks, expansion, pagination, writers

COLUMNS = [("C", "c1", "i1"), ("C", "c2", None), ("A", "l1", "i3")]
HEAD = lambda: {"title": F.trim("title"), "rec_artist": F.trim("singer")}
WORKS = [
    (1, "One", "Ann Bee", "5", "Cy Dee Ef - 1234567", "ann  bee", "5", "Sue"), (2, "Two", "Mono", "", "", "Gus Hay", "9", "Sue"),
    (3, "Three", None, None, None, "Ida Jay", " ", ""), (4, "Four", "Ann Bee", "1", "Ann Bee", "Ann Bee", "1", "Tom"),
]


@pytest.fixture(scope="module")
def sound(spark):
    works = spark.createDataFrame(WORKS, "work_seq long, title string, c1 string, i1 string, c2 string, l1 string, i3 string, singer string").cache()
    return works, writers.writer_rows(works, COLUMNS, HEAD()).withColumn("file", F.lit("f")).cache()


def judge(works, rows, placed=None):
    placed = pagination.parts(rows) if placed is None else placed
    sizes = rows.join(placed, ["file", "work_seq"]).groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"))
    out = expansion.expansion_checks(expansion.compared(works, COLUMNS, HEAD(), rows, placed), sizes).collect()
    assert len(out) == 15
    return {r["check"]: r for r in out if not r["ok"]}


def test_a_sound_expansion_passes(sound):
    assert judge(*sound) == {}


#: A work without its rows fails all that compares rows; a wrong name also fails what is compared by name.
LOST = {"a row for each writer", "works with a writer", "writers in order", "work written once", "singers as the recording artist", "names split", "roles as in the columns", "identifiers copied"}
NAMES = {"names split", "writers in order", "roles as in the columns", "identifiers copied"}


def second(column, value):
    return lambda r: r.withColumn(column, F.when((F.col("work_seq") == 1) & (F.col("writer_seq") == 2), F.lit(value)).otherwise(F.col(column)))


@pytest.mark.parametrize(
    "fault, named",
    [
        (lambda r: r.filter("work_seq <> 2"), LOST),
        (lambda r: r.withColumn("work_seq", F.when(F.col("work_seq") == 2, 9).otherwise(F.col("work_seq"))), LOST),
        (second("role", "A"), {"roles as in the columns"}),
        (second("role", "CA"), {"both roles in one row", "roles as in the columns", "a row for each writer"}),
        (second("ipi", ""), {"identifiers copied"}),
        (second("title", "One"), {"work written once"}),
        (lambda r: r.withColumn("rec_artist", F.lit("")), {"work written once", "singers as the recording artist"}),
        (lambda r: second("first", "")(second("last", "")(r)), {"no blank writers", *NAMES}),
        (second("last", "Dee Ef - 1234567"), {"identifiers stripped from names", *NAMES}),
        (lambda r: r.withColumn("writer_seq", F.when(F.col("work_seq") == 2, 3 - F.col("writer_seq")).otherwise(F.col("writer_seq"))), {"writers in order", "work written once", "singers as the recording artist"}),
        (lambda r: r.withColumn("iswc", F.lit("T-1")), {"fields without a source left blank"}),
    ],
)
def test_faults_are_found(sound, fault, named):
    works, rows = sound
    assert set(judge(works, fault(rows))) == named


def test_only_identifiers_of_two_roles_clash(spark, sound):
    works, _ = sound
    works = works.withColumn("i3", F.when(F.col("work_seq") == 1, "6").otherwise(F.col("i3")))
    found = judge(works, writers.writer_rows(works, COLUMNS, HEAD()).withColumn("file", F.lit("f")))
    assert list(found) == ["one identifier for a merged writer"] and found["one identifier for a merged writer"]["faults"] == "ann  bee (One)"


def test_faults_of_parts_are_found(spark, sound):
    works, rows = sound
    placed = pagination.parts(rows)
    split = placed.unionByName(placed.filter("work_seq = 1").withColumn("part", F.lit(2)))
    assert set(judge(works, rows, split)) == {"work in one part"}
    seqs = spark.range(100, 401).withColumnRenamed("id", "work_seq")
    many, more = (t.filter("work_seq = 3").drop("work_seq").crossJoin(seqs) for t in (rows, works))
    one = many.select("file", "work_seq", F.lit(1).alias("part"))
    found = judge(more, many, one)
    assert set(found) == {"parts within the limit"} and found["parts within the limit"]["faults"] == "f-1"


def test_faults_that_cancel_out_are_found_and_samples_are_bounded(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("r"), "id"))).alias("bad"))
    out = checks.judged(rows, {"even": (F.lit(1), F.lit(1), F.col("bad")), "none": (F.lit(2), F.lit(2), F.lit(None).cast("array<string>"))}, "id")
    assert [tuple(r) for r in out.orderBy("check").collect()] == [("even", 1, 1, 500, "r0, r2, r4", False), ("none", 2, 2, 0, "", True)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert [r["n_faults"] for r in checks.judged(rows.limit(0), {"a": (F.count(F.lit(1)), F.lit(0), F.col("bad"))}, "id").collect()] == [0]
