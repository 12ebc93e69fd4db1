"""Work that is dealt to as many tasks as the rows ask for, each value worked out once, and samples that sort no column."""

from __future__ import annotations

from pyspark.sql import functions as F

from solfa.functions.headers import STRETCH, first_cells
from solfa.operators import matching, royalty, writers


def test_parties_go_to_more_tasks_as_a_report_grows(spark):
    rows = spark.range(100).select(F.col("id").alias("seq"), F.concat(F.lit("W"), F.col("id") % 7).alias("work_key"), F.lit("C").alias("role"))
    few, many = (royalty.parties(rows, ["work_key", "role"], n) for n in (100, 20 * royalty.ROWS_A_PART))
    assert many.rdd.getNumPartitions() == 20 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 7


def test_shares_need_no_exchange_after_rows_are_dealt_by_work(spark):
    roles = ["CA", "C", "E", "E", "E", "A", "", None, "AR"]
    rows = spark.createDataFrame([(i, "W", r) for i, r in enumerate(roles)], "seq long, work_key string, role string")
    shares = royalty.allocate(royalty.by_work(rows, 9))
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    found = {r["seq"]: r["share"] for r in shares.collect()}
    assert found == {0: "25", 1: "12.5", 2: "16.6667", 3: "16.6667", 4: "16.6666", 5: "12.5", 6: "0", 7: "0", 8: "0"}


def test_each_spelling_of_a_header_is_scored_once(spark):
    heads = spark.createDataFrame([("s", i, h) for i, h in enumerate(["isrc", "LABEL  name", "genre of song", None, " "] * 40)], "file string, place int, header string")
    scores = matching.header_scores(heads, matching.targets(spark))
    found = scores.groupBy("header", "target").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
    assert {r["header"] for r in found} == {"isrc", "LABEL  name", "genre of song"} and all(r["n"] == 40 and r["low"] == r["high"] for r in found)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [header" in plan[plan.index("ArrowEvalPython"):]


def test_first_cells_of_each_column(spark):
    # column a has few cells in each stretch, b has one far behind, c has two
    at = [(i, "a") for i in range(0, 40 * STRETCH, STRETCH // 2)] + [(i, "b") for i in range(30)] + [(10**9, "b"), (-5, "c"), (7, "c")]
    cells = spark.createDataFrame(at, "row_index long, col string")
    found = {}
    for r in first_cells(cells, ["col"], 31).collect():
        found.setdefault(r["col"], {})[r["nth"]] = r["row_index"]
    for c in "abc":
        assert [found[c][n] for n in sorted(found[c])] == sorted(i for i, x in at if x == c)[:31]


def test_writers_need_one_exchange(spark):
    works = spark.createDataFrame([(1, "", "Asha Rao", "7"), (2, "Ravi Sen", "Ravi Sen", ""), (3, "Uma", "Asha Rao", "9")], "work_seq long, c string, a string, i string")
    rows = writers.writer_rows(works, [("C", "c", None), ("A", "a", "i")], {"title": F.concat(F.lit("t"), "work_seq")})
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # before it has run
    assert {tuple(r) for r in rows.collect()} == {
        (1, 1, "t1", "Rao", "Asha", "7", "A"), (2, 1, "t2", "Sen", "Ravi", "", "CA"), (3, 1, "t3", "Uma", "Uma", "", "C"), (3, 2, "", "Rao", "Asha", "9", "A"),
    }
