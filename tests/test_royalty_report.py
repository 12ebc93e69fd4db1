"""The report dealt by work once: the rows of its SQL on odd tables, and no exchange in what follows."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from solfa.operators import royalty
from solfa.plans import reshapes
from solfa.plans.fixtures import RAW_PARTIES, spark_table
from solfa.sources.storage import stored_by


@pytest.fixture(scope="module")
def odd(spark):
    """Lines without a part, with a part listed twice, without a supplier or its nation, alike, without an order, and of an order without a key."""
    lines = [(o, n, 10 * o + n if n != 3 else 99, n, float(n)) for o in (1, 2, 97, 194) for n in (1, 2, 3, 4, 5, 6, 7)] + [(1, 1, 11, 1, 1.0), (1, 1, 11, 1, 2.0), (None, 1, 11, 1, 1.0), (2, 2, None, 2, 1.0)]
    parts = [(10 * o + n, f"t{n}", f"name {o}") for o in (1, 2, 97, 194) for n in (1, 2, 4, 5, 6, 7)] + [(12, "again", "name 1"), (22, "t2", "name 2"), (None, "no", "key")]
    tables = {
        "lineitem": spark.createDataFrame([(*x, "A") for x in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string"),
        "part": spark.createDataFrame(parts, "p_partkey long, p_type string, p_name string"),
        "supplier": spark.createDataFrame([(1, "s1", 1), (2, "s2", 1), (3, "s3", 1), (5, "s5", 1), (6, "s6", 8), (7, "s7", None)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": spark.createDataFrame([(1, "N1")], "n_nationkey int, n_name string"),
    }
    folder = tempfile.mkdtemp(prefix="odd-", dir="/tmp")
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_the_report_is_that_of_its_sql(spark, odd):
    found, _ = reshapes._report(spark, odd)
    meant = spark_table(spark, odd, RAW_PARTIES).withColumn("work_key", F.trim("work_key")).filter("work_key <> ''").select(found.columns)
    # lines alike but for what they don't show may change places
    rows = sorted(map(tuple, meant.collect()))
    assert sorted(map(tuple, found.collect())) == rows and len(rows) > len({r[0] for r in rows}) > 5


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_are_dealt_by_work_once(spark, odd):
    for name in ("royalty_parties", "royalty_shares", "royalty_slots", "royalty_issues"):
        plan = reshapes.QUERIES[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "p_partkey" not in x and "s_suppkey" not in x]
        assert len(dealt) == 1 and "_work" in dealt[0], dealt


@pytest.fixture(scope="module")
def by_work(spark, odd):
    report, n = reshapes._report(spark, odd)
    return stored_by(royalty.allocate(reshapes._parties(report)), "shares", "work_key", n), n


def test_a_table_stays_as_it_was_dealt(spark, by_work):
    rows, n = by_work
    works = ["title", "duration"]
    fields = ["name", "role", "ipi", "society", "share"]
    table = royalty.blocks(rows, works, fields)
    assert rows.groupBy("work_key").count().rdd.getNumPartitions() == n
    assert exchanges(table) == 0
    back = stored_by(table, "blocks", "work_key", n)
    for df in (royalty.compared(rows, back, works, fields), royalty.evenly_held(rows), rows.groupBy("work_key").agg(F.min("title"))):
        assert exchanges(df) == 0
    assert sorted(map(tuple, back.select("work_key", "issue").collect())) == sorted(map(tuple, royalty.issues(rows).collect()))


def test_rows_alike_are_counted_key_by_key(spark):
    raw = spark.createDataFrame([("W1", "A, B", "1:x", "B A", "x", "W1a"), ("W1", "A, B", "1:x", "B A", "x", "W1a"), ("W2", "c", "y", "c", "y", "W2a")], "work_key string, name string, society string, new_name string, new_society string, whole string")
    kept = spark.range(2)
    whole, dealt = royalty.source_checks(raw.drop("work_key"), kept), royalty.source_checks(raw, kept, "work_key")
    assert dealt.first().asDict() == whole.first().asDict() and dealt.first()["repeats"] == 1
    assert royalty.source_checks(raw.limit(0), kept.limit(0), "work_key").first()["n"] == 0
