"""Each check of a consolidation on a sound one, and with a fault planted for it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from solfa.operators import royalty
from solfa.plans.reshapes import consolidation_checks

FIELDS, WORKS = ["name", "role", "ipi", "society", "share"], ["title"]
PARTIES = [
    (1, "W1", "One", "Ann Bee", "C", "1", "PRS"), (2, "W1", "One", "Cy Dee", "CA", "2", "PRS"), (3, "W1", "One", "Pub Ltd", "E", "3", "BMI"),
    (4, "W2", "Two", "Ann Bee", "A", "1", "PRS"), (5, "W2", "Two", "Ann Bee", "C", "1", "PRS"), (6, "W2", "Two", "Pub Ltd", "E", "3", "BMI"), (7, "W2", "Two", "Pub Inc", "E", "4", "BMI"),
]


@pytest.fixture(scope="module")
def sound(spark):
    rows = spark.createDataFrame(PARTIES, "seq long, work_key string, title string, name string, role string, ipi string, society string")
    rows = royalty.allocate(rows).cache()
    return rows, royalty.blocks(rows, WORKS, FIELDS).cache()


def source(spark, kept, changes=None):
    raw = [("Bee, Ann", "052:PRS", "Ann Bee", "PRS", f"k{i}") for i in range(7)] + [("Pub Ltd", "BMI", "Pub Ltd", "BMI", "k0")]
    raw = changes(raw) if changes else raw
    return royalty.source_checks(spark.createDataFrame(raw, "name string, society string, new_name string, new_society string, whole string"), kept)


def failed(spark, rows, table, changes=None, kinds=frozenset(FIELDS), moved=()):
    out = consolidation_checks(royalty.compared(rows, table, WORKS, FIELDS), source(spark, rows, changes), royalty.evenly_held(rows), [*FIELDS, *moved], list(moved), set(kinds))
    found = out.collect()
    assert len(found) == 15
    return {r["check"] for r in found if not r["ok"]}


def test_a_sound_consolidation_passes(spark, sound):
    assert failed(spark, *sound) == set()


def parties(change):
    return F.map_from_entries(F.transform(F.map_entries("parties"), lambda e: F.struct(e["key"], F.when(F.col("work_key") == "W2", change(e["value"])).otherwise(e["value"]))))


def renamed(p, **new):
    return F.struct(*((F.lit(new[f]) if f in new else p[f]).alias(f) for f in FIELDS))


@pytest.mark.parametrize(
    "fault, named",
    [
        (lambda t: t.filter("work_key <> 'W2'"), {"every work once", "every party once", "no party at another work", "party fields as they were"}),
        (lambda t: t.unionByName(t.filter("work_key = 'W1'")), {"every work once", "every party once"}),
        (lambda t: t.unionByName(t.filter("work_key = 'W1'").withColumn("work_key", F.lit("W9"))), {"every work once"}),
        (lambda t: t.withColumn("parties", parties(F.reverse)), {"party order as it was"}),
        (lambda t: t.withColumn("parties", parties(lambda v: F.slice(v, 1, 1))), {"every party once", "party fields as they were"}),
        (lambda t: t.withColumn("parties", parties(lambda v: F.transform(v, lambda p: renamed(p, ipi="9")))), {"party fields as they were", "no party at another work"}),
        (lambda t: t.withColumn("parties", parties(lambda v: F.transform(v, lambda p: renamed(p, share="")))), {"share written"}),
        (lambda t: t.withColumn("title", F.lit("One")), {"work columns once a work"}),
        (lambda t: t.withColumn("issue", F.lit("Author share not allocated")), {"100 percent in every work"}),
        (lambda t: t.withColumn("parties", F.transform_keys("parties", lambda k, v: F.when(k == "C", "AR").otherwise(k))), {"combined composers in the composers' block"}),
    ],
)
def test_faults_of_the_table_are_found(spark, sound, fault, named):
    rows, table = sound
    assert named <= failed(spark, rows, fault(table))


def test_only_the_order_differs(spark, sound):
    rows, table = sound
    assert failed(spark, rows, table.withColumn("parties", parties(F.reverse))) == {"party order as it was"}


@pytest.mark.parametrize(
    "changes, named",
    [
        (lambda raw: [(*raw[0][:2], "Bee, Ann", *raw[0][3:]), *raw[1:]], "names turned"),
        (lambda raw: [(*raw[0][:3], "052:PRS", raw[0][4]), *raw[1:]], "society prefixes stripped"),
        (lambda raw: [*raw, ("x", "y", "x", "y", "k99")], "repeats removed"),
    ],
)
def test_faults_of_the_source_are_found(spark, sound, changes, named):
    assert failed(spark, *sound, changes) == {named}


def test_other_faults(spark, sound):
    rows, table = sound
    assert failed(spark, rows, table, kinds={"name", "role", "ipi", "society"}) == {"fields of parties"}
    assert "varying columns moved to parties" in failed(spark, rows, table, moved=("title",))
    uneven = rows.withColumn("share", F.when(F.col("seq") == 7, "30").when(F.col("seq") == 6, "20").otherwise(F.col("share")))
    assert failed(spark, uneven, royalty.blocks(uneven, WORKS, FIELDS)) == {"shares even parts of pools"}
