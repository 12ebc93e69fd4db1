"""Cleaners as chains of projections give what they give as lambdas."""

from pyspark.sql import functions as F

from solfa.functions.cells import clean_value
from solfa.functions.text import staging
from solfa.plans import catalog
from tests.conftest import SF_DIR

ODD = [None, "", "  ", "N/A", "$$ x", "a|b, C and été", "60% | 140%", "1:75", "1:02:03", "31/02/2020", "5-Jan-69", "2020-13", "inst", "HIN", "in-a01-19-00001", "ALLCAPS", "x_x0041_y", "½", "9" * 13, "1 2"]


def test_stages_give_the_same_cells(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in ODD for b in ODD[::3])], "row_index long, a string, b string").repartition(3)
    for column in ("Singer", "Release Date", "Audio Duration (mm:sec)", "Revenue Split"):
        raws = [F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))]
        with staging() as stages:
            cell = clean_value(column, raws, as_of=2026)
        staged = rows
        for level in stages.levels:
            staged = staged.select("*", *level)
        assert len(stages.levels) > 2
        want = rows.select("row_index", clean_value(column, raws, as_of=2026).alias("c"))
        assert sorted(staged.select("row_index", cell.alias("c")).collect()) == sorted(want.collect()), column


def test_sheet_is_made_on_all_cores(spark):
    plan = catalog.catalog(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("RepartitionByExpression [p_partkey")
