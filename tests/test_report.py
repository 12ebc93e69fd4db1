"""The daily report over several runs, a repeated batch, and odd entries."""

from __future__ import annotations

import datetime

from solfa.streaming import activity, report

SCHEMA = "file_id long, inserted long, updated long, ts timestamp"
T = [datetime.datetime(2024, 1, d) for d in range(1, 9)]


def seen(spark, folder):
    return sorted((r["file_id"], r["stored"], r["commits"], r["last"]) for r in report.totals(spark, folder).collect())


def test_three_runs_equal_one(spark, tmp_path):
    days = [[(1, 2, 1, T[0]), (2, 5, 0, T[1])], [(1, 1, None, T[3]), (3, None, None, None), (None, 9, 9, T[4])], [(2, 1, 1, T[2]), (2, 0, 7, T[6])]]
    log, kept = str(tmp_path / "log"), str(tmp_path / "totals")
    for rows in days:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(log)
        report.run(activity.log_files(spark, log), kept, str(tmp_path / "state"))
    expected = [(1, 4, 2, T[3]), (2, 14, 3, T[6]), (3, 0, 1, None)]
    assert seen(spark, kept) == expected
    report.run(activity.log_files(spark, log), kept, str(tmp_path / "state"))  # nothing new
    assert seen(spark, kept) == expected
    once = str(tmp_path / "once")
    report.run(activity.log_files(spark, log), once, str(tmp_path / "state-once"))
    assert seen(spark, once) == expected


def test_a_repeated_batch_counts_once(spark, tmp_path):
    folder, frame = str(tmp_path / "totals"), lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert seen(spark, folder) == []
    report.add(frame([(1, 1, 0, T[0])]), 0, folder)
    report.add(frame([(1, 2, 0, T[1])]), 1, folder)
    report.add(frame([(1, 4, 0, T[2])]), 2, folder)
    for _ in range(2):
        report.add(frame([(1, 4, 0, T[2])]), 2, folder)  # again, after a failure
        assert seen(spark, folder) == [(1, 7, 3, T[2])]
    assert report.batches(spark, folder) == [1, 2]
    report.add(frame([]), 3, folder)
    assert seen(spark, folder) == [(1, 7, 3, T[2])]


def test_files_without_commits(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, name string")
    held = spark.createDataFrame([(1, 5, 2, T[0]), (9, 1, 1, T[0])], report.TOTALS)
    assert sorted(map(tuple, report.report(files, held).collect())) == [(1, "a", 5, 2, T[0]), (2, "b", 0, 0, None)]
