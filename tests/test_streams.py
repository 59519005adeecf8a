"""Streams in several batches, run again and restarted."""

import datetime as dt

from pyspark.sql import functions as F

from cohortloom.streaming import events as ev


def add_file(spark, folder, name, rows):
    day = dt.datetime(2024, 1, 1)
    data = [(i, day + dt.timedelta(hours=h), u, kind, 1.0, None) for i, h, u, kind in rows]
    part = f"{folder}/part-{name}"
    spark.createDataFrame(data, ev.EVENTS).coalesce(1).write.parquet(part)
    return part


def test_impacted_subjects_count_all_batches(spark, tmp_path):
    add_file(spark, tmp_path / "in", "a", [(1, 0, 7, "view"), (2, 1, 8, "view")])
    add_file(spark, tmp_path / "in", "b", [(3, 2, 7, "view"), (4, 2, None, "view")])
    at, check = f"{tmp_path}/out", f"{tmp_path}/check"

    def run(checkpoint=check):
        rows = ev.read_events(spark, f"{tmp_path}/in/*", "*.parquet", files_per_batch=1)
        ev.recompute_impacted(rows, at, F.col("user_id").cast("string"), lambda b: b.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")), checkpoint).awaitTermination()
        return {r.subject_id: r.n for r in spark.read.schema("n long, subject_id string").parquet(f"{at}/subjects").collect()}

    assert run() == {"7": 2, "8": 1}
    assert run() == {"7": 2, "8": 1}  # nothing new
    add_file(spark, tmp_path / "in", "c", [(5, 9, 8, "view"), (6, 9, 9, "view")])
    assert run() == {"7": 2, "8": 2, "9": 1}  # a restart goes on
    assert run(f"{tmp_path}/again") == {"7": 2, "8": 2, "9": 1}  # all batches run again


def test_open_windows_come_out(spark, tmp_path):
    add_file(spark, tmp_path / "in", "a", [(1, 0, 7, "view"), (2, 30, 8, "view"), (3, 31, 8, "view")])
    rows = ev.tumbling_counts(ev.read_events(spark, f"{tmp_path}/in/*", "*.parquet"))
    ev.run_to_result(rows, f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
