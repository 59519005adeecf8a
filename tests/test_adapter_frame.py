"""The stored frame follows its input."""

import shutil

from cohortloom.sources.adapter import orders_frame


def test_a_changed_input_is_another_frame(spark, tmp_path):
    names = ("orders", "customer", "lineitem", "supplier", "nation")
    for n in names:
        shutil.copy(f"/root/testdata/sf0.001/{n}.parquet", tmp_path / f"{n}.parquet")
    folder = str(tmp_path)
    first = orders_frame(spark, folder).cases.count()
    assert orders_frame(spark, folder).cases.inputFiles() == orders_frame(spark, folder).cases.inputFiles()
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(10).coalesce(1).write.parquet(f"{folder}/few")
    (part,) = (tmp_path / "few").glob("part-*.parquet")
    (tmp_path / "orders.parquet").chmod(0o644)
    shutil.copy(part, tmp_path / "orders.parquet")
    (tmp_path / ".orders.parquet.crc").unlink(missing_ok=True)
    assert orders_frame(spark, folder).cases.count() == 10 < first
