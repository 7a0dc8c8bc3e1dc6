"""What a lookup moves of each stored row."""

from pyspark.sql import functions as F

from lodestone.sources import store


def test_no_path_goes_with_a_row(spark, tmp_path):
    """Of rows in many files the last counts, and aggregates order them by a number, not by a path."""
    path = str(tmp_path / "s")
    spark.range(400).select((F.col("id") % 40).alias("row_id"), F.col("id").cast("double").alias("s")).repartitionByRange(12, "s").sortWithinPartitions("s").write.parquet(path)
    got = store.lookup(spark.read.parquet(path), range(40))
    assert [(r.row_id, r.s) for r in got.collect()] == [(i, 360.0 + i) for i in range(40)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "max_by(_value" in plan and "SortAggregate" not in plan
