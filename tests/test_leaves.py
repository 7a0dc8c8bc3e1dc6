"""What the search through cells compares stays small in large cells."""

from pyspark.sql import functions as F

from lodestone.operators.cells import nearest_in_cells


def test_leaves_bound_the_work_in_large_cells(spark):
    """With few pivots for many points, a point still meets a few leaves of its cell and not the cell."""
    at = lambda name: F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(1_000_003)) / 1000.0
    p = spark.range(4000).select(F.col("id").alias("row_id"), at("x").alias("x"), at("y").alias("y"))
    pairs = spark.sparkContext.accumulator(0)
    got = nearest_in_cells(p, p, 3, "xy", pivots=4, compared=pairs)
    assert got.count() == 12_000
    assert pairs.value < 4000 * 600, pairs.value / 4000
