"""Peaks of sounds come from their extremes."""

from lodestone.sources import export


def test_peaks_need_only_the_extremes(spark):
    y = [[0.25, -0.5], [2.0, 0.1], [-3.0], [float("nan"), 0.0], [0.0, -0.0], [], None]
    df = export.frames(spark.createDataFrame(list(enumerate(y)), "row_id long, y array<float>"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.peak for r in df.orderBy("row_id").collect()] == [16384, 32767, 32767, 32767, 0, None, None]
