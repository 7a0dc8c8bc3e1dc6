"""The index against the scan of all rows: the same neighbours, from few row groups."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestone.operators import indexed, knn
from lodestone.plans.queries import _order_vectors


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_orders(spark, tmp_path):
    s = _order_vectors(spark, "/root/testdata/sf0.01").persist()
    indexed.write(s, f"{tmp_path}/i", group=200)
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in (tmp_path / "i").glob("*.parquet") for g in range(pq.ParquetFile(f).num_row_groups)]
    assert len(groups) > 60
    for ref in (5, 777, 14_999):
        v = knn._reference(s, ref, ["s"])[0]
        assert rows(indexed.knn(spark, f"{tmp_path}/i", ref, v, 20)) == rows(knn.knn(None, ref, 20, "Bruteforce", store=s))
        near = indexed.near(spark, f"{tmp_path}/i", v, 20)
        assert 20 <= near.count() < s.count() / 10
        plan = near._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "PushedFilters: [Or(" in plan or "PushedFilters: [And(" in plan or "EqualTo(cell" in plan


@pytest.mark.parametrize("k", [1, 40, 500])
def test_copies_and_ties(spark, tmp_path, k):
    x = np.random.default_rng(1).integers(0, 5, (300, 3)).astype(float)
    x[:100] = 2.0
    s = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, s array<double>")
    indexed.write(s, f"{tmp_path}/i", pivots=12, group=10)
    for ref in (3, 250):
        assert rows(indexed.knn(spark, f"{tmp_path}/i", ref, list(x[ref]), k)) == rows(knn.knn(None, ref, k, "Bruteforce", store=s))
    empty = s.limit(0)
    indexed.write(empty, f"{tmp_path}/e")
    assert indexed.near(spark, f"{tmp_path}/e", [1.0, 2.0, 3.0], k).count() == 0
