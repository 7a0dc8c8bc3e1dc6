import pytest

from lodestone.plans.queries import ORACLES, QUERIES
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """A folder whose embeddings are 30 of the given ones, for the chain of 65,536 samples."""
    folder = str(tmp_path_factory.mktemp("few"))
    spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 30").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, few, name):
    assert QUERIES[name](spark, few if "full" in name else SF).count() > 0
