"""The feature store and other saved tables: one Parquet row an id, features in one array column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The most ids that go into a pushed-down IN list; longer requests are joined.
MOST_LITERALS = 1000
#: More rows than a file has: a row's place is its file's number times this and its place in the file.
FILE_SPAN = 1 << 40


def write(df: DataFrame, path: str, order: str = "row_id") -> None:
    """Overwrite path. Files hold ranges of row_id in order, so filters on it skip row groups by their statistics; rows
    with the same id stay in df's order."""
    if order in df.columns:
        df = df.withColumn("_came", F.monotonically_increasing_id()).repartitionByRange(order).sortWithinPartitions(order, "_came").drop("_came")
    df.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _keyed_name(path: str) -> str:
    return f"keyed_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def write_keyed(df: DataFrame, path: str, buckets: int = 64, key: str = "row_id") -> DataFrame:
    """Write df under path dealt into buckets by its key, sorted, with Bloom filters on it; gives the table.

    A bucket is one file, so joins and groups by the key need no shuffle of the store, whatever its size, and a scan for a few
    keys skips files by filter. What a later session must know of the buckets lies beside them."""
    bloom = {f"parquet.bloom.filter.enabled#{key}": "true"}
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_keyed_name(path)}")
    writer = df.repartition(buckets, key).write.format("parquet").options(path=path, **bloom).bucketBy(buckets, key).sortBy(key)
    writer.mode("overwrite").saveAsTable(_keyed_name(path))
    spark.createDataFrame([(buckets, key)], "buckets int, key string").coalesce(1).write.mode("overwrite").json(f"{path}/_keyed")
    return read_keyed(spark, path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The table that write_keyed wrote under path, known to this session as one in buckets."""
    name = _keyed_name(path)
    if not spark.catalog.tableExists(name):
        of = spark.read.schema("buckets int, key string").json(f"{path}/_keyed").first()
        columns = spark.read.parquet(path)._jdf.schema().toDDL()
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{of.key}`) SORTED BY (`{of.key}`) INTO {of.buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def from_wide(df: DataFrame, key: str = "row_id") -> DataFrame:
    """(row_id, s) from a table of one float column a coefficient, named 0, 1, ..."""
    names = sorted((c for c in df.columns if c != key), key=int)
    return df.select(F.col(key).alias("row_id"), F.array(*(F.col(f"`{c}`") for c in names)).alias("s"))


def filtered(store: DataFrame, ids: Iterable[int]) -> DataFrame:
    """Rows whose row_id is among ids: pushed down to the scan, or a semi-join for long lists."""
    ids = sorted({int(i) for i in ids})
    if len(ids) <= MOST_LITERALS:
        return store.where(F.col("row_id").isin(ids))
    wanted = store.sparkSession.createDataFrame([(i,) for i in ids], "row_id long")
    return store.join(wanted, "row_id", "left_semi")


def request(spark: SparkSession, ids: Iterable[int]) -> DataFrame:
    """(pos, row_id) of a list of ids, in its order."""
    return spark.createDataFrame([(p, int(i)) for p, i in enumerate(ids)], "pos long, row_id long")


def storage_order(store: DataFrame) -> Column | None:
    """Where a stored row stands: its file, in the order of paths, and its place in the file, both from Parquet's hidden
    columns; None if store isn't the scan of such files."""
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    try:
        store.select(at).schema
    except AnalysisException:
        return None
    return at


def lookup(store: DataFrame, ids: DataFrame | Iterable[int], value: str = "s") -> DataFrame:
    """(pos, row_id, value) in request order: repeated ids repeat, missing ids are left out, of rows with the same id the
    last one stored counts. All missing: an empty table.

    A store that isn't read from Parquet files has no order; there the greatest value counts."""
    wanted = ids if isinstance(ids, DataFrame) else request(store.sparkSession, ids)
    at = storage_order(store)
    held = store.select("row_id", F.col(value).alias("_value"), (F.lit(0) if at is None else at).alias("_at"))
    if at is not None:  # paths are long: rows carry their file's number in the order of paths, a row a file being sent to the tasks
        files = held.select(F.col("_at.path").alias("_path")).distinct().select("_path", F.row_number().over(Window.orderBy("_path")).alias("_file"))
        held = held.join(F.broadcast(files), F.col("_at.path") == F.col("_path")).select("row_id", "_value", (F.col("_file").cast("long") * FILE_SPAN + F.col("_at.row")).alias("_at"))
    last = F.max("_value") if at is None else F.max_by("_value", "_at")
    found = held.join(wanted.select("row_id").distinct(), "row_id", "left_semi").groupBy("row_id").agg(last.alias(value))
    return wanted.join(found, "row_id").select("pos", "row_id", value).orderBy("pos")


def lookup_batches(store: DataFrame, ids: DataFrame | Iterable[int], batch_size: int, value: str = "s") -> DataFrame:
    """lookup with the batch of each request position; batches without a hit just have no rows."""
    return lookup(store, ids, value).withColumn("batch", F.expr(f"pos DIV {batch_size}"))


def hub_rows(store: DataFrame, hubs: DataFrame) -> DataFrame:
    """The stored rows of hubs, each once. hubs is small beside the store; Spark broadcasts it by its size."""
    return store.join(hubs.select("row_id"), "row_id", "left_semi")
