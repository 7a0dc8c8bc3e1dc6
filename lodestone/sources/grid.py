"""Parameter grids: generation, CSV in and out, evenly spaced hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.schemas import AXES

#: Splits whose starts are broadcast, at about 200 bytes each.
MOST_SPLITS = 50_000
#: The drum's default axes.
BOUNDS = {"tau": (0.4, 3.0), "p": (-5.0, -0.7), "d": (-5.0, -0.5), "alpha": (1e-4, 1.0)}


def grid(spark: SparkSession, bounds: dict[str, tuple[float, float]] = BOUNDS, subdiv: int = 10, single: bool = False) -> DataFrame:
    """(row_id, axes...): the Cartesian product of evenly spaced, end-inclusive axes, the last axis fastest.

    row_id is arithmetic on the axes' indices, so it doesn't depend on partitions: one range is generated and split into
    indices, which needs no join. single rounds the values to float32. One subdivision gives the lower bounds.
    """
    if subdiv < 1:
        raise ValueError("subdiv must be 1 or more")
    names = list(bounds)
    df = spark.range(subdiv ** len(names)).withColumnRenamed("id", "row_id")
    for place, name in enumerate(names):
        low, high = map(float, bounds[name])
        i = F.expr(f"CAST((row_id DIV {subdiv ** (len(names) - 1 - place)}) % {subdiv} AS DOUBLE)")
        value = F.lit(low) if subdiv == 1 else F.when(i == subdiv - 1, F.lit(high)).otherwise(i * F.lit((high - low) / (subdiv - 1)) + F.lit(low))
        df = df.withColumn(name, value.cast("float").cast("double") if single else value)
    return df


def write_csv(df: DataFrame, path: str, ids: bool = True, rows: int | None = None) -> None:
    """Header and no index, as other readers expect. ids=False leaves row_id out and writes the rows in its order instead,
    so that positions in the files, in the order of their names, tell the ids again; rows: at most so many in a file."""
    if not ids:
        df = df.repartitionByRange("row_id").sortWithinPartitions("row_id").drop("row_id")
    df.write.options(**({"maxRecordsPerFile": rows} if rows else {})).mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, axes: tuple[str, ...] = AXES, single: bool = True) -> DataFrame:
    """(row_id, axes) of CSV files with a header. Columns are found by name; without a row_id, ids are positions."""
    names = spark.read.csv(path, header=True).columns
    kinds = {"row_id": "long"} | dict.fromkeys(axes, "double")
    df = spark.read.schema(", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in names)).csv(path, header=True)
    if "row_id" not in names:
        df = with_positions(df)
    return df.select("row_id", *(F.col(a).cast("float").cast("double").alias(a) if single else F.col(a) for a in axes))


def with_positions(df: DataFrame, name: str = "row_id") -> DataFrame:
    """df, a scan of files of any format, with each row's position: files in the order of their paths, rows in the order of
    the file.

    A file is read in splits. Rows of a split are numbered where they are read; a first pass counts the rows of each split,
    and the sums over the splits before give where a split starts. The driver holds one row a split, as Spark's own scan
    does; up to MOST_SPLITS they are broadcast, beyond they are joined. Rows themselves are not moved."""
    spark, columns = df.sparkSession, df.columns
    at = df.select(*(F.col(f"`{c}`") for c in columns), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    splits = at.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_first")).collect()
    starts, total = [], 0
    for r in sorted(splits):
        starts.append((r["_path"], r["_start"], total - r["_first"]))
        total += r.n
    found = spark.createDataFrame(starts, "_path string, _start long, _shift long")
    found = at.join(F.broadcast(found) if len(starts) <= MOST_SPLITS else found, ["_path", "_start"])
    return found.select((F.col("_row") + F.col("_shift")).alias(name), *(F.col(f"`{c}`") for c in columns if c != name))


def first_rows(df: DataFrame, n: int = 10_000) -> DataFrame:
    """The rows of the first n ids: a pushed-down filter, not an unordered limit."""
    return df.where(F.col("row_id") < n)


def hub_ids(spark: SparkSession, n: int, hubs: int) -> DataFrame:
    """(hub, row_id): evenly spaced ids from 0 to n - 1, truncated; repeats if there are more hubs than rows."""
    if hubs < 1 or n < 1:
        raise ValueError("hubs and n must be 1 or more")
    at = F.expr(f"(id * {n - 1}L) DIV {hubs - 1}L") if hubs > 1 else F.lit(0).cast("long")
    return spark.range(hubs).select(F.col("id").cast("int").alias("hub"), at.alias("row_id"))
