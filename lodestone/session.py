"""Session settings that the engine's stages are sized for; a caller may bring its own session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "lodestone", **more: str) -> SparkSession:
    """A session with SETTINGS, whose executors have this package."""
    spark = SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once a session, so that they need no installation of it."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_lodestone", False) or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/lodestone.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(f"{folder}/lodestone.zip")
    sc._lodestone = True
