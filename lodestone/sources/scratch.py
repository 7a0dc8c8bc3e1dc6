"""Tables in the folder that driver and executors share: what a stage has made, for later stages to read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import ship

#: Narrow rows in a file of a stored table whose size is known beforehand.
FILE_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a session whose executors run
    inside the driver (master local) may go without: it gets a temporary folder."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


class Stored:
    """Tables written into the shared folder: they cut lineage, survive lost executors and give Spark exact sizes.

    A result that reads them is lazy, so they stay until the scope they were made in ends or, outside of any, Python does."""

    _scope: ContextVar[list[Stored]] = ContextVar("stored", default=[])

    def __init__(self, spark: SparkSession):
        ship(spark)
        self._scope.get().append(self)
        self.spark, self.top, self.paths = spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", {}

    def place(self, name: str) -> str:
        """A path for files of any kind that end with the store."""
        return f"{self.top}/{name}-{uuid.uuid4().hex[:8]}"

    def put(self, name: str, df: DataFrame, rows: int | None = None, compact: bool = False) -> DataFrame:
        """rows: at most so many rows come, so that many small partitions become fewer files of up to FILE_ROWS. compact:
        smaller files for somewhat more work, where texts are stored."""
        if rows is not None:
            df = df.coalesce(rows // FILE_ROWS + 1)
        self.drop(name)
        path = self.place(name)
        df.write.options(**({"compression": "zstd"} if compact else {})).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        """A table that put() has stored."""
        return self.spark.read.parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            if path := self.paths.pop(name, None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

    def release(self) -> None:
        self.paths.clear()
        self._delete(self.top)

    @classmethod
    @contextmanager
    def scope(cls) -> Iterator[None]:
        """Delete the tables of all stores made inside, once what reads them has been written. Threads have their own scopes."""
        made: list[Stored] = []
        token = cls._scope.set(made)
        try:
            yield
        finally:
            cls._scope.reset(token)
            for store in made:
                store.release()


@atexit.register
def _release() -> None:
    for store in Stored._scope.get():
        try:
            store.release()
        except Exception:  # its session has ended: the folder is all that is left to try
            shutil.rmtree(store.top.removeprefix("file:"), ignore_errors=True)
