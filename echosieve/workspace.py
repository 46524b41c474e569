"""Shared-storage tables that cut lineage between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a folder of
    its own, which is then also set for the rest of the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to storage that every executor can reach"
        )
    own = tempfile.mkdtemp(prefix="echosieve-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, store = _at(spark, folder)
    return store.exists(path)


def delete(spark: SparkSession, folder: str) -> None:
    path, store = _at(spark, folder)
    store.delete(path, True)


def mark(spark: SparkSession, folder: str, name: str) -> None:
    """Create the empty file ``name`` in ``folder``."""
    path, store = _at(spark, f"{folder}/{name}")
    store.create(path, True).close()


def marks(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in ``folder``; none if there is no such folder."""
    path, store = _at(spark, folder)
    return [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []


def stamp(spark: SparkSession, folder: str, millis: int) -> None:
    """Give the files in ``folder`` one time of modification."""
    path, store = _at(spark, folder)
    for file in store.listStatus(path):
        store.setTimes(file.getPath(), millis, -1)


class Workspace:
    """Numbered Parquet tables below one folder of the shared storage.

    A written table survives the loss of any executor, is columnar, and has a
    known size, so that the planner can tell whether it may be broadcast.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def path(self, name: str) -> str:
        """A new place in this workspace."""
        self.tables.append(f"{self.folder}/{len(self.tables) + 1:04d}-{name}")
        return self.tables[-1]

    def remove(self) -> None:
        """Delete this workspace, once no DataFrame over its tables is needed."""
        delete(self.spark, self.folder)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back from storage."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
