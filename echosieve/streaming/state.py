"""What a stream remembers: Parquet tables with one folder per micro-batch.

A batch reads only folders of earlier batches and overwrites its own, so a batch
that is run again after a failure gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchTable:
    """Rows added by each micro-batch, below ``<path>/batch=<id>``.

    ``merge`` brings rows of several batches into fewer, for compaction.
    """

    def __init__(
        self, path: str, schema: str, merge: Callable[[DataFrame], DataFrame] | None = None
    ):
        self.path = path.rstrip("/")
        self.schema = schema
        self.merge = merge

    def at(self, path: str) -> "BatchTable":
        """A table of the same kind in another place."""
        return BatchTable(path, self.schema, self.merge)

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            # Known to be empty while planning, so the joins with it fall away.
            return spark.createDataFrame([], self.schema).limit(0)
        stored = spark.read.schema(f"{self.schema}, batch bigint").parquet(self.path)
        return stored.filter(F.col("batch") < batch_id).drop("batch")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def of(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, batch bigint").parquet(self.path)

    def compact_into(self, spark: SparkSession, path: str, files: int) -> "BatchTable":
        """Copy a stopped stream's batches into few files below a new folder.

        The last batch stays apart: if it was not committed, it will be run
        again and must then not see its own rows.
        """
        target = self.at(path)
        rows = self.read(spark)
        last = rows.agg(F.max("batch")).first()[0]
        if last is None:
            raise ValueError(f"{self.path} holds no batch yet")
        if last > 0:
            earlier = rows.filter(F.col("batch") < last).drop("batch")
            if self.merge is not None:
                earlier = self.merge(earlier)
            target.write(earlier.repartition(files), last - 1)
        target.write(rows.filter(F.col("batch") == last).drop("batch"), last)
        return target
