"""A stream's state that stays where it is when a batch is joined with it.

The state is a table in hash buckets of its key, a partition per step.  A join on the key reads
it bucket by bucket, so the batch is shuffled to the state and not the state to the batch,
however large the batch is.  The files lie in a folder of the stream; the session's catalog only
knows the layout, and is told again by every session that opens the folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import exists
from .state import BatchTable


class BucketedTable(BatchTable):
    """As ``BatchTable``, in ``buckets`` hash buckets of the first column of ``schema``.

    The number of buckets is that of the first step; a folder keeps it.  Use as many as there
    are shuffle partitions, or more, or the planner shuffles both sides for their parallelism.
    """

    def __init__(
        self, path: str, schema: str, buckets: int,
        merge: Callable[[DataFrame], DataFrame] | None = None,
    ):
        super().__init__(path, schema, merge)
        self.buckets = buckets
        self.key = schema.split()[0]
        self.name = f"echosieve_state_{hashlib.md5(self.path.encode()).hexdigest()}"

    def at(self, path: str) -> BucketedTable:
        return BucketedTable(path, self.schema, self.buckets, self.merge)

    def _known(self, spark: SparkSession) -> None:
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema}, batch BIGINT) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY ({self.key}) SORTED BY ({self.key}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        if exists(spark, self.path):
            spark.sql(f"MSCK REPAIR TABLE {self.name} SYNC PARTITIONS")
        spark.catalog.refreshTable(self.name)

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return super().before(spark, batch_id)
        return self.read(spark).filter(F.col("batch") < batch_id).drop("batch")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        self._known(spark)
        view = f"{self.name}_new"
        columns = [c.split()[0] for c in self.schema.split(", ")]
        # One task per bucket, so one file.
        rows.select(*columns).repartition(self.buckets, self.key).createOrReplaceTempView(view)
        spark.sql(
            f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {batch_id}) SELECT * FROM {view}"
        )
        spark.catalog.dropTempView(view)

    def read(self, spark: SparkSession) -> DataFrame:
        self._known(spark)
        return spark.table(self.name)

    def forget(self, spark: SparkSession) -> None:
        """Take the table out of the catalog; its files stay."""
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
