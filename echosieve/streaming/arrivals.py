"""Positions for streamed rows that have none: the order of arrival.

A streamed row knows its file and the block of it that it was read from.  Rows of one block lie
in one task in file order, so a row's number within its block is a number within the task less
the least one of the block.  The ledger holds a row per block of every batch: where its first row
stands.  It is written with the batch; a batch that is run again finds the same files, starts at
the same place, as the ledgers of earlier batches say, and gives every row the same position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .state import BatchTable

#: The column that carries a streamed row's origin until it is numbered.
ARRIVAL = "_arrival"
ORIGIN = "time timestamp, file string, block bigint"
LEDGER = f"{ORIGIN}, first bigint, rows bigint"


def with_arrival(stream: DataFrame) -> DataFrame:
    """Add where each row of a file stream comes from."""
    if ARRIVAL in stream.columns:
        raise ValueError(f"the corpus has a column {ARRIVAL!r} of its own")
    return stream.select("*", F.struct(
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    ).alias(ARRIVAL))


def next_position(spark: SparkSession, ledger: BatchTable, step: int) -> int:
    """The first position that the steps before ``step`` left free."""
    return ledger.before(spark, step).agg(
        F.coalesce(F.max(F.col("first") + F.col("rows")), F.lit(0))
    ).first()[0]


def numbered(
    batch: DataFrame, ledger: BatchTable, step: int, name: str, work: Workspace
) -> DataFrame:
    """``batch`` with its positions as ``name`` instead of ``ARRIVAL``, as a written table.

    Files are taken by time, then path.  The batch is read once; the ledger, a row per file
    block of one batch, is all that is ordered in one task.
    """
    nth, low = f"{ARRIVAL}_nth", f"{ARRIVAL}_low"
    first = f"{ARRIVAL}_first"
    spark = batch.sparkSession
    arrived = work.table(
        batch.withColumn(nth, F.monotonically_increasing_id()), "arrived"
    )
    before = Window.orderBy("time", "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = work.table(
        arrived.groupBy(f"{ARRIVAL}.time", f"{ARRIVAL}.file", f"{ARRIVAL}.block").agg(
            F.min(nth).alias("least"), F.count(F.lit(1)).alias("rows")
        ).withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))
                     + next_position(spark, ledger, step)),
        "blocks",
    )
    ledger.write(blocks.select("time", "file", "block", "first", "rows"), step)
    placed = blocks.select(
        F.struct("time", "file", "block").alias(ARRIVAL),
        F.col("first").alias(first), F.col("least").alias(low),
    )
    columns = [c for c in batch.columns if c != ARRIVAL]
    return arrived.join(placed, ARRIVAL).select(
        *columns, (F.col(first) + F.col(nth) - F.col(low)).alias(name)
    )
