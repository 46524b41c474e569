"""Corpora in: batch and streaming reads, positions, chunks, row limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numbers import block_of
from ..operators.survivors import columns_of, unused
from ..params import Params
from ..streaming.arrivals import with_arrival
from ..workspace import Workspace


def select_part(df: DataFrame, params: Params) -> DataFrame:
    """The configured part of a corpus, by the columns the caller named for it."""
    wanted = (
        (params.config_column, params.dataset_config), (params.split_column, params.dataset_split),
    )
    for column, value in wanted:
        if column is None:
            continue
        if column not in df.columns:
            raise ValueError(f"the corpus has no column {column!r}; it has {df.columns}")
        df = df.filter(F.col(column) == value)
    return df


def read_corpus(
    spark: SparkSession, path: str, params: Params, format: str = "parquet",
    schema: StructType | str | None = None, **options,
) -> DataFrame:
    """A corpus in any format Spark reads; partition folders are pruned."""
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return limit_chunks(select_part(reader.load(path), params), params)


def stream_corpus(
    spark: SparkSession, path: str, params: Params, schema: StructType | str,
    format: str = "parquet", files_per_batch: int = 1, numbered: bool = True, **options,
) -> DataFrame:
    """The same as a stream of files, oldest first.

    ``max_chunks`` is applied by the runner, which stops before a file beyond it.  Rows that
    have no ``order_column`` (``numbered=False``) carry their origin, by which the runner numbers
    them in order of arrival; the numbers count the rows of the configured part.
    """
    reader = (
        spark.readStream.format(format).options(**options).schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
    )
    rows = reader.load(path)
    return select_part(rows if numbered else with_arrival(rows), params)


def limit_chunks(df: DataFrame, params: Params) -> DataFrame:
    """The first ``max_chunks`` chunks; a position filter that reaches the scan."""
    if params.max_chunks is None:
        return df
    return df.filter(F.col(params.order_column) < params.max_chunks * params.chunk_size)


def with_chunk(df: DataFrame, params: Params) -> DataFrame:
    """Add ``chunk``: consecutive groups of ``chunk_size`` positions, from 0."""
    return df.withColumn("chunk", block_of(F.col(params.order_column), params.chunk_size))


def with_file_positions(df: DataFrame, work: Workspace, name: str = "pos") -> DataFrame:
    """Number the rows of a file scan 0, 1, 2, … in order of file path and row.

    For corpora without an id or a sort key: the order of arrival is the order.  Nothing
    is sorted or shuffled: a row's number is its index in its file plus one offset per
    file, and the list of files, which has a row each, is sent to all tasks.
    """
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    at, nth, offset = unused("_file", df), unused("_row", df), unused("_offset", df)
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    files = df.select(path.alias(at)).groupBy(at).agg(F.count("*").alias("_rows"))
    offsets = work.table(files.select(
        at, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(offset)
    ), "file-offsets")
    placed = df.select("*", path.alias(at), row.alias(nth))
    # A file is never dealt to one task, as a shuffle on its path would do.
    return placed.join(F.broadcast(offsets), at).select(
        *columns_of(df), (F.col(offset) + F.col(nth)).alias(name)
    )


def position_index(
    df: DataFrame, order_by: list[str], work: Workspace, name: str = "pos",
    partitions: int | None = None,
) -> DataFrame:
    """``df``, a narrow one, numbered 0, 1, 2, … by a unique sort key, without a one-task sort.

    Rows are range-partitioned and sorted; a written copy fixes the partition of
    each row, so that the few per-partition offsets stay valid.
    """
    part, at, offset = unused("_part", df), unused("_at", df), unused("_offset", df)
    ranged = (
        df.repartitionByRange(partitions, *order_by) if partitions
        else df.repartitionByRange(*order_by)
    )
    local = ranged.sortWithinPartitions(*order_by).select(
        "*",
        F.spark_partition_id().alias(part),
        # The low 33 bits are the row number inside the partition.
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(at),
    )
    placed = work.table(local, "placed")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort.
    offsets = placed.groupBy(part).agg(F.count("*").alias("_rows")).select(
        part, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(offset)
    )
    return placed.join(F.broadcast(offsets), part).select(
        *columns_of(df), (F.col(offset) + F.col(at)).alias(name)
    )


def with_positions(
    df: DataFrame, order_by: list[str], work: Workspace, name: str = "pos",
    partitions: int | None = None,
) -> DataFrame:
    """Number rows 0, 1, 2, … by a unique sort key, of which only the keys are sorted.

    The numbers meet the rows by a join on the key, which shuffles the columns that are used
    afterwards once, and no others.  A key that occurs twice is an error.
    """
    keys = df.select(*[F.col(c) for c in order_by])
    index = work.table(position_index(keys, order_by, work, name, partitions), "positions")
    return join_positions(df, index, order_by, name)


def join_positions(
    df: DataFrame, index: DataFrame, order_by: list[str], name: str = "pos"
) -> DataFrame:
    """The rows of ``df`` whose key is in the written ``index(order_by…, name)``, numbered."""
    if not index.groupBy(*order_by).count().filter("count > 1").isEmpty():
        raise ValueError(f"{order_by} does not tell rows apart")
    keys = [unused(f"_key_{n}", df) for n in range(len(order_by))]
    named = index.select(
        *[F.col(c).alias(k) for c, k in zip(order_by, keys)], F.col(name).alias(unused("_at", df))
    )
    matched = reduce(
        Column.__and__, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(order_by, keys)]
    )
    return df.join(named, matched).select(
        *columns_of(df), F.col(unused("_at", df)).alias(name)
    )
