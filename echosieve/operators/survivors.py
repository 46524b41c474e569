"""What all methods share: positions in, a table of dropped positions out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Params


def position(params: Params) -> Column:
    return F.col(params.order_column).cast("bigint").alias("pos")


def text_rows(df: DataFrame, text: Column, params: Params) -> DataFrame:
    """``(pos, text)`` for the steps that spend their time on the text itself."""
    return enough_tasks(df.select(position(params), text.alias("text")), params)


def enough_tasks(rows: DataFrame, params: Params) -> DataFrame:
    """``rows`` in ``min_tasks`` partitions if they lie in fewer."""
    if params.min_tasks is None or rows.rdd.getNumPartitions() >= params.min_tasks:
        return rows
    return rows.repartition(params.min_tasks, "pos")


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, marked until no column of ``tables`` is called so, in any case of its letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df``, also such with dots in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def _gone(df: DataFrame, dropped: DataFrame, params: Params) -> tuple[DataFrame, Column]:
    name = unused("_gone", df)
    return dropped.select(F.col("pos").alias(name)), F.col(params.order_column) == F.col(name)


def keep(df: DataFrame, dropped: DataFrame, params: Params) -> DataFrame:
    """The surviving rows of ``df`` with all their columns.

    ``dropped`` is a written table, so the planner knows its size: up to
    ``spark.sql.autoBroadcastJoinThreshold`` the payload is only filtered where
    it lies; beyond that the two sides are shuffled on the unique position.
    """
    return df.join(*_gone(df, dropped, params), "left_anti")


def removed(df: DataFrame, dropped: DataFrame, params: Params) -> DataFrame:
    """The complement of ``keep``."""
    return df.join(*_gone(df, dropped, params), "left_semi")


def in_order(df: DataFrame, params: Params) -> DataFrame:
    """Rows in corpus order, for callers that read the result in sequence."""
    return df.orderBy(params.order_column)
