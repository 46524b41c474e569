"""Small expressions and table helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASK_BYTES = 4 << 20  # of a small table in a task
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and no other letter, in lower case."""
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def may_broadcast(df: DataFrame, row_bytes: int, most_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows stay below the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df


def few_tasks(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` of about ``rows`` rows in tasks of ``TASK_BYTES``, but as many as there are cores.

    A task and a file for each shuffle partition cost a small table more than its rows do.  A
    large one has no more than ``TASK_BYTES`` in a partition, and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, ceil(rows * row_bytes / TASK_BYTES)))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
