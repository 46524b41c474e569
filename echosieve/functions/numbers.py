"""Integer arithmetic on positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_of(position: Column, size: int) -> Column:
    """The block of ``size`` consecutive positions that a position lies in, from 0.

    Integer division: a quotient of doubles would be off above 2 ** 53.
    """
    return F.call_function("div", position.cast("bigint"), F.lit(size).cast("bigint"))
