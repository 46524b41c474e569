"""Running totals without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import block_of

BLOCK = 1_000_000


def running_totals(
    df: DataFrame, order: str, totals: dict[str, str], group: tuple[str, ...] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Add ``name = running sum of column`` for every item of ``totals``.

    ``order`` is an integer that is unique within ``group``, so a block of
    ``block`` consecutive values holds at most that many rows.  Sums run inside
    each block; only one row per block is ordered across blocks.
    """
    keys = [*group, "_block"]
    blocked = df.withColumn("_block", block_of(F.col(order), block))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        blocked.groupBy(*keys)
        .agg(*[F.sum(col).alias(f"_sum_{name}") for name, col in totals.items()])
        .select(
            *keys,
            *[
                F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_off_{name}")
                for name in totals
            ],
        )
    )
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.select(
        "*", *[F.sum(col).over(inside).alias(f"_in_{name}") for name, col in totals.items()]
    ).join(offsets, keys)
    return summed.select(
        *df.columns,
        *[(F.col(f"_in_{name}") + F.col(f"_off_{name}")).alias(name) for name in totals],
    )
