"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SENT_KEYS = 50_000  # a few MB with 16-byte keys


def _shares(n: Column, hot_rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(hot_rows))).cast("int")


def spread_join(
    rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, spread: str, hot_rows: int
) -> DataFrame:
    """Inner join of many rows per key with one row per key.

    Both sides carry ``n``, the number of rows of the key.  A key with more than
    ``hot_rows`` rows is dealt out over ``ceil(n / hot_rows)`` shuffle groups, and
    its one partner row is repeated once per group.
    """
    dealt = rows.withColumn(
        "_share", F.pmod(F.xxhash64(spread), _shares(F.col(n), hot_rows)).cast("int")
    )
    copies = per_key.withColumn(
        "_share", F.explode(F.sequence(F.lit(0), _shares(F.col(n), hot_rows) - 1))
    ).drop(n)
    return dealt.join(copies, [*keys, "_share"]).drop("_share")


def join_per_key(
    rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, spread: str, hot_rows: int
) -> DataFrame:
    """As ``spread_join`` when only ``per_key``, a written table, knows ``n``; ``n`` is kept.

    The hot keys are counted first.  Without any this is a plain join; up to ``SENT_KEYS``
    of them are sent to every task, more are looked up by a join of their own.
    """
    hot = per_key.filter(F.col(n) > hot_rows).select(*keys, F.col(n).alias("_n"))
    count = hot.count()
    if count == 0:
        return rows.join(per_key, keys)
    known = rows.join(F.broadcast(hot) if count <= SENT_KEYS else hot, keys, "left")
    dealt = known.withColumn(
        "_share",
        F.pmod(F.xxhash64(spread), _shares(F.coalesce("_n", F.lit(1)), hot_rows)).cast("int"),
    ).drop("_n")
    copies = per_key.withColumn(
        "_share", F.explode(F.sequence(F.lit(0), _shares(F.col(n), hot_rows) - 1))
    )
    return dealt.join(copies, [*keys, "_share"]).drop("_share")
