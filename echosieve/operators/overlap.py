"""Which methods agree on which rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def method_overlap(dropped: dict[str, DataFrame]) -> DataFrame:
    """Rows dropped by each combination of methods: ``(by_<name>…, documents)``."""
    flagged = reduce(
        DataFrame.unionByName,
        [
            rows.select("pos", *[F.lit(name == other).alias(f"by_{other}") for other in dropped])
            for name, rows in dropped.items()
        ],
    )
    flags = [f"by_{name}" for name in dropped]
    per_row = flagged.groupBy("pos").agg(*[F.max(flag).alias(flag) for flag in flags])
    return per_row.groupBy(*flags).agg(F.count("*").alias("documents"))
