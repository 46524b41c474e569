"""Chunk, running and final metrics, computed from positions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import block_of
from ..params import Params
from .running import running_totals
from .survivors import position

# The names of all metric columns and labels in this module, and the
# method metrics that are passed on to the metrics sink.
LOGGED_METRICS = (
    "processed_total", "chunk_kept", "chunk_duplicates",
    "global_unique", "global_duplicates", "duplicate_ratio",
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def chunk_counts(df: DataFrame, dropped: DataFrame, params: Params) -> DataFrame:
    """``(chunk, original, kept, removed)`` with chunks counted from 0."""
    chunk = block_of(F.col("pos"), params.chunk_size).alias("chunk")
    original = df.select(position(params)).groupBy(chunk).agg(F.count("*").alias("original"))
    gone = dropped.groupBy(chunk).agg(F.count("*").alias("removed"))
    removed = F.coalesce("removed", F.lit(0))
    return original.join(gone, "chunk", "left").select(
        "chunk", "original", (F.col("original") - removed).alias("kept"),
        removed.alias("removed"),
    )


def chunk_metrics(counts: DataFrame) -> DataFrame:
    """One row per chunk, counted from 1."""
    return counts.select(
        (F.col("chunk") + 1).alias("chunk_index"),
        F.col("original").alias("chunk_original_count"),
        F.col("kept").alias("chunk_deduplicated_count"),
        F.col("removed").alias("chunk_duplicates_removed"),
        _ratio(F.col("kept"), F.col("original")).alias("chunk_compression_ratio"),
    )


def exact_metrics(counts: DataFrame) -> DataFrame:
    """Rows of this chunk against duplicates so far, so the ratio can exceed 1."""
    running = running_totals(counts, "chunk", {"duplicates": "removed"})
    return running.select(
        (F.col("chunk") + 1).alias("chunk_index"),
        F.col("original").alias("processed_total"),
        F.col("kept").alias("unique_docs"),
        "duplicates",
        (F.col("duplicates") / F.greatest(F.lit(1), "original")).alias("duplicate_ratio"),
    )


def minhash_metrics(counts: DataFrame) -> DataFrame:
    """Counts of this chunk and of all chunks so far."""
    running = running_totals(
        counts, "chunk",
        {"processed_total": "original", "global_unique": "kept", "global_duplicates": "removed"},
    )
    return running.select(
        (F.col("chunk") + 1).alias("chunk_index"),
        "processed_total",
        F.col("original").alias("chunk_size"),
        F.col("kept").alias("chunk_kept"),
        F.col("removed").alias("chunk_duplicates"),
        "global_unique",
        "global_duplicates",
        (F.col("global_duplicates") / F.greatest(F.lit(1), "processed_total")).alias(
            "duplicate_ratio"
        ),
    )


def method_metrics(method: str, counts: DataFrame) -> DataFrame | None:
    """The metrics a method reports; the Bloom methods report none."""
    return {"exact": exact_metrics, "minhash": minhash_metrics}.get(method, lambda _: None)(counts)


def logged(metrics: DataFrame) -> DataFrame:
    """The chunk number and those logged columns that the method has."""
    return metrics.select(
        "chunk_index", *[name for name in LOGGED_METRICS if name in metrics.columns]
    )


def final_summary(counts: DataFrame, metrics: DataFrame | None) -> DataFrame:
    """One row of totals; the mean ratio is 0 for methods without metrics."""
    parts = counts.select("original", "kept", "removed", F.lit(None).cast("double").alias("ratio"))
    if metrics is not None:
        none = F.lit(None).cast("bigint")
        parts = parts.unionAll(metrics.select(none, none, none, "duplicate_ratio"))
    totals = parts.agg(
        F.coalesce(F.sum("original"), F.lit(0)).alias("total_original_count"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("total_deduplicated_count"),
        F.coalesce(F.sum("removed"), F.lit(0)).alias("total_duplicates_removed"),
        F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("avg_duplicate_ratio"),
    )
    ratio = _ratio(F.col("total_deduplicated_count"), F.col("total_original_count"))
    return totals.select(
        "total_original_count", "total_deduplicated_count", "total_duplicates_removed",
        ratio.alias("total_compression_ratio"), "avg_duplicate_ratio",
    )


def unique_share(counts: DataFrame) -> DataFrame:
    """``(label, documents, percent)`` for the kept and the dropped part."""
    totals = counts.agg(
        F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"),
        F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"),
    )
    parts = totals.select(
        (F.col("kept") + F.col("removed")).alias("_all"),
        F.explode(
            F.create_map(F.lit("Unique"), F.col("kept"), F.lit("Duplicates"), F.col("removed"))
        ).alias("label", "documents"),
    )
    return parts.select(
        "label", "documents", (_ratio(F.col("documents"), F.col("_all")) * 100).alias("percent")
    )


def compression_trend(counts: DataFrame) -> DataFrame:
    """Rows before and after, by chunk."""
    return counts.select(
        (F.col("chunk") + 1).alias("chunk_index"),
        F.col("original").alias("original_count"),
        F.col("kept").alias("deduplicated_count"),
    ).orderBy("chunk_index")
