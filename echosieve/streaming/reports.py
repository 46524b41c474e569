"""Reports of a stream, out of what each step adds to them.

A step writes which rows it dropped for which kept ones and the first pairs of its chunks; a
report sums these over all whole steps when it is read, so a row that was kept long ago shows the
copies that came since, and no step rewrites another's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sample
from ..operators import bloom, metrics
from ..operators.running import running_totals
from ..operators.survivors import columns_of, unused
from ..params import Params
from ..workspace import Workspace
from .runner import StreamFolders, batch_counts, first_of_chunks, kept_rows, read_whole


def copies(spark: SparkSession, folders: StreamFolders) -> DataFrame:
    """``(owner_pos, copies)`` of all steps so far."""
    return read_whole(spark, folders.dropped(), folders).filter(
        "owner_pos is not null"
    ).groupBy("owner_pos").agg(F.count(F.lit(1)).alias("copies"))


def with_duplicate_count(
    spark: SparkSession, params: Params, folders: StreamFolders, work: Workspace
) -> DataFrame:
    """The kept rows with the number of rows each of them stands for by now."""
    rows = kept_rows(spark, folders)
    owner, count = unused("owner", rows), unused("copies", rows)
    sizes = work.table(copies(spark, folders).toDF(owner, count), "copies")
    return rows.join(sizes, F.col(params.order_column) == F.col(owner), "left").select(
        *columns_of(rows), F.coalesce(F.col(count), F.lit(0)).alias("duplicate_count")
    )


def top_groups(spark: SparkSession, params: Params, folders: StreamFolders) -> DataFrame:
    """The largest groups with the head of their first text; ties by position."""
    largest = copies(spark, folders).select(
        "owner_pos", (F.col("copies") + 1).alias("group_size")
    ).orderBy(F.desc("group_size"), "owner_pos").limit(params.top_n_duplicates)
    texts = kept_rows(spark, folders).select(
        F.col(params.order_column).cast("bigint").alias("owner_pos"),
        sample(F.col(params.text_column)).alias("text_sample"),
    )
    # At most ``top_n_duplicates`` rows are sent.
    return texts.join(F.broadcast(largest), "owner_pos").select(
        "owner_pos", "group_size", "text_sample"
    ).orderBy(F.desc("group_size"), "owner_pos")


def pair_sample(
    spark: SparkSession, params: Params, folders: StreamFolders, work: Workspace
) -> DataFrame:
    """The first pairs of every chunk of rows:
    ``(chunk, pos, owner_pos, owner_text, text, parameter)``.

    An owner is a kept row, so its text is looked up among these.
    """
    parameter = "1.0" if params.method == "exact" else str(params.minhash_threshold)
    stored = read_whole(spark, folders.pairs(), folders).drop("batch")
    first = work.table(first_of_chunks(stored, params), "pair-sample")
    owners = kept_rows(spark, folders).select(
        F.col(params.order_column).cast("bigint").alias("owner_pos"),
        F.col(params.text_column).cast("string").alias("owner_text"),
    )
    wanted = work.table(first.select("owner_pos").distinct(), "owners")
    found = work.table(owners.join(wanted, "owner_pos", "left_semi"), "owner-texts")
    return first.join(found, "owner_pos").select(
        "chunk", "pos", "owner_pos", "owner_text", "text", F.lit(parameter).alias("parameter")
    )


def final_summary(spark: SparkSession, params: Params, folders: StreamFolders) -> DataFrame:
    """One row of totals over all chunks so far."""
    counts = batch_counts(spark, folders)
    return metrics.final_summary(counts, metrics.method_metrics(params.method, counts))


def saturation(
    spark: SparkSession, params: Params, folders: StreamFolders, work: Workspace
) -> DataFrame:
    """``(step, processed_docs, bits_set, bloom_saturation, bloom_saturation_percent)``.

    One row per step: the filter after it.  A step adds only bits that no earlier one set.
    """
    m = params.bloom().m
    state = read_whole(spark, folders.state(params), folders)
    fresh = state.groupBy("batch").agg(bloom.bits_set().alias("fresh"))
    rows = read_whole(spark, folders.counts(), folders).groupBy("batch").agg(
        F.sum("original").alias("original")
    )
    steps = work.table(rows.join(fresh, "batch", "left").select(
        F.col("batch").alias("step"), "original", F.coalesce("fresh", F.lit(0)).alias("fresh")
    ), "saturation-steps")
    share = F.col("bits_set") / F.lit(m)
    totals = {"processed_docs": "original", "bits_set": "fresh"}
    return running_totals(steps, "step", totals).select(
        "step", "processed_docs", "bits_set", share.alias("bloom_saturation"),
        (share * 100).alias("bloom_saturation_percent"),
    )
