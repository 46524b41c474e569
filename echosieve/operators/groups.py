"""Duplicate groups: sizes, ranks within a group, texts of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import block_of
from ..functions.text import sample
from ..params import PAIRS_PER_CHUNK, Params
from ..workspace import Workspace
from .running import running_totals
from .skew import join_per_key
from .survivors import columns_of, keep, position, unused

# A list of positions up to this size, counted first, is sent to every task.
SENT_BYTES, POSITION_BYTES = 64 << 20, 16


def group_sizes(dropped: DataFrame) -> DataFrame:
    """``(owner_pos, group_size)``: the kept row and all it stands for."""
    return dropped.groupBy("owner_pos").agg((F.count("*") + 1).alias("group_size"))


def sized_pairs(dropped: DataFrame, params: Params, work: Workspace) -> DataFrame:
    """``dropped`` plus ``group_size``, joined in shares before any text is at hand."""
    sizes = work.table(group_sizes(dropped), "group-sizes")
    return work.table(
        join_per_key(dropped, sizes, ["owner_pos"], "group_size", "pos", params.hot_rows),
        "sized-pairs",
    )


def top_groups(df: DataFrame, dropped: DataFrame, params: Params) -> DataFrame:
    """The largest groups with the head of their first text; ties by position."""
    largest = (
        group_sizes(dropped)
        .orderBy(F.desc("group_size"), "owner_pos")
        .limit(params.top_n_duplicates)
    )
    texts = df.select(
        position(params).alias("owner_pos"), F.col(params.text_column).alias("_text")
    )
    return (
        texts.join(largest, "owner_pos")
        .select("owner_pos", "group_size", sample(F.col("_text")).alias("text_sample"))
        .orderBy(F.desc("group_size"), "owner_pos")
    )


def with_duplicate_count(
    df: DataFrame, dropped: DataFrame, params: Params, work: Workspace
) -> DataFrame:
    """Surviving rows with the number of rows each of them stands for."""
    kept = keep(df, dropped, params)
    owner, copies = unused("_owner", kept), unused("_copies", kept)
    # Written, so that the planner sees its size before it meets the payload.
    sizes = work.table(
        group_sizes(dropped).select(
            F.col("owner_pos").alias(owner), (F.col("group_size") - 1).alias(copies)
        ),
        "copies",
    )
    return kept.join(sizes, F.col(params.order_column) == F.col(owner), "left").select(
        *columns_of(kept), F.coalesce(F.col(copies), F.lit(0)).alias("duplicate_count")
    )


def ordinals(dropped: DataFrame) -> DataFrame:
    """``(pos, owner_pos, ordinal)``: 1 for the first copy of an owner, and so on."""
    return running_totals(
        dropped.select("pos", "owner_pos", F.lit(1).cast("bigint").alias("_one")),
        "pos", {"ordinal": "_one"}, group=("owner_pos",),
    ).drop("_one")


def with_shifted_duplicate_count(
    df: DataFrame, dropped: DataFrame, params: Params, work: Workspace
) -> DataFrame:
    """Surviving rows with the count in its old, shifted alignment.

    The i-th surviving row of a chunk gets the ordinal of the i-th row of the
    chunk, which is 0 when that row survives itself.
    """
    in_chunk = Window.partitionBy("_chunk").orderBy("pos")  # at most chunk_size rows
    rows = work.table(
        df.select(position(params))
        .join(ordinals(dropped).select("pos", "ordinal"), "pos", "left")
        .withColumn("_chunk", block_of(F.col("pos"), params.chunk_size))
        .withColumn("_at", F.row_number().over(in_chunk)),
        "chunk-rows",
    )
    kept_at = F.count(F.when(F.col("ordinal").isNull(), 1)).over(in_chunk)
    kept = rows.withColumn("_at", kept_at).filter(F.col("ordinal").isNull())
    survivors = keep(df, dropped, params)
    at, count = unused("_pos", survivors), unused("_count", survivors)
    # Most counts are 0; only the others, a few per cent of the rows, meet the payload.
    counts = work.table(
        kept.select(F.col("pos").alias("_pos"), "_chunk", "_at").join(
            rows.filter("ordinal > 0").select("_chunk", "_at", "ordinal"), ["_chunk", "_at"]
        ).select(F.col("_pos").alias(at), F.col("ordinal").alias(count)),
        "shifted-counts",
    )
    return survivors.join(counts, F.col(params.order_column) == F.col(at), "left").select(
        *columns_of(survivors), F.coalesce(F.col(count), F.lit(0)).alias("duplicate_count")
    )


def pair_texts(
    df: DataFrame, pairs: DataFrame, params: Params, work: Workspace
) -> DataFrame:
    """Add ``owner_text`` and ``text`` to ``pairs(pos, owner_pos, …)``.

    ``pairs`` is a written table.  The corpus is read once, for owners and copies
    together, and only rows of some pair go on.  Which rows those are is a written
    table of positions, so the planner can send it to the scan if it is small; if
    not, the corpus is shuffled on the position once.  An owner with very many
    copies is joined in shares, see ``join_per_key``.
    """
    wanted = work.table(
        pairs.select("pos").unionAll(pairs.select(F.col("owner_pos").alias("pos"))).distinct(),
        "pair-positions",
    )
    if wanted.count() * POSITION_BYTES <= SENT_BYTES:
        wanted = F.broadcast(wanted)
    texts = work.table(
        df.select(position(params), F.col(params.text_column).alias("text")).join(
            wanted, "pos", "left_semi"
        ),
        "pair-texts",
    )
    sizes = pairs.groupBy("owner_pos").agg(F.count("*").alias("_n"))
    owners = texts.select(F.col("pos").alias("owner_pos"), F.col("text").alias("owner_text")).join(
        sizes, "owner_pos"
    )
    with_owner = join_per_key(pairs, owners, ["owner_pos"], "_n", "pos", params.hot_rows)
    return with_owner.drop("_n").join(texts, "pos")


def pair_sample(
    df: DataFrame, dropped: DataFrame, params: Params, work: Workspace,
    per_chunk: int = PAIRS_PER_CHUNK,
) -> DataFrame:
    """The first pairs of every chunk: ``(chunk, pos, owner_pos, owner_text, text, parameter)``."""
    in_chunk = Window.partitionBy("chunk").orderBy("pos")  # at most chunk_size rows
    parameter = "1.0" if params.method == "exact" else str(params.minhash_threshold)
    first = work.table(
        dropped.filter(F.col("owner_pos").isNotNull())
        .withColumn("chunk", block_of(F.col("pos"), params.chunk_size))
        .withColumn("_at", F.row_number().over(in_chunk))
        .filter(F.col("_at") <= per_chunk)
        .drop("_at"),
        "pair-sample",
    )
    return pair_texts(df, first, params, work).withColumn("parameter", F.lit(parameter))
