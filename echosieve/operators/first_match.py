"""First-come selection over shared buckets, in parallel rounds.

Rule: in order of position, a row is kept unless it shares a bucket with a row
kept before it.  That is the lexicographically first maximal independent set of
the "shares a bucket" graph (parallel rounds: Blelloch, Fineman and Shun, SPAA
2012).  The graph is never built: all work is on ``(pos, bucket)`` rows, so a
bucket of any size costs time in proportion to its rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import block_of
from ..workspace import Workspace
from .skew import join_per_key, spread_join

# So many undecided rows of a component, the lowest ones, are settled in one task at a time.
COMPONENT_ROWS = 10_000
# The cut between them and the others falls between blocks of this share of them.
BLOCKS = 4


@dataclass(frozen=True)
class Selection:
    """``dropped(pos, owner_pos)`` and every kept row each of them ``matches``."""

    dropped: DataFrame
    matches: DataFrame


def select_first(
    bucketed: DataFrame, work: Workspace, hot_rows: int, plain_rounds: int,
    component_rows: int = COMPONENT_ROWS,
) -> Selection:
    """Apply the rule to a written table ``(pos, buckets)``."""
    pairs = bucketed.select("pos", F.explode(F.array_distinct("buckets")).alias("bucket"))
    # A bucket of one row decides nothing; most rows end here and are kept.
    shared = work.table(
        pairs.groupBy("bucket")
        .agg(F.min("pos").alias("lo"), F.count("*").alias("n"))
        .filter(F.col("n") > 1),
        "shared-buckets",
    )
    edges = work.table(
        join_per_key(pairs, shared, ["bucket"], "n", "pos", hot_rows).select(
            "pos", "bucket", "n", "lo"
        ),
        "edges",
    )
    kept = _rounds(edges, work, hot_rows, plain_rounds, component_rows)
    return _with_owners(edges, kept, work, hot_rows)


def _rounds(
    edges: DataFrame, work: Workspace, hot_rows: int, plain_rounds: int, component_rows: int
) -> DataFrame:
    """Kept rows among those with a shared bucket."""
    kept, still = [], edges
    for _ in range(plain_rounds):
        first, still = _round(still, work, hot_rows)
        kept.append(first)
        if still.isEmpty():
            return reduce(DataFrame.unionAll, kept)
    # Long dependency chains: one round per link would be slow.  A step settles the lowest
    # rows of each component in order, and one more round of all the others.
    labels = _components(still, work, hot_rows)
    still = work.table(still.join(labels, "pos"), "components")
    while True:
        first, still = _lowest_of_components(still, work, hot_rows, component_rows)
        kept.append(first)
        if still.isEmpty():
            return reduce(DataFrame.unionAll, kept)
        first, still = _round(still, work, hot_rows)
        kept.append(first)
        if still.isEmpty():
            return reduce(DataFrame.unionAll, kept)


def _round(still: DataFrame, work: Workspace, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(kept, undecided)`` after the rows that lead all their buckets are kept."""
    if "lo" not in still.columns:
        lowest = still.groupBy("bucket", "n").agg(F.min("pos").alias("lo"))
        still = work.table(
            spread_join(still, lowest, ["bucket"], "n", "pos", hot_rows), "open"
        )
    first = work.table(
        still.groupBy("pos")
        .agg(F.every(F.col("lo") == F.col("pos")).alias("leads"))
        .filter("leads")
        .select("pos"),
        "kept",
    )
    taken = (
        still.filter(F.col("lo") == F.col("pos"))
        .join(first, "pos", "left_semi")
        .select("bucket", "n")
    )
    return first, _without_matches(still.drop("lo"), taken, work, hot_rows)


def _without_matches(
    still: DataFrame, taken: DataFrame, work: Workspace, hot_rows: int
) -> DataFrame:
    """The rows of ``still`` that are in none of the buckets ``taken(bucket, n)``."""
    pairs = still.select("pos", "bucket", "n")
    decided = spread_join(pairs, taken, ["bucket"], "n", "pos", hot_rows).select("pos").distinct()
    return work.table(still.join(decided, "pos", "left_anti"), "undecided")


def _with_owners(
    edges: DataFrame, kept: DataFrame, work: Workspace, hot_rows: int
) -> Selection:
    rows = edges.select("pos", "bucket", "n")
    # Two kept rows never share a bucket, so a bucket has at most one owner.
    owners = rows.join(kept, "pos", "left_semi").select(
        "bucket", "n", F.col("pos").alias("owner_pos")
    )
    matches = work.table(
        spread_join(rows, owners, ["bucket"], "n", "pos", hot_rows)
        .filter(F.col("owner_pos") < F.col("pos"))
        .select("pos", "owner_pos")
        .distinct(),
        "matches",
    )
    dropped = work.table(
        matches.groupBy("pos").agg(F.min("owner_pos").alias("owner_pos")), "dropped"
    )
    return Selection(dropped, matches)


def _components(still: DataFrame, work: Workspace, hot_rows: int) -> DataFrame:
    """``(pos, label)``: the lowest position of the row's connected component.

    Lowest-label steps over the buckets, each followed by a jump to the label of
    the label, so a chain of L rows takes about log L steps.
    """
    labels = still.select("pos").distinct().withColumn("label", F.col("pos"))
    while True:
        labelled = still.join(labels, "pos")
        lowest = labelled.groupBy("bucket", "n").agg(F.min("label").alias("low"))
        stepped = work.table(
            spread_join(labelled, lowest, ["bucket"], "n", "pos", hot_rows)
            .groupBy("pos")
            .agg(F.min("low").alias("label"), F.max(F.col("low") < F.col("label")).alias("moved")),
            "labels",
        )
        if stepped.filter("moved").isEmpty():
            return stepped.select("pos", "label")
        sizes = stepped.groupBy("label").agg(F.count("*").alias("n"))
        targets = work.table(
            sizes.join(
                stepped.select(F.col("pos").alias("label"), F.col("label").alias("next")), "label"
            ),
            "label-targets",
        )
        labels = work.table(
            join_per_key(
                stepped.select("pos", "label"), targets, ["label"], "n", "pos", hot_rows
            ).select("pos", F.col("next").alias("label")),
            "labels-jumped",
        )


def _lowest_of_components(
    still: DataFrame, work: Workspace, hot_rows: int, component_rows: int
) -> tuple[DataFrame, DataFrame]:
    """``(kept, undecided)`` after the lowest rows of every component were settled in order.

    What a row's fate depends on lies below it in its component, so the lowest
    ``component_rows`` rows can be scanned without the others.  Where they end follows from
    counts per block of positions; a block holds no more rows than positions.
    """
    width = max(1, component_rows // BLOCKS)
    block = block_of(F.col("pos"), width)
    docs = still.groupBy("label", "pos").agg(F.count(F.lit(1)).alias("own"))
    blocks = docs.groupBy("label", block.alias("block")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("own").alias("own")
    )
    upwards = Window.partitionBy("label").orderBy("block")
    # A row per block of positions that the component has rows in.
    cuts = work.table(
        blocks.select(
            "label", "block", F.sum("docs").over(upwards).alias("below"), "own",
            F.row_number().over(upwards).alias("nth"),
        ).groupBy("label").agg(
            F.max(F.when(
                (F.col("below") <= component_rows) | (F.col("nth") == 1), F.col("block")
            )).alias("last"),
            F.sum("own").alias("rows"),
        ),
        "cuts",
    )
    marked = work.table(
        join_per_key(still, cuts, ["label"], "rows", "pos", hot_rows).select(
            *still.columns, (block <= F.col("last")).alias("low")
        ),
        "marked",
    )
    low = marked.filter("low").drop("low")
    kept = _settle(low, work)
    taken = low.join(kept, "pos", "left_semi").select("bucket", "n").distinct()
    return kept, _without_matches(marked.filter("not low").drop("low"), taken, work, hot_rows)


def _settle(low: DataFrame, work: Workspace) -> DataFrame:
    """Kept rows of the lowest ones of each component, scanned in order in one task."""

    def scan(part):
        import pandas as pd

        taken, kept = set(), []
        for pos, own in part.sort_values("pos").groupby("pos")["bucket"]:
            if taken.isdisjoint(own):
                taken.update(own)
                kept.append(pos)
        return pd.DataFrame({"pos": pd.Series(kept, dtype="int64")})

    return work.table(
        low.select("label", "pos", "bucket").groupBy("label").applyInPandas(scan, "pos bigint"),
        "kept",
    )
