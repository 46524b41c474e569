"""One micro-batch of each method against the state of the earlier batches.

Each step returns ``(dropped, new_state)``: ``dropped(pos, owner_pos)`` and the
rows to add to the state, both still to be written by the caller.  State is narrowed to the keys of the batch before
anything else, so a batch small enough to be sent out never shuffles the state.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bloom, exact, hybrid, minhash
from ..operators.first_match import select_first
from ..operators.skew import join_per_key
from ..operators.survivors import position
from ..params import Params
from ..workspace import Workspace

Step = Callable[[DataFrame, DataFrame, Params, Workspace], tuple[DataFrame, DataFrame]]


def exact_step(
    batch: DataFrame, state: DataFrame, params: Params, work: Workspace
) -> tuple[DataFrame, DataFrame]:
    """State ``(fp, pos)``: the first row of every text so far."""
    prints = work.table(exact.fingerprints(batch, params), "fingerprints")
    firsts = work.table(
        prints.groupBy("fp").agg(F.min("pos").alias("first"), F.count("*").alias("n")), "firsts"
    )
    seen = state.join(firsts.select("fp"), "fp", "left_semi")
    owners = work.table(
        firsts.join(seen, "fp", "left").select(
            "fp", "n", "first", F.coalesce("pos", "first").alias("owner_pos"),
            F.col("pos").isNull().alias("is_new"),
        ),
        "owners",
    )
    copied = owners.filter((F.col("n") > 1) | ~F.col("is_new")).select("fp", "n", "owner_pos")
    dropped = (
        join_per_key(prints, copied, ["fp"], "n", "pos", params.hot_rows)
        .filter(F.col("pos") != F.col("owner_pos"))
        .select("pos", "owner_pos")
    )
    return dropped, owners.filter("is_new").select("fp", F.col("first").alias("pos"))


def _bloom_step(
    prints: DataFrame, batch: DataFrame, state: DataFrame, params: Params, work: Workspace
) -> tuple[DataFrame, DataFrame]:
    """State ``(bucket, bits)``: the bits that each batch set first, as bitmaps."""
    setters = work.table(bloom.first_setters(prints, params.bloom()), "setters")
    buckets = setters.select(bloom.bucket_of(F.col("bit"))).distinct()
    seen = bloom.merged(state.join(buckets, "bucket", "left_semi"))
    fresh = work.table(bloom.unset(setters, seen), "fresh-bits")
    kept = fresh.select(F.col("first_pos").alias("pos")).distinct()
    dropped = batch.select(position(params)).join(kept, "pos", "left_anti")
    return (
        dropped.select("pos", F.lit(None).cast("bigint").alias("owner_pos")), bloom.packed(fresh)
    )


def bloom_step(
    batch: DataFrame, state: DataFrame, params: Params, work: Workspace
) -> tuple[DataFrame, DataFrame]:
    return _bloom_step(bloom.fingerprints(batch, params), batch, state, params, work)


def hybrid_step(
    batch: DataFrame, state: DataFrame, params: Params, work: Workspace
) -> tuple[DataFrame, DataFrame]:
    return _bloom_step(hybrid.fingerprints(batch, params), batch, state, params, work)


def minhash_step(
    batch: DataFrame, state: DataFrame, params: Params, work: Workspace
) -> tuple[DataFrame, DataFrame]:
    """State ``(bucket, pos)``: the buckets of every kept row, each held by one row."""
    bucketed = minhash.buckets(batch, params, work)
    pairs = bucketed.select("pos", F.explode(F.array_distinct("buckets")).alias("bucket"))
    wanted = pairs.groupBy("bucket").agg(F.count("*").alias("n"))
    held = work.table(
        state.select("bucket", F.col("pos").alias("owner_pos")).join(wanted, "bucket"), "held"
    )
    matched = work.table(
        join_per_key(pairs, held, ["bucket"], "n", "pos", params.hot_rows)
        .groupBy("pos")
        .agg(F.min("owner_pos").alias("owner_pos")),
        "matched",
    )
    open_rows = work.table(bucketed.join(matched, "pos", "left_anti"), "open-rows")
    chosen = select_first(
        open_rows, work, hot_rows=params.hot_rows, plain_rounds=params.plain_rounds
    )
    kept = open_rows.join(chosen.dropped, "pos", "left_anti")
    return (
        matched.unionByName(chosen.dropped),
        kept.select(F.explode(F.array_distinct("buckets")).alias("bucket"), "pos"),
    )


STEPS: dict[str, tuple[Step, str]] = {
    "exact": (exact_step, "fp binary, pos bigint"),
    "bloomfilter": (bloom_step, bloom.PACKED),
    "minhash_bloom_hybrid": (hybrid_step, bloom.PACKED),
    "minhash": (minhash_step, "bucket binary, pos bigint"),
}

#: How rows of several batches with this state can be brought into fewer.
MERGES: dict[str, Callable[[DataFrame], DataFrame]] = {bloom.PACKED: bloom.merged}


def register_step(name: str, step: Step, state_schema: str) -> None:
    """Make a method of one's own run in streams: its step and the columns of its state.

    The step sees the state rows that earlier micro-batches added, and returns the rows to drop
    and those to add.  It must not depend on anything else, so that a batch can be repeated.
    """
    STEPS[name] = (step, state_schema)
