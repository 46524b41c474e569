"""Bloom-filter de-duplication, false positives included, without a scan in order.

A row that a sequential filter drops sets no new bit.  The bits set before a row
are therefore the bits of *all* earlier rows, and a row survives exactly when it
is the first to set at least one of its bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bloom_bits, sha256_hex
from ..functions.numbers import block_of
from ..functions.text import lenient_text
from ..params import BloomShape, Params
from ..workspace import Workspace
from .running import running_totals
from .survivors import position


def fingerprints(df: DataFrame, params: Params) -> DataFrame:
    """``(pos, fp)`` from the key column when there is one, else the text."""
    return df.select(
        position(params), sha256_hex(lenient_text(params.key or params.text_column)).alias("fp")
    )


def first_setters(prints: DataFrame, shape: BloomShape) -> DataFrame:
    """``(bit, first_pos)``: the filled filter as a relation of at most m rows.

    A later row of one fingerprint sets nothing, so only the first gets its bits
    computed, and a text that a third of the rows share sends one row on per task.
    """
    # The digest is moved as 32 bytes, not as 64 characters.
    firsts = prints.groupBy(F.unhex("fp").alias("fp")).agg(F.min("pos").alias("pos"))
    spelt = firsts.select("pos", F.lower(F.hex("fp")).alias("fp"))
    return (
        bloom_bits(spelt, "fp", shape).groupBy("bit").agg(F.min("pos").alias("first_pos"))
    )


def kept_positions(prints: DataFrame, shape: BloomShape) -> DataFrame:
    return first_setters(prints, shape).select(F.col("first_pos").alias("pos")).distinct()


def dropped(df: DataFrame, params: Params, work: Workspace) -> DataFrame:
    """``(pos, owner_pos)``; a Bloom filter knows no owner, so that one is null."""
    return dropped_by(fingerprints(df, params), df, params, work)


def dropped_by(
    prints: DataFrame, df: DataFrame, params: Params, work: Workspace
) -> DataFrame:
    kept = kept_positions(prints, params.bloom())
    gone = df.select(position(params)).join(kept, "pos", "left_anti")
    return work.table(
        gone.select("pos", F.lit(None).cast("bigint").alias("owner_pos")), "dropped"
    )


def contains(probe: DataFrame, ids: list[str], setters: DataFrame, shape: BloomShape) -> DataFrame:
    """Add ``is_member`` to ``probe(ids…, fp)``: no bit of the row is unset.

    Bits are looked up once per distinct fingerprint; ``ids`` stay in the rows.
    """
    prints = probe.select(F.col("fp").alias("_fp"), "fp").distinct()
    wanted = bloom_bits(prints, "fp", shape)
    missing = wanted.join(setters.select("bit"), "bit", "left_anti").select("_fp").distinct()
    return probe.join(missing, F.col("fp") == F.col("_fp"), "left").select(
        *probe.columns, F.col("_fp").isNull().alias("is_member")
    )


# --- the filter packed into bitmaps ------------------------------------------------------

PACKED = "bucket bigint, bits binary"
#: Fixed value: how many bits one bitmap of Spark's holds.
BITMAP_BITS = 1 << 15


def bucket_of(bit: Column) -> Column:
    return block_of(bit, BITMAP_BITS).alias("bucket")


def packed(bits: DataFrame) -> DataFrame:
    """``(bucket, bits)`` of ``bits(bit, …)``: a binary row per 32,768 bits instead of a row per
    bit.  Bits may be repeated."""
    return bits.groupBy(bucket_of(F.col("bit"))).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(BITMAP_BITS))).alias("bits")
    )


def merged(filters: DataFrame) -> DataFrame:
    """One filter out of the bitmaps of several over the same bits."""
    return filters.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bits_set() -> Column:
    """Aggregate over the bitmaps of one filter: how many of its bits are set."""
    return F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))


def is_set(bits: Column, bit: Column) -> Column:
    """Whether ``bit`` is set in the bitmap of its bucket; null without one."""
    at = F.pmod(bit, F.lit(BITMAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    # The lowest bit of a byte comes first.
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1


def unset(wanted: DataFrame, filter_: DataFrame) -> DataFrame:
    """The rows of ``wanted(bit, …)`` whose bit is not set in a filter of one row per bucket.

    A bucket has at most 32,768 bits, so no key of the join is hot as long as ``wanted`` names
    each bit only a few times.
    """
    keyed = wanted.withColumn("bucket", bucket_of(F.col("bit")))
    return keyed.join(filter_, "bucket", "left").filter(
        ~F.coalesce(is_set(F.col("bits"), F.col("bit")), F.lit(False))
    ).select(*wanted.columns)


def contains_packed(
    probe: DataFrame, ids: list[str], filter_: DataFrame, shape: BloomShape, work: Workspace
) -> DataFrame:
    """As ``contains``, with the filter as bitmaps."""
    prints = probe.select(F.col("fp").alias("_fp"), "fp").distinct()
    wanted = work.table(bloom_bits(prints, "fp", shape), "wanted-bits")
    missing_bits = unset(wanted.select("bit").distinct(), filter_)
    missing = wanted.join(missing_bits, "bit", "left_semi").select("_fp").distinct()
    return probe.join(missing, F.col("fp") == F.col("_fp"), "left").select(
        *ids, "fp", F.col("_fp").isNull().alias("is_member")
    )


def saturation(
    prints: DataFrame, shape: BloomShape, every: int, work: Workspace
) -> DataFrame:
    """``(step, processed_docs, bits_set, bloom_saturation, bloom_saturation_percent)``.

    One row per ``every`` positions: the filter after that many rows.
    """
    seen = prints.groupBy(block_of(F.col("pos"), every).alias("step")).agg(
        F.count("*").alias("_rows")
    )
    fresh = first_setters(prints, shape).groupBy(
        block_of(F.col("first_pos"), every).alias("step")
    ).agg(F.count("*").alias("_bits"))
    steps = work.table(
        seen.join(fresh, "step", "left").select(
            "step", "_rows", F.coalesce("_bits", F.lit(0)).alias("_bits")
        ),
        "saturation-steps",
    )
    share = F.col("bits_set") / F.lit(shape.m)
    return running_totals(steps, "step", {"processed_docs": "_rows", "bits_set": "_bits"}).select(
        "step", "processed_docs", "bits_set",
        share.alias("bloom_saturation"),
        (share * 100).alias("bloom_saturation_percent"),
    )
