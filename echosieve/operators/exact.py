"""Exact copies: the first row of every text survives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_key
from ..functions.text import required_text
from ..params import Params
from ..sources.readers import join_positions, position_index
from ..workspace import Workspace
from .skew import join_per_key
from .survivors import keep, position, unused


def fingerprints(df: DataFrame, params: Params) -> DataFrame:
    """``(pos, fp)``: the text is read once and not carried further."""
    return df.select(position(params), md5_key(required_text(params.text_column)).alias("fp"))


def kept_positions(df: DataFrame, params: Params) -> DataFrame:
    """Positions of the survivors: one partial and one final aggregate."""
    return fingerprints(df, params).groupBy("fp").agg(F.min("pos").alias("pos")).select("pos")


def copy_groups(prints: DataFrame, work: Workspace) -> DataFrame:
    """``(fp, owner_pos, n)`` of every text that occurs more than once."""
    return work.table(
        prints.groupBy("fp")
        .agg(F.min("pos").alias("owner_pos"), F.count("*").alias("n"))
        .filter(F.col("n") > 1),
        "copy-groups",
    )


def dropped(df: DataFrame, params: Params, work: Workspace) -> DataFrame:
    """``(pos, owner_pos)`` of every later copy and the row it copies.

    The fingerprints, 24 bytes a row, are written, so the text is read and hashed once.
    """
    prints = work.table(fingerprints(df, params), "fingerprints")
    return dropped_by(prints, params, work)


def dropped_by(prints: DataFrame, params: Params, work: Workspace) -> DataFrame:
    """The same from written ``prints(pos, fp)``."""
    groups = copy_groups(prints, work)
    members = join_per_key(prints, groups, ["fp"], "n", "pos", params.hot_rows)
    return work.table(
        members.filter(F.col("pos") != F.col("owner_pos")).select("pos", "owner_pos"),
        "dropped",
    )


def kept_in_order_of(
    df: DataFrame, order_by: list[str], params: Params, work: Workspace
) -> DataFrame:
    """The survivors among rows in order of a unique sort key, numbered as ``order_column``.

    Rows without positions need not be sorted to be de-duplicated: only keys and fingerprints
    are, and the numbers of the survivors meet their rows at the end.
    """
    name = params.order_column
    fp = unused("_fp", df)
    narrow = df.select(
        *[F.col(c) for c in order_by], md5_key(required_text(params.text_column)).alias(fp)
    )
    index = work.table(position_index(narrow, order_by, work, name), "positions")
    gone = dropped_by(index.select(F.col(name).alias("pos"), F.col(fp).alias("fp")), params, work)
    survivors = work.table(keep(index.drop(fp), gone, params), "kept-positions")
    return join_positions(df, survivors, order_by, name)
