"""Near copies: MinHash signatures, bands, and first-come selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.minhash import text_buckets, text_signature
from ..functions.text import required_text
from ..params import Params
from ..workspace import Workspace
from .first_match import Selection, select_first
from .survivors import text_rows


def signatures(df: DataFrame, params: Params) -> DataFrame:
    """``(pos, sig)``"""
    rows = text_rows(df, required_text(params.text_column), params)
    return rows.select(
        "pos", text_signature(F.col("text"), params.minhash_num_hashes).alias("sig")
    )


def buckets(df: DataFrame, params: Params, work: Workspace) -> DataFrame:
    """Written ``(pos, buckets)``, so that signatures are computed once."""
    rows = text_rows(df, required_text(params.text_column), params)
    return work.table(
        rows.select("pos", text_buckets(F.col("text"), params.bands()).alias("buckets")), "buckets"
    )


def selection(df: DataFrame, params: Params, work: Workspace) -> Selection:
    return select_first(
        buckets(df, params, work), work, hot_rows=params.hot_rows,
        plain_rounds=params.plain_rounds,
    )


def dropped(df: DataFrame, params: Params, work: Workspace) -> DataFrame:
    """``(pos, owner_pos)`` with the lowest kept row that shares a bucket."""
    return selection(df, params, work).dropped
