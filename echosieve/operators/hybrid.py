"""A Bloom filter over whole MinHash signatures of word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha256_hex
from ..functions.minhash import signature, signature_text
from ..functions.text import blank_tokens, lenient_text, word_shingles
from ..params import Params
from ..workspace import Workspace
from . import bloom
from .survivors import text_rows


def words(df: DataFrame, params: Params) -> DataFrame:
    """``(pos, words)`` of the key column when there is one, else the text."""
    rows = text_rows(df, lenient_text(params.key or params.text_column), params)
    return rows.select("pos", blank_tokens(F.col("text")).alias("words"))


def shingles(df: DataFrame, params: Params) -> DataFrame:
    """``(pos, shingles)``: the set of word runs."""
    runs = word_shingles(F.col("words"), params.minhash_ngram_size)
    return words(df, params).select("pos", runs.alias("shingles"))


def fingerprints(df: DataFrame, params: Params) -> DataFrame:
    """``(pos, fp)``; rows with too few words all share the empty signature."""
    sig = signature(F.col("words"), params.minhash_num_perm, run=params.minhash_ngram_size)
    signed = words(df, params).select("pos", sig.alias("sig"))
    return signed.select("pos", sha256_hex(signature_text(F.col("sig"))).alias("fp"))


def dropped(df: DataFrame, params: Params, work: Workspace) -> DataFrame:
    # The signature is the dear part and is needed once per filter bit pass.
    prints = work.table(fingerprints(df, params), "fingerprints")
    return bloom.dropped_by(prints, df, params, work)
