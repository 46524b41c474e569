"""Fingerprints and Bloom bit positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import BloomShape


def md5_hex(text: Column) -> Column:
    return F.md5(text)


def _present(value: Column, otherwise) -> Column:
    """The same value, typed as never null.

    A join on a nullable expression first filters on it being present, and so
    evaluates it twice.
    """
    return F.coalesce(value, F.lit(otherwise))


def md5_key(text: Column) -> Column:
    """The MD5 as 16 bytes: half the shuffle volume of the hex form."""
    return _present(F.unhex(F.md5(text)), bytearray())


def sha256_hex(text: Column) -> Column:
    return _present(F.sha2(text, 256), "")


def digest_words(digest: Column) -> list[Column]:
    """A 256-bit hex number as one 16-bit and four 60-bit words, high to low."""
    cuts = [(1, 4), *[(start, 15) for start in range(5, 65, 15)]]
    return [F.conv(F.substring(digest, at, n), 16, 10).cast("bigint") for at, n in cuts]


def words_modulo(words: list[Column], m: int) -> Column:
    """The number made of ``digest_words`` modulo ``m``, by Horner's rule in BIGINT.

    Each step takes in as many bits as leave the intermediate value below 2^63.
    All of it is plain arithmetic, so it stays inside generated code.
    """
    if m < 1 << 33:
        step = 30
    elif m < 1 << 47:
        step = 15
    else:
        raise ValueError(f"a filter of {m} bits is beyond the supported 2^47")
    value = words[0] % F.lit(m)
    for word in words[1:]:
        for shift in range(60 - step, -1, -step):
            part = F.shiftright(word, shift).bitwiseAND(F.lit((1 << step) - 1))
            value = (value * F.lit(1 << step) + part) % F.lit(m)
    return _present(value, 0)


def bloom_bits(rows: DataFrame, fingerprint: str, shape: BloomShape) -> DataFrame:
    """``k`` rows ``(…, i, bit)`` per input row; the fingerprint is dropped."""
    ids = [c for c in rows.columns if c != fingerprint]
    digests = rows.select(
        *ids, fingerprint, F.explode(F.array(*[F.lit(i) for i in range(shape.k)])).alias("i")
    ).select(
        *ids, "i", F.sha2(F.concat(F.col(fingerprint), F.col("i").cast("string")), 256).alias("_d")
    )
    words = digest_words(F.col("_d"))
    names = [f"_w{at}" for at in range(len(words))]
    split = digests.select(*ids, "i", *[w.alias(n) for w, n in zip(words, names)])
    return split.select(*ids, "i", words_modulo([F.col(n) for n in names], shape.m).alias("bit"))
