"""URL rules: a blocked Bloom filter in front of an exact hash join.

Every url gives one candidate per (host suffix, path prefix of a listed length).  A blocked
Bloom filter over the listed (host, path) pairs, one 256-bit block and eight bits a pair,
passes the possible hits on; only those are joined with the list, which removes the false
positives.  The longest fitting rule decides.  The filter has 16 to 32 bits a rule at every size:
up to ``SENT_BLOCKS`` blocks it is sent to every task, a larger one is a table of blocks that the
candidates meet by block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echosieve.llm.common import ascii_lower, same

WORDS = 4  # 64-bit words of a block
SENT_BLOCKS = 1 << 15  # 1 MB
SHARES = 16  # in which the candidates of one block of a larger filter are dealt out


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(host: Column, path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(blocks)).cast("int")


def _masks(host: Column, path: Column) -> list[Column]:
    """Two bits in each word of the block."""
    bits = F.xxhash64(path, host, F.lit(1))
    one = F.lit(1).cast("long")

    def bit(k: int) -> Column:
        place = F.shiftright(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", one, place)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """``(block, words)``: the 64-bit words of every block that has a bit set."""
    pairs = rules.select(
        _block(F.col("host"), F.col("path"), blocks).alias("block"),
        *[m.alias(f"w{w}") for w, m in enumerate(_masks(F.col("host"), F.col("path")))],
    )
    return pairs.groupBy("block").agg(
        F.array(*[F.bit_or(f"w{w}") for w in range(WORDS)]).alias("words")
    )


def bloom_words(rules: DataFrame, blocks: int) -> DataFrame:
    """One row, ``words``: the filter's 64-bit words, block after block."""
    empty = F.array(*[F.lit(0).cast("long")] * WORDS)
    every = rules.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    return (
        every.join(bloom_blocks(rules, blocks), "block", "left")
        .agg(F.array_sort(F.collect_list(
            F.struct("block", F.coalesce("words", empty).alias("words"))
        )).alias("all"))
        .select(F.flatten(F.col("all.words")).alias("words"))
    )


def possible_hits(
    candidates: DataFrame, rules: DataFrame, bits_per_rule: int = 16,
    sent_blocks: int = SENT_BLOCKS,
) -> DataFrame:
    """The rows of ``candidates`` whose (``host``, ``path``) the filter over ``rules`` passes.

    No listed pair is lost; of others a small share passes, whatever the number of rules.
    """
    wanted = rules.count() * bits_per_rule // (64 * WORDS) + 1
    blocks = 1 << (wanted - 1).bit_length()
    block = _block(F.col("host"), F.col("path"), blocks)
    if blocks <= sent_blocks:
        met = candidates.select("*", bloom_words(rules, blocks).scalar().alias("words"))
        first = block * WORDS
    else:
        shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
        share = F.pmod(F.xxhash64(*candidates.columns), F.lit(SHARES)).cast("int")
        met = candidates.select("*", block.alias("block"), share.alias("share")).join(
            bloom_blocks(rules, blocks).select("block", "words", shares), ["block", "share"]
        )
        first = F.lit(0)
    for w, mask in enumerate(_masks(F.col("host"), F.col("path"))):
        met = met.filter(F.col("words")[first + w].bitwiseAND(mask) == mask)
    return met.select(*candidates.columns)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
    bits_per_rule: int = 16,
    sent_blocks: int = SENT_BLOCKS,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``.  A rule fits its host and all
    subdomains when the url's path starts with the rule's path.  The longest ``host || path``
    wins; of equally long ones the longer host, then a blocking one.  A url that no rule
    fits, a null one and one without ``://`` (both parts empty) get ``default``.  Repeated
    rows stay, null ids too; an empty table gives an empty result; other columns are ignored.
    """
    listed = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "verdict",
    ).distinct()
    lengths = listed.agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    parsed = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.transform(
        F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.left("path", n)
    )
    candidates = (
        parsed.filter(F.length("host") > 0)
        .select("page_id", "url", "host", "path", lengths.scalar().alias("lengths"))
        .select("page_id", "url", F.explode(suffixes).alias("host"), prefixes.alias("paths"))
        .select("page_id", "url", "host", F.explode("paths").alias("path"))
    )
    possible = possible_hits(candidates, listed, bits_per_rule, sent_blocks)
    fits = possible.join(listed, ["host", "path"])
    rank = F.struct(
        F.length(F.concat("host", "path")).alias("size"),
        F.length("host").alias("host_size"),
        F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"),
    )
    best = (
        fits.groupBy(F.col("page_id").alias("_id"), F.col("url").alias("_url"))
        .agg(F.max(F.struct(
            rank.alias("rank"), F.concat("host", "path").alias("rule"), "verdict"
        )).alias("best"))
    )
    return parsed.join(
        best, same(F.col("page_id"), F.col("_id")) & same(F.col("url"), F.col("_url")), "left"
    ).select(
        "page_id", "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
