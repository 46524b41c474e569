"""Line removal by site-relative frequency.

A line is boilerplate of a host when the share of the host's pages that hold it lies above
``ratio`` beyond chance: the lower Wilson bound of pages / total exceeds it, and two different
texts hold it.  The bound has no switch by size, so a host of three pages is cleaned like one of
a million; copies of one text alone never make its lines boilerplate, so no text is lost for
being held twice.

Lines are counted once a page, by a 64-bit hash: two lines of one corpus are taken for each other
with a probability below 1e-15 a line.  Counts are combined before they are shuffled, so a hot
host costs no more than its distinct lines.  A host has at most (its lines per page) / ``ratio``
boilerplate lines, whatever its pages, so its list fits in one row.  The lists are sent to every
task when their counted lines are few; else pages meet them by host, hot hosts in shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echosieve.llm.common import let, may_broadcast, same
from echosieve.operators.survivors import unused
from echosieve.workspace import Workspace

RATIO = 0.05
Z = 1.96  # of the Wilson bound
BROADCAST_BYTES = 64 << 20
HOT_PAGES = 20_000  # pages of a host that go to one share


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """Identity of a line, blanks at its ends apart; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(
    docs: DataFrame, text: str = "text", host: str = "source",
    ratio: float = RATIO, z: float = Z,
) -> DataFrame:
    """``(host, total, lines)``: hashes of the boilerplate lines of each host that has any."""
    keys = F.array_distinct(F.transform(_lines(F.col(text)), _key))
    pages = docs.select(
        F.col(host).alias("host"), F.xxhash64(F.col(text)).alias("page"), keys.alias("keys")
    )
    totals = docs.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("total"))
    counts = (
        pages.select("host", "page", F.explode("keys").alias("line"))
        .filter(F.col("line").isNotNull())
        .groupBy("host", "line")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.min("page").alias("one"), F.max("page").alias("other"),
        )
        .filter("one != other")
    )
    # The Wilson interval inverts the score test, so its lower bound needs no root.
    excess = F.col("pages") - F.lit(float(ratio)) * F.col("total")
    chance = F.lit(z * z * ratio * (1 - ratio)) * F.col("total")
    return (
        counts.join(totals, same(F.col("host"), F.col("_host")))
        .filter((excess > 0) & (excess * excess > chance))
        .groupBy("host")
        .agg(F.max("total").alias("total"), F.collect_set("line").alias("lines"))
    )


def _with_lists(
    docs: DataFrame, lists: DataFrame, host: str, of_host: str, lines: str,
    broadcast_bytes: int, hot_pages: int,
) -> DataFrame:
    """``docs`` with the ``lines`` listed for their host, null where there are none."""
    named = lists.select(F.col("host").alias(of_host), "total", F.col("lines").alias(lines))
    size = lists.agg(F.sum(F.size("lines") * 8 + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        return docs.join(
            F.broadcast(named.drop("total")), same(F.col(host), F.col(of_host)), "left"
        )
    # Hosts of many pages are dealt out, each share with a copy of the list.
    share, shares, hot_host, of_share = (
        unused(name, docs) for name in ("_share", "_shares", "_hot", "_of")
    )
    many = F.ceil(F.col("total") / hot_pages)
    hot = lists.filter(many > 1).select(F.col("host").alias(hot_host), many.alias(shares))
    dealt = docs.join(
        may_broadcast(hot, 64, broadcast_bytes), same(F.col(host), F.col(hot_host)), "left"
    ).withColumn(share, F.pmod(
        F.monotonically_increasing_id(), F.coalesce(shares, F.lit(1).cast("long"))
    ))
    copies = named.withColumn(
        of_share, F.explode(F.sequence(F.lit(0).cast("long"), many - 1))
    ).drop("total")
    return dealt.join(
        copies, same(F.col(host), F.col(of_host)) & (F.col(share) == F.col(of_share)), "left"
    )


def drop_lines(
    docs: DataFrame, work: Workspace, text: str = "text", host: str = "source",
    ratio: float = RATIO, z: float = Z, broadcast_bytes: int = BROADCAST_BYTES,
    hot_pages: int = HOT_PAGES,
) -> DataFrame:
    """``docs`` without boilerplate lines, plus ``n_lines`` and ``n_dropped`` (replaced if
    there); ``n_chars`` is corrected where the table has it.

    Lines that only one text of a host holds stay.  Blank lines stay.  All rows stay: a
    page of boilerplate only becomes empty, a null text stays null with no lines, an empty one
    has one blank line.  Pages with a null host form a host of their own.  Repeated rows count
    as pages of their own.
    """
    of_host, listed_lines, new = (unused(name, docs) for name in ("_host", "_lines", "_new"))
    lists = work.table(boilerplate(docs, text, host, ratio, z), "boilerplate")
    listed = _with_lists(docs, lists, host, of_host, listed_lines, broadcast_bytes, hot_pages)

    def clean(lines: Column) -> Column:
        own = F.array_intersect(F.transform(lines, _key), F.col(listed_lines))
        return let(own, lambda hit: F.filter(
            lines, lambda x: ~F.coalesce(F.array_contains(hit, _key(x)), F.lit(False))
        ))

    none = F.col(listed_lines).isNull() | F.col(text).isNull()
    cleaned = let(_lines(F.col(text)), lambda lines: let(clean(lines), lambda kept: F.struct(
        F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("dropped")
    )))
    out = listed.withColumn(new, F.when(~none, cleaned)).withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text)))),
        "n_dropped": F.coalesce(F.col(new)["dropped"], F.lit(0)),
        text: F.coalesce(F.col(new)["text"], F.col(text)),
    })
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast("long"))
    return out.select(*dict.fromkeys([*docs.columns, "n_lines", "n_dropped"]))
