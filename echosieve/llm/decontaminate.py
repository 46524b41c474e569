"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of an item.  Over every window of a text the k-gram
with the least hash is kept; equal windows keep the same k-gram at the same place, so any
shared span of a window or more shares a fingerprint.  Items shorter than a window are one
window of their own length, for which the k-gram is the window.

One pass over the corpus takes the kept hashes of all lengths, without places, and joins them
with those of the items.  Only documents that share one are gone over again: there each kept
k-gram comes with the words within a window's reach, is joined with the items' windows, and a
hit is extended to the whole window and compared word by word (by 64-bit word hashes).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echosieve.llm.common import ascii_lower, let, may_broadcast, same
from echosieve.operators.skew import spread_join
from echosieve.workspace import Workspace

WINDOW, KGRAM = 13, 5
BROADCAST_BYTES = 64 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARES, HOT_ROWS = 32, 100_000


def words(text: Column) -> Column:
    low = ascii_lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _kept(hashes: Column, window: int, k: int) -> Column:
    """``array<struct(start, h, at)>``: the least k-gram of every window, at its place."""
    span = window - k + 1
    n = F.size(hashes)
    grams = F.transform(
        F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.slice(hashes, i + 1, k))
    )

    def least(grams: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - window), lambda s: let(
            F.slice(grams, s + 1, span), lambda part: let(F.array_min(part), lambda h: F.struct(
                s.alias("start"), h.alias("h"),
                (s + F.array_position(part, h).cast("int") - 1).alias("at"),
            ))
        ))

    return F.when(n >= window, let(grams, least))


def _least(hashes: Column, window: int, k: int) -> Column:
    """The least hash of every window, as a sliding minimum by doubling; null if it is too short."""
    n = F.size(hashes)
    least = F.transform(
        F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.slice(hashes, i + 1, k))
    )
    reach, span = 1, window - k + 1
    while reach < span:
        step = min(reach, span - reach)
        least = let(least, lambda x, step=step: F.zip_with(  # ``least`` ignores the nulls at the end
            x, F.slice(x, step + 1, F.size(x)), lambda p, q: F.least(p, q)
        ))
        reach += step
    return F.when(n >= window, F.slice(least, 1, n - window + 1))


def _joined(arrays: list[Column]) -> Column:
    return F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))


def _fingerprints(hashes: Column, window: int, k: int) -> Column:
    """Each kept k-gram once, with the words within a window's reach: ``first`` is the place
    of the first of them."""

    def once(kept: Column) -> Column:
        return F.filter(kept, lambda x, i: (i == 0) | (
            kept[F.greatest(i - 1, F.lit(0))]["at"] != x["at"]
        ))

    def around(x: Column) -> Column:
        return let(F.greatest(x["at"] - (window - k), F.lit(0)), lambda first: F.struct(
            F.lit(window).alias("size"), x["h"].alias("h"), x["at"].alias("at"),
            first.alias("first"),
            F.slice(hashes, first + 1, x["at"] - first + window).alias("near"),
        ))

    return F.transform(let(_kept(hashes, window, k), once), around)


def _windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """``(item_id, h, off, size, window, window_id)``: the distinct windows of one length, by their k-gram."""
    hashed = items.filter(F.least("n_words", F.lit(WINDOW)) == window)
    kept = hashed.select(
        "item_id", "hashes", F.explode(_kept(F.col("hashes"), window, k)).alias("w")
    )
    return kept.select(
        "item_id",
        F.col("w.h").alias("h"),
        (F.col("w.at") - F.col("w.start")).alias("off"),
        F.lit(window).alias("size"),
        F.slice("hashes", F.col("w.start") + 1, window).alias("window"),
    ).withColumn("window_id", F.xxhash64("window")).distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, work: Workspace,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per document.

    A document word inside any occurrence of a window is hit; ``contaminated`` is
    ``n_hit > 0 and 20 * n_hit >= n_words``.  Null and empty texts have no words; items without
    words occur nowhere; items with one id count as one, a null id as an empty string.  Rows
    that repeat an id with another text are judged apart.  Other columns are ignored.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"),
        _hashes(F.col(item_text)).alias("hashes"),
    ).withColumn("n_words", F.size("hashes")).filter("n_words > 0")
    size = F.least("n_words", F.lit(WINDOW)).alias("size")
    lengths = sorted(r["size"] for r in items.select(size).distinct().collect())
    texts = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_key"),
        F.col(text).alias("text"),
    )
    counted = texts.select(
        "doc_id", "text_key", F.size(words(F.col("text"))).cast("long").alias("n_words")
    )
    if not lengths:
        found = counted.limit(0).select(
            F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"),
            F.lit(0).alias("n_hit"), F.lit(0).alias("n_items"), F.lit("").alias("ids"),
        )
    else:
        shapes = [(w, KGRAM if w == WINDOW else w) for w in lengths]  # at most WINDOW of them
        own = work.table(
            reduce(DataFrame.unionByName, [_windows(items, *shape) for shape in shapes]), "windows"
        )
        hits = _hits(texts, own, shapes, work, broadcast_bytes, hot_rows)
        found = _totals(hits, own.select("window_id", "item_id").distinct())
    joined = counted.join(
        found, same(F.col("doc_id"), F.col("_id")) & (F.col("text_key") == F.col("_key")), "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _hits(
    texts: DataFrame, own: DataFrame, shapes: list[tuple[int, int]], work: Workspace,
    broadcast_bytes: int, hot_rows: int,
) -> DataFrame:
    """``(doc_id, text_key, window_id, place)`` for every occurrence of a window, written."""
    # The join key carries a share of the documents, so that a k-gram of all of them is dealt out.
    share = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SHARES)).alias("share")
    prints = texts.select("doc_id", "text_key", share, F.explode(let(
        _hashes(F.col("text")), lambda x: F.array_distinct(_joined([_least(x, *s) for s in shapes]))
    )).alias("h"))
    listed = own.select("h").distinct()
    if listed.count() * 16 <= broadcast_bytes:
        shared = prints.join(F.broadcast(listed), "h")
    else:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))
        shared = prints.join(listed.select("h", every.alias("share")), ["h", "share"])
    shared = work.table(shared.select("doc_id", "text_key", "h"), "shared")

    # From here on only what occurs on both sides is in play.
    counts = shared.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    tests = work.table(
        own.select("h", "off", "size", "window", "window_id").distinct().join(counts, "h"), "tests"
    )
    keys = shared.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    some = texts.join(
        may_broadcast(keys, 32, broadcast_bytes),
        same(F.col("doc_id"), F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_semi",
    )
    near = some.select("doc_id", "text_key", F.explode(let(
        _hashes(F.col("text")), lambda x: _joined([_fingerprints(x, *s) for s in shapes])
    )).alias("f")).select(
        "doc_id", "text_key", "f.*", F.xxhash64("doc_id", "text_key", "f.at").alias("spread")
    )
    if tests.count() * (64 + 8 * WINDOW) <= broadcast_bytes:
        met = near.join(F.broadcast(tests), ["h", "size"])
    else:
        hot = tests.filter(F.col("n") > hot_rows).select("h", "n").distinct()
        dealt = near.join(may_broadcast(hot, 16, broadcast_bytes), "h", "left").fillna({"n": 1})
        met = spread_join(dealt, tests, ["h", "size"], "n", "spread", hot_rows)
    begin = F.col("at") - F.col("off")
    extended = met.filter(F.when(begin >= F.col("first"), F.slice(
        "near", begin - F.col("first") + 1, F.col("size")
    ) == F.col("window"))).select(
        "doc_id", "text_key", "window_id",
        # a run of windows is told by its starts; 16 is above any window's length
        (begin.cast("long") * 16 + F.col("size")).alias("place"),
    )
    return work.table(extended, "hits")


def _totals(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """Hit words and items of each document that has any."""
    spans = F.transform(F.collect_set("place"), lambda x: F.sequence(
        F.shiftright(x, 4), F.shiftright(x, 4) + x.bitwiseAND(F.lit(15)) - 1
    ))
    keys = [F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")]
    places = hits.groupBy(*keys).agg(F.size(F.array_distinct(F.flatten(spans))).alias("n_hit"))
    ids = (
        hits.select(*keys, "window_id").distinct()
        .join(owners, "window_id")
        .groupBy("_id", "_key")
        .agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
        .select(
            F.col("_id").alias("_id2"), F.col("_key").alias("_key2"),
            F.size("ids").alias("n_items"), F.array_join("ids", ",").alias("ids"),
        )
    )
    return places.join(
        ids, same(F.col("_id"), F.col("_id2")) & (F.col("_key") == F.col("_key2"))
    ).drop("_id2", "_key2")
