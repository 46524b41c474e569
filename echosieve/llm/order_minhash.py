"""Document fingerprints by order MinHash.

The k-mers of a text are its runs of ``K`` words, numbered by occurrence: the second "a b" is
another element than the first.  A hash deals the elements to ``SKETCHES`` sketches by its upper
bits; of each, the ``PER_SKETCH`` elements of least hash are kept, put back into text order, and
hashed together.  So a sketch agrees only when the same elements are least and stand in the same
order, which makes the share of agreeing sketches follow edits and moves, not only sets.  All of
it is one expression over a row; no element leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echosieve.llm.common import let, may_broadcast, same
from echosieve.workspace import Workspace

K, PER_SKETCH, SKETCH_BITS = 2, 2, 6
BROADCAST_BYTES = 16 << 20
LEAST = -(1 << 63)


def _kmers(text: Column) -> Column:
    """Hashes of the k-mers in text order; with fewer than ``K`` words one of all words."""

    def of(w: Column) -> Column:
        n = F.size(w)
        full = F.transform(
            F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[w[i + k] for k in range(K)])
        )
        none = F.array().cast("array<bigint>")
        return F.when(n >= K, full).when(n > 0, F.array(F.xxhash64(w))).otherwise(none)

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return let(words, of)


def sketches(text: Column) -> Column:
    """``array<int>``: one entry per sketch that has elements, its number in the upper bits."""

    def numbered(s: Column) -> Column:
        """Elements of k-mers sorted by (hash, place), each with its occurrence hashed in."""
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (
            s[i]["h"] != s[F.greatest(i - 1, F.lit(0))]["h"]
        ))
        return let(starts, lambda st: F.flatten(F.transform(st, lambda a, j: F.transform(
            F.slice(s, a + 1, F.coalesce(F.get(st, j + 1), F.size(s)) - a),
            lambda x, c: F.struct(
                F.xxhash64(x["h"], c).alias("g"), x["at"].alias("at"), x["h"].alias("h")
            ),
        ))))

    def sketch(x: Column) -> Column:
        return F.shiftrightunsigned(x["g"], 64 - SKETCH_BITS)

    def kept(e: Column) -> Column:
        """Of the elements sorted by hash, the first few of each sketch, in text order."""
        first = F.filter(e, lambda x, i: (i < PER_SKETCH) | (
            sketch(e[F.greatest(i - PER_SKETCH, F.lit(0))]) != sketch(x)
        ))
        return F.sort_array(F.transform(first, lambda x: F.struct(
            sketch(x).alias("no"), x["at"].alias("at"), x["h"].alias("h")
        )))

    def entries(t: Column) -> Column:
        leads = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (
            t[i]["no"] != t[F.greatest(i - 1, F.lit(0))]["no"]
        ))

        def entry(i: Column) -> Column:
            own = F.filter(F.slice(t, i + 1, PER_SKETCH), lambda x: x["no"] == t[i]["no"])
            code = F.xxhash64(F.transform(own, lambda x: x["h"]))
            low = code.bitwiseAND(F.lit((1 << (32 - SKETCH_BITS)) - 1)).cast("int")
            return F.shiftleft(t[i]["no"].cast("int"), 32 - SKETCH_BITS).bitwiseOR(low)

        return F.transform(leads, entry)

    def from_kmers(kmers: Column) -> Column:
        placed = F.sort_array(F.transform(kmers, lambda h, i: F.struct(
            h.alias("h"), i.alias("at")
        )))
        found = let(placed, lambda s: let(F.sort_array(numbered(s)), lambda e: let(kept(e), entries)))
        return F.when(F.size(kmers) > 0, found).otherwise(F.array().cast("array<int>"))

    return let(_kmers(text), from_kmers)


def as_text(entries: Column) -> Column:
    return F.concat_ws("", F.transform(entries, lambda x: F.lpad(F.hex(
        x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Share of sketches that agree, of those that either text has; 1 for two without words."""

    def numbers(x: Column) -> Column:
        return F.transform(x, lambda e: F.shiftrightunsigned(e, 32 - SKETCH_BITS))

    either = F.size(F.array_union(numbers(a), numbers(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _followers(ids: DataFrame, work: Workspace) -> DataFrame:
    """``ids(id, pick, n)`` plus ``target``, ``need``: the id that this one is next of in
    descending order (the next higher one; the least for the greatest), and a third of its length.

    Ids are dealt out by range; only the ends of the ranges are ordered across them.
    """
    ranged = work.table(
        ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "id-ranges"
    )
    here = Window.partitionBy("part").orderBy("id")
    ends = ranged.groupBy("part").agg(
        F.min("id").alias("low"), F.min_by("n", "id").alias("low_n")
    )
    parts = Window.orderBy("part")  # a row per range
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ends.select(
        "part",
        F.coalesce(F.lead("low").over(parts), F.first("low").over(whole)).alias("after"),
        F.coalesce(F.lead("low_n").over(parts), F.first("low_n").over(whole)).alias("after_n"),
    )
    inside = ranged.select(
        "*", F.lead("id").over(here).alias("_t"), F.lead("n").over(here).alias("_n")
    )
    return inside.join(after, "part").select(
        "id", "pick", F.coalesce("_t", "after").alias("target"),
        F.floor(F.coalesce("_n", "after_n") / 3).cast("int").alias("need"),
    )


def edited_fingerprints(
    docs: DataFrame, work: Workspace, doc_id: str = "doc_id", text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Fingerprints of each text and of its edited form (see the columns of the result).

    The edited text has the last third replaced by the start of the next document in descending
    id order; after the least id comes the greatest.  Null texts are empty; a null id counts as
    the least.  Of rows that repeat an id, the one whose text has the least hash is what other
    rows see as next.  Repeated rows stay; other columns are ignored.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("key", F.xxhash64("text"))
    own = work.table(
        rows.select("id", "key", F.length("text").alias("n"), sketches(F.col("text")).alias("fp"))
        .dropDuplicates(["id", "key"]),
        "fingerprints",
    )
    ids = own.groupBy("id").agg(F.min("key").alias("pick"), F.max("n").alias("n"))
    follows = work.table(_followers(ids, work), "followers")
    seen = (F.col("id") == F.col("_id")) & (F.col("key") == F.col("pick"))
    next_one = follows.withColumnRenamed("id", "_id")
    starts = (
        rows.select("id", "key", "text")
        .join(may_broadcast(next_one, 48, broadcast_bytes), seen)
        .select("target", F.expr("left(text, need)").alias("start"))
        .dropDuplicates(["target"])
    )
    next_prints = own.join(next_one, seen).select(
        F.col("target").alias("_t2"), F.col("fp").alias("next_fp")
    )
    third = F.floor(F.length("text") / 3).cast("int")
    edited = rows.join(starts, F.col("id") == F.col("target")).select(
        "doc_id", "id", "key", F.length("text").cast("long").alias("n_chars"),
        F.concat(
            F.left("text", F.length("text") - third), F.left("start", third)
        ).alias("edited"),
    )
    printed = edited.select(
        "doc_id", "id", "key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketches(F.col("edited")).alias("edited_fp"),
    )
    return (
        printed.join(own.select("id", "key", "fp"), ["id", "key"])
        .join(next_prints, F.col("id") == F.col("_t2"))
        .select(
            "doc_id", "n_chars", "edited_sha256",
            as_text(F.col("fp")).alias("fingerprint"),
            as_text(F.col("edited_fp")).alias("edited_fingerprint"),
            likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
            likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        )
    )
