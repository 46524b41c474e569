"""Exact Jaccard similarity of matched rows, and its histogram."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, word_tokens
from ..params import HISTOGRAM_BINS, Params
from ..workspace import Workspace
from .groups import pair_texts
from .survivors import enough_tasks


def scored_pairs(
    df: DataFrame, matches: DataFrame, params: Params, work: Workspace
) -> DataFrame:
    """``(pos, owner_pos, jaccard)`` over the word sets of each matched pair.

    ``matches`` pairs a row with kept rows only, so there are at most as many
    per row as there are bands, however many rows share a bucket.
    """
    texts = enough_tasks(pair_texts(df, matches, params, work), params)
    sets = texts.select(
        "pos", "owner_pos",
        word_tokens(F.col("text")).alias("a"), word_tokens(F.col("owner_text")).alias("b"),
    )
    common = sets.select(
        "pos", "owner_pos", F.size(F.array_intersect("a", "b")).alias("both"),
        (F.size("a") + F.size("b")).alias("sum"),
    )
    # Two empty sets are the same set.
    score = F.coalesce(F.try_divide(F.col("both"), F.col("sum") - F.col("both")), F.lit(1.0))
    # Written, for a filter on the score would be moved down to the texts and
    # have them split several times.
    return work.table(common.select("pos", "owner_pos", score.alias("jaccard")), "scores")


def verified(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(F.col("jaccard") >= threshold)


def histogram(scores: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(bin, low, high, pairs)`` over equal bins from the least to the largest score.

    ``scores`` is a written table, since it is read for its ends first.
    """
    spark = scores.sparkSession
    ends = scores.agg(F.min("jaccard").alias("lo"), F.max("jaccard").alias("hi")).first()
    numbers = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if ends.lo is None:
        return numbers.limit(0).select(
            "bin", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"),
            F.lit(0).cast("bigint").alias("pairs"),
        )
    width = (ends.hi - ends.lo) / bins
    which = (
        F.lit(1) if width == 0.0
        else F.least(
            F.lit(bins),
            F.width_bucket("jaccard", F.lit(ends.lo), F.lit(ends.hi), F.lit(bins)),
        )
    ).cast("int")
    counts = scores.groupBy(which.alias("bin")).agg(F.count("*").alias("pairs"))
    return numbers.join(counts, "bin", "left").select(
        "bin",
        (F.lit(ends.lo) + (F.col("bin") - 1) * F.lit(width)).alias("low"),
        (F.lit(ends.lo) + F.col("bin") * F.lit(width)).alias("high"),
        F.coalesce("pairs", F.lit(0)).alias("pairs"),
    )


def line_differences(texts: DataFrame) -> DataFrame:
    """Replace the two texts of a pair by its distinct common, lost and new lines."""
    split = texts.select(
        *[c for c in texts.columns if c not in ("text", "owner_text")],
        lines(F.col("owner_text")).alias("_old"), lines(F.col("text")).alias("_new"),
    )
    return split.select(
        "*",
        F.array_intersect("_old", "_new").alias("unchanged"),
        F.array_except("_old", "_new").alias("removed"),
        F.array_except("_new", "_old").alias("added"),
    ).drop("_old", "_new")


DIFF = "pos bigint, owner_pos bigint, line_number bigint, op string, line string"
#: What a line of a diff is.
SAME, REMOVED, ADDED = "same", "removed", "added"


def diff_ops(old: list, new: list) -> Iterator[str]:
    """The operations of a shortest line diff, in order; a removed line comes before an added.

    Bit-parallel longest common subsequence: bit p of the vector of a suffix of ``new`` is unset
    where the last p + 1 lines of ``old`` share one line more with it than the last p do.  Each
    line of ``new`` is a handful of operations on whole vectors.  Only every ``step``-th vector
    is held; those between are made again when the walk from the start gets there.
    """
    n, full, places = len(old), (1 << len(old)) - 1, {}
    for at, line in enumerate(reversed(old)):
        places[line] = places.get(line, 0) | 1 << at

    def before(vector: int, line) -> int:
        shared = vector & places.get(line, 0)
        return (vector + shared | vector - shared) & full

    step = max(1, math.isqrt(len(new)))
    held = {len(new): full}
    vector = full
    for j in range(len(new) - 1, -1, -1):
        vector = before(vector, new[j])
        if j % step == 0:
            held[j] = vector
    i = j = 0
    block, first = [], 0
    while i < n or j < len(new):
        if i < n and j < len(new) and old[i] == new[j]:
            i, j = i + 1, j + 1
            yield SAME
        elif j == len(new):
            i += 1
            yield REMOVED
        elif i == n:
            j += 1
            yield ADDED
        else:
            if not block or not first <= j < first + len(block):
                first = j - j % step
                past = min(first + step, len(new))
                block, vector = [], held[past]
                for k in range(past - 1, first - 1, -1):
                    vector = before(vector, new[k])
                    block.append(vector)
                block.reverse()
            if block[j - first] >> n - 1 - i & 1:
                i += 1
                yield REMOVED
            else:
                j += 1
                yield ADDED


def _diffed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ["pos", "owner_pos", "line_number", "op", "line"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def lines():
        for batch in batches:
            for row in range(batch.num_rows):  # one pair at a time
                pos, owner, old, new = (c[row].as_py() for c in batch.columns)
                old, new = old or [], new or []
                i = j = 0
                for number, op in enumerate(diff_ops(old, new), 1):
                    yield pos, owner, number, op, new[j] if op == ADDED else old[i]
                    i, j = i + (op != ADDED), j + (op != REMOVED)

    rows = lines()
    while held := list(itertools.islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held), types)], names
        )


def ordered_diff(texts: DataFrame) -> DataFrame:
    """``(pos, owner_pos, line_number, op, line)``: the lines of each pair, in order, with repeats.

    ``same`` and ``removed`` lines, in order, are the owner's text, ``same`` and ``added`` ones
    the copy's.  As many lines as can be are ``same``.  A null text has no lines.  Pairs are
    diffed where their texts lie, one at a time; memory grows with the lines of one pair to the
    power of one and a half, in bits.
    """
    split = texts.select(
        F.col("pos").cast("bigint"), F.col("owner_pos").cast("bigint"),
        lines(F.col("owner_text")).alias("old"), lines(F.col("text")).alias("new"),
    )
    return split.mapInArrow(_diffed, DIFF)


def pair_table(texts: DataFrame) -> DataFrame:
    """Pairs in the layout of the pair table, with the differing lines as arrays."""
    named = texts.withColumn("Original", F.col("owner_text")).withColumn(
        "Duplicate", F.col("text")
    ).withColumnRenamed("parameter", "Parameter")
    return line_differences(named)
