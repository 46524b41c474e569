"""Results out: kept rows by chunk, metrics, duplicate pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..functions.numbers import block_of
from ..operators.running import running_totals
from ..operators.survivors import columns_of, position, unused
from ..params import Params
from ..workspace import Workspace
from .readers import with_chunk

# The name of the result folder and the layouts of the exported
# duplicate files.
OUTPUT_NAME = "deduplicated_{config}_using_{method}_with_{size}_data"
CSV_COLUMNS = ("group_id", "group_size", "text_original", "text_duplicate", "similarity_threshold")
PAIR_COLUMNS = ("Original", "Duplicate", "Parameter")
DUMP_RULE = "------------------------"


def output_folder(params: Params) -> str:
    """Name of the result folder; a run without a chunk limit is marked ``all``."""
    size = (
        "all" if params.max_chunks is None
        else f"{params.max_chunks * params.chunk_size // 1000}k"
    )
    return OUTPUT_NAME.format(config=params.dataset_config, method=params.method, size=size)


def write_chunks(
    kept: DataFrame, path: str, params: Params, rows_per_file: int = 0, cluster: bool = True,
    mode: str = "errorifexists",
) -> None:
    """Kept rows as Parquet, one folder per chunk.

    ``cluster`` brings the rows of a chunk together first (AQE evens out the
    sizes); leave it off when the input already lies in chunk order.
    """
    rows = with_chunk(kept, params)
    if cluster:
        rows = rows.hint("rebalance", "chunk")
    writer = rows.write.mode(mode).partitionBy("chunk")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


#: Blocks of positions in the table that tells a row its part; it is sent to every task.
PART_BLOCKS = 1 << 16


def row_bytes(df: DataFrame) -> Column:
    """Size of a row before compression: its texts and binaries, and 8 bytes for any other value."""
    sizes = [
        F.coalesce(F.octet_length(column), F.lit(0))
        if isinstance(field.dataType, (StringType, BinaryType)) else F.lit(8)
        for field, column in zip(df.schema.fields, columns_of(df))
    ]
    return reduce(Column.__add__, sizes).cast("bigint")


def part_starts(kept: DataFrame, params: Params, part_bytes: int, work: Workspace) -> DataFrame:
    """``(start)``: the first position of each part, consecutive rows of at most ``part_bytes``.

    Only positions and sizes are moved.  A part may exceed the limit by a row that is larger
    than half of it.
    """
    sizes = work.table(kept.select(position(params), row_bytes(kept).alias("bytes")), "row-sizes")
    largest = sizes.agg(F.max("bytes")).first()[0] or 0
    room = max(part_bytes - largest, part_bytes // 2, 1)
    before = running_totals(sizes, "pos", {"through": "bytes"}).select(
        "pos", (F.col("through") - F.col("bytes")).alias("before")
    )
    return work.table(
        before.groupBy(block_of(F.col("before"), room)).agg(F.min("pos").alias("start"))
        .select("start"),
        "part-starts",
    )


def with_part(kept: DataFrame, starts: DataFrame, params: Params, work: Workspace) -> DataFrame:
    """Add ``part``, counted from 0, where the rows lie.

    A table of ``PART_BLOCKS`` blocks of positions, with the starts that fall into each, is sent
    to the rows; there is a start for every ``part_bytes`` of the corpus.
    """
    last = starts.agg(F.max("start")).first()[0] or 0
    width = last // PART_BLOCKS + 1
    own = starts.groupBy(block_of(F.col("start"), width).alias("block")).agg(
        F.sort_array(F.collect_list("start")).alias("starts"), F.count("*").alias("n")
    )
    spark = kept.sparkSession
    blocks = work.table(
        spark.range(last // width + 1).select(F.col("id").alias("block")).join(
            own, "block", "left"
        ).select("block", "starts", F.coalesce("n", F.lit(0)).alias("n")),
        "part-blocks",
    )
    names = [unused(f"_part_{name}", kept) for name in ("block", "starts", "before")]
    known = running_totals(blocks, "block", {"through": "n"}).select(
        F.col("block").alias(names[0]), F.col("starts").alias(names[1]),
        (F.col("through") - F.col("n")).alias(names[2]),
    )
    pos = F.col(params.order_column).cast("bigint")
    block = F.least(block_of(pos, width), F.lit(last // width))
    here = F.size(F.filter(F.coalesce(F.col(names[1]), F.array()), lambda s: s <= pos))
    # At most PART_BLOCKS rows, and the starts.
    return kept.join(F.broadcast(known), block == F.col(names[0])).select(
        *columns_of(kept), (F.col(names[2]) + here - 1).alias("part")
    )


def write_parts(
    kept: DataFrame, path: str, params: Params, part_bytes: int, work: Workspace,
    mode: str = "errorifexists",
) -> None:
    """Kept rows as Parquet, one folder per part: many small chunks, or a piece of a large one.

    Every row says which ``chunk`` it is of.  The rows are shuffled once, by part; AQE may deal
    a part over several files.
    """
    starts = part_starts(kept, params, part_bytes, work)
    rows = with_part(with_chunk(kept, params), starts, params, work)
    rows.hint("rebalance", "part").write.mode(mode).partitionBy("part").parquet(path)


def csv_rows(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs in the layout of the duplicate CSV, from the texts of ``groups.sized_pairs``."""
    return texts.select(
        F.concat(F.lit("doc_"), F.col("owner_pos").cast("string")).alias("group_id"),
        "group_size",
        F.col("owner_text").alias("text_original"),
        F.col("text").alias("text_duplicate"),
        F.lit(float(threshold)).alias("similarity_threshold"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV; texts may hold quotes and line breaks."""
    rows.select(*CSV_COLUMNS).write.option("header", True).option("quoteAll", True).option(
        "escape", '"'
    ).csv(path)


def read_csv(spark, path: str) -> DataFrame:
    return spark.read.schema(
        "group_id string, group_size bigint, text_original string, text_duplicate string, "
        "similarity_threshold double"
    ).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def dump_text() -> Column:
    """One pair as a block of plain text."""
    return F.format_string(
        "Current Text:\n%s\n\nMatched With:\n%s\n" + DUMP_RULE, F.col("text"), F.col("owner_text")
    )


def write_dump(texts: DataFrame, path: str) -> None:
    texts.select(dump_text().alias("value")).write.text(path)
