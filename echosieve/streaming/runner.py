"""De-duplication of a stream of files, micro-batch by micro-batch."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import block_of
from ..operators.survivors import keep
from ..params import PAIRS_PER_CHUNK, Params
from ..sources.readers import limit_chunks
from ..workspace import Workspace, delete, exists, mark, marks
from . import arrivals
from .bucketed import BucketedTable
from .state import BatchTable
from .steps import MERGES, STEPS

METRIC_SCHEMA = "original bigint, kept bigint, removed bigint"
ROWS_KEY = "stream_step"


@dataclass(frozen=True)
class StreamFolders:
    """Folders of one stream below a common root on shared storage.

    ``state_folder`` is for a state that was compacted into another place.  With ``row_chunks``
    a chunk is ``chunk_size`` rows, as at rest, and not what one micro-batch brings: rows beyond
    the last full chunk wait for the next batch, and ``flush`` takes them at the end.

    ``state_buckets`` lays the state out in so many hash buckets of its key, so that a batch too
    large to be sent out is shuffled to the state, and the state stays where it is.

    Every folder holds one sub-folder per step.  A step is a micro-batch; with ``row_chunks``
    the even steps are micro-batches and an odd one is the flush after the step before it.
    ``commits`` names the steps whose results are whole: only these are read.
    """

    root: str
    state_folder: str | None = None
    row_chunks: bool = False
    state_buckets: int | None = None

    @property
    def rows(self) -> str:
        return f"{self.root}/rows"

    @property
    def waiting(self) -> str:
        return f"{self.root}/waiting"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    def step_of(self, batch_id: int) -> int:
        return 2 * batch_id if self.row_chunks else batch_id

    def state(self, params: Params) -> BatchTable:
        schema = STEPS[params.method][1]
        path, merge = self.state_folder or f"{self.root}/state", MERGES.get(schema)
        if self.state_buckets is not None:
            return BucketedTable(path, schema, self.state_buckets, merge)
        return BatchTable(path, schema, merge)

    def dropped(self) -> BatchTable:
        return BatchTable(f"{self.root}/dropped", "pos bigint, owner_pos bigint")

    def counts(self) -> BatchTable:
        chunk = "chunk bigint, " if self.row_chunks else ""
        return BatchTable(f"{self.root}/counts", chunk + METRIC_SCHEMA)

    def pairs(self) -> BatchTable:
        """The first dropped rows of every chunk, with their texts."""
        return BatchTable(f"{self.root}/pairs", "pos bigint, owner_pos bigint, text string")

    def ledger(self) -> BatchTable:
        return BatchTable(f"{self.root}/ledger", arrivals.LEDGER)

    @property
    def commits(self) -> str:
        return f"{self.root}/commits"

    @property
    def flushes(self) -> str:
        return f"{self.root}/flushes"

    def committed(self, spark: SparkSession) -> list[int]:
        """The whole steps, in order: one empty file each."""
        return sorted(int(name) for name in marks(spark, self.commits) if name.isdigit())

    def last_step(self, spark: SparkSession, before: int | None = None) -> int | None:
        steps = [s for s in self.committed(spark) if before is None or s < before]
        return steps[-1] if steps else None


class ChunkLimit(Exception):
    """Raised inside a stream that has reached ``max_chunks``."""


def process_batch(
    batch: DataFrame, batch_id: int, params: Params, folders: StreamFolders
) -> None:
    """Keep, report and remember one micro-batch; safe to repeat.

    With ``max_chunks`` only rows of the first chunks are processed, as at rest.  A
    batch that goes beyond them is not committed: ``ChunkLimit`` ends the stream, and a
    restart with a higher limit takes the batch again as a whole.
    """
    spark, step = batch.sparkSession, folders.step_of(batch_id)
    work = Workspace(spark)
    try:
        _withdraw(spark, step, folders)
        if folders.row_chunks and step > 0:
            _discard_flush(spark, step - 1, params, folders)
        if arrivals.ARRIVAL in batch.columns:
            batch = arrivals.numbered(batch, folders.ledger(), step, params.order_column, work)
        if folders.row_chunks:
            batch = _full_chunks(batch, step, params, folders, work)
        within = limit_chunks(batch, params)
        beyond = params.max_chunks is not None and not batch.filter(
            F.col(params.order_column) >= params.max_chunks * params.chunk_size
        ).isEmpty()
        if not (beyond and within.isEmpty()):
            _process(within, step, params, folders, work)
    finally:
        work.remove()
    if beyond:
        raise ChunkLimit(f"batch {batch_id} goes beyond chunk {params.max_chunks}")


def flush(spark: SparkSession, params: Params, folders: StreamFolders) -> None:
    """Process the rows that wait for a full chunk: the last, short one of a corpus.

    For a stream that has ended; it may be started again, and then fills up that chunk.  A flush
    that breaks off leaves nothing behind that is read, and can be repeated.
    """
    last = folders.last_step(spark) if folders.row_chunks else None
    if last is None or last % 2 == 1:
        return
    waiting = limit_chunks(spark.read.parquet(f"{folders.waiting}/batch={last}"), params)
    if waiting.isEmpty():
        return
    step, work = last + 1, Workspace(spark)
    try:
        mark(spark, folders.flushes, str(step))
        waiting.limit(0).write.mode("overwrite").parquet(f"{folders.waiting}/batch={step}")
        _process(waiting, step, params, folders, work)
    finally:
        work.remove()


def _withdraw(spark: SparkSession, step: int, folders: StreamFolders) -> None:
    """Hide a step that is about to be run again."""
    delete(spark, f"{folders.commits}/{step}")


def _discard_flush(
    spark: SparkSession, step: int, params: Params, folders: StreamFolders
) -> None:
    """Remove what a broken flush left, before the rows it took are taken again."""
    begun = f"{folders.flushes}/{step}"
    if exists(spark, begun) and not exists(spark, f"{folders.commits}/{step}"):
        delete(spark, f"{folders.state(params).path}/batch={step}")
        delete(spark, begun)


def _full_chunks(
    batch: DataFrame, step: int, params: Params, folders: StreamFolders, work: Workspace
) -> DataFrame:
    """The rows of full chunks, earlier waiting ones included; the others are put to wait."""
    spark, pos = batch.sparkSession, F.col(params.order_column)
    before = folders.last_step(spark, step)
    if before is not None:
        waiting = spark.read.schema(batch.schema).parquet(f"{folders.waiting}/batch={before}")
        batch = waiting.unionByName(batch)
    last = batch.agg(F.max(pos)).first()[0]
    cut = 0 if last is None else (last + 1) // params.chunk_size * params.chunk_size
    batch.filter(pos >= cut).write.mode("overwrite").parquet(f"{folders.waiting}/batch={step}")
    return batch.filter(pos < cut)


def _process(
    batch: DataFrame, step: int, params: Params, folders: StreamFolders, work: Workspace
) -> None:
    spark = batch.sparkSession
    method, _ = STEPS[params.method]
    state = folders.state(params)
    dropped, added = method(batch, state.before(spark, step), params, work)
    folders.dropped().write(dropped, step)
    dropped = folders.dropped().of(spark, step)
    kept = keep(batch, dropped, params)
    if folders.row_chunks:
        kept = kept.withColumn("chunk", block_of(F.col(params.order_column), params.chunk_size))
    # The remaining results do not depend on each other.
    writes = (
        lambda: kept.write.mode("overwrite").parquet(f"{folders.rows}/{ROWS_KEY}={step}"),
        lambda: folders.counts().write(_counts(batch, dropped, params, folders), step),
        lambda: state.write(added, step),
    )
    if params.log_duplicates:
        writes += (lambda: folders.pairs().write(_first_pairs(batch, dropped, params), step),)
    with ThreadPoolExecutor(len(writes)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]
        for job in jobs:
            job.result()
    mark(spark, folders.commits, str(step))


def _counts(
    batch: DataFrame, dropped: DataFrame, params: Params, folders: StreamFolders
) -> DataFrame:
    """``(original, kept, removed)`` of a step, by chunk of rows if chunks are counted so."""
    chunk = lambda c: block_of(c, params.chunk_size).alias("chunk")
    by = ["chunk"] if folders.row_chunks else []
    marked = batch.select(
        chunk(F.col(params.order_column)), F.lit(0).cast("bigint").alias("gone")
    ).unionAll(dropped.select(chunk(F.col("pos")), F.lit(1).cast("bigint")))
    return marked.groupBy(*by).agg(
        F.count_if(F.col("gone") == 0).alias("original"),
        F.coalesce(F.sum("gone"), F.lit(0)).alias("removed"),
    ).select(*by, "original", (F.col("original") - F.col("removed")).alias("kept"), "removed")


def first_of_chunks(pairs: DataFrame, params: Params) -> DataFrame:
    """The first ``PAIRS_PER_CHUNK`` of ``pairs(pos, …)`` of every chunk, with ``chunk``."""
    in_chunk = Window.partitionBy("chunk").orderBy("pos")  # at most chunk_size rows
    return pairs.withColumn("chunk", block_of(F.col("pos"), params.chunk_size)).withColumn(
        "nth", F.row_number().over(in_chunk)
    ).filter(F.col("nth") <= PAIRS_PER_CHUNK).drop("nth")


def _first_pairs(batch: DataFrame, dropped: DataFrame, params: Params) -> DataFrame:
    first = first_of_chunks(dropped.filter("owner_pos is not null"), params).drop("chunk")
    texts = batch.select(
        F.col(params.order_column).cast("bigint").alias("pos"),
        F.col(params.text_column).cast("string").alias("text"),
    )
    return texts.join(first, "pos").select("pos", "owner_pos", "text")


def start(
    stream: DataFrame, params: Params, folders: StreamFolders, available_now: bool = True
) -> StreamingQuery:
    """Start the stream; a restart with the same folders goes on where it stopped.

    Rows need ``order_column``, or the origin that ``stream_corpus(…, numbered=False)`` gives
    them, from which they are numbered in order of arrival.  Use ``finish`` to wait for a stream
    with ``max_chunks`` or with chunks of rows.
    """
    if params.method not in STEPS:
        raise ValueError(
            f"unknown streaming method {params.method!r}; available: {', '.join(sorted(STEPS))}"
        )
    if params.order_column not in stream.columns and arrivals.ARRIVAL not in stream.columns:
        raise ValueError(
            f"the stream has no column {params.order_column!r}; read it with numbered=False "
            "to have its rows numbered"
        )
    if params.order_column in stream.columns and arrivals.ARRIVAL in stream.columns:
        raise ValueError(f"{params.order_column!r} is there already; name another order_column")
    if folders.row_chunks and "chunk" in stream.columns:
        raise ValueError("the corpus has a column 'chunk' of its own")
    writer = stream.writeStream.option("checkpointLocation", folders.checkpoint).foreachBatch(
        lambda batch, batch_id: process_batch(batch, batch_id, params, folders)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish(
    query: StreamingQuery, params: Params | None = None, folders: StreamFolders | None = None
) -> bool:
    """Wait for the end of a stream; true if ``max_chunks`` ended it.

    Given ``params`` and ``folders``, rows that wait for a full chunk are flushed at its end.
    """
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if ChunkLimit.__name__ not in str(error):
            raise
        return True
    if folders is not None:
        flush(SparkSession.active(), params, folders)
    return False


def _whole(rows: DataFrame, key: str, spark: SparkSession, folders: StreamFolders) -> DataFrame:
    """Rows of committed steps only."""
    return rows.filter(F.col(key).isin(folders.committed(spark)))


def kept_rows(spark: SparkSession, folders: StreamFolders) -> DataFrame:
    """All rows kept so far, with the ``chunk`` that brought them.

    Only whole steps are seen: not the rows of one that is at work or broke off.
    """
    rows = _whole(spark.read.parquet(folders.rows), ROWS_KEY, spark, folders)
    if folders.row_chunks:
        return rows.drop(ROWS_KEY)
    return rows.withColumnRenamed(ROWS_KEY, "chunk")


def read_whole(spark: SparkSession, table: BatchTable, folders: StreamFolders) -> DataFrame:
    """The rows of committed steps of one of the stream's tables, with their ``batch``."""
    return _whole(table.read(spark), "batch", spark, folders)


def batch_counts(spark: SparkSession, folders: StreamFolders) -> DataFrame:
    """``(chunk, original, kept, removed)``: input of every report in ``metrics``."""
    counts = read_whole(spark, folders.counts(), folders)
    if not folders.row_chunks:
        return counts.withColumnRenamed("batch", "chunk")
    # A flushed chunk may have been filled up later.
    sums = [F.sum(c).alias(c) for c in ("original", "kept", "removed")]
    return counts.groupBy("chunk").agg(*sums)
