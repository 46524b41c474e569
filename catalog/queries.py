"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve import Params, Workspace, deduplicate, method, register
from echosieve.functions.hashing import bloom_bits, md5_hex, sha256_hex
from echosieve.functions.minhash import band_texts, signature_text
from echosieve.functions.text import blank_tokens, lenient_text, required_text, word_tokens
from echosieve.operators import (
    bloom, exact, groups, hybrid, metrics, minhash, overlap, similarity,
)
from echosieve.operators.survivors import enough_tasks, keep, removed
from echosieve.params import BloomShape
from echosieve.plans import batch
from echosieve.sources import readers, sinks
from echosieve.streaming import reports, runner
from echosieve.streaming.steps import register_step
from echosieve.workspace import marks, stamp

CHUNK = 100
PART_BYTES = 400_000
SMALL = {"bloom_capacity": 300, "bloom_error_rate": 0.05}
USUAL = {"bloom_capacity": 1000, "bloom_error_rate": 0.01}
LARGE = {"bloom_capacity": 100_000, "bloom_error_rate": 0.001}

Query = Callable[[SparkSession, str], DataFrame]


def _params(spark: SparkSession, **changes) -> Params:
    # Each test table is one row group: give the signature step more tasks.
    return Params(
        chunk_size=CHUNK, min_tasks=spark.sparkContext.defaultParallelism, **changes
    )


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Run:
    """One method over ``documents``, with the tables its reports start from."""

    def __init__(self, spark: SparkSession, sf_dir: str, **changes):
        self.params = _params(spark, **changes)
        self.work = Workspace(spark)
        self.docs = readers.read_corpus(spark, f"{sf_dir}/documents.parquet", self.params)

    def dropped(self) -> DataFrame:
        return method(self.params.method)(self.docs, self.params, self.work)

    def kept_ids(self) -> DataFrame:
        return keep(self.docs, self.dropped(), self.params).select("doc_id")

    def counts(self) -> DataFrame:
        return self.work.table(
            metrics.chunk_counts(self.docs, self.dropped(), self.params), "chunk-counts"
        )


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("pos").alias("doc_id"), F.col("owner_pos").alias("owner_id"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- queries that exist once per method ----------------------------------------------

def _kept(**changes) -> Query:
    return lambda spark, sf: _Run(spark, sf, **changes).kept_ids()


def _pairs(name: str) -> Query:
    return lambda spark, sf: _ids(_Run(spark, sf, method=name).dropped())


def _group_sizes(name: str) -> Query:
    return lambda spark, sf: groups.group_sizes(
        _Run(spark, sf, method=name).dropped()
    ).withColumnRenamed("owner_pos", "owner_id")


def _top_groups(name: str) -> Query:
    def query(spark, sf):
        run = _Run(spark, sf, method=name)
        return groups.top_groups(run.docs, run.dropped(), run.params).withColumnRenamed(
            "owner_pos", "owner_id"
        )
    return query


def _duplicate_count(name: str, shifted: bool = False) -> Query:
    def query(spark, sf):
        run = _Run(spark, sf, method=name)
        count = groups.with_shifted_duplicate_count if shifted else groups.with_duplicate_count
        return count(run.docs, run.dropped(), run.params, run.work).select("doc_id", "duplicate_count")
    return query


def _ordinal(name: str) -> Query:
    def query(spark, sf):
        ranked = groups.ordinals(_Run(spark, sf, method=name).dropped())
        return ranked.select(
            F.col("pos").alias("doc_id"), F.col("owner_pos").alias("owner_id"), "ordinal"
        )
    return query


def _chunk_metrics(name: str) -> Query:
    return lambda spark, sf: _rounded(
        metrics.chunk_metrics(_Run(spark, sf, method=name).counts()), "chunk_compression_ratio"
    )


def _running(name: str, logged: bool = False) -> Query:
    def query(spark, sf):
        rows = metrics.method_metrics(name, _Run(spark, sf, method=name).counts())
        return _rounded(metrics.logged(rows) if logged else rows, "duplicate_ratio")
    return query


def _summary(name: str, **changes) -> Query:
    def query(spark, sf):
        counts = _Run(spark, sf, method=name, **changes).counts()
        return _rounded(
            metrics.final_summary(counts, metrics.method_metrics(name, counts)),
            "total_compression_ratio", "avg_duplicate_ratio",
        )
    return query


def _sampled(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "chunk", F.col("pos").alias("doc_id"), F.col("owner_pos").alias("owner_id"),
        F.col("owner_text").alias("original"), F.col("text").alias("duplicate"), "parameter",
    )


def _pair_sample(name: str) -> Query:
    def query(spark, sf):
        run = _Run(spark, sf, method=name)
        return _sampled(groups.pair_sample(run.docs, run.dropped(), run.params, run.work))
    return query


# --- exact and reports ---------------------------------------------------------------

def exact_fingerprints(spark, sf):
    return _table(spark, sf, "documents").select(
        "doc_id", md5_hex(required_text("text")).alias("fp")
    )


def exact_kept(spark, sf):
    """Positions only, so the corpus is read once and its text is never shuffled."""
    docs = _table(spark, sf, "documents")
    return exact.kept_positions(docs, _params(spark)).withColumnRenamed("pos", "doc_id")


def exact_rows(spark, sf):
    return deduplicate(_table(spark, sf, "documents"), _params(spark))


def exact_dropped_rows(spark, sf):
    run = _Run(spark, sf)
    return removed(run.docs, run.dropped(), run.params)


def unique_share(spark, sf):
    return _rounded(metrics.unique_share(_Run(spark, sf).counts()), "percent")


def compression_trend(spark, sf):
    return metrics.compression_trend(_Run(spark, sf).counts())


def chunk_assignment(spark, sf):
    return readers.with_chunk(_table(spark, sf, "documents"), _params(spark)).select(
        "doc_id", "chunk"
    )


def max_chunks_limit(spark, sf):
    params = _params(spark, max_chunks=3)
    docs = readers.read_corpus(spark, f"{sf}/documents.parquet", params)
    return readers.with_chunk(docs, params).select("doc_id", "chunk")


def chunk_files(spark, sf):
    """Kept rows written by chunk and read back."""
    run = _Run(spark, sf)
    path = run.work.path("rows")
    sinks.write_chunks(keep(run.docs, run.dropped(), run.params), path, run.params, 1_000_000)
    return spark.read.parquet(path).groupBy(F.col("chunk").cast("bigint").alias("chunk")).agg(
        F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars")
    )


def chunk_group_files(spark, sf):
    """The same in parts by size: many chunks to a folder."""
    run = _Run(spark, sf)
    path = run.work.path("parts")
    sinks.write_parts(
        keep(run.docs, run.dropped(), run.params), path, run.params, PART_BYTES, run.work
    )
    return spark.read.parquet(path).groupBy("part").agg(
        F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"),
        F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"),
    ).withColumn("part", F.col("part").cast("bigint"))


def registry_custom_method(spark, sf):
    """A user's own rule, registered by name: one row per (lang, source, length)."""
    def same_shape(df, params, work):
        kept = df.groupBy("lang", "source", "n_chars").agg(F.min("doc_id").alias("pos"))
        gone = df.select(F.col("doc_id").alias("pos")).join(kept, "pos", "left_anti")
        return work.table(gone, "dropped")

    register("same_shape", same_shape)
    return _Run(spark, sf, method="same_shape").kept_ids()


def pages_exact_kept(spark, sf):
    params = Params(text_column="html", order_column="page_id")
    return deduplicate(_table(spark, sf, "pages"), params).select("page_id", "url")


def conversations_exact_kept(spark, sf):
    """Turns in (conversation, turn) order, which only the keys are brought into."""
    turns = _table(spark, sf, "conversations")
    return exact.kept_in_order_of(
        turns, ["conv_id", "turn"], Params(order_column="pos"), Workspace(spark)
    ).select("pos", "conv_id", "turn", "role")


# --- Bloom ---------------------------------------------------------------------------

def bloom_fingerprints(spark, sf):
    prints = bloom.fingerprints(_table(spark, sf, "documents"), _params(spark))
    return prints.withColumnRenamed("pos", "doc_id")


def _bits(shape: Callable[[], BloomShape]) -> Query:
    def query(spark, sf):
        prints = bloom_fingerprints(spark, sf)
        return bloom_bits(prints, "fp", shape())
    return query


def bloom_kept_positions(changes: dict) -> Query:
    def query(spark, sf):
        params = _params(spark, method="bloomfilter", **changes)
        prints = bloom.fingerprints(_table(spark, sf, "documents"), params)
        return bloom.kept_positions(prints, params.bloom()).withColumnRenamed("pos", "doc_id")
    return query


def _saturation(prints: Callable, changes: dict) -> Query:
    def query(spark, sf):
        params = _params(spark, **changes)
        work = Workspace(spark)
        rows = work.table(prints(_table(spark, sf, "documents"), params), "fingerprints")
        return _rounded(
            bloom.saturation(rows, params.bloom(), CHUNK, work),
            "bloom_saturation", "bloom_saturation_percent",
        )
    return query


def bloom_membership(spark, sf):
    params = _params(spark, **USUAL)
    shape = params.bloom()
    setters = bloom.first_setters(
        bloom.fingerprints(_table(spark, sf, "documents"), params), shape
    )
    probe = _table(spark, sf, "benchmark").select(
        "item_id", sha256_hex(lenient_text("text")).alias("fp")
    )
    return bloom.contains(probe, ["item_id"], setters, shape).select("item_id", "is_member")


def bloom_packed_membership(spark, sf):
    """The same against the filter as bitmaps."""
    params, work = _params(spark, **USUAL), Workspace(spark)
    shape = params.bloom()
    prints = bloom.fingerprints(_table(spark, sf, "documents"), params)
    filter_ = work.table(bloom.packed(bloom.first_setters(prints, shape)), "filter")
    probe = _table(spark, sf, "benchmark").select(
        "item_id", sha256_hex(lenient_text("text")).alias("fp")
    )
    return bloom.contains_packed(probe, ["item_id"], filter_, shape, work).select(
        "item_id", "is_member"
    )


def bloom_packed_saturation(spark, sf):
    """A filter per language, and the filter of all that they merge into."""
    params, work = _params(spark, **LARGE), Workspace(spark)
    shape = params.bloom()
    docs = _table(spark, sf, "documents")
    langs = [r.lang for r in docs.select("lang").distinct().orderBy("lang").collect()]
    filters = [
        bloom.packed(bloom.first_setters(
            bloom.fingerprints(docs.filter(F.col("lang") == lang), params), shape
        )).withColumn("part", F.lit(lang))
        for lang in langs
    ]
    parts = work.table(reduce(DataFrame.unionByName, filters), "filters")
    every = parts.unionByName(bloom.merged(parts).withColumn("part", F.lit("all")))
    set_ = every.groupBy("part").agg(bloom.bits_set().alias("bits_set"))
    return set_.withColumn("bloom_saturation", F.round(F.col("bits_set") / shape.m, 6))


# --- text, MinHash, hybrid -----------------------------------------------------------

def word_token_rows(spark, sf):
    docs = _table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(word_tokens(required_text("text"))).alias("token"))


def word_split(spark, sf):
    words = _table(spark, sf, "documents").select(
        "doc_id", blank_tokens(F.col("text")).alias("words")
    )
    return words.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.md5(F.array_join("words", " ")).alias("words_md5"),
    )


def shingles(spark, sf):
    rows = hybrid.shingles(_table(spark, sf, "documents"), _params(spark))
    return rows.select(
        F.col("pos").alias("doc_id"), F.size("shingles").cast("bigint").alias("n_shingles"),
        F.md5(F.array_join(F.array_sort("shingles"), "\n")).alias("shingles_md5"),
    )


def minhash_signature(spark, sf):
    signed = minhash.signatures(_table(spark, sf, "documents"), _params(spark))
    return signed.select(
        F.col("pos").alias("doc_id"), signature_text(F.col("sig")).alias("signature")
    )


def minhash_bands(spark, sf):
    params = _params(spark)
    signed = minhash.signatures(_table(spark, sf, "documents"), params)
    texts = F.array(*[F.md5(text) for text in band_texts(F.col("sig"), params.bands())])
    return signed.select(F.col("pos").alias("doc_id"), F.posexplode(texts).alias("band", "bucket"))


def minhash_rows(spark, sf):
    """Surviving documents with all their columns."""
    return deduplicate(_table(spark, sf, "documents"), _params(spark, method="minhash"))


def _scored(spark, sf):
    run = _Run(spark, sf, method="minhash")
    chosen = minhash.selection(run.docs, run.params, run.work)
    return run, similarity.scored_pairs(run.docs, chosen.matches, run.params, run.work)


def minhash_matches(spark, sf):
    run = _Run(spark, sf, method="minhash")
    return _ids(minhash.selection(run.docs, run.params, run.work).matches)


def jaccard_pairs(spark, sf):
    run, scored = _scored(spark, sf)
    sure = similarity.verified(scored, run.params.minhash_threshold)
    return sure.select(
        F.col("pos").alias("doc_id"), F.col("owner_pos").alias("owner_id"),
        F.round("jaccard", 6).alias("jaccard"),
    )


def similarity_histogram(spark, sf):
    _, scored = _scored(spark, sf)
    return _rounded(similarity.histogram(scored), "low", "high")


def similarity_histogram_after_exact(spark, sf):
    """The scores that are left once exact copies are gone."""
    run = _Run(spark, sf, method="minhash")
    rows = run.work.table(
        deduplicate(run.docs, run.params.but(method="exact"), run.work), "exact-rows"
    )
    chosen = minhash.selection(rows, run.params, run.work)
    scored = similarity.scored_pairs(rows, chosen.matches, run.params, run.work)
    return _rounded(similarity.histogram(scored), "low", "high")


def _batch_run(spark, sf):
    run = _Run(spark, sf, method="minhash")
    out = run.work.path("out")
    return out, batch.run(spark, run.params, run.docs, out)


def batch_run_rows(spark, sf):
    _, result = _batch_run(spark, sf)
    return spark.read.parquet(result.path).select(
        "doc_id", "lang", "source", "n_chars", F.col("chunk").cast("bigint").alias("chunk")
    )


def batch_run_metrics(spark, sf):
    _, result = _batch_run(spark, sf)
    return _rounded(result.method_metrics, "duplicate_ratio")


def batch_run_duplicate_count(spark, sf):
    _, result = _batch_run(spark, sf)
    return spark.read.parquet(result.path).select("doc_id", "duplicate_count")


def batch_run_two_methods(spark, sf):
    """Two runs below one folder, each with its own rows and reports."""
    run = _Run(spark, sf)
    out = run.work.path("out")
    kept = []
    for changes in ({"method": "exact"}, {"method": "bloomfilter", **SMALL}):
        result = batch.run(spark, run.params.but(**changes), run.docs, out)
        rows = spark.read.parquet(result.path).select("doc_id")
        kept.append(rows.withColumn("method", F.lit(changes["method"])))
    return kept[0].unionByName(kept[1])


def batch_run_saturation(spark, sf):
    run = _Run(spark, sf, method="bloomfilter", **USUAL)
    result = batch.run(spark, run.params, run.docs, run.work.path("out"))
    return _rounded(result.saturation, "bloom_saturation", "bloom_saturation_percent")


def corpus_with_split_column(spark, sf):
    """A data column called ``split`` is data, unless the caller names it."""
    docs = _table(spark, sf, "documents").withColumn("split", F.col("lang"))
    work = Workspace(spark)
    path = work.path("corpus")
    docs.write.parquet(path)
    every = readers.read_corpus(spark, path, _params(spark))
    named = _params(spark, split_column="split", dataset_split="fr")
    part = readers.read_corpus(spark, path, named)
    return every.select("doc_id", F.lit("all").alias("part")).unionAll(
        part.select("doc_id", F.lit("fr"))
    )


def positions_by_file(spark, sf):
    """Documents without their id, numbered by file and row; the files follow the id."""
    work = Workspace(spark)
    docs = _table(spark, sf, "documents")
    path = work.path("corpus")
    for part, rows in enumerate((docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 > 0"))):
        # As many files as the sort has tasks; their names are in order of the id.
        rows.orderBy("doc_id").drop("doc_id").write.parquet(f"{path}/part={part}")
    return readers.with_file_positions(spark.read.parquet(path), work).select(
        "pos", "source", "n_chars"
    )


def pair_table(spark, sf):
    """The sampled pairs as a run writes them."""
    _, result = _batch_run(spark, sf)
    return spark.read.parquet(f"{result.reports}/pairs").select(
        *sinks.PAIR_COLUMNS,
        *[F.size(c).cast("bigint").alias(f"{name}_lines")
          for c, name in (("unchanged", "same"), ("removed", "gone"), ("added", "new"))],
    )


def _all_pair_texts(spark, sf, **changes):
    run = _Run(spark, sf, method="minhash", **changes)
    dropped = run.dropped()
    return run, dropped, groups.pair_texts(run.docs, dropped, run.params, run.work)


def pair_line_diff(spark, sf):
    run, _, texts = _all_pair_texts(spark, sf)
    diff = similarity.line_differences(enough_tasks(texts, run.params))
    joined = {c: F.array_join(F.array_sort(c), "\n") for c in ("removed", "added")}
    return diff.select(
        F.col("pos").alias("doc_id"), F.col("owner_pos").alias("owner_id"),
        *[F.size(c).cast("bigint").alias(f"{c}_lines") for c in ("unchanged", "removed", "added")],
        *[text.alias(c) for c, text in joined.items()],
    )


def pair_ordered_diff(spark, sf):
    run, _, texts = _all_pair_texts(spark, sf)
    return similarity.ordered_diff(enough_tasks(texts, run.params)).select(
        F.col("pos").alias("doc_id"), F.col("owner_pos").alias("owner_id"), "line_number", "op",
        "line",
    )


def pair_csv(spark, sf):
    """All pairs written as CSV and read back."""
    run = _Run(spark, sf, method="minhash", minhash_threshold=0.7)
    pairs = groups.sized_pairs(run.dropped(), run.params, run.work)
    texts = groups.pair_texts(run.docs, pairs, run.params, run.work)
    rows = sinks.csv_rows(texts, run.params.minhash_threshold)
    path = run.work.path("csv")
    sinks.write_csv(rows, path)
    return sinks.read_csv(spark, path).select(
        "group_id", "group_size", F.md5("text_original").alias("original_md5"),
        F.md5("text_duplicate").alias("duplicate_md5"), "similarity_threshold",
    )


def pair_dump(spark, sf):
    _, _, texts = _all_pair_texts(spark, sf)
    return texts.select(sinks.dump_text().alias("value"))


def hybrid_fingerprints(spark, sf):
    prints = hybrid.fingerprints(_table(spark, sf, "documents"), _params(spark))
    return prints.withColumnRenamed("pos", "doc_id")


def method_overlap(spark, sf):
    """The methods do not depend on each other, so they run side by side."""
    names = ("exact", "minhash", "bloomfilter", "minhash_bloom_hybrid")
    runs = {name: _Run(spark, sf, method=name, **LARGE) for name in names}
    with ThreadPoolExecutor(len(runs)) as pool:
        jobs = {
            name: pool.submit(inheritable_thread_target(spark)(run.dropped))
            for name, run in runs.items()
        }
    return overlap.method_overlap({name: job.result() for name, job in jobs.items()})


# --- streams -------------------------------------------------------------------------

STREAM_FILES = 4
STATE_BUCKETS = 16


def _delivered(docs: DataFrame, inbox: str, step: int, gone: list[str]) -> int:
    """Write ``docs`` in ``STREAM_FILES`` deliveries of ``step`` positions; returns the files of
    each.

    A delivery is written by as many tasks as its share of the scan has, in position order.  Its
    files bear one time and so arrive together, in order of their names; where a delivery has
    fewer of them, empty ones fill it up.
    """
    spark = docs.sparkSession
    pieces = -(-docs.rdd.getNumPartitions() // STREAM_FILES)
    folders = [f"{inbox}/{at}" for at in range(STREAM_FILES)]
    for at, folder in enumerate(folders):
        part = docs.filter(F.col("doc_id").between(at * step, (at + 1) * step - 1))
        part.repartitionByRange(pieces, "doc_id").sortWithinPartitions("doc_id").drop(
            *gone
        ).write.parquet(folder)
    found = [sum(name.startswith("part-") for name in marks(spark, f)) for f in folders]
    now = time.time_ns() // 1_000_000
    for at, folder in enumerate(folders):
        for _ in range(max(found) - found[at]):
            docs.limit(0).drop(*gone).coalesce(1).write.mode("append").parquet(folder)
        stamp(spark, folder, now - 1000 * (STREAM_FILES - at))
    return max(found)


def _streamed(
    spark: SparkSession, sf_dir: str, limits: tuple[float | None, ...] = (None,),
    row_chunks: bool = False, numbered: bool = True, state_buckets: int | None = None, **changes
) -> runner.StreamFolders:
    """Documents are delivered in position order, and deliveries are worked off one by one.

    ``limits``: one start of the stream for each, with that many deliveries' worth of chunks.
    Without ``numbered`` the files hold no ids.
    """
    params = _params(spark, **changes)
    work = Workspace(spark)
    docs = _table(spark, sf_dir, "documents")
    inbox = work.path("inbox")
    last = docs.agg(F.max("doc_id")).first()[0]
    step = last // STREAM_FILES + 1
    gone = [] if numbered else ["doc_id"]
    files = _delivered(docs, inbox, step, gone)
    folders = runner.StreamFolders(
        work.path("stream"), row_chunks=row_chunks, state_buckets=state_buckets
    )
    schema = docs.drop(*gone).schema
    for limit in limits:
        own = params if limit is None else params.but(max_chunks=int(limit * step) // CHUNK)
        stream = readers.stream_corpus(
            spark, f"{inbox}/*", own, schema, files_per_batch=files, numbered=numbered
        )
        runner.finish(runner.start(stream, own, folders), own, folders)
    return folders


def _stream_kept(**changes) -> Query:
    return lambda spark, sf: runner.kept_rows(spark, _streamed(spark, sf, **changes)).select(
        "doc_id"
    )


def stream_chunk_running(spark, sf):
    counts = runner.batch_counts(spark, _streamed(spark, sf))
    return _rounded(metrics.exact_metrics(counts), "duplicate_ratio")


def stream_unnumbered_kept(spark, sf):
    """Files without ids, numbered in order of arrival."""
    return _stream_kept(numbered=False)(spark, sf)


def stream_row_chunks(spark, sf):
    """Metrics of chunks of rows, whatever the files: those of a run at rest."""
    counts = runner.batch_counts(spark, _streamed(spark, sf, row_chunks=True))
    return _rounded(metrics.exact_metrics(counts), "duplicate_ratio")


def stream_final_summary(spark, sf):
    folders = _streamed(spark, sf, row_chunks=True)
    return _rounded(
        reports.final_summary(spark, _params(spark), folders),
        "total_compression_ratio", "avg_duplicate_ratio",
    )


def stream_top_groups(spark, sf):
    return reports.top_groups(spark, _params(spark), _streamed(spark, sf)).withColumnRenamed(
        "owner_pos", "owner_id"
    )


def stream_duplicate_count(spark, sf):
    """Rows kept in early batches show the copies that came with later ones."""
    return reports.with_duplicate_count(
        spark, _params(spark), _streamed(spark, sf), Workspace(spark)
    ).select("doc_id", "duplicate_count")


def stream_bloom_saturation(spark, sf):
    folders = _streamed(spark, sf, method="bloomfilter", **USUAL)
    params = _params(spark, method="bloomfilter", **USUAL)
    return _rounded(
        reports.saturation(spark, params, folders, Workspace(spark)),
        "bloom_saturation", "bloom_saturation_percent",
    )


def stream_pair_sample(spark, sf):
    return _sampled(
        reports.pair_sample(spark, _params(spark), _streamed(spark, sf), Workspace(spark))
    )


def stream_custom_method(spark, sf):
    """The rule of ``registry_custom_method`` as a step with a state of its own."""
    shape = ["lang", "source", "n_chars"]

    def same_shape(batch, state, params, work):
        firsts = work.table(
            batch.groupBy(*shape).agg(F.min("doc_id").alias("pos")).join(
                state.select(*shape), shape, "left_anti"
            ), "firsts",
        )
        gone = batch.select(F.col("doc_id").alias("pos")).join(firsts, "pos", "left_anti")
        return gone.withColumn("owner_pos", F.lit(None).cast("bigint")), firsts

    register_step("same_shape", same_shape, "lang string, source string, n_chars bigint, pos bigint")
    return _stream_kept(method="same_shape")(spark, sf)


def stream_max_chunks_limit(spark, sf):
    """A stream that ends within its third file, after the same chunks as a run at rest."""
    return runner.kept_rows(spark, _streamed(spark, sf, limits=(2.4,))).select("doc_id")


def stream_max_chunks_resumed(spark, sf):
    """The same, started again without a limit: nothing is missing."""
    return runner.kept_rows(spark, _streamed(spark, sf, limits=(2.4, None))).select("doc_id")


def stream_minhash_pairs(spark, sf):
    return _ids(_streamed(spark, sf, method="minhash").dropped().read(spark))


def all_queries() -> dict[str, Query]:
    return {
        "exact_fingerprints": exact_fingerprints,
        "exact_kept": exact_kept,
        "exact_rows": exact_rows,
        "exact_dropped_rows": exact_dropped_rows,
        "exact_dropped_pairs": _pairs("exact"),
        "exact_group_sizes": _group_sizes("exact"),
        "exact_top_groups": _top_groups("exact"),
        "exact_duplicate_count": _duplicate_count("exact"),
        "exact_duplicate_ordinal": _ordinal("exact"),
        "exact_duplicate_count_compat": _duplicate_count("exact", shifted=True),
        "exact_pair_sample": _pair_sample("exact"),
        "chunk_assignment": chunk_assignment,
        "max_chunks_limit": max_chunks_limit,
        "chunk_metrics": _chunk_metrics("exact"),
        "exact_chunk_running": _running("exact"),
        "exact_logged_metrics": _running("exact", logged=True),
        "final_summary": _summary("exact"),
        "unique_share": unique_share,
        "compression_trend": compression_trend,
        "chunk_files": chunk_files,
        "chunk_group_files": chunk_group_files,
        "registry_custom_method": registry_custom_method,
        "bloom_fingerprints": bloom_fingerprints,
        "bloom_bits": _bits(lambda: BloomShape.sized(1000, 0.01)),
        "bloom_wide_bits": _bits(lambda: BloomShape(1 << 40, 4)),
        "bloom_kept": bloom_kept_positions(USUAL),
        "bloom_kept_undersized": _kept(method="bloomfilter", **SMALL),
        "bloom_key_kept": _kept(method="bloomfilter", key="n_chars", **LARGE),
        "bloom_saturation": _saturation(bloom.fingerprints, USUAL),
        "bloom_membership": bloom_membership,
        "bloom_packed_membership": bloom_packed_membership,
        "bloom_packed_saturation": bloom_packed_saturation,
        "bloom_summary": _summary("bloomfilter", **USUAL),
        "word_tokens": word_token_rows,
        "word_split": word_split,
        "shingles": shingles,
        "minhash_signature": minhash_signature,
        "minhash_bands": minhash_bands,
        "minhash_kept": _kept(method="minhash"),
        "minhash_kept_lower_threshold": _kept(method="minhash", minhash_threshold=0.7),
        "minhash_pairs": _pairs("minhash"),
        "minhash_matches": minhash_matches,
        "minhash_group_sizes": _group_sizes("minhash"),
        "minhash_top_groups": _top_groups("minhash"),
        "minhash_duplicate_count": _duplicate_count("minhash"),
        "minhash_duplicate_ordinal": _ordinal("minhash"),
        "minhash_duplicate_count_compat": _duplicate_count("minhash", shifted=True),
        "minhash_chunk_metrics": _chunk_metrics("minhash"),
        "minhash_chunk_running": _running("minhash"),
        "minhash_final_summary": _summary("minhash"),
        "minhash_pair_sample": _pair_sample("minhash"),
        "pair_line_diff": pair_line_diff,
        "pair_ordered_diff": pair_ordered_diff,
        "pair_csv": pair_csv,
        "pair_dump": pair_dump,
        "jaccard_pairs": jaccard_pairs,
        "similarity_histogram": similarity_histogram,
        "similarity_histogram_after_exact": similarity_histogram_after_exact,
        "pair_table": pair_table,
        "batch_run_rows": batch_run_rows,
        "batch_run_metrics": batch_run_metrics,
        "batch_run_duplicate_count": batch_run_duplicate_count,
        "batch_run_two_methods": batch_run_two_methods,
        "batch_run_saturation": batch_run_saturation,
        "corpus_with_split_column": corpus_with_split_column,
        "positions_by_file": positions_by_file,
        "hybrid_fingerprints": hybrid_fingerprints,
        "hybrid_kept": _kept(method="minhash_bloom_hybrid", **LARGE),
        "hybrid_kept_undersized": _kept(method="minhash_bloom_hybrid", **SMALL),
        "hybrid_key_kept": _kept(
            method="minhash_bloom_hybrid", key="lang", minhash_ngram_size=1, **LARGE
        ),
        "hybrid_saturation": _saturation(hybrid.fingerprints, USUAL),
        "method_overlap": method_overlap,
        "pages_exact_kept": pages_exact_kept,
        "conversations_exact_kept": conversations_exact_kept,
        "stream_exact": _stream_kept(),
        "stream_exact_bucketed": _stream_kept(state_buckets=STATE_BUCKETS),
        "stream_minhash": _stream_kept(method="minhash"),
        "stream_bloom": _stream_kept(method="bloomfilter", **SMALL),
        "stream_bloom_packed": _stream_kept(method="bloomfilter", **LARGE),
        "stream_bloom_saturation": stream_bloom_saturation,
        "stream_hybrid": _stream_kept(method="minhash_bloom_hybrid", **SMALL),
        "stream_chunk_running": stream_chunk_running,
        "stream_max_chunks_limit": stream_max_chunks_limit,
        "stream_max_chunks_resumed": stream_max_chunks_resumed,
        "stream_minhash_pairs": stream_minhash_pairs,
        "stream_unnumbered_kept": stream_unnumbered_kept,
        "stream_row_chunks": stream_row_chunks,
        "stream_final_summary": stream_final_summary,
        "stream_top_groups": stream_top_groups,
        "stream_duplicate_count": stream_duplicate_count,
        "stream_pair_sample": stream_pair_sample,
        "stream_custom_method": stream_custom_method,
    }
