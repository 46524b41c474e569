import hashlib

import pytest

import models
from echosieve import Params, Workspace, deduplicate
from echosieve.operators import metrics
from echosieve.sources.readers import stream_corpus
from echosieve.streaming import reports, runner
from echosieve.streaming.steps import register_step
from echosieve.workspace import exists
from pyspark.sql import functions as F

DOCS = "/root/testdata/sf0.001/documents.parquet"
BLOOM = {"bloom_capacity": 60, "bloom_error_rate": 0.05}
CASES = [
    Params(),
    Params(method="bloomfilter", **BLOOM),
    Params(method="minhash_bloom_hybrid", **BLOOM),
    Params(method="minhash", minhash_threshold=0.6),
]


def land(docs, inbox, lo, hi):
    docs.filter(docs.doc_id.between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(inbox)


def run(spark, docs, inbox, params, folders):
    stream = stream_corpus(spark, inbox, params, docs.schema)
    query = runner.start(stream, params, folders)
    query.awaitTermination()
    assert query.exception() is None


def kept(spark, folders):
    return sorted(r.doc_id for r in runner.kept_rows(spark, folders).collect())


@pytest.mark.parametrize("params", CASES, ids=lambda p: p.method)
def test_stream_equals_batch_across_a_restart(spark, work, params):
    docs = spark.read.parquet(DOCS)
    inbox, folders = work.path("inbox"), runner.StreamFolders(work.path("stream"))
    land(docs, inbox, 0, 70)
    land(docs, inbox, 70, 120)
    run(spark, docs, inbox, params, folders)
    assert folders.counts().read(spark).count() == 2
    land(docs, inbox, 120, 200)
    run(spark, docs, inbox, params, folders)
    want = sorted(r.doc_id for r in deduplicate(docs, params).select("doc_id").collect())
    assert kept(spark, folders) == want
    counts = runner.batch_counts(spark, folders)
    assert {(r.chunk, r.original) for r in counts.collect()} == {(0, 70), (1, 50), (2, 80)}
    total = metrics.final_summary(counts, None).first()
    assert total.total_deduplicated_count == len(want)


def test_repeated_batch_changes_nothing(spark, work):
    params = Params(method="minhash", minhash_threshold=0.6)
    docs = spark.read.parquet(DOCS)
    folders = runner.StreamFolders(work.path("stream"))
    parts = [docs.filter(docs.doc_id.between(lo, lo + 99)) for lo in (0, 100)]
    for batch_id, part in enumerate(parts):
        runner.process_batch(part, batch_id, params, folders)
    before = kept(spark, folders)
    state = folders.state(params).read(spark).count()
    for batch_id, part in enumerate(parts):
        runner.process_batch(part, batch_id, params, folders)
    assert kept(spark, folders) == before
    assert folders.state(params).read(spark).count() == state


def test_owners_reach_back_to_earlier_batches(spark, work):
    df = spark.createDataFrame(
        [(0, "a b c"), (1, "d e f"), (2, "a b c"), (3, "d e f"), (4, "a b c")],
        "doc_id bigint, text string",
    )
    for params in (Params(), Params(method="minhash")):
        folders = runner.StreamFolders(work.path("stream"))
        for batch_id, (lo, hi) in enumerate([(0, 1), (1, 3), (3, 5)]):
            runner.process_batch(df.filter(df.doc_id.between(lo, hi - 1)), batch_id, params, folders)
        got = {r.pos: r.owner_pos for r in folders.dropped().read(spark).collect()}
        assert got == {2: 0, 3: 1, 4: 0}


def test_hot_text_across_batches(spark, work):
    texts = {i: "same" if i % 3 == 0 else f"t{i % 400}" for i in range(900)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    params = Params(hot_rows=20)
    folders = runner.StreamFolders(work.path("stream"))
    for batch_id in range(3):
        part = df.filter(df.doc_id.between(batch_id * 300, batch_id * 300 + 299))
        runner.process_batch(part, batch_id, params, folders)
    keys = [(i, hashlib.md5(t.encode()).hexdigest()) for i, t in texts.items()]
    assert kept(spark, folders) == models.first_seen(keys)


def test_compacted_state_gives_the_same_result(spark, work):
    docs = spark.read.parquet(DOCS)
    params = Params()
    folders = runner.StreamFolders(work.path("stream"))
    parts = [docs.filter(docs.doc_id.between(lo, lo + 49)) for lo in range(0, 200, 50)]
    for batch_id in range(3):
        runner.process_batch(parts[batch_id], batch_id, params, folders)
    compact = folders.state(params).compact_into(spark, work.path("state"), 1)
    for batch_id in (2, 3):
        old, new = (
            {(bytes(r.fp), r.pos) for r in state.before(spark, batch_id).collect()}
            for state in (folders.state(params), compact)
        )
        assert old == new
    moved = runner.StreamFolders(folders.root, compact.path)
    for batch_id in (2, 3):  # batch 2 is run again, as after a failure
        runner.process_batch(parts[batch_id], batch_id, params, moved)
    want = sorted(r.doc_id for r in deduplicate(docs, params).select("doc_id").collect())
    assert kept(spark, moved) == want


def test_chunk_limit_and_unknown_method(spark, work):
    docs = spark.read.parquet(DOCS)
    inbox = work.path("inbox")
    for lo in (0, 50, 100):
        land(docs, inbox, lo, lo + 50)
    folders = runner.StreamFolders(work.path("stream"))
    limited = Params(max_chunks=3, chunk_size=25)  # ends within the second file
    stream = stream_corpus(spark, inbox, limited, docs.schema)
    assert runner.finish(runner.start(stream, limited, folders)) is True
    first = docs.filter("doc_id < 75")
    want = lambda df: sorted(r.doc_id for r in deduplicate(df, Params()).select("doc_id").collect())
    assert kept(spark, folders) == want(first)
    stream = stream_corpus(spark, inbox, Params(), docs.schema)
    assert runner.finish(runner.start(stream, Params(), folders)) is False
    assert kept(spark, folders) == want(docs.filter("doc_id < 150"))
    with pytest.raises(ValueError, match="available"):
        runner.start(stream_corpus(spark, inbox, Params(), docs.schema), Params(method="x"), folders)


# --- rows without positions, chunks of rows, reports ------------------------------------


def land_unnumbered(docs, inbox, lo, hi, format="parquet"):
    part = docs.filter(docs.doc_id.between(lo, hi - 1)).coalesce(1)
    part.sortWithinPartitions("doc_id").select("text", "lang").write.mode("append").format(
        format
    ).save(inbox)


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_rows_are_numbered_in_order_of_arrival(spark, work, format):
    docs = spark.read.parquet(DOCS)
    inbox, folders = work.path("inbox"), runner.StreamFolders(work.path("stream"))
    params = Params(order_column="pos")
    schema = "text string, lang string"

    def go():
        stream = stream_corpus(
            spark, inbox, params, schema, format, files_per_batch=2, numbered=False
        )
        assert runner.finish(runner.start(stream, params, folders)) is False

    for lo, hi in ((0, 70), (70, 90), (90, 150)):
        land_unnumbered(docs, inbox, lo, hi, format)
    go()
    land_unnumbered(docs, inbox, 150, 200, format)
    go()
    got = runner.kept_rows(spark, folders).select("pos", "text").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = models.first_seen([(i, hashlib.md5(t.encode()).hexdigest()) for i, t in texts.items()])
    assert sorted((r.pos, r.text) for r in got) == [(i, texts[i]) for i in want]
    ledger = folders.ledger().read(spark).orderBy("first").collect()
    assert [r.first for r in ledger] == [sum(r.rows for r in ledger[:n]) for n in range(len(ledger))]
    with pytest.raises(ValueError, match="numbered=False"):
        runner.start(stream_corpus(spark, inbox, params, schema, format), params, folders)


def test_repeated_unnumbered_batch_gets_the_same_positions(spark, work):
    docs = spark.read.parquet(DOCS)
    inbox, folders = work.path("inbox"), runner.StreamFolders(work.path("stream"))
    params = Params(order_column="pos")
    for lo in (0, 40, 80):
        land_unnumbered(docs, inbox, lo, lo + 40)

    def arrived():
        from echosieve.streaming.arrivals import with_arrival

        return with_arrival(spark.read.schema("text string, lang string").parquet(inbox))

    first, seen = arrived(), {}
    for batch_id in (0, 1, 0, 1):  # the second batch holds the same files, as copies
        runner.process_batch(first, batch_id, params, folders)
        ledger = [tuple(r) for r in folders.ledger().of(spark, batch_id).orderBy("first").collect()]
        assert seen.setdefault(batch_id, ledger) == ledger
    assert seen[1][0][3] == 120
    want = models.first_seen([(r.doc_id, r.text) for r in docs.filter("doc_id < 120").collect()])
    assert sorted(kept_column(spark, folders, "pos")) == want


def kept_column(spark, folders, name):
    return [r[name] for r in runner.kept_rows(spark, folders).collect()]


@pytest.mark.parametrize("sizes", [(70, 120, 200), (10, 11, 12, 200), (200,)])
def test_chunks_of_rows_equal_a_run_at_rest(spark, work, sizes):
    docs = spark.read.parquet(DOCS)
    params = Params(chunk_size=30, top_n_duplicates=5)
    inbox = work.path("inbox")
    folders = runner.StreamFolders(work.path("stream"), row_chunks=True)
    lo = 0
    for n, hi in enumerate(sizes):
        land(docs, inbox, lo, hi)
        lo = hi
        if n in (0, len(sizes) - 1):  # two starts; the first flush leaves a chunk to fill up
            stream = stream_corpus(spark, inbox, params, docs.schema)
            assert runner.finish(runner.start(stream, params, folders), params, folders) is False
            assert kept(spark, folders) == sorted(
                r.doc_id for r in deduplicate(docs.filter(docs.doc_id < hi), params).collect()
            )
    dropped = method_dropped(docs, params, work)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = metrics.chunk_counts(docs, dropped, params)
    assert rows(runner.batch_counts(spark, folders).select(want.columns)) == rows(want)
    from echosieve.operators import groups

    assert rows(reports.top_groups(spark, params, folders)) == rows(
        groups.top_groups(docs, dropped, params)
    )
    want = groups.pair_sample(docs, dropped, params, work)
    assert rows(reports.pair_sample(spark, params, folders, work).select(want.columns)) == rows(want)
    want = groups.with_duplicate_count(docs, dropped, params, work)
    got = reports.with_duplicate_count(spark, params, folders, work)
    assert rows(got.select(want.columns)) == rows(want)
    chunks = {(r.doc_id, r.chunk) for r in runner.kept_rows(spark, folders).collect()}
    assert all(chunk == i // 30 for i, chunk in chunks)


def method_dropped(docs, params, work):
    from echosieve import method

    return method(params.method)(docs, params, work)


def test_broken_steps_are_not_seen(spark, work, monkeypatch):
    docs = spark.read.parquet(DOCS)
    params = Params(chunk_size=30)
    folders = runner.StreamFolders(work.path("stream"), row_chunks=True)
    part = lambda lo, hi: docs.filter(docs.doc_id.between(lo, hi - 1))
    runner.process_batch(part(0, 100), 0, params, folders)
    before = kept(spark, folders)
    assert before == models.first_seen([(r.doc_id, r.text) for r in part(0, 90).collect()])

    def fail(spark, folder, name):
        if folder == folders.commits:
            raise RuntimeError("the driver is gone")
        return real(spark, folder, name)

    real = runner.mark
    monkeypatch.setattr(runner, "mark", fail)
    with pytest.raises(RuntimeError):
        runner.flush(spark, params, folders)
    assert exists(spark, f"{folders.rows}/{runner.ROWS_KEY}=1")
    with pytest.raises(RuntimeError):
        runner.process_batch(part(100, 170), 1, params, folders)
    assert kept(spark, folders) == before
    assert runner.batch_counts(spark, folders).agg(F.sum("original")).first()[0] == 90
    monkeypatch.setattr(runner, "mark", real)
    runner.process_batch(part(100, 170), 1, params, folders)
    runner.flush(spark, params, folders)
    runner.flush(spark, params, folders)  # nothing waits any more
    want = models.first_seen([(r.doc_id, r.text) for r in part(0, 170).collect()])
    assert kept(spark, folders) == want


def test_chunk_limit_with_chunks_of_rows(spark, work):
    docs = spark.read.parquet(DOCS)
    inbox = work.path("inbox")
    for lo in (0, 50, 100):
        land(docs, inbox, lo, lo + 50)
    folders = runner.StreamFolders(work.path("stream"), row_chunks=True)
    for limit, rows in ((3, 75), (None, 150)):
        params = Params(max_chunks=limit, chunk_size=25)
        stream = stream_corpus(spark, inbox, params, docs.schema)
        ended = runner.finish(runner.start(stream, params, folders), params, folders)
        assert ended is (limit is not None)
        want = deduplicate(docs.filter(docs.doc_id < rows), Params())
        assert kept(spark, folders) == sorted(r.doc_id for r in want.collect())


def test_registered_step(spark, work):
    """A rule of one's own: one row per language."""
    def step(batch, state, params, work):
        new = work.table(batch.groupBy("lang").agg(F.min("doc_id").alias("pos")).join(
            state.select("lang"), "lang", "left_anti"
        ), "new")
        gone = batch.select(F.col("doc_id").alias("pos")).join(new, "pos", "left_anti")
        return gone.withColumn("owner_pos", F.lit(None).cast("bigint")), new

    register_step("per_language", step, "lang string, pos bigint")
    docs = spark.read.parquet(DOCS)
    inbox, folders = work.path("inbox"), runner.StreamFolders(work.path("stream"))
    params = Params(method="per_language")
    land(docs, inbox, 0, 90)
    land(docs, inbox, 90, 200)
    run(spark, docs, inbox, params, folders)
    want = docs.groupBy("lang").agg(F.min("doc_id").alias("i")).collect()
    assert kept(spark, folders) == sorted(r.i for r in want)


def test_bitmaps_hold_and_merge_any_bits(spark, work):
    import random

    from echosieve.operators import bloom

    rng = random.Random(8)
    edges = [0, 1, 7, 8, 32_767, 32_768, 65_535, 65_536]
    first, second = ({*rng.sample(range(200_000), 500), *edges[::2]}, {*rng.sample(range(200_000), 500), *edges})
    rows = lambda bits: spark.createDataFrame([(b,) for b in bits], "bit long")
    packed = work.table(bloom.packed(rows([*first, *first])), "first")
    both = work.table(bloom.merged(packed.unionAll(bloom.packed(rows(second)))), "both")
    assert both.agg(bloom.bits_set()).first()[0] == len(first | second)
    probe = sorted({*rng.sample(range(300_000), 3000), *edges, *first, *second})
    got = {r.bit for r in bloom.unset(rows(probe), both).collect()}
    assert got == set(probe) - first - second
    assert bloom.unset(rows(probe), both.limit(0)).count() == len(probe)


def test_compacted_bitmaps_give_the_same_result(spark, work):
    docs = spark.read.parquet(DOCS)
    params = Params(method="bloomfilter", bloom_capacity=20_000, bloom_error_rate=0.01)
    folders = runner.StreamFolders(work.path("stream"))
    parts = [docs.filter(docs.doc_id.between(lo, lo + 49)) for lo in range(0, 200, 50)]
    for batch_id in range(3):
        runner.process_batch(parts[batch_id], batch_id, params, folders)
    compact = folders.state(params).compact_into(spark, work.path("state"), 1)
    before, after = (t.read(spark).filter("batch < 2") for t in (folders.state(params), compact))
    assert after.count() < before.count()
    moved = runner.StreamFolders(folders.root, compact.path)
    for batch_id in (2, 3):
        runner.process_batch(parts[batch_id], batch_id, params, moved)
    want = sorted(r.doc_id for r in deduplicate(docs, params).select("doc_id").collect())
    assert kept(spark, moved) == want


def _plan(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.toString()


def test_bucketed_state_is_not_shuffled(spark, work):
    from echosieve.streaming.bucketed import BucketedTable

    keys = spark.range(900).select(
        F.unhex(F.md5(F.col("id").cast("string"))).alias("fp"), F.col("id").alias("pos")
    )
    table = BucketedTable(work.path("state"), "fp binary, pos bigint", 16)
    for batch in (0, 1, 2, 1):  # the second is run again
        table.write(keys.filter(F.col("pos") % 3 == batch), batch)
    table.forget(spark)  # as in a new session
    assert {(r.batch, r.n) for r in table.read(spark).groupBy("batch").agg(
        F.count("*").alias("n")).collect()} == {(0, 300), (1, 300), (2, 300)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = table.before(spark, 2).join(keys.select("fp").distinct(), "fp", "left_semi")
        state_side = _plan(found).split("SortMergeJoin")[1].split("FileScan")[0]
        assert "Exchange" not in state_side and "Bucketed: true" in _plan(found)
        assert sorted(r.pos for r in found.collect()) == [i for i in range(900) if i % 3 < 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("params", [CASES[0], CASES[1], CASES[3]], ids=lambda p: p.method)
def test_stream_with_bucketed_state(spark, work, params):
    docs = spark.read.parquet(DOCS)
    folders = runner.StreamFolders(work.path("stream"), state_buckets=9)
    parts = [docs.filter(docs.doc_id.between(lo, lo + 49)) for lo in range(0, 200, 50)]
    for batch_id in (0, 1, 1, 2):
        runner.process_batch(parts[batch_id], batch_id, params, folders)
    compact = folders.state(params).compact_into(spark, work.path("state"), 4)
    moved = runner.StreamFolders(folders.root, compact.path, state_buckets=9)
    for batch_id in (2, 3):
        runner.process_batch(parts[batch_id], batch_id, params, moved)
    want = sorted(r.doc_id for r in deduplicate(docs, params).select("doc_id").collect())
    assert kept(spark, moved) == want


def test_registered_streams_deliver_by_many_tasks(spark, work):
    from catalog import queries
    from echosieve.workspace import _at, marks

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    docs = spark.read.parquet(DOCS)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        inbox = work.path("inbox")
        files = queries._delivered(docs.filter("doc_id not between 10 and 49"), inbox, 50, [])
        names = [[n for n in marks(spark, f"{inbox}/{at}") if n.startswith("part-")] for at in range(4)]
        times = []
        for at in range(4):
            path, store = _at(spark, f"{inbox}/{at}")
            times.append({f.getModificationTime() for f in store.listStatus(path)})
        running = queries.stream_chunk_running(spark, DOCS.rsplit("/", 1)[0]).orderBy("chunk_index")
        sizes = [r.processed_total for r in running.collect()]
        unnumbered = queries.stream_unnumbered_kept(spark, DOCS.rsplit("/", 1)[0]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert files > 1 and [len(n) for n in names] == [files] * 4
    assert [len(t) for t in times] == [1] * 4 and sorted(times, key=min) == times
    assert sizes == [50] * 4
    firsts = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).collect()
    assert sorted(r.doc_id for r in unnumbered) == sorted(r.doc_id for r in firsts)
