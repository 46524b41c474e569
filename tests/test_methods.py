import hashlib

import pytest
from pyspark.sql import functions as F

import models
from echosieve import BloomShape, Params, deduplicate, method, register
from echosieve.operators import bloom, exact, groups, hybrid, metrics, minhash
from echosieve.operators.survivors import keep, removed

DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def kept_ids(df, params):
    return sorted(r.doc_id for r in deduplicate(df, params).select("doc_id").collect())


def test_exact_equals_scan(docs, texts):
    want = models.first_seen([(i, hashlib.md5(t.encode()).hexdigest()) for i, t in texts.items()])
    assert kept_ids(docs, Params()) == want
    assert sorted(r.pos for r in exact.kept_positions(docs, Params()).collect()) == want


def test_minhash_equals_scan(docs, texts, work):
    params = Params(method="minhash", minhash_threshold=0.6)
    shape = params.bands()
    rows = {
        i: models.band_keys(models.signature(models.words(t), 150), shape)
        for i, t in texts.items()
    }
    kept, owner = models.chosen(rows)
    assert len(owner) > 5
    assert kept_ids(docs, params) == kept
    got = {r.pos: r.owner_pos for r in minhash.dropped(docs, params, work).collect()}
    assert got == owner


@pytest.mark.parametrize("n,p", [(40, 0.05), (200, 0.01)])
def test_bloom_equals_scan(docs, texts, n, p):
    params = Params(method="bloomfilter", bloom_capacity=n, bloom_error_rate=p)
    shape = params.bloom()
    prints = [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()]
    kept, bits = models.filtered(prints, shape.m, shape.k)
    assert kept_ids(docs, params) == kept
    assert bloom.first_setters(bloom.fingerprints(docs, params), shape).count() == bits


def test_bloom_bits_of_wide_filters(spark):
    fp = hashlib.sha256(b"x").hexdigest()
    rows = spark.createDataFrame([(1, fp)], "pos bigint, fp string")
    for m in (1870, (1 << 31) - 1, 1 << 31, (1 << 47) - 1):
        got = [r.bit for r in bloom.bloom_bits(rows, "fp", BloomShape(m, 5)).orderBy("i").collect()]
        assert got == [
            int(hashlib.sha256(f"{fp}{i}".encode()).hexdigest(), 16) % m for i in range(5)
        ]
    with pytest.raises(ValueError):
        bloom.bloom_bits(rows, "fp", BloomShape(1 << 47, 5))


def test_hybrid_equals_scan(docs, texts):
    params = Params(
        method="minhash_bloom_hybrid", bloom_capacity=60, bloom_error_rate=0.05, min_tasks=4
    )
    prints = [
        (i, models.signature_print(models.signature(models.shingles(t, 2), 128)))
        for i, t in texts.items()
    ]
    shape = params.bloom()
    assert kept_ids(docs, params) == models.filtered(prints, shape.m, shape.k)[0]


def test_short_documents_collapse_in_the_hybrid(spark):
    df = frame(spark, [(0, ""), (1, "a"), (2, "b"), (3, "a b")])
    params = Params(
        method="minhash_bloom_hybrid", bloom_capacity=1000, bloom_error_rate=0.01
    )
    assert kept_ids(df, params) == [0, 3]


def test_signature_over_several_slabs(spark):
    from echosieve.functions.minhash import signature

    rows = [(i, [f"w{j}" for j in range(i * 37 % 90)]) for i in range(40)]
    df = spark.createDataFrame(rows, "pos bigint, words array<string>").coalesce(1)
    got = df.select("pos", signature(F.col("words"), 20, slab=64).alias("s")).collect()
    assert {r.pos: list(r.s) for r in got} == {i: models.signature(w, 20) for i, w in rows}


def test_runs_are_signed_like_their_texts(spark):
    """Runs of words across slabs, long ones and such of any script included."""
    from echosieve.functions.minhash import signature

    rows = [(0, []), (1, ["a"]), (2, ["a", "b"]), (3, [f"w{i % 50}" for i in range(400)]),
            (4, ["x" * n for n in range(70)]), (5, ["é", "日本語", "😀" * 20, ""]), (6, ["b"])]
    df = spark.createDataFrame(rows, "pos long, words array<string>").coalesce(1)
    for run in (1, 2, 3):
        got = df.select("pos", signature(F.col("words"), 20, run=run, slab=64).alias("s")).collect()
        texts = {i: [" ".join(w[at:at + run]) for at in range(len(w) - run + 1)] for i, w in rows}
        assert {r.pos: list(r.s) for r in got} == {i: models.signature(t, 20) for i, t in texts.items()}


def test_nulls(spark):
    df = frame(spark, [(0, None), (1, "None"), (2, "x")])
    bloomy = {"bloom_capacity": 1000, "bloom_error_rate": 0.01}
    assert kept_ids(df, Params(method="bloomfilter", **bloomy)) == [0, 2]
    for name in ("exact", "minhash"):
        with pytest.raises(Exception, match="holds a null"):
            kept_ids(df, Params(method=name))


def test_key_column(spark):
    df = spark.createDataFrame(
        [(0, "a", 7), (1, "b", 7), (2, "a", 8)], "doc_id bigint, text string, k int"
    )
    params = Params(method="bloomfilter", key="k", bloom_capacity=1000, bloom_error_rate=0.01)
    assert kept_ids(df, params) == [0, 2]
    single = Params(
        method="minhash_bloom_hybrid", key="k", minhash_ngram_size=1, bloom_capacity=1000,
        bloom_error_rate=0.01,
    )
    assert kept_ids(df, single) == [0, 2]
    with pytest.raises(Exception, match="nokey"):
        kept_ids(df, params.but(key="nokey"))


def test_order_decides_not_layout(spark, docs):
    shuffled = docs.repartition(7, F.rand(3))
    for params in (
        Params(), Params(method="minhash"),
        Params(method="bloomfilter", bloom_capacity=40, bloom_error_rate=0.05),
    ):
        assert kept_ids(shuffled, params) == kept_ids(docs, params)


def test_idempotent_and_complete(docs, work):
    for params in (
        Params(), Params(method="minhash"),
        Params(method="bloomfilter", bloom_capacity=40, bloom_error_rate=0.05),
    ):
        dropped = method(params.method)(docs, params, work)
        kept = keep(docs, dropped, params)
        assert kept.columns == docs.columns
        assert kept.count() + removed(docs, dropped, params).count() == docs.count()
        assert kept_ids(kept, params) == sorted(r.doc_id for r in kept.collect())


def test_hot_text_is_joined_in_shares(spark, work):
    df = frame(spark, [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(3000)])
    params = Params(hot_rows=50)
    dropped = exact.dropped(df.repartition(6), params, work)
    assert {(r.pos, r.owner_pos) for r in dropped.collect()} == {
        (i, 0) for i in range(3, 3000, 3)
    }
    ranks = {r.pos: r.ordinal for r in groups.ordinals(dropped).collect()}
    assert ranks == {i: i // 3 for i in range(3, 3000, 3)}
    texts = groups.pair_texts(df, dropped, params, work)
    assert texts.filter((F.col("text") == "same") & (F.col("owner_text") == "same")).count() == 999


def test_duplicate_counts_both_alignments(spark, work):
    df = frame(spark, [(0, "A"), (1, "A"), (2, "B")])
    dropped = exact.dropped(df, Params(), work)
    now = groups.with_duplicate_count(df, dropped, Params(), work).collect()
    assert {r.text: r.duplicate_count for r in now} == {"A": 1, "B": 0}
    old = groups.with_shifted_duplicate_count(df, dropped, Params(), work).collect()
    assert {r.text: r.duplicate_count for r in old} == {"A": 0, "B": 1}


def test_ties_in_top_groups(spark, work):
    long = "x" * 201
    df = frame(spark, [(0, "q"), (1, long), (2, "z"), (3, "z"), (4, long), (5, "y" * 200)])
    dropped = exact.dropped(df, Params(), work)
    top = groups.top_groups(df, dropped, Params()).collect()
    assert [(r.owner_pos, r.group_size) for r in top] == [(1, 2), (2, 2)]
    assert top[0].text_sample == "x" * 200 + "..." and top[1].text_sample == "z"
    assert len(groups.top_groups(df, dropped, Params(top_n_duplicates=1)).collect()) == 1


def test_custom_method(spark, work):
    register("longest_only", lambda df, params, work: work.table(
        df.filter(F.length("text") < 3).select(F.col("doc_id").alias("pos")), "dropped"))
    df = frame(spark, [(0, "ab"), (1, "abc")])
    assert kept_ids(df, Params(method="longest_only")) == [1]
    with pytest.raises(ValueError, match="available: .*exact"):
        method("nope")


def test_membership_and_saturation(spark, work):
    params = Params(bloom_capacity=1000, bloom_error_rate=0.01)
    shape = params.bloom()
    df = frame(spark, [(i, f"t{i % 5}") for i in range(7)])
    prints = bloom.fingerprints(df, params)
    setters = bloom.first_setters(prints, shape)
    probe = bloom.fingerprints(frame(spark, [(1, "t3"), (2, "other")]), params)
    got = {r.pos: r.is_member for r in bloom.contains(probe, ["pos"], setters, shape).collect()}
    assert got == {1: True, 2: False}
    steps = bloom.saturation(prints, shape, 3, work).orderBy("step").collect()
    assert [r.processed_docs for r in steps] == [3, 6, 7]
    for row in steps:
        seen = [(i, hashlib.sha256(f"t{i % 5}".encode()).hexdigest())
                for i in range(row.processed_docs)]
        assert row.bits_set == models.filtered(seen, shape.m, shape.k)[1]


def test_metrics_definitions(spark, work):
    params = Params(chunk_size=3)
    df = frame(spark, list(enumerate("aabacad")))
    counts = metrics.chunk_counts(df, exact.dropped(df, params, work), params)
    rows = [(r.chunk, r.original, r.kept, r.removed) for r in counts.orderBy("chunk").collect()]
    assert rows == [(0, 3, 2, 1), (1, 3, 1, 2), (2, 1, 1, 0)]
    ex = metrics.exact_metrics(counts).orderBy("chunk_index").collect()
    assert [(r.processed_total, r.duplicates, r.duplicate_ratio) for r in ex] == [
        (3, 1, 1 / 3), (3, 3, 1.0), (1, 3, 3.0)]
    mh = metrics.minhash_metrics(counts).orderBy("chunk_index").collect()
    assert [(r.processed_total, r.global_unique, r.global_duplicates) for r in mh] == [
        (3, 2, 1), (6, 3, 3), (7, 4, 3)]
    assert metrics.logged(metrics.exact_metrics(counts)).columns == [
        "chunk_index", "processed_total", "duplicate_ratio"]
    total = metrics.final_summary(counts, None).first()
    assert (total.total_original_count, total.total_duplicates_removed) == (7, 3)
    assert total.avg_duplicate_ratio == 0.0
    empty = metrics.final_summary(counts.limit(0), metrics.exact_metrics(counts.limit(0))).first()
    assert empty.total_original_count == 0 and empty.total_compression_ratio == 0.0


def test_output_in_corpus_order(spark, docs):
    from echosieve.operators.survivors import in_order

    ids = [r.doc_id for r in in_order(deduplicate(docs.repartition(5), Params()), Params()).collect()]
    assert ids == sorted(ids)


def test_method_overlap_runs_its_methods_side_by_side(spark, monkeypatch):
    from threading import Barrier

    from catalog import queries

    all_there, one = Barrier(4, timeout=30), queries._Run.dropped

    def dropped(run):
        all_there.wait()
        return one(run)

    monkeypatch.setattr(queries._Run, "dropped", dropped)
    rows = queries.method_overlap(spark, "/root/testdata/sf0.001").collect()
    assert any(r.by_exact and r.by_minhash for r in rows)
