import pytest
from pyspark.sql import functions as F

import models
from echosieve import Params, Workspace, run
from echosieve.functions import text as tx
from echosieve.operators import exact, groups, similarity
from echosieve.sources import readers, sinks
from echosieve.workspace import shared_folder

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_positions_are_dense_and_ordered(spark, work):
    df = spark.createDataFrame([(i * 7919 % 1009, f"v{i}") for i in range(1000)], "k int, v string")
    rows = readers.with_positions(df, ["k"], work, partitions=5).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1000))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_chunks_and_limit(spark):
    df = spark.range(7).withColumnRenamed("id", "doc_id")
    params = Params(chunk_size=3)
    sizes = readers.with_chunk(df, params).groupBy("chunk").count().orderBy("chunk").collect()
    assert [(r.chunk, r["count"]) for r in sizes] == [(0, 3), (1, 3), (2, 1)]
    assert readers.limit_chunks(df, params.but(max_chunks=2)).count() == 6
    assert readers.limit_chunks(df, params).count() == 7


def test_limit_reaches_the_scan(spark):
    df = readers.read_corpus(spark, DOCS, Params(chunk_size=10, max_chunks=2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(doc_id,20)" in plan


@pytest.mark.parametrize("format", ["parquet", "json", "orc", "csv"])
def test_config_and_split_folders(spark, work, format):
    rows = [(0, "a", "en", "train"), (1, "b", "en", "test"), (2, "c", "de", "train")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, config string, split string")
    path = work.path("corpus")
    df.write.format(format).partitionBy("config", "split").save(path)
    schema = "doc_id bigint, text string, config string, split string"
    read = lambda p: sorted(
        r.text for r in readers.read_corpus(spark, path, p, format, schema=schema).collect()
    )
    named = Params(dataset_config="en", config_column="config", split_column="split")
    assert read(named) == ["a"]
    assert read(named.but(dataset_split="test")) == ["b"]
    assert read(Params(split_column="split")) == ["a", "c"]
    assert read(Params(dataset_config="en")) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="no column"):
        read(Params(split_column="part"))
    with pytest.raises(ValueError, match="needs a dataset_config"):
        Params(config_column="config")


def test_chunks_above_the_doubles(spark):
    top = 2**53 + 1
    df = spark.createDataFrame([(top,), (top + 1,)], "doc_id bigint")
    got = readers.with_chunk(df, Params(chunk_size=1)).orderBy("doc_id").collect()
    assert [r.chunk for r in got] == [top, top + 1]


def test_positions_by_file(spark, work):
    path = work.path("files")
    for at in range(4):
        rows = [(f"f{at}r{i}", i % 2) for i in range(5 - at)]
        spark.createDataFrame(rows, "text string, n int").coalesce(1).write.parquet(f"{path}/part={at}")
    df = spark.read.parquet(path)
    got = readers.with_file_positions(df, work).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(14))
    assert [r.text for r in got] == [f"f{a}r{i}" for a in range(4) for i in range(5 - a)]
    plan = readers.with_file_positions(df, work)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan


def test_positions_by_file_writes_and_joins_in_many_tasks(spark):
    from catalog.queries import positions_by_file

    keep = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keep}
    try:
        for key, value in keep.items():
            spark.conf.set(key, value)
        df = positions_by_file(spark, "/root/testdata/sf0.001")
        files = [f for f in df.inputFiles() if "/part=" in f]
        got = [(r.pos, r.source, r.n_chars) for r in df.orderBy("pos").collect()]
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(files) > 8 and "hashpartitioning" not in plan
    rows = spark.read.parquet(DOCS).orderBy(F.col("doc_id") % 3 > 0, "doc_id").collect()
    assert got == [(n, r.source, r.n_chars) for n, r in enumerate(rows)]


def test_batch_run_writes_everything(spark, work):
    params = Params(
        method="minhash", dataset_config="en", chunk_size=50, max_chunks=3, minhash_threshold=0.6
    )
    out = work.path("out")
    result = run(spark, params, DOCS, out)
    with pytest.raises(FileExistsError):
        run(spark, params, DOCS, out)
    result = run(spark, params.but(dataset_name=DOCS), None, out, overwrite=True)
    out = result.reports
    assert result.path.endswith("/deduplicated_en_using_minhash_with_0k_data")
    rows = spark.read.parquet(result.path)
    docs = spark.read.parquet(DOCS).filter("doc_id < 150")
    total = result.summary.first()
    assert rows.count() == total.total_deduplicated_count
    assert rows.count() + result.dropped.count() == docs.count() == 150
    assert {r.chunk for r in rows.select("chunk").distinct().collect()} <= {0, 1, 2}
    assert spark.read.parquet(f"{out}/metrics/chunk").count() == 3
    assert "global_unique" in spark.read.parquet(f"{out}/metrics/method").columns
    assert spark.read.parquet(f"{out}/metrics/summary").count() == 1
    pairs = spark.read.parquet(f"{out}/pairs")
    assert set(sinks.PAIR_COLUMNS) <= set(pairs.columns)
    assert {r.Parameter for r in pairs.collect()} == {"0.6"}
    assert rows.agg(F.sum("duplicate_count")).first()[0] == total.total_duplicates_removed
    assert spark.read.parquet(f"{out}/metrics/share").count() == 2
    assert spark.read.parquet(f"{out}/metrics/trend").count() == 3
    assert spark.read.parquet(f"{out}/top_duplicates").count() <= 10


def test_batch_run_of_a_bloom_method(spark, work):
    params = Params(
        method="bloomfilter", bloom_capacity=1000, bloom_error_rate=0.01, chunk_size=100
    )
    result = run(spark, params, DOCS, work.path("out"), cluster=False, rows_per_file=20)
    assert result.top_groups is None and result.method_metrics is None
    assert result.saturation.count() == 2
    assert result.summary.first().avg_duplicate_ratio == 0.0
    sizes = spark.read.parquet(result.path).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) <= 20


def test_csv_keeps_quotes_and_line_breaks(spark, work):
    odd = 'say "x",\nnext, "y"\\ end'
    df = spark.createDataFrame([(0, odd), (1, odd), (2, "z")], "doc_id bigint, text string")
    params = Params()
    dropped = exact.dropped(df, params, work)
    pairs = groups.sized_pairs(dropped, params, work)
    texts = groups.pair_texts(df, pairs, params, work)
    path = work.path("csv")
    sinks.write_csv(sinks.csv_rows(texts, 1.0), path)
    row = sinks.read_csv(spark, path).first()
    assert (row.group_id, row.group_size, row.similarity_threshold) == ("doc_0", 2, 1.0)
    assert row.text_original == row.text_duplicate == odd
    dump = work.path("dump")
    sinks.write_dump(texts, dump)
    lines = [r.value for r in spark.read.text(dump).collect()]
    assert lines[0] == "Current Text:" and "Matched With:" in lines and set(lines[-1]) == {"-"}


def test_text_functions_equal_python(spark):
    samples = ["", " ", "a", "a b", " a  b\tc ", "x\x1cy z　w", "Don't stop_it 3.5 é", "a b b a"]
    df = spark.createDataFrame(list(enumerate(samples)), "id int, t string")
    df = df.withColumn("words", tx.blank_tokens(F.col("t")))
    got = df.select(
        "t", "words", tx.word_tokens(F.col("t")).alias("tokens"),
        *[tx.word_shingles(F.col("words"), n).alias(f"s{n}") for n in (1, 2, 3)],
    ).collect()
    for r in got:
        assert r.words == r.t.split()
        assert set(r.tokens) == models.words(r.t) and len(set(r.tokens)) == len(r.tokens)
        for n in (1, 2, 3):
            assert set(r[f"s{n}"]) == models.shingles(r.t, n)


def test_lines_and_differences(spark):
    rows = [(1, 0, "a\nb\r\nc\n", "b\nx\n\ny"), (3, 2, "", "q"), (5, 4, "same\n", "same")]
    df = spark.createDataFrame(rows, "pos bigint, owner_pos bigint, owner_text string, text string")
    got = {r.pos: r for r in similarity.line_differences(df).collect()}
    assert (got[1].unchanged, got[1].removed, got[1].added) == (["b"], ["a", "c"], ["x", "", "y"])
    assert (got[3].removed, got[3].added) == ([], ["q"])
    assert (got[5].unchanged, got[5].removed, got[5].added) == (["same"], [], [])


def test_histogram_edges(spark):
    def bins(values):
        df = spark.createDataFrame([(v,) for v in values], "jaccard double")
        rows = similarity.histogram(df).orderBy("bin").collect()
        return [r.pairs for r in rows]

    got = bins([0.0, 0.049, 0.05, 0.5, 1.0])
    assert len(got) == 20 and sum(got) == 5 and got[0] == 2 and got[1] == 1 and got[19] == 1
    assert bins([0.7, 0.7])[0] == 2
    assert bins([]) == []


def test_jaccard_of_matches(spark, work):
    df = spark.createDataFrame(
        [(0, "a b c d"), (1, "a b c e"), (2, ""), (3, "")], "doc_id bigint, text string"
    )
    matches = work.table(
        spark.createDataFrame([(1, 0), (3, 2)], "pos bigint, owner_pos bigint"), "matches"
    )
    got = similarity.scored_pairs(df, matches, Params(), work).collect()
    assert {r.pos: r.jaccard for r in got} == {1: 0.6, 3: 1.0}


def test_workspace_removes_only_itself(spark):
    one, two = Workspace(spark), Workspace(spark)
    left = two.table(spark.range(3), "numbers")
    one.table(spark.range(3), "numbers")
    one.remove()
    assert left.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{one.folder}/0001-numbers")


def test_workspace_uses_the_named_folder(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert Workspace(spark).folder.startswith(shared_folder(spark))


def test_parts_stay_below_a_size(spark, work):
    """Random letters hardly compress, so the files are about as large as the texts."""
    import glob
    import os
    import random

    from echosieve.sources import sinks

    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    sizes = [rng.choice([10, 400, 3000]) for _ in range(700)] + [30_000, 5, 60_000, 5]
    rows = [(3 * i, text(n), None) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(5)
    path, params = work.path("parts"), Params(chunk_size=30)
    sinks.write_parts(df, path, params, 100_000, work)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text, r.note) for r in back.collect()) == rows
    assert back.filter("chunk != doc_id div 30").isEmpty()
    parts = sorted((r.part, r.lo, r.hi, r.bytes) for r in back.groupBy("part").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
        F.sum(F.length("text") + 8).alias("bytes"),
    ).collect())
    assert [p[0] for p in parts] == list(range(len(parts))) and len(parts) > 5
    assert all(a[2] < b[1] for a, b in zip(parts, parts[1:]))
    assert all(p[3] <= 100_000 + 60_008 - 50_000 for p in parts)  # the row of 60,000 is over half
    assert max(os.path.getsize(f) for f in glob.glob(f"{path}/part=*/*.parquet")) < 110_000
    empty = work.path("none")
    sinks.write_parts(df.limit(0), empty, params, 100_000, work)


def test_a_run_in_parts(spark, work):
    from echosieve import run

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    result = run(spark, Params(chunk_size=20), docs, work.path("out"), part_bytes=200_000)
    rows = spark.read.parquet(result.path)
    assert rows.count() == docs.select("text").distinct().count()
    assert {"part", "chunk", "duplicate_count"} <= set(rows.columns)


def test_numbering_by_a_sort_key_moves_no_text(spark, work):
    from echosieve import deduplicate

    rows = [(i * 37 % 101 if i else None, f"text {i % 7}", i, "x") for i in range(101)]
    df = work.table(
        spark.createDataFrame(rows, "k int, text string, _at int, _key_0 string").repartition(3), "in"
    )
    params = Params(order_column="pos")
    numbered = readers.with_positions(df, ["k"], work, partitions=4)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [tuple(r) for r in numbered.orderBy("pos").collect()] == [
        (*r, n) for n, r in enumerate(order)
    ]
    got = exact.kept_in_order_of(df, ["k"], params, work)
    want = deduplicate(numbered, params)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = got.select("pos", "k")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "text#" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    with pytest.raises(ValueError, match="apart"):
        readers.with_positions(df.unionAll(df), ["k"], work)


def test_columns_named_like_helpers(spark, work):
    """No method, report or sink stumbles over columns of the corpus."""
    names = ["_gone", "_owner", "_copies", "_pos", "_count", "_text", "_chunk", "_at", "_file",
             "_row", "_part", "_offset", "label", "bucket", "n", "_part_block", "a.b"]
    rows = [(i, f"text {i % 5} of some words", *["v"] * len(names)) for i in range(40)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame(rows, schema)
    bloom = {"bloom_capacity": 100, "bloom_error_rate": 0.01}
    for params in (Params(), Params(method="minhash"), Params(method="bloomfilter", **bloom),
                   Params(method="minhash_bloom_hybrid", **bloom)):
        result = run(spark, params, df, work.path("out"))
        assert spark.read.parquet(result.path).select("doc_id").distinct().count() >= 4
    gone = exact.dropped(df, Params(), work)
    for count in (groups.with_duplicate_count, groups.with_shifted_duplicate_count):
        assert count(df, gone, Params(), work).count() == 5
    sinks.write_parts(df, work.path("parts"), Params(), 500, work)
    path = work.path("in")
    df.drop("doc_id").write.parquet(path)
    assert readers.with_file_positions(spark.read.parquet(path), work).count() == 40
