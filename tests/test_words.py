import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import models
from echosieve.functions.minhash import (
    bucket_keys, signature, text_buckets, text_signature,
)
from echosieve.functions.text import words_and_marks
from echosieve.functions.words import code_point_classes, word_cutter
from echosieve.params import BandShape, Params

ODD = [
    "", " ", "a", "a b", "a,b", "ab" * 40, "Ünï_cödé, 中文字 ——x y z", "x　y ",
    "éé", "\U0001f600\U0001f600 ok\U00020000\U0001d7d8", "\x1c\x1d\x0b\x0c\x85a\x00b\x7f",
    "tail é", "é", "ࡰᲉ \U0002ebf0", "«q» it's 3.14 ½ Ⅷ ² _", "é" * 50 + " " + "中" * 50,
]


def _texts():
    rng = random.Random(3)
    alphabet = "ab _,.é中  \n\t\x1c\U0001f600٣"
    return ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(200)]


@pytest.mark.parametrize("slab", [7, 64, 1 << 19])
def test_texts_are_cut_as_the_pattern_cuts_them(spark, slab):
    df = spark.createDataFrame(list(enumerate(_texts())), "pos long, text string").coalesce(2)
    wanted = {r.pos: r.w for r in df.select("pos", words_and_marks(F.col("text")).alias("w")).collect()}
    found = {pos: [] for pos in wanted}
    cut = word_cutter(code_point_classes(), slab)
    for first, offsets, tokens in cut(pa.array(_texts()).slice(0)):
        tokens = tokens.to_pylist()
        assert offsets[0] == 0 and offsets[-1] == len(tokens)
        for row, (lo, hi) in enumerate(zip(offsets, offsets[1:]), first):
            found[row] += tokens[lo:hi]
    assert found == wanted


def test_a_slice_with_nulls_is_cut(spark):
    texts = pa.array(["no", "a b", None, "", "c"]).slice(1)
    found = [(f, o.tolist(), t.to_pylist()) for f, o, t in word_cutter(code_point_classes())(texts)]
    assert found == [(0, [0, 2, 2, 2, 3], ["a", "b", "c"])]
    assert list(word_cutter(code_point_classes())(pa.array(["", None]))) == []


def test_text_signatures_equal_those_of_their_words(spark):
    df = spark.createDataFrame(list(enumerate(_texts())), "pos long, text string").coalesce(2)
    shape = BandShape(4, 5)
    words = words_and_marks(F.col("text"))
    got = df.select(
        "pos", text_signature(F.col("text"), 22, slab=64).alias("s"),
        text_buckets(F.col("text"), shape, slab=64).alias("b"),
        signature(words, 22).alias("s0"), bucket_keys(signature(words, 22), shape).alias("b0"),
        words.alias("w"),
    ).collect()
    assert len(got) == len(_texts())
    for r in got:
        assert list(r.s) == list(r.s0) == models.signature(r.w, 22)
        assert r.b == r.b0


def test_bytes_that_are_no_utf8(spark):
    df = spark.range(1).select(F.expr("cast(unhex('6120FF62C3') as string)").alias("text"))
    got = df.select(
        text_signature(F.col("text"), 8).alias("s"),
        signature(words_and_marks(F.col("text")), 8).alias("s0"),
    ).first()
    assert got.s == got.s0


def test_buckets_send_texts_not_words(spark, work):
    from echosieve.operators import minhash

    df = spark.createDataFrame([(0, "a b"), (1, "c")], "doc_id long, text string")
    rows = minhash.signatures(df, Params(method="minhash", order_column="doc_id"))
    assert "regexp_extract_all" not in rows._jdf.queryExecution().toString()
