import random

import pytest

import models
from echosieve.operators.first_match import select_first


def bucketed(spark, work, rows):
    df = spark.createDataFrame(
        [(pos, [b.encode() for b in buckets]) for pos, buckets in rows.items()],
        "pos bigint, buckets array<binary>",
    )
    return work.table(df.repartition(3), "rows")


def check(spark, work, rows, **settings):
    defaults = {"hot_rows": 1_000_000, "plain_rounds": 100}
    result = select_first(bucketed(spark, work, rows), work, **{**defaults, **settings})
    _, owner = models.chosen(rows)
    assert {r.pos: r.owner_pos for r in result.dropped.collect()} == owner
    kept = set(rows) - set(owner)
    for r in result.matches.collect():
        assert r.owner_pos in kept and r.pos in owner and r.owner_pos < r.pos
        assert set(rows[r.pos]) & set(rows[r.owner_pos])
    return set(rows) - set(owner)


def test_chain_keeps_every_other_row(spark, work):
    rows = {d: [f"e{d}", f"e{d + 1}"] for d in range(5)}
    assert check(spark, work, rows) == {0, 2, 4}


def test_random_buckets(spark, work):
    rng = random.Random(5)
    rows = {d: sorted({f"b{rng.randrange(700)}" for _ in range(4)}) for d in range(800)}
    check(spark, work, rows)


def test_owner_is_the_lowest_kept_row_even_if_settled_late(spark, work):
    # Row 3 is hit by row 2 in the first round, by the lower row 1 only in the second.
    rows = {0: ["a"], 1: ["b", "c"], 2: ["d"], 3: ["d", "c"], 4: ["a", "b"]}
    check(spark, work, rows)
    rows = {0: ["a"], 1: ["a", "p"], 2: ["p", "q"], 3: ["r"], 4: ["q", "r"]}
    check(spark, work, rows)


def test_hot_bucket_is_dealt_out(spark, work):
    rows = {d: [f"z{d // 2}", "hot" if d % 3 == 0 else f"c{d}"] for d in range(3000)}
    kept = check(spark, work, rows, hot_rows=40)
    assert len(kept) == 1500


@pytest.mark.parametrize("component_rows", [100_000, 20])
def test_long_chains_end_in_components(spark, work, component_rows):
    rows = {d: [f"e{d}", f"e{d + 1}"] for d in range(20)}
    rows.update({100 + d: [f"f{d}", f"f{d + 1}"] for d in range(8)})
    rng = random.Random(1)
    rows.update({1000 + d: [f"g{rng.randrange(90)}" for _ in range(2)] for d in range(120)})
    check(spark, work, rows, plain_rounds=1, component_rows=component_rows, hot_rows=20)


def test_same_result_without_broadcast_joins(spark, work):
    rng = random.Random(9)
    rows = {d: [f"z{d // 2}", "hot" if d % 3 == 0 else f"c{rng.randrange(300)}"] for d in range(600)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, work, rows, hot_rows=25)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_nothing_shared(spark, work):
    assert check(spark, work, {d: [f"x{d}"] for d in range(4)}) == {0, 1, 2, 3}


def test_a_chain_longer_than_a_task_takes_steps_by_rows(spark, work):
    """5,000 links, 500 rows at a time: about ten steps, not thousands."""
    rows = {d: [f"e{d}", f"e{d + 1}"] for d in range(5000)}
    kept = check(spark, work, rows, plain_rounds=2, component_rows=500)
    assert kept == set(range(0, 5000, 2))
    steps = [t for t in work.tables if t.endswith("-cuts")]
    assert len(steps) <= 12


def test_a_hot_component_is_dealt_out(spark, work):
    """One component of most rows, with chains in it, cut in steps and joined in shares."""
    rng = random.Random(2)
    rows = {d: [f"c{d}", f"c{d + 1}", f"r{rng.randrange(4000)}"] for d in range(600)}
    rows.update({9000 + 7 * d: [f"s{d}", f"s{d + 1}"] for d in range(60)})
    check(spark, work, rows, plain_rounds=1, component_rows=64, hot_rows=50)
