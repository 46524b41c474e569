"""The ordered line diff against a table of all suffixes."""

from __future__ import annotations

import random
import time

from echosieve.operators import similarity


def model(old, new):
    n, m = len(old), len(new)
    common = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            common[i][j] = (
                common[i + 1][j + 1] + 1 if old[i] == new[j]
                else max(common[i + 1][j], common[i][j + 1])
            )
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and old[i] == new[j]:
            i, j = i + 1, j + 1
            yield "same"
        elif j == m or i < n and common[i + 1][j] >= common[i][j + 1]:
            i += 1
            yield "removed"
        else:
            j += 1
            yield "added"


def test_follows_the_table():
    rng = random.Random(4)
    for size in (0, 1, 2, 5, 30, 90):
        for _ in range(40):
            kinds = "ab" if rng.random() < 0.3 else "abcdefghijkl"
            old = rng.choices(kinds, k=rng.randrange(size + 1))
            new = rng.choices(kinds, k=rng.randrange(size + 1))
            assert list(similarity.diff_ops(old, new)) == list(model(old, new))


def test_moved_and_repeated_lines(spark):
    rows = [
        (5, 1, "a\nb\nc", "b\nc\na"), (6, 1, "x\n\nx\n", "x\nx"), (7, 2, None, "q"), (8, 3, "", ""),
    ]
    df = spark.createDataFrame(rows, "pos int, owner_pos long, owner_text string, text string")
    got = {}
    for r in similarity.ordered_diff(df).orderBy("pos", "line_number").collect():
        got.setdefault(r.pos, []).append((r.line_number, r.op, r.line))
    assert got == {
        5: [(1, "removed", "a"), (2, "same", "b"), (3, "same", "c"), (4, "added", "a")],
        6: [(1, "same", "x"), (2, "removed", ""), (3, "same", "x")],
        7: [(1, "added", "q")],
    }
    assert similarity.ordered_diff(df.limit(0)).count() == 0


def test_a_pair_of_many_lines(spark):
    """20,000 lines, a third of them equal, hundreds of edits all over."""
    rng = random.Random(9)
    old = [f"line {i}" if i % 3 else "" for i in range(20_000)]
    new = list(old)
    for _ in range(300):
        at = rng.randrange(len(new))
        rng.choice([lambda: new.pop(at), lambda: new.insert(at, f"new {at}"),
                    lambda: new.insert(rng.randrange(len(new)), new.pop(at))])()
    df = spark.createDataFrame(
        [(2, 1, "\n".join(old), "\n".join(new))],
        "pos long, owner_pos long, owner_text string, text string",
    )
    began = time.time()
    rows = similarity.ordered_diff(df).orderBy("line_number").collect()
    assert time.time() - began < 60
    assert [r.line for r in rows if r.op != "added"] == old
    assert [r.line for r in rows if r.op != "removed"] == new
    assert sum(r.op == "same" for r in rows) >= len(old) - 600
