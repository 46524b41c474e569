"""License scans against plain searches."""

from __future__ import annotations

import re

import pytest

from echosieve.llm import licenses

SCHEMA = "doc_id long, text string, label string, h string, template int, words string, n int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    own, places, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        for at in range(len(own) - len(parts) + 1):
            if own[at:at + len(parts)] == parts:
                places.append(at)
                labels.add(label)
    return (len(own), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


MIT = next(t for t, label in licenses.NOTICES if label == "mit")
FILL = " ".join(f"w{i}" for i in range(40))
TEXTS = [
    None, "", "?!", "one", "The MIT License.", "MIT  license; mit-LICENSE CC BY cc by cc",
    "GNU General Public License, and the gnu general public", "É cc by é", "Apache\nLicense " * 400,
    f"{FILL} {MIT} {FILL}", f"{FILL} {MIT.upper()} {FILL}",
    MIT.replace("copy modify", "copy and also really modify").replace("merge ", ""),
    " ".join(MIT.split()[:20]), "licensed under cc by-nc 4.0.", "mit license " * 3000 + "x" * 100_000,
]


@pytest.mark.parametrize("sent", [licenses.SENT_GRAMS, 40])
def test_follows_a_plain_search(spark, work, sent):
    rows = [(i if i % 4 else None, t, "l", "h", 7, "w", 3) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], rows[0]]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA)
    got = licenses.scan_licenses(df, licenses.templates(spark), work, sent_grams=sent).collect()
    want = sorted(repr((r[0], *base(r[1]))) for r in rows)
    assert sorted(repr(tuple(r)[:6]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(
            r["labels"].split(",")
        )
    for whole in (9, 10):
        assert (by_id[whole]["base_labels"], by_id[whole]["labels"], by_id[whole]["score"]) == ("", "mit", 1)
    assert by_id[11]["labels"] == "mit" and licenses.LEAST_SHARE < by_id[11]["score"] < 1
    assert by_id[13]["labels"] == "cc-by,cc-by-nc"


def test_spans_and_drift(spark, work):
    edited = MIT.replace("copy modify", "copy and also really modify")
    df = spark.createDataFrame([(1, f"{FILL} {edited} {FILL} {MIT}")], "doc_id long, text string")
    own = licenses.templates(spark, [], [(MIT, "mit")])
    found = sorted(licenses.spans(df, own, work).collect(), key=lambda r: r["first"])
    n = len(MIT.split())
    assert [(r["first"], r["last"]) for r in found] == [(40, 40 + n + 2), (83 + n, 82 + 2 * n)]
    assert found[0]["share"] > 0.9 and found[1]["share"] == 1


def test_no_rows_and_no_templates(spark, work):
    none = spark.createDataFrame([], SCHEMA)
    assert licenses.scan_licenses(none, licenses.templates(spark), work).count() == 0
    df = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    empty = licenses.templates(spark, [("", "none")], [])
    assert [tuple(r) for r in licenses.scan_licenses(df, empty, work).collect()] == [
        (1, 2, 0, None, None, "", "", 0.0)
    ]
