"""Token alignment against a two-pointer walk over the bytes."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from echosieve.llm import alignment
from echosieve.llm.queries import ALIGNED_A, ALIGNED_B, tokenizer_path

A, B = tokenizer_path(ALIGNED_A), tokenizer_path(ALIGNED_B)
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
SCHEMA = "doc_id long, text string, row int, pair string, pairs int, times int, links string"


def tokens(texts):
    """``[(ids, byte strings)]`` by both libraries as they are named, per text."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    names = {i: name for name, i in first.get_vocab().items()}
    to_byte = alignment.byte_level()
    second = sentencepiece.SentencePieceProcessor(model_file=B)

    def spelt(i):
        name = second.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", name)
        return bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode()

    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        yield a, [bytes(to_byte[c] for c in names[i]) for i in a], b, [spelt(i) for i in b]


def model(texts):
    rows, counts = [], collections.Counter()
    for text, (a, ba, b, bb) in zip(texts, tokens([t or "" for t in texts])):
        whole = (" " + (text or "")).encode()
        if not text or b"".join(ba) != whole or b"".join(bb) != whole:
            rows.append((0, 0, [], None))
            continue
        ea, eb = np.cumsum([len(x) for x in ba]), np.cumsum([len(x) for x in bb])
        i = j = 0
        groups, links, own_a, own_b = [], [], [], []
        while i < len(a):
            if ea[i] < eb[j]:
                own_a.append(a[i])
                i += 1
            elif ea[i] > eb[j]:
                own_b.append(b[j])
                j += 1
            else:
                groups.append(",".join(map(str, [*own_a, a[i]])) + "|"
                              + ",".join(map(str, [*own_b, b[j]])))
                links.append((a[i], b[j]))
                own_a, own_b, i, j = [], [], i + 1, j + 1
        counts.update(links)
        rows.append((len(a), len(b), links, ";".join(groups)))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (n_a, n_b, len(links), len(links), sum(counts[p] == best[p[1]] for p in links),
         sum(counts[p] for p in links),
         "" if spelt is None else hashlib.sha256(spelt.encode()).hexdigest())
        for n_a, n_b, links, spelt in rows
    ]


TEXTS = [
    None, "", " ", "  two  blanks ", "a\n\tb", "Él año: 10 000 €, naïve façade!", "▁x", "日本語の文",
    "<s> x </s> <unk> <|endoftext|> <0x41>", "\x00\x01 control", "👩‍👩‍👧 emoji", "same text here",
    "same text here", "x" * 5000, " nbsp　wide", "é combining",
]


@pytest.mark.parametrize("sent", [alignment.BROADCAST_BYTES, 0])
def test_follows_a_plain_model(spark, work, sent):
    texts = TEXTS + [" ".join(random.Random(1).choices(["the", "Haus", "été", "x1", "?"], k=3000))]
    df = spark.createDataFrame(
        [(i if i % 5 else None, t, 1, "p", 2, 3, "l") for i, t in enumerate(texts)], SCHEMA
    ).repartition(3)
    got = alignment.align(df, work, A, B, broadcast_bytes=sent, hot_rows=2).collect()
    want = [(i if i % 5 else None, *row) for i, row in enumerate(model(texts))]
    assert sorted(map(repr, [tuple(r) for r in got])) == sorted(map(repr, want))


def test_slabs_and_no_rows(spark, work, monkeypatch):
    texts = [t for t in TEXTS if t] * 4
    a, b = alignment._byte_bpe(A), alignment._pieces(B)
    whole = alignment._aligned(a, b, texts)
    single = [alignment._aligned(a, b, [t]) for t in texts]
    assert list(whole[3]) == [x[3][0] for x in single]
    assert list(whole[2]) == [x[2][0] for x in single]
    none = spark.createDataFrame([], SCHEMA)
    assert alignment.align(none, work, A, B).count() == 0


def test_steps_grow_with_the_logarithm():
    """Tokens that overlap in one long chain end in one group."""
    n = 4096
    ends_a = np.append(np.arange(2, 2 * n, 2), 2 * n + 1)
    ends_b = np.append(np.arange(3, 2 * n, 2), 2 * n + 1)
    pointers, steps = alignment.terminals(ends_a, ends_b)
    assert set(pointers) == {len(ends_a) + len(ends_b) - 1} and steps <= 14
