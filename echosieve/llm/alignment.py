"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Both token sequences of a text cover the same bytes.  Every token points to the token farthest
to the right that overlaps it: the one of the other sequence that holds its last byte, or itself
when it ends where that one ends and is of the second sequence.  Doubling the pointers (all
tokens of about ``SLAB`` bytes of texts at once) leads every token to the terminal token of its
component in about log2 of the longest chain steps; equal terminals make a group.  Tokens that
end together are linked.  How often an id pair is linked is counted over the whole corpus.

Texts are tokenised once, where they lie.  The written table holds a document's counts, the
digest of its groups and its distinct linked pairs; corpus counts are sums over these, and are
joined back to them, dealt out by pair where they are too many to send.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echosieve.operators.skew import join_per_key
from echosieve.workspace import Workspace

SLAB = 1 << 20
PAIR_BYTES = 40
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 1_000_000
SHIFT = 20  # bits of an id within a pair
ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pairs array<long>, times array<int>"
)
_CODERS: dict = {}


def byte_level() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 characters stand for
    themselves, the other bytes in order for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Coder:
    """Ids of texts by one tokenizer, and the bytes of every id."""

    def __init__(self, encode, pieces: list[bytes]):
        import numpy as np

        if len(pieces) > 1 << SHIFT:
            raise ValueError(f"more than {1 << SHIFT} ids")
        self.encode = encode
        self.pieces = np.array(pieces, object)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        names = [str(i).encode() for i in range(len(pieces))]
        self.inner = np.array([n + b"," for n in names], object)
        self.bar = np.array([n + b"|" for n in names], object)
        self.last = np.array([n + b";" for n in names], object)


def _byte_bpe(json_path: str) -> _Coder:
    """The JSON vocabulary, without special tokens: their strings are ordinary text.

    ``tiktoken`` gives the same ids faster from the ranks beside it; a text that it fails on (a
    run of about a million blanks) goes to ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken

    with open(json_path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    to_byte = byte_level()
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for name, i in vocabulary.items():
        pieces[i] = (
            bytes(to_byte[c] for c in name) if all(c in to_byte for c in name) else name.encode()
        )
    with open(os.path.splitext(json_path)[0] + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(
        "alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            try:
                out.append(fast.encode_ordinary(" " + text))
            except ValueError:
                from tokenizers import Tokenizer

                slow = Tokenizer.from_file(json_path)
                slow.encode_special_tokens = True
                out.append(slow.encode(" " + text, add_special_tokens=False).ids)
        return out

    return _Coder(encode, pieces)


def _pieces(model_path: str) -> _Coder:
    """The sentence-piece model, which puts a blank before the text itself."""
    import re

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", name)
        pieces.append(
            bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode()
        )
    return _Coder(lambda texts: model.encode(texts, num_threads=1), pieces)


def _coder(kind, path: str) -> _Coder:
    if path not in _CODERS:
        _CODERS[path] = kind(path)
    return _CODERS[path]


def terminals(ends_a, ends_b):
    """``(pointers, steps)`` over the tokens of A, then those of B, each to its terminal token.

    ``ends``: where the tokens end; both sequences cover the same bytes.
    """
    import numpy as np

    n_a = len(ends_a)
    over = np.searchsorted(ends_b, ends_a)  # of B, and it ends at or beyond the token's end
    back = np.searchsorted(ends_a, ends_b)
    itself = np.arange(len(ends_b)) + n_a
    together = ends_a[back] == ends_b if n_a else np.zeros(0, bool)
    pointers = np.concatenate([over + n_a, np.where(together, itself, back)])
    steps = 0
    while True:
        jumped = pointers[pointers]
        if np.array_equal(jumped, pointers):
            return pointers, steps
        pointers, steps = jumped, steps + 1


def _aligned(a: _Coder, b: _Coder, texts: list[str]):
    """Columns ``n_a`` … ``times`` of ``ALIGNED`` for texts that are not empty."""
    import numpy as np

    n = len(texts)
    ids = [coder.encode(texts) for coder in (a, b)]
    whole = [(" " + text).encode() for text in texts]
    good = np.array([
        b"".join(a.pieces[x]) == w and b"".join(b.pieces[y]) == w
        for x, y, w in zip(*ids, whole)
    ], bool)
    counts = [np.where(good, [len(x) for x in own], 0) for own in ids]
    flat = [
        np.fromiter((i for x, ok in zip(own, good) if ok for i in x), np.int64, int(count.sum()))
        for own, count in zip(ids, counts)
    ]
    ends_a, ends_b = (np.cumsum(coder.sizes[f]) for coder, f in zip((a, b), flat))
    pointers, _ = terminals(ends_a, ends_b)
    n_a, n_b = len(ends_a), len(ends_b)
    closes = pointers[n_a:] == np.arange(n_b) + n_a  # the terminals close one group each
    group_of_b = np.cumsum(closes) - closes
    group = group_of_b[pointers - n_a]
    last_b = np.flatnonzero(closes)
    last_a = np.searchsorted(ends_a, ends_b[last_b])

    # Spell the groups: its tokens of A, then those of B, group after group.
    before_b = np.concatenate([[0], last_b + 1])
    spelt = np.empty(n_a + n_b, object)
    names = a.inner[flat[0]]
    names[last_a] = a.bar[flat[0][last_a]]
    spelt[np.arange(n_a) + before_b[group[:n_a]]] = names
    names = b.inner[flat[1]]
    names[last_b] = b.last[flat[1][last_b]]
    spelt[np.arange(n_b) + (last_a + 1)[group[n_a:]]] = names
    starts = np.concatenate([[0], np.cumsum(counts[0] + counts[1])])
    digests = [
        hashlib.sha256(b"".join(spelt[lo:hi])[:-1]).hexdigest() if hi > lo else ""
        for lo, hi in zip(starts[:-1], starts[1:])
    ]

    doc_of_b = np.repeat(np.arange(n), counts[1])
    links = np.bincount(doc_of_b[last_b], minlength=n)
    pair = (flat[0][last_a] << SHIFT) | flat[1][last_b]
    order = np.lexsort((pair, doc_of_b[last_b]))
    pair, doc = pair[order], doc_of_b[last_b][order]
    first = np.flatnonzero(np.concatenate([
        np.ones(min(len(pair), 1), bool), (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    ]))
    times = np.diff(np.append(first, len(pair)))
    lists = np.bincount(doc[first], minlength=n)
    return counts[0], counts[1], links, digests, lists, pair[first], times


def _align(json_path: str, model_path: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        a, b = _coder(_byte_bpe, json_path), _coder(_pieces, model_path)
        for batch in batches:
            size = np.array(batch.column("text").fill_null("").to_pylist(), object)
            length = np.array([len(t) for t in size], np.int64)
            at = 0
            while at < len(size):  # whole documents, about ``SLAB`` characters at a time
                past = np.searchsorted(np.cumsum(length[at:]), SLAB, "right")
                stop = at + max(1, int(past))
                part, rows = size[at:stop], batch.slice(at, stop - at)
                filled = np.flatnonzero(length[at:stop])
                n_a, n_b, links, lists = (np.zeros(len(part), np.int64) for _ in range(4))
                digests = np.full(len(part), "", object)
                pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(filled):
                    (n_a[filled], n_b[filled], links[filled], digests[filled], lists[filled],
                     pairs, times) = _aligned(a, b, list(part[filled]))
                offsets = pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), rows.column("doc_id"), pa.array(n_a), pa.array(n_b),
                     pa.array(links), pa.array(links), pa.array(digests, pa.string()),
                     pa.ListArray.from_arrays(offsets, pa.array(pairs)),
                     pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                     "pairs", "times"],
                )
                at = stop

    return run


def pair_counts(aligned: DataFrame, work: Workspace) -> DataFrame:
    """``(pair, links, docs, best)``: how often, in how many documents, and whether no other
    pair with the same id of B is linked more often."""
    each = aligned.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(
        F.col("pairs").alias("pair")
    ).agg(F.sum("times").alias("links"), F.count(F.lit(1)).alias("docs"))
    counts = work.table(each, "pairs")
    id_b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = counts.groupBy(id_b.alias("id_b")).agg(F.max("links").alias("most"))
    return work.table(
        counts.withColumn("id_b", id_b).join(most, "id_b").select(
            "pair", "links", "docs", (F.col("links") == F.col("most")).alias("best")
        ),
        "pair-counts",
    )


def align(
    docs: DataFrame, work: Workspace, json_path: str, model_path: str, doc_id: str = "doc_id",
    text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per document.

    A are the ids of a blank and the text by the byte-level BPE of ``json_path`` (whose ranks lie
    beside it as ``.tiktoken``), B those of the text by the model of ``model_path``.  A pair's
    count is the number of links over all documents that hold it; ``n_best`` counts the links
    whose count no other pair of their B id exceeds, ``count_sum`` sums the counts of all links.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have
    no tokens: zeros, and an empty digest.  Repeated rows and ids, also null ones, are documents
    of their own.  No rows give no rows; other columns are ignored.  A text is held whole, with
    some 100 bytes per token, by the task that reads it; several short ones share that memory.
    """
    numbered = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    aligned = work.table(numbered.mapInArrow(_align(json_path, model_path), ALIGNED), "aligned")
    counts = pair_counts(aligned, work)
    each = aligned.select("row", F.inline(F.arrays_zip("pairs", "times"))).select(
        "row", F.col("pairs").alias("pair"), "times"
    )
    if counts.count() * PAIR_BYTES <= broadcast_bytes:
        counted = each.join(F.broadcast(counts), "pair")
    else:
        counted = join_per_key(each, counts, ["pair"], "docs", "row", hot_rows)
    sums = counted.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("links")).alias("count_sum"),
    )
    whole = aligned.drop("pairs", "times").join(sums, "row", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256",
    )
