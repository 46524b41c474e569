"""Packing of token sequences by a configuration linear program.

Documents are tokenised once, where they lie; only ``(length, count)`` of the pieces, at most
``CAPACITY`` rows, reach the driver, which plans with configurations: multisets of lengths that
fit one sequence.  Multiplicative weights find a fractional cover of the histogram, a knapsack
dynamic program pricing the next configurations; the cover is rounded down and what it leaves is
covered again, until at most ``LEFT`` pieces a unit of capacity are left or covers place too few.
The rest is packed best-fit, longest first, in equal shares where it is larger than that.  So the
plan's work and size depend on the rounds, the capacity and the logarithm of the number of pieces.
Pieces of one length are numbered in parallel (a number within each task plus the
counts of earlier tasks) and their number decides the place, so no task sees a whole length.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echosieve.workspace import Workspace

CAPACITY = 2048
END_ID = 0
ROUNDS = 40
NEAR_BEST = 0.02  # configurations this close to the best price are taken in the same round
STEP = 0.25  # share of a length that one round may cover
LEFT = 16  # pieces a unit of capacity that are packed best-fit one by one
PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
)
PLACED = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, "
    "offset long"
)
_ENCODERS: dict = {}


def _encoder(ranks_path: str):
    """``text -> ids`` by the byte-level BPE of ``ranks_path``, loaded once per worker.

    The ids are those of ``tokenizers`` with the JSON file of the same name, whose added tokens
    are taken out of the text as one id each.  Texts that ``tiktoken`` fails on (a run of about a
    million blanks) go to ``tokenizers`` itself.
    """
    if ranks_path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        json_path = os.path.splitext(ranks_path)[0] + ".json"
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(json_path, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        fast = tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens=added,
        )

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:
                from tokenizers import Tokenizer

                slow = Tokenizer.from_file(json_path)
                return slow.encode(text, add_special_tokens=False).ids

        _ENCODERS[ranks_path] = encode
    return _ENCODERS[ranks_path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def _tokenise(ranks_path: str, capacity: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = _encoder(ranks_path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                for k, (at, size) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[at:at + size])
                    out.append((key, k, at, size, crc, task, int(seen[size])))
                    seen[size] += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    return run


def _best_values(sizes, price, capacity: int):
    """Unbounded knapsack: the best value of every room, and the item last put in (-1: none)."""
    import numpy as np

    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            gains = best[room - sizes[:fits[room]]] + price[:fits[room]]
            top = int(gains.argmax())
            if gains[top] > best[room]:
                best[room], item[room] = gains[top], top
    return best, item


def _filled(room: int, sizes, item) -> list[int]:
    config = []
    while room > 0:
        if item[room] < 0:
            room -= 1
        else:
            config.append(int(item[room]))
            room -= int(sizes[item[room]])
    return config


def fractional_cover(counts: dict[int, int], capacity: int, rounds: int = ROUNDS):
    """``{configuration: weight}`` that uses no length more often than there are pieces.

    A length's weight falls exponentially in the share of its pieces that is covered.  A round
    prices the lengths, solves the knapsack, and takes for each length its best configuration if
    that is within ``NEAR_BEST`` of the best of all, in proportion to the pieces left.
    """
    import numpy as np

    sizes = np.array(sorted(counts))
    wanted = np.array([counts[s] for s in sizes], float)
    covered, chosen = np.zeros(len(sizes)), Counter()
    for _ in range(rounds):
        price = sizes / capacity * np.exp(-covered / wanted)
        best, item = _best_values(sizes, price, capacity)
        value = price + best[capacity - sizes]
        take, use = [], np.zeros(len(sizes))
        for s in np.flatnonzero(value >= (1 - NEAR_BEST) * value.max()):
            config = Counter([int(s), *_filled(capacity - int(sizes[s]), sizes, item)])
            most = max(1.0, max(k / wanted[i] for i, k in config.items()))
            weight = STEP * wanted[s] / most
            take.append((config, weight))
            for i, k in config.items():
                use[i] += k * weight
        over = np.maximum(use / (STEP * wanted), 1.0)
        for config, weight in take:  # within the step for its most used length
            weight /= max(over[i] for i in config)
            chosen[tuple(sorted(config.elements()))] += weight
            for i, k in config.items():
                covered[i] += k * weight
    over = np.maximum(covered / wanted, 1.0)
    return {
        tuple(int(sizes[i]) for i in config): weight / max(over[i] for i in config)
        for config, weight in chosen.items()
    }


def best_fit(counts: Counter, capacity: int) -> Counter:
    """``{configuration: sequences}`` for all pieces, longest first into the tightest room."""
    open_by_room: dict[int, list] = {}
    mask = 0  # bit r: some sequence has r ids of room
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            above = mask >> size
            if above:
                room = size + (above & -above).bit_length() - 1
                config = open_by_room[room].pop()
                if not open_by_room[room]:
                    mask &= ~(1 << room)
            else:
                room, config = capacity, ()
            config, room = (*config, size), room - size
            open_by_room.setdefault(room, []).append(config)
            mask |= 1 << room
    return Counter(tuple(sorted(c)) for own in open_by_room.values() for c in own)


def in_shares(counts: Counter, capacity: int) -> Counter:
    """``best_fit`` in steps of at most ``LEFT * capacity`` pieces, whatever their number.

    A step packs one of equal shares of the pieces and takes its sequences as often as there are
    shares; what the division leaves, fewer pieces of a length than shares, is for the next step.
    """
    out, rest = Counter(), +counts
    while rest:
        shares = max(1, -(-rest.total() // (LEFT * capacity)))
        one = Counter({size: n // shares for size, n in rest.items() if n >= shares})
        for config, times in best_fit(one, capacity).items():
            out[config] += times * shares
        rest = +Counter({size: n % shares for size, n in rest.items()})
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Counter:
    """``{configuration: sequences}`` that hold exactly the pieces of ``counts``."""
    full = counts.get(capacity, 0)
    rest = Counter({s: n for s, n in counts.items() if n and s != capacity})
    out = Counter({(capacity,): full}) if full else Counter()
    before = None
    while rest and (before is None or LEFT * capacity < rest.total() <= before / 2):
        before = rest.total()
        for config, weight in fractional_cover(rest, capacity, rounds).items():
            whole = int(weight + 1e-9)
            if whole:
                out[config] += whole
                rest.subtract({s: k * whole for s, k in Counter(config).items()})
        rest = +rest
    out += in_shares(rest, capacity)
    return out


def _places(configs: Counter) -> dict[int, tuple]:
    """For each length, sorted arrays: first number, first sequence, pieces a sequence, offset."""
    import numpy as np

    rows: dict[int, list] = {}
    numbered: Counter = Counter()
    sequence = 0
    for config, times in sorted(configs.items()):
        offset = 0
        for size, k in sorted(Counter(config).items()):
            rows.setdefault(size, []).append((numbered[size], sequence, k, offset))
            numbered[size] += times * k
            offset += size * k
        sequence += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*own)) for s, own in rows.items()}


def _place(places):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            size, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            edges = np.flatnonzero(np.diff(size[order])) + 1
            for own in np.split(order, edges) if len(size) else []:
                first, begin, per, at = places.value[int(size[own[0]])]
                slot = np.searchsorted(first, number[own], "right") - 1
                within = number[own] - first[slot]
                sequence[own] = begin[slot] + within // per[slot]
                offset[own] = at[slot] + within % per[slot] * size[own]
            names = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, work: Workspace, ranks_path: str, doc_id: str = "doc_id",
    text: str = "text", capacity: int = CAPACITY, rounds: int = ROUNDS,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A document is the ids of its text (null: none) and then ``END_ID``, so an empty text has one
    piece of one id.  Only documents above ``capacity`` are cut.  Repeated rows are packed each
    by itself, null ids too; an empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = work.table(texts.mapInArrow(_tokenise(ranks_path, capacity), PIECES), "pieces")
    counted = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in totals.collect()}  # at most ``capacity`` rows
    places = docs.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity, rounds)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = counted.select(
        "task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    numbered = pieces.join(earlier, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("nth") + F.col("earlier")).alias("number"),
    )
    return numbered.mapInArrow(_place(places), PLACED)
