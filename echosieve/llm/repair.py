"""Conversation structure repair by Hirschberg's divide and conquer.

A repair keeps, renames or deletes each row and inserts empty ones, so that the roles read
``(s?(ua)+)?``.  What is left to come depends on four states only: nothing yet, after the system
turn, after a user turn, after an assistant turn.  A stretch of rows is therefore a table of
least costs from state to state, with the order of the least audits of its ends; stretches
combine like matrices.  Forward costs from the start and backward costs from the end meet in the
middle; of the cheapest crossings the one with the least audit before it is taken, and both
halves are solved alike.  Only two vectors of four are held at a time.

No task holds a conversation.  All rows are sorted across the cluster; ``BLOCK`` consecutive
ones of a conversation make a segment, the segments of a task's rows a part.  Tables of stretches
go up from segments to parts to conversations, crossings come down the same way.  The digest of a
repaired conversation, which is sequential, streams through a task line by line.

Audits are compared by the order of their prefixes alone: those of two states at one place hold
equally many row letters and end in one, so that neither begins the other, and they differ, as
the letters determine the state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echosieve.llm.common import same
from echosieve.operators.skew import join_per_key
from echosieve.workspace import Workspace

BLOCK = 512
HOT_ROWS = 1_000_000
KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1  # costs
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 40
INITIALS = "sua"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)  # faults
LEGAL = {(0, 1), (1, 2), (2, 1)}  # neighbours su, ua, au
#: What must follow each state when a row is renamed or inserted: (role, next state).
DUE = {
    START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT),
    ASSISTANT: ("user", USER),
}
#: White space that makes a text blank.
SPACE = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after the damage that the checksum of a row deals it."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deal = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = plain("text")
    return conversations.select(
        "conv_id", "turn", plain("role").alias("role"), text.alias("text"), deal.alias("deal")
    ).filter("deal <> 0").select(
        "conv_id", "turn",
        F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("deal") == 1, "").when(
            F.col("deal") == 2, F.translate("text", ".!?", "")
        ).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("deal") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


# --- stretches of rows: costs[x][y] and the order[x][y] of their least audits -----------------


def _inserts(x: int) -> dict[int, int]:
    """State -> fewest inserted rows that lead there from ``x``."""
    steps, state, count = {x: 0}, x, 0
    while True:
        state, count = DUE[state][1], count + 1
        if state in steps:
            return steps
        steps[state] = count


def _row(initial: int, fault: int):
    """``(costs, order, letters)`` of one row with the inserts before it."""
    costs = [[FAR] * 4 for _ in STATES]
    letters = [[""] * 4 for _ in STATES]
    for x in STATES:
        for z, count in _inserts(x).items():
            lead, paid = "I" * count, INSERT * count
            ways = [(paid + DELETE, lead + "D", z)]
            if fault in (FINE, TRUNCATED):
                more = paid + (CUT_OFF if fault == TRUNCATED else 0)
                ways.append((more + RENAME, lead + "R", DUE[z][1]))
                if INITIALS[initial:initial + 1] == DUE[z][0][0]:
                    ways.append((more + KEEP, lead + "K", DUE[z][1]))
                if initial == 0 and z == START:
                    ways.append((more + KEEP, lead + "K", SYSTEM))
            for cost, spelt, y in ways:
                if (cost, spelt) < (costs[x][y], letters[x][y]):
                    costs[x][y], letters[x][y] = cost, spelt
    order = []
    for x in STATES:
        reached = sorted((y for y in STATES if costs[x][y] < FAR), key=lambda y: letters[x][y])
        order.append([reached.index(y) if y in reached else 4 for y in STATES])
    return costs, order, letters


ROWS = {(i, f): _row(i, f) for i in range(4) for f in range(4)}
#: The row kinds as they are stored, one byte a row.
KINDS = [ROWS[code // 4, code % 4] for code in range(16)]


def forward(costs: list[int], order: list[int], stretch) -> tuple[list[int], list[int]]:
    """The vector after one more stretch: least costs, and the order of their least audits."""
    reached, after = [], [FAR] * 4
    for y in STATES:
        best = None
        for x in STATES:
            if costs[x] < FAR and stretch[0][x][y] < FAR:
                way = (costs[x] + stretch[0][x][y], order[x], stretch[1][x][y])
                if best is None or way < best:
                    best = way
        if best:
            after[y] = best[0]
            reached.append((*best[1:], y))
    place = [4] * 4
    for n, (_, _, y) in enumerate(sorted(reached)):
        place[y] = n
    return after, place


def backward(costs: list[int], stretch) -> list[int]:
    return [
        min(min(stretch[0][x][y] + costs[y] for y in STATES), FAR) for x in STATES
    ]


def _unit(state: int) -> list[int]:
    return [0 if s == state else FAR for s in STATES]


def combined(stretches: list) -> tuple[list, list]:
    """One stretch out of consecutive ones."""
    costs, order = [], []
    for x in STATES:
        vector = (_unit(x), [0 if s == x else 4 for s in STATES])
        for stretch in stretches:
            vector = forward(*vector, stretch)
        costs.append(vector[0])
        order.append(vector[1])
    return costs, order


def crossings(stretches: list, start: int, end: int) -> list[int]:
    """The states before, between and after the stretches on the cheapest, audit-least way."""
    states = [start] + [end] * len(stretches)
    todo = [(0, len(stretches))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        vector = (_unit(states[low]), [0 if s == states[low] else 4 for s in STATES])
        for stretch in stretches[low:middle]:
            vector = forward(*vector, stretch)
        rest = _unit(states[high])
        for stretch in reversed(stretches[middle:high]):
            rest = backward(rest, stretch)
        states[middle] = min(STATES, key=lambda s: (vector[0][s] + rest[s], vector[1][s]))
        todo += [(low, middle), (middle, high)]
    return states


def edits(kinds: bytes, start: int, end: int) -> list[str]:
    """The audit letters of each row: inserts before it, then its own."""
    rows = [KINDS[k] for k in kinds]
    states = crossings(rows, start, end)
    return [row[2][x][y] for row, x, y in zip(rows, states, states[1:])]


def ending(costs: list[int], order: list[int]) -> tuple[int, int, int]:
    """``(cost, state, inserts)`` of the best way to close a conversation."""
    close = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    state = min(close, key=lambda s: (costs[s] + INSERT * close[s], order[s]))
    return costs[state] + INSERT * close[state], state, close[state]


def _inserted(state: int, count: int) -> tuple[list[str], int]:
    lines = []
    for _ in range(count):
        role, state = DUE[state]
        lines.append(f"{role}:")
    return lines, state


# --- what runs in tasks, over rows sorted by group --------------------------------------------


def _grouped(batches: Iterator, *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal keys, also across batches."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[k] for k in keys)
            if rows and own != key:
                yield key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield key, rows


def _batches(rows: Iterator[dict], schema, size: int = 2048) -> Iterator:
    import pyarrow as pa

    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


TALLY = (
    "n long, blank long, duplicate long, truncated long, illegal long, first int, last int, "
    "low long, high long, turns long"
)
STRETCH = f"conv_id long, part int, {TALLY}, costs array<long>, places array<int>"
SEGMENTS = f"{STRETCH}, block long, at long, kinds binary"
PARTS = "conv_id long, part int, x int, y int, tail int, end_cost long, {}".format(TALLY)
OPS = "part int, at long, letters string, made array<string>, role string, deleted boolean"


def _arrow(columns: str):
    import pyarrow as pa

    types = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
        "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    }
    named = [c.split() for c in columns.split(", ")]
    return pa.schema([(name, types[kind]) for name, kind in named])


def _tally(rows: list[dict]) -> dict:
    """Counts of consecutive stretches, or of rows given as stretches of one."""
    out = dict(rows[0])
    for row in rows[1:]:
        for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns"):
            out[c] += row[c]
        out["illegal"] += (out["last"], row["first"]) not in LEGAL
        out["last"] = row["last"]
        if row["low"] is not None:
            out["turns"] -= out["high"] == row["low"]
            out["low"] = row["low"] if out["low"] is None else out["low"]
            out["high"] = row["high"]
    return out


def _stretch(row: dict):
    return (
        [row["costs"][4 * x:4 * x + 4] for x in STATES],
        [row["places"][4 * x:4 * x + 4] for x in STATES],
    )


def _flat(stretch) -> dict:
    return {"costs": sum(stretch[0], []), "places": sum(stretch[1], [])}


COUNTED = ("n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")


def _segments(batches: Iterator) -> Iterator:
    """Rows ``(conv_id, part, block, at, turn, kind)`` to segments."""

    def made():
        for (part, block, _), rows in _grouped(batches, "part", "block", "conv_id"):
            kinds = bytes(row["kind"] for row in rows)
            tally = _tally([{
                "n": 1, "blank": int(k % 4 == BLANK), "duplicate": int(k % 4 == DUPLICATE),
                "truncated": int(k % 4 == TRUNCATED), "illegal": 0, "first": k // 4, "last": k // 4,
                "low": row["turn"], "high": row["turn"], "turns": int(row["turn"] is not None),
            } for k, row in zip(kinds, rows)])
            yield {
                **tally, **_flat(combined([KINDS[k] for k in kinds])), "kinds": kinds,
                "conv_id": rows[0]["conv_id"], "part": part, "block": block, "at": rows[0]["at"],
            }

    yield from _batches(made(), _arrow(SEGMENTS))


def _parts(batches: Iterator) -> Iterator:
    """Segments of a part, in order, to one stretch."""

    def made():
        for (conv, part), rows in _grouped(batches, "conv_id", "part"):
            yield {
                **_tally([{c: row[c] for c in COUNTED} for row in rows]), "conv_id": conv,
                "part": part, **_flat(combined([_stretch(row) for row in rows])),
            }

    yield from _batches(made(), _arrow(STRETCH))


def _meet(batches: Iterator) -> Iterator:
    """Parts of a conversation, in order, to the states at both ends of each.

    The last part's row also carries the whole conversation's counts, its cost, and the number
    of rows inserted after it (``tail``); the others have nulls there.
    """

    def made():
        for (conv,), rows in _grouped(batches, "conv_id"):
            stretches = [_stretch(row) for row in rows]
            whole = combined(stretches)
            cost, state, tail = ending(whole[0][START], whole[1][START])
            states = crossings(stretches, START, state)
            for row, x, y in zip(rows[:-1], states, states[1:]):
                yield {"conv_id": conv, "part": row["part"], "x": x, "y": y}
            yield {
                **_tally([{c: row[c] for c in COUNTED} for row in rows]), "conv_id": conv,
                "part": rows[-1]["part"], "x": states[-2], "y": state, "tail": tail,
                "end_cost": cost,
            }

    yield from _batches(made(), _arrow(PARTS))


def _edit(batches: Iterator) -> Iterator:
    """Segments of a part with the states at its ends to what happens to each row."""

    def made():
        for _, rows in _grouped(batches, "conv_id", "part"):
            states = crossings([_stretch(row) for row in rows], rows[0]["x"], rows[0]["y"])
            for row, x, y in zip(rows, states, states[1:]):
                state = x
                for n, letters in enumerate(edits(row["kinds"], x, y)):
                    lines, state = _inserted(state, len(letters) - 1)
                    role = None
                    if letters[-1] == "R":
                        role, state = DUE[state]
                    elif letters[-1] == "K":
                        system = row["kinds"][n] // 4 == 0
                        state = SYSTEM if system else DUE[state][1]
                    yield {
                        "part": row["part"], "at": row["at"] + n, "letters": letters,
                        "made": lines, "role": role, "deleted": letters[-1] == "D",
                    }

    yield from _batches(made(), _arrow(OPS))


def _digest(batches: Iterator) -> Iterator:
    """Sorted ``(conv_id, letters, lines)`` to a row per conversation; nothing is held but
    its audit."""

    def made():
        key, audit, digest, begun = None, None, None, False
        for batch in batches:
            for row in batch.to_pylist():
                if audit is None or row["conv_id"] != key:
                    if audit is not None:
                        yield {"conv_id": key, "audit": "".join(audit),
                               "repaired_sha256": digest.hexdigest()}
                    key, audit, digest, begun = row["conv_id"], [], hashlib.sha256(), False
                audit.append(row["letters"])
                for line in row["lines"]:
                    digest.update(("\n" if begun else "").encode())
                    digest.update(line.encode())
                    begun = True
        if audit is not None:
            yield {"conv_id": key, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    yield from _batches(made(), _arrow("conv_id long, audit string, repaired_sha256 string"), 64)


# --- the job ------------------------------------------------------------------------------------


def _faults(text: Column) -> Column:
    bare = F.rtrim(text, F.lit(SPACE))
    return F.when(bare == "", BLANK).when(
        ~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED
    ).otherwise(FINE)


def repair(
    rows: DataFrame, work: Workspace, block: int = BLOCK, hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(repaired, totals, digests)`` of ``rows(conv_id, turn, role, text)``.

    * ``repaired``: ``(conv_id, part, at, letters, lines)``, the audit letters and the repaired
      ``role:text`` lines of every row, in the order of ``part`` and ``at``.
    * ``totals``: ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost)``.
    * ``digests``: ``(conv_id, audit, repaired_sha256)``.

    Rows are ordered by turn, nulls first; equal turns by role, then by the MD5 of the text.  Ids
    may be null, which is one conversation; roles and texts must not be (``damaged`` fills them).
    No rows give no rows.  ``block`` rows of a conversation are solved at a time; the texts are
    not part of that.
    """
    order = ["conv_id", "turn", "role", "digest"]
    ranged = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", "text", F.md5("text").alias("digest"),
    ).repartitionByRange(*order).sortWithinPartitions(*order)
    code = F.lit(len(INITIALS))
    for n, initial in enumerate(INITIALS):
        code = F.when(F.startswith(F.col("role"), F.lit(initial)), n).otherwise(code)
    text_key = F.md5(F.concat_ws(
        "\x00", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), "digest", "role"
    ))
    placed = work.table(ranged.select(
        "conv_id", "turn", "role", "text", text_key.alias("key"),
        (code * 4 + _faults(F.col("text"))).cast("int").alias("kind"),
        F.spark_partition_id().alias("part"),
        # The low 33 bits are the row number inside the partition.
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
    ), "sorted")

    # Rows whose role and text were seen earlier in their conversation.
    groups = work.table(placed.groupBy("key").agg(
        F.min(F.struct("part", "at")).alias("earliest"), F.count(F.lit(1)).alias("copies")
    ).filter("copies > 1"), "repeated")
    later = work.table(join_per_key(
        placed.select("key", "part", "at"), groups, ["key"], "copies", "at", hot_rows
    ).filter(F.struct("part", "at") > F.col("earliest")).select("part", "at"), "later")

    fault = F.col("kind") % 4
    kinds = placed.select("conv_id", "turn", "kind", "part", "at").join(
        later.withColumn("seen", F.lit(True)), ["part", "at"], "left"
    ).select(
        "conv_id", "turn", "part", "at", F.floor(F.col("at") / block).alias("block"),
        F.when(F.col("seen") & (fault != BLANK), F.col("kind") - fault + DUPLICATE)
        .otherwise(F.col("kind")).alias("kind"),
    )
    segments = work.table(
        kinds.repartition("part", "block").sortWithinPartitions("part", "at")
        .mapInArrow(_segments, SEGMENTS), "segments",
    )
    parts = work.table(
        segments.drop("kinds").repartition("conv_id", "part")
        .sortWithinPartitions("conv_id", "part", "block").mapInArrow(_parts, STRETCH), "parts",
    )
    ends = work.table(
        parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
        .mapInArrow(_meet, PARTS), "ends",
    )
    sides = ends.select(
        F.col("conv_id").alias("conv"), F.col("part").alias("piece"), "x", "y"
    )
    ops = segments.join(
        sides, same(F.col("conv_id"), F.col("conv")) & (F.col("part") == F.col("piece"))
    ).drop("conv", "piece").repartition("conv_id", "part").sortWithinPartitions(
        "conv_id", "part", "block"
    ).mapInArrow(_edit, OPS).withColumnRenamed("role", "renamed")
    line = F.concat(F.coalesce("renamed", "role"), F.lit(":"), F.col("text"))
    edited = placed.select("conv_id", "role", "text", "part", "at").join(ops, ["part", "at"]).select(
        "conv_id", "part", "at", "letters",
        F.when(F.col("deleted"), F.col("made"))
        .otherwise(F.concat("made", F.array(line))).alias("lines"),
    )
    # What is inserted after the last row is a row of its own.
    after = ends.filter("tail > 0").select(
        "conv_id", F.col("part"), F.lit(1 << 33).alias("at"), F.repeat(F.lit("I"), F.col("tail")),
        F.slice(F.array(F.lit("user:"), F.lit("assistant:")), 3 - F.col("tail"), F.col("tail")),
    )
    repaired = work.table(edited.unionAll(after), "repaired")
    digests = repaired.repartition("conv_id").sortWithinPartitions(
        "conv_id", "part", "at"
    ).mapInArrow(_digest, "conv_id long, audit string, repaired_sha256 string")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    totals = ends.filter("tail is not null").select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("end_cost").alias("cost"),
    )
    return repaired, totals, digests


def repaired_conversations(
    conversations: DataFrame, work: Workspace, block: int = BLOCK, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``.

    One row for every id of ``conversations``, which is damaged by ``damaged`` and repaired by
    ``repair``.  Nulls read as one blank there; a null id is one conversation, null turns come
    first and count for no gap.  A conversation whose rows all went has zeros, an empty audit and
    the digest of no bytes.  Repeated rows are rows; other columns are ignored; no rows give none.
    """
    _, totals, digests = repair(damaged(conversations), work, block, hot_rows)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counted = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    own = lambda df, name: df.withColumnRenamed("conv_id", name)
    return ids.join(
        own(totals, "of_totals"), same(F.col("conv_id"), F.col("of_totals")), "left"
    ).join(
        own(digests, "of_digests"), same(F.col("conv_id"), F.col("of_digests")), "left"
    ).select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
