"""Conversation repair against a dynamic program over whole audits."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from echosieve.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, part int, at long, kind string, x int"


def after_damage(rows):
    plain = lambda v: " " if v is None else str(v)
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own = found[conv]
        deal = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = plain(role), plain(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(deal, text)
        role = "user" if deal == 4 else role
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(deal, 1)
    for own in found.values():
        own.sort(key=lambda r: (
            r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()
        ))
    return found


def faults(own):
    seen, out = set(), []
    for _, role, text in own:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(
            "blank" if not bare else "duplicate" if (role, text) in seen
            else "truncated" if bare[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    return out


def best(own, own_faults):
    """``(cost, audit, lines)`` by states that carry their whole audit."""
    def more(states):
        states, todo = dict(states), list(states)
        while todo:
            cost, audit, lines = states[state := todo.pop()]
            due = "a" if state == "u" else "u"
            name = {"u": "user:", "a": "assistant:"}[due]
            new = (cost + 2, audit + "I", (*lines, name))
            if due not in states or new[:2] < states[due][:2]:
                states[due] = new
                todo.append(due)
        return states

    states = {"": (0, "", ())}
    for (_, role, text), fault in zip(own, own_faults):
        after = {}
        for state, (cost, audit, lines) in more(states).items():
            due = "a" if state == "u" else "u"
            name = {"u": "user:", "a": "assistant:"}[due]
            ways = [(state, (cost + 3, audit + "D", lines))]
            if fault in ("", "truncated"):
                paid = cost + (fault == "truncated")
                ways.append((due, (paid + 2, audit + "R", (*lines, name + text))))
                if role[:1] == due or role[:1] == "s" and state == "":
                    ways.append((role[:1], (paid, audit + "K", (*lines, f"{role}:{text}"))))
            for to, way in ways:
                if to not in after or way[:2] < after[to][:2]:
                    after[to] = way
        states = after
    return min((v for k, v in more(states).items() if k in ("", "a")), key=lambda v: v[:2])


def model(rows):
    out = {}
    for conv, own in after_damage(rows).items():
        kinds = faults(own)
        n = collections.Counter(kinds)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, lines = best(own, kinds)
        out[conv] = (
            gaps, n["blank"], n["duplicate"], n["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def result(spark, work, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, "k", 3) for r in rows], SCHEMA)
    found = repair.repaired_conversations(df, work, **options).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:] for r in found}


def row(rng):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "s", "", None]
    texts = ["a.", "b", "c!", " ", "", None, "d. ", "e?x", f"f {rng.randrange(500)}.",
             f"g {rng.randrange(500)}."]
    conv = rng.choice([1, 2, None]) if rng.random() < 0.4 else 9  # one conversation of most rows
    return conv, rng.choice([None, *range(300)]), rng.choice(roles), rng.choice(texts)


@pytest.mark.parametrize("block", [repair.BLOCK, 5])
def test_follows_a_plain_model(spark, work, block):
    rng = random.Random(block)
    rows = [row(rng) for _ in range(600)] + [(c, 0, "user", "alone.") for c in range(100, 150)]
    rows += [(200, t, "user", "copied text.") for t in range(40)]  # a hot group of copies
    assert result(spark, work, rows, block=block, hot_rows=10) == model(rows)


def test_no_rows_and_all_dropped(spark, work):
    assert result(spark, work, []) == {}
    gone = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(spark, work, [(gone, 0, "user", "x.")]) == {
        gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    }
    assert result(spark, work, [(None, None, None, None)]) == model([(None, None, None, None)])


def test_whole_table(spark, work):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    found = repair.repaired_conversations(df, work).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == model(rows)


def test_every_audit_of_short_conversations():
    """Crossings against all edits of up to four rows, of which the least audit is cheapest."""
    def audits(kinds):
        grammar = re.compile("(s?(ua)+)?")
        for ops in itertools.product("DKRN", repeat=len(kinds)):  # N: renamed to the other role
            for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(kinds) + 1):
                cost, roles, audit = 0, "", ""
                for n, more in enumerate(inserts):
                    roles, audit, cost = roles + more, audit + "I" * len(more), cost + 2 * len(more)
                    if n == len(kinds):
                        break
                    initial, fault = kinds[n]
                    if ops[n] == "D":
                        audit, cost = audit + "D", cost + 3
                        continue
                    if fault in (repair.BLANK, repair.DUPLICATE):
                        break
                    cost += fault == repair.TRUNCATED
                    if ops[n] == "K":
                        roles, audit = roles + "suax"[initial], audit + "K"
                    else:
                        roles, audit, cost = roles + ("u" if ops[n] == "R" else "a"), audit + "R", cost + 2
                else:
                    continue
                if n == len(kinds) and grammar.fullmatch(roles):
                    yield cost, audit

    rng = random.Random(5)
    for _ in range(60):
        kinds = [(rng.randrange(4), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 4))]
        rows = [repair.ROWS[k] for k in kinds]
        whole = repair.combined(rows)
        cost, state, tail = repair.ending(whole[0][0], whole[1][0])
        letters = repair.edits(bytes(4 * i + f for i, f in kinds), 0, state)
        assert (cost, "".join(letters) + "I" * tail) == min(audits(kinds))
