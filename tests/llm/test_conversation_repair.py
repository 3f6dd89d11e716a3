import hashlib
import random
import re
import zlib

import pytest

from tenderloom.llm.conversation_repair import cheapest_edits, damaged, repaired, reported
from tests.llm.helpers import AWKWARD

SCHEMA = "conv_id long, turn long, role string, text string, place long, edits string, _conv long, digest string"
BLANK = " \t\n\x0b\x0c\r"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute(rows):
    """Forward search over all edits, keeping the cheapest and least (cost, audit) for each legal list of roles so far."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
    seen, faults, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        fault = None
        if not text.strip(BLANK):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(BLANK)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    def settle(found):
        todo = list(found.items())
        while todo:
            state, (cost, audit, said) = todo.pop()
            for role in ("user", "assistant"):
                if role[0] in legal[state]:
                    new = (cost + 3, audit + "I", said + [(role, "")])
                    if role[0] not in found or new[:2] < found[role[0]][:2]:
                        found[role[0]] = new
                        todo.append((role[0], new))
        return found

    states = settle({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def offer(state, cost, audit, said):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, said)

        for state, (cost, audit, said) in states.items():
            offer(state, cost + 4, audit + "D", said)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] and role[0] in legal[state]:
                offer(role[0], cost + more, audit + "K", said + [(role, text)])
            for other in ("user", "assistant"):
                if other[0] in legal[state]:
                    offer(other[0], cost + more + 3, audit + "R", said + [(other, text)])
        states = settle(new)
    cost, audit, said = min((states[s] for s in ("", "a") if s in states), key=lambda v: v[:2])
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in said)
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def made_up(rng, conversations, most):
    rows = []
    for conv in range(conversations):
        n, turn = rng.randrange(most), 0
        for _ in range(n):
            turn += rng.choice([0, 1, 1, 1, 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["yes.", "no!", "cut off", "", " \n", "what? ", None, f"word {rng.randrange(5)}.", "again.", "x" * rng.randrange(3)])
            rows.append((conv, rng.choice([turn, turn, turn, None]) if rng.random() < 0.2 else turn, role, text))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "e", 2, "d") for r in rows], SCHEMA).repartition(3)


def by_conversation(rows):
    found = {}
    for row in rows:
        found.setdefault(row[0], []).append(row)
    return found


def got_of(frame):
    rows = frame.collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("block_rows", [2, 4096])
def test_against_brute_force(spark, block_rows):
    rng = random.Random(5)
    rows = made_up(rng, 60, 14) + [(None, i, "user", "a.") for i in range(4)] + made_up(rng, 1, 2)
    rows += [(500, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(AWKWARD)]
    # very many equal rows of one turn, and a conversation over many blocks
    rows += [(501, 7, "user", "same.")] * 300 + [(502, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"{i}.", "b"])) for i in range(400)]
    expected = {conv: brute(of) for conv, of in by_conversation(rows).items()}
    turns = table(spark, rows)
    assert got_of(reported(repaired(turns, block_rows=block_rows))) == expected


def test_query_with_damage(spark):
    dropped = next(c for c in range(900, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = made_up(random.Random(8), 80, 12) + [(dropped, 0, "user", "a.")]
    hurt = by_conversation(damage(rows))
    expected = {conv: brute(hurt.get(conv, [])) for conv in by_conversation(rows)}
    turns = table(spark, rows)
    assert sorted(map(repr, map(tuple, damaged(turns).collect()))) == sorted(map(repr, damage(rows)))
    assert got_of(reported(repaired(damaged(turns), turns))) == expected
    assert expected[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_in_order(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "More"), (1, 3, "user", "Bye.")]
    edits = repaired(table(spark, rows)).collect()
    assert [(r["edit"], r["role"], r["text"], r["fault"]) for r in edits] == [
        ("K", "system", "Be kind.", None), ("R", "user", "Hello.", None), ("K", "assistant", "More", "truncated"), ("K", "user", "Bye.", None), ("I", "assistant", "", None)]


def test_empty_table(spark):
    turns = table(spark, [(1, 0, "user", "a.")]).where("false")
    assert cheapest_edits(turns).count() == 0
    assert reported(repaired(damaged(turns), turns)).count() == 0
