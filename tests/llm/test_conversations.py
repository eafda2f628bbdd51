"""Repaired conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

from duebook.llm import conversations
from tests.llm.conftest import CLASHING


def plain_damage(rows):
    out = []
    for key, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(key, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows, faults, delete=2, insert=5):
    """Cost, audit and rows of the cheapest edits, by Dijkstra's search."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, kept
        if (i, state) in done:
            continue
        done.add((i, state))
        new = [r for r in ("user", "assistant") if r[0] in AFTER[state]]
        for role in new:
            heapq.heappush(heap, (cost + insert, audit + "I", i, role[0], (*kept, (role, ""))))
        if i == len(rows):
            continue
        role, text = rows[i]
        heapq.heappush(heap, (cost + delete, audit + "D", i + 1, state, kept))
        if faults[i] in ("", "truncated"):
            cost += 5 * (faults[i] == "truncated")
            if role and role[0] in AFTER[state]:
                heapq.heappush(heap, (cost, audit + "K", i + 1, role[0], (*kept, (role, text))))
            for role in new:
                heapq.heappush(heap, (cost + 1, audit + "R", i + 1, role[0], (*kept, (role, text))))


def plain(rows):
    found = {row[0]: [] for row in rows}
    for key, *row in plain_damage(rows):
        found[key].append(row)
    result = {}
    for key, after in found.items():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in after:
            text_only = re.sub(r"[\x20\x09-\x0D]+", "", text)
            faults.append("blank" if not text_only else "duplicate" if (role, text) in seen
                          else "truncated" if text_only[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, kept = cheapest([r[1:] for r in after], faults)
        result[key] = (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit,
                       hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return result


def frame(spark, rows):
    clashing = CLASHING.replace("id string", "id string, rank string, copies string")
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 0.5, 6, "x", "y", "z", 8, "y") for r in rows],
                                 f"conv_id long, turn long, role string, text string, {clashing}")


def repaired(spark, rows):
    got = conversations.repair_damaged(frame(spark, rows)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def odd_rows(seed=5):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "\u00a0", "two\nlines.", "end.  \n", "東京。", "🙂 ok.", None]
    roles = ["user", "assistant", "system", "tool", "", "User", "student", None]
    rows = []
    for key in range(150):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((key, rng.choice([turn, turn, turn, turn + 20, None]), role, rng.choice(texts)))
    rows += [(500, t, "user", "Same.") for t in range(300)]  # copies in many turns
    rows += [(501, 4, "user", "Same.")] * 40 + [(501, 4, "assistant", "Same.")] * 40  # repeated rows, ties
    rows += [(502, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(2000)]  # a long one
    rows += [(503, 0, "user", "word " * 300_000 + "."), (503, 1, "assistant", "Yes.")]
    rows += [(None, t, ("user", "assistant")[t % 2], "Yes." * t) for t in range(5)]
    rows += [(key, 3, "user", "Alone.") for key in range(600, 660)]  # some lose their only row
    return rows


def test_as_by_searching_all_edits(spark):
    rows = odd_rows()
    want = plain(rows)
    assert repaired(spark, rows) == want
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert sum(v == empty for v in want.values()) > 1
    assert {letter for v in want.values() for letter in v[6]} == set("KRD")  # rows put in cost too much


def test_rows_put_in(monkeypatch):
    """With other prices, rows are put in too."""
    monkeypatch.setattr(conversations, "DELETE", 3)
    monkeypatch.setattr(conversations, "INSERT", 1)
    rng, letters = random.Random(8), set()
    for _ in range(400):
        rows = [(rng.choice(("user", "assistant", "system", "tool")), f"{i}") for i in range(rng.randrange(7))]
        faults = [rng.choice(("", "", "", "truncated", "blank")) for _ in rows]
        cost, audit, _ = cheapest(rows, faults, delete=3, insert=1)
        sequence = bytes(conversations.signature(r, f) for (r, _), f in zip(rows, faults))
        assert conversations.SuffixAutomaton().cheapest(sequence) == (cost, audit)
        letters |= set(audit)
    assert letters == set("KRDI")


def test_empty(spark):
    assert repaired(spark, []) == {}


def test_nodes_are_worked_out_once():
    """Sequences in the order of their endings share the nodes of what they have in common."""
    rng = random.Random(7)
    sequences = sorted({bytes(rng.choice(b"036478;") for _ in range(rng.randrange(12))) for _ in range(3000)},
                       key=lambda s: s[::-1])
    made = []
    plain_step = conversations._cost_to_go
    conversations._cost_to_go = lambda byte, then: made.append(byte) or plain_step(byte, then)
    try:
        automaton = conversations.SuffixAutomaton()
        together = [automaton.cheapest(s) for s in sequences]
    finally:
        conversations._cost_to_go = plain_step
    assert len(made) == len({s[i:] for s in sequences for i in range(len(s))})
    assert together == [conversations.SuffixAutomaton().cheapest(s) for s in sequences]


def test_plan_of_the_audits(spark):
    """Sequences are made distinct before they are sorted, and no plan has a cross join."""
    rows = spark.createDataFrame([(b"47",), (b"47",), (b"4",)], "signatures binary")
    got = {bytes(r.signatures): (r.cost, r.audit) for r in conversations.audits(rows).collect()}
    assert got == {b"47": conversations.SuffixAutomaton().cheapest(b"47"), b"4": conversations.SuffixAutomaton().cheapest(b"4")}
