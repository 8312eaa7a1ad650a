import hashlib
import random
import re
from heapq import heappop, heappush
from zlib import crc32

import pytest

from proofmill.llm import conversation_repair as C
from proofmill.llm.queries import op11_conversation_repair

SF = "/root/testdata/sf0.001"
IN_ORDER = re.compile(r"(s?(ua)+)?\Z")


def slow_edits(turns: list[C.Turn]) -> tuple[int, str]:
    """All sequences of edits in order of cost, then ASCII; the order is looked for in the resulting initials."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, initials = heappop(heap)
        if k == len(turns) and IN_ORDER.match(initials):
            return cost, audit
        state = (k, initials[-1:], len(initials) < 2)
        if state in seen:
            continue
        seen.add(state)

        def push(edit: str, price: int, at: int, said: str) -> None:
            if any(IN_ORDER.match(said + rest) for rest in ("", "a", "ua")):
                heappush(heap, (cost + price, audit + edit, at, said))

        for made in "ua":
            push("I", 2, k, initials + made)
        if k < len(turns):
            turn = turns[k]
            push("D", 3, k + 1, initials)
            if not turn.goes:
                push("K", int(turn.truncated), k + 1, initials + (turn.initial or "-"))
                for made in "ua":
                    push("R", 2 + turn.truncated, k + 1, initials + made)
    raise AssertionError


def slow_result(rows: list[tuple]) -> tuple:
    """Of turns ``number, role, text`` in order."""
    turns, seen = [], []
    counts = [0, 0, 0]
    for number, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        seen.append((role, text))
        turns.append(C.Turn(role[:1], fault in (0, 1), fault == 2))
    numbers = {n for n, _, _ in rows if n is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    cost, audit = slow_edits(turns)
    lines, at, said = [], 0, ""
    for edit in audit:
        if edit in "IR":
            role = "assistant" if said.endswith("u") else "user"
            lines.append(f"{role}:{rows[at][2] if edit == 'R' else ''}")
            said += role[0]
        elif edit == "K":
            lines.append(f"{rows[at][1]}:{rows[at][2]}")
            said += rows[at][1][:1]
        at += edit != "I"
    text = "\n".join(lines)
    return gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text


def slow_damage(rows: list[tuple]) -> dict:
    by_conv: dict = {}
    for conv, number, role, text in rows:
        found = by_conv.setdefault(conv, [])
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if number is None else number}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            found += [(number, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(f, key=lambda r: (r[0] is not None, r[0] or 0)) for c, f in by_conv.items()}


def some_turns(rng: random.Random, n: int) -> list[C.Turn]:
    return [C.Turn(rng.choice("uuaast"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]


def test_search_finds_the_cheapest_and_least():
    rng = random.Random(11)
    for _ in range(3000):
        turns = some_turns(rng, rng.randint(0, 12))
        assert C.Search(turns, None)(C.START) == slow_edits(turns), turns


def test_pieces_add_up():
    rng = random.Random(12)
    for _ in range(600):
        turns, ways = some_turns(rng, rng.randint(0, 40)), C.Ways(True)
        said = [({"u": "user", "a": "assistant"}.get(t.initial, t.initial), str(k)) for k, t in enumerate(turns)]
        k = 0
        while k < len(turns):
            step = rng.randint(1, 9)
            through = [(b, e, *found) for e in range(4) for b in range(4) if (found := C.Search(turns[k : k + step], e)(b))]
            ways.extend(said[k : k + step], through)
            k += step
        cost, audit = C.Search(turns, None)(C.START)
        text = "\n".join(C.repaired(said, audit, C.START))
        assert ways.finish() == (cost, audit, hashlib.sha256(text.encode()).hexdigest(), text)


def test_long_conversations_stay_cheap():
    rng = random.Random(13)
    search = C.Search(some_turns(rng, 2000), None)
    cost, audit = search(C.START)
    assert cost > 1000 and len(audit) >= 2000


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def odd_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(30)]:
        size = 300 if conv == 7 else rng.randint(1, 9)
        for k in range(size):
            number = None if rng.random() < 0.02 and k == 0 else k + (k > 4)
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "", None])
            rows.append((conv, number, role, rng.choice([None, "", " \t", "Yes.", "No", f"Well {k}!", "Über?\n"])))
    return rows


@pytest.mark.parametrize("longest, piece, parts", [(512, 64, 1), (512, 64, 6), (4, 3, 4), (20, 7, 9)])
def test_against_brute_force(spark, monkeypatch, longest, piece, parts):
    monkeypatch.setattr(C, "LONGEST", longest)
    monkeypatch.setattr(C, "PIECE", piece)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = odd_rows(parts)
        got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(C.damaged(frame(spark, rows))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {c: slow_result(turns) for c, turns in slow_damage(rows).items()}
    assert got == want


def test_edges(spark):
    rows = [(1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 3, "user", "Hi."), (2, None, None, None), (3, 2, "assistant", "x" * 300_000 + ".")]
    extra = frame(spark, rows).selectExpr("*", "'x' AS audit", "1 AS cost", "'y' AS conv", "0 AS hash")
    got = {r["conv_id"]: tuple(r)[1:-2] for r in C.repair(extra).collect()}
    for conv in (1, 2, 3):
        want = slow_result([r[1:2] + tuple(" " if x is None else x for x in r[2:]) for r in rows if r[0] == conv])
        assert got[conv] == want[:-2]
    assert C.repair(frame(spark, [])).collect() == []
    gone = spark.createDataFrame([(5, 1, "user", "a", False)], "conv_id long, turn long, role string, text string, present boolean")
    assert [tuple(r) for r in C.repair(gone).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), "")]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in op11_conversation_repair(spark, SF).collect()}
    assert got == {c: slow_result(turns)[:-1] for c, turns in slow_damage(rows).items()}
