import random
import re
from collections import defaultdict
from hashlib import sha256
from itertools import product
from zlib import crc32

import pytest

from stackwright.llm import conversation_repair as C

ROWS = "conv_id string, turn long, role string, text string, alive boolean, _c int, place int"
WHOLE = re.compile(r"(s?(ua)+)?\Z")


def brute(rows):
    """All edits of a short conversation: every row kept, reroled or deleted, and at most two insertions in each gap."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.strip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
        faults.append("b" if not end else "d" if (role, text) in seen else "" if end in ".!?" else "t")
        seen.add((role, text))
    options = []
    for (_, role, text), f in zip(rows, faults, strict=True):
        own = [("D", None, 4)]
        if f not in ("b", "d"):
            more = 3 if f == "t" else 0
            own += [("K", (role, text), more), ("R", ("user", text), 3 + more), ("R", ("assistant", text), 3 + more)]
        options.append(own)
    gap = [()] + [(x,) for x in ("user", "assistant")] + [("user", "assistant")]
    best = None
    for gaps in product(gap, repeat=len(rows) + 1):
        for picks in product(*options):
            out, audit, cost = [], "", 0
            for g, pick in zip(gaps, [*picks, None], strict=True):
                out += [(r, "") for r in g]
                audit, cost = audit + "I" * len(g), cost + 3 * len(g)
                if pick:
                    audit, cost = audit + pick[0], cost + pick[2]
                    out += [pick[1]] if pick[1] else []
            if (best is None or (cost, audit) < best[:2]) and WHOLE.match("".join(r[:1] or "-" for r, _ in out)):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, best[0], best[1], sha256(best[2].encode()).hexdigest())


def _rows(rng, n):
    return [(t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", " ", ""]), rng.choice(["a.", "b!", "c", " ", "", "d?\n", "e. f"])) for t in sorted(rng.choices(range(9), k=n))]


def test_cheapest_repair_against_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 3, 4):
        for _ in range(25 if n < 4 else 8):
            rows = _rows(rng, n)
            assert C.repaired(rows) == brute(rows), rows


def test_blocks_join_up_to_the_same():
    rng = random.Random(2)
    for _ in range(60):
        rows = _rows(rng, rng.randint(1, 40))
        seen, faults = set(), []
        for _, role, text in rows:
            faults.append(C.faults_of(text, (role, text) in seen))
            seen.add((role, text))
        blocks, at = [], 0
        while at < len(rows):
            to = at + rng.randint(1, 9)
            part, own = rows[at:to], faults[at:to]
            turns = sorted({t for t, _, _ in part})
            steps = [dict(zip(("a", "b", "cost", "audit"), s, strict=True)) for s in C._steps([(r[:1], f in ("b", "d"), f == "t") for (_, r, _), f in zip(part, own, strict=True)])]
            legal = sum(not C._legal(x[1][:1], y[1][:1]) for x, y in zip(part, part[1:], strict=False))
            blocks.append((part[0][1][:1], part[-1][1][:1], turns[0], turns[-1], len(turns), own.count("b"), own.count("d"), own.count("t"), legal, steps))
            at = to
        assert C._joined(blocks) == C.repaired(rows)[:-1]


def _expected(rows):
    from hashlib import md5

    by = defaultdict(list)
    for c, t, role, text, alive, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by[c] += [(t, role, text)] if alive else []
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2].encode()).hexdigest())
    return {c: C.repaired(sorted(own, key=order)) for c, own in by.items()}


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(7)
    rows = [("long", *r, True, 1, 2) for r in _rows(rng, 150)] + [("long", None, "user", "null turn.", True, 1, 2)] * 9
    rows += [(None, rng.choice([None, 1, 2]), "user", "same.", True, 1, 2) for _ in range(60)]
    rows += [(f"c{i}", *r, rng.random() > 0.1, 1, 2) for i in range(30) for r in _rows(rng, 5)]
    rows += [("gone", 1, "user", "x", False, 1, 2), ("null", 1, None, None, True, 1, 2), ("huge", 1, "user", "w" * 3_000_000, True, 1, 2), ("far", 1, "user", "a.", True, 1, 2), ("far", 10**15, "assistant", "b.", True, 1, 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("long", [C.LONG, 20])
def test_whole_and_in_blocks(spark, monkeypatch, odd, long):
    monkeypatch.setattr(C, "BLOCK", 7)
    got = C.repair(spark, spark.createDataFrame(odd, ROWS), long)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == _expected(odd)
    assert got.where("conv_id = 'gone'").select("cost", "audit", "repaired_sha256").first()[:] == (0, "", sha256(b"").hexdigest())


def test_turns_are_what_is_hashed(spark, odd):
    df = spark.createDataFrame(odd, ROWS)
    repairs = C.repair(spark, df)
    by = defaultdict(dict)
    for r in C.turns(df, repairs).collect():
        by[r["conv_id"]][r["place"]] = f"{r['role']}:{r['text']}"
    for r in repairs.collect():
        own = by[r["conv_id"]]
        assert sha256("\n".join(own[i] for i in range(len(own))).encode()).hexdigest() == r["repaired_sha256"]


def test_empty(spark):
    assert C.repair(spark, spark.createDataFrame([], ROWS)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "So. Yes! No?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = defaultdict(list)
    for r in C.damaged(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect():
        got[(r["conv_id"], r["turn"])].append((r["role"], r["text"], r["alive"]))
    for c, t, *_ in rows:
        h = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = ("assistant", "So. Yes! No?") if c is not None else (" ", " ")
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
        assert got[(c, t)] == [("user" if h == 4 else role, text, h != 0)] * (2 if h == 3 else 1)
