"""Repair of conversations' role structure by a generalised LR parser.

Roles count by their initials: s, u and a. The grammar of a whole conversation is
C -> (nothing) | P | s P;  P -> u a | P u a. A row is kept (K, at no cost), gets another role (R) or
is deleted (D); a turn with an empty text can be inserted anywhere (I). The parser carries all
repairs at once as one stack graph: a stack is its top state and a link to what lies below, which
stacks share, and of stacks with equal tops the one with the least (cost, audit) stays, where the
audit is the repair's letters in order. Nothing is lost by that: here what can follow depends on
the top alone, and of two audits for the same rows and of equal cost none begins with the other,
so their order stays whatever follows.

Conversations of at most LONG rows are repaired each in one go, many to a task. Longer ones are cut
into blocks of rows dealt by range; a block gives, for each kind of stack that may come in, the
least (cost, audit) for each that may go out, and those tables are joined up in order. Only the
hash of a conversation's repaired text has to read it in one piece; it does so as a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import groupby

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm.common import join_keyed
from stackwright.sources.scratch import Scratch

#: Rows of a conversation that is repaired in one go, and of a block of a longer one.
LONG, BLOCK = 10_000, 4096
#: Ids of longer conversations that are broadcast; more are joined by a shuffle.
BROADCAST = 100_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: The parser's states: 0 nothing read, 1 after s, 2 after u, 3 and 4 after P (without and with s), 5 after P u.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 6}, 3: {"u": 5}, 4: {"u": 5}, 5: {"a": 7}}
#: Complete productions of P, with how many states they take off the stack, and the state then reached.
REDUCE, GOTO = {6: 2, 7: 3}, {0: 3, 1: 4}
ACCEPT = (0, 3, 4)
#: States that may be followed by the same, for stacks that come from another block, and a stack of each kind.
KIND = {0: 0, 1: 1, 2: 2, 5: 2, 3: 3, 4: 3}
STACKS = {0: (0, None), 1: (1, (0, None)), 2: (2, (0, None)), 3: (3, (0, None))}

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def _put(tops: dict, cost: int, audit: str, stack: tuple) -> bool:
    """Adds a stack, reduced; says whether it is the best of its top."""
    while stack[0] in REDUCE:
        for _ in range(REDUCE[stack[0]]):
            stack = stack[1]
        stack = (GOTO[stack[0]], stack)
    had = tops.get(stack[0])
    if had is None or (cost, audit) < had[:2]:
        tops[stack[0]] = (cost, audit, stack)
        return True
    return False


def with_inserts(tops: dict) -> dict:
    """The stacks with those that insertions lead to."""
    tops, work = dict(tops), list(tops.values())
    while work:
        cost, audit, stack = work.pop()
        for symbol, state in SHIFT[stack[0]].items():
            if symbol in ROLES:
                after: dict = {}
                _put(after, cost + INSERT, audit + "I", (state, stack))
                (new,) = after.values()
                if _put(tops, *new):
                    work.append(new)
    return tops


def with_row(tops: dict, initial: str, must_go: bool, cut: bool) -> dict:
    """The stacks after one more row."""
    out: dict = {}
    for cost, audit, stack in with_inserts(tops).values():
        _put(out, cost + DELETE, audit + "D", stack)
        if not must_go:
            stays = cost + TRUNCATED * cut
            for symbol, state in SHIFT[stack[0]].items():
                if symbol == initial:
                    _put(out, stays + KEEP, audit + "K", (state, stack))
                if symbol in ROLES:
                    _put(out, stays + REROLE, audit + "R", (state, stack))
    return out


def cheapest(tops: dict) -> tuple[int, str]:
    """The least (cost, audit) of a stack that is a whole conversation, after insertions at its end."""
    after = with_inserts(tops)
    return min(after[s][:2] for s in ACCEPT if s in after)


def edited(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of a conversation after the edits; inserted and reroled turns alternate from user."""
    rows, n = iter(rows), 0
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = ROLES["ua"[n % 2]]
        n += not (n == 0 and role[:1] == "s")
        yield role, text


def faults_of(text: str, seen: bool) -> str:
    """The first fault of a row: b blank, d duplicate, t truncated, or none."""
    end = text.rstrip(SPACES)[-1:]
    return "b" if not end else "d" if seen else "" if end in ".!?" else "t"


def _digest(turns: Iterable[tuple[str, str]]) -> str:
    out, first = sha256(), True
    for role, text in turns:
        out.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False
    return out.hexdigest()


def _legal(x: str, y: str) -> bool:
    return x + y in ("su", "ua", "au")


def repaired(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of one conversation's rows (turn, role, text), in order."""
    seen: set = set()
    tops, faults = {0: (0, "", STACKS[0])}, []
    for _, role, text in rows:
        faults.append(faults_of(text, (role, text) in seen))
        seen.add((role, text))
        tops = with_row(tops, role[:1], faults[-1] in ("b", "d"), faults[-1] == "t")
    cost, audit = cheapest(tops)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(not _legal(x[1][:1], y[1][:1]) for x, y in zip(rows, rows[1:], strict=False))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, _digest(edited(audit, [r[1:] for r in rows]))


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _runs(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple[str, Iterator[tuple]]]:
    """Rows sorted by _c, as runs of one _c, read as they are asked for."""
    each = (row for pdf in batches for row in zip(pdf["_c"], *(pdf[c] for c in columns), strict=True))
    for key, rows in groupby(each, key=lambda r: r[0]):
        yield key, (r[1:] for r in rows)


def _number(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    names = ["_c", *(f.split()[0] for f in FACTS.split(", "))]
    for key, rows in _runs(batches, "turn", "role", "text", "alive"):
        out.append((key, *repaired([(_number(t), role, text) for t, role, text, alive in rows if alive])))
        if len(out) >= 1000:
            yield pd.DataFrame(out, columns=names)
            out = []
    yield pd.DataFrame(out, columns=names)


# ---- conversations of more than LONG rows


BLOCKS = "_c string, part int, block int, first string, last string, from_turn long, to_turn long, turns long, blank long, duplicate long, truncated long, illegal long, steps array<struct<a int, b int, cost long, audit string>>"


def _steps(rows: list[tuple]) -> list[tuple]:
    """For each kind of stack that comes in (a) and goes out (b) the least cost and audit of a block's rows (initial, must_go, cut)."""
    out = []
    for a, stack in STACKS.items():
        tops, kinds = {stack[0]: (0, "", stack)}, {}
        for row in rows:
            tops = with_row(tops, *row)
        for state, (cost, audit, _) in tops.items():
            if KIND[state] not in kinds or (cost, audit) < kinds[KIND[state]]:
                kinds[KIND[state]] = (cost, audit)
        out += [(a, b, *x) for b, x in kinds.items()]
    return out


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (_c, turn, ...), each standing for n equal ones, as blocks of about BLOCK rows."""
    part = TaskContext.get().partitionId()
    names = [f.split()[0] for f in BLOCKS.split(", ")[:12]] + ["steps"]

    def block(key: str, number: int, rows: list[tuple]) -> tuple:
        turns = sorted({t for t, _, _ in rows if t is not None})
        faults = [f for _, _, f in rows]
        inits = [i for _, i, _ in rows]
        return (
            key, part, number, inits[0], inits[-1], turns[0] if turns else None, turns[-1] if turns else None, len(turns), faults.count("b"), faults.count("d"), faults.count("t"),
            sum(not _legal(x, y) for x, y in zip(inits, inits[1:], strict=False)), _steps([(i, f in ("b", "d"), f == "t") for _, i, f in rows]),
        )

    def frame(row: tuple) -> pd.DataFrame:
        return pd.DataFrame([row], columns=names).astype({"from_turn": "Int64", "to_turn": "Int64"})

    for key, rows in _runs(batches, "turn", "role", "text", "n", "again"):
        held, number = [], 0
        for turn, role, text, n, again in rows:
            for copy in range(n):
                held.append((_number(turn), role[:1], faults_of(text, again or copy > 0)))
                if len(held) == BLOCK:
                    yield frame(block(key, number, held))
                    held, number = [], number + 1
        if held:
            yield frame(block(key, number, held))


def _joined(blocks: Iterable[tuple]) -> tuple:
    """The facts of a conversation but its hash, from those of its blocks in order."""
    ways: dict[int, tuple[int, list[str]]] = {0: (0, [])}
    counts, turns, low, high, last = [0, 0, 0, 0], 0, None, None, None
    for first, end, from_turn, to_turn, own, *more, steps in blocks:
        counts = [x + int(y) for x, y in zip(counts, more, strict=True)]
        counts[3] += last is not None and not _legal(last, first)
        last = end
        if own:
            turns += int(own) - (high is not None and high == int(from_turn))
            low, high = int(from_turn) if low is None else low, int(to_turn)
        after: dict = {}
        for s in steps:
            if s["a"] in ways:
                cost, pieces = ways[s["a"]]
                new, had = (cost + s["cost"], [*pieces, s["audit"]]), after.get(s["b"])
                if had is None or new[0] < had[0] or new[0] == had[0] and "".join(new[1]) < "".join(had[1]):
                    after[s["b"]] = new
        ways = after
    cost, audit = cheapest({k: (c, "".join(p), STACKS[k]) for k, (c, p) in ways.items()})
    return (high - low + 1 - turns if turns else 0, *counts, cost, audit)


def _join_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in FACTS.split(", ")][:-1]
    for key, rows in _runs(batches, "first", "last", "from_turn", "to_turn", "turns", "blank", "duplicate", "truncated", "illegal", "steps"):
        yield pd.DataFrame([(key, *_joined(rows))], columns=["_c", *names])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each conversation first a row with its audit as text, then its rows."""
    for key, rows in _runs(batches, "role", "text", "n"):
        _, audit, _ = next(rows)
        yield pd.DataFrame([(key, _digest(edited(audit, ((r, t) for r, t, n in rows for _ in range(n)))))], columns=["_c", "repaired_sha256"])


def _long(scratch: Scratch, rows: DataFrame) -> DataFrame:
    order = ["_c", "turn", "role", "_h"]
    runs = rows.where("alive").groupBy("_c", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("_h", F.md5("text"))
    runs = scratch.keep(runs.withColumn("_k", F.sha2(F.to_json(F.array("_c", "role", "text")), 256)), "runs")
    # a struct, so that a null turn comes first
    first = scratch.keep(runs.groupBy("_k").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("rows")), "first")
    known = join_keyed(runs, first, "_k", runs.count(), "rows").withColumn("again", ~F.col("turn").eqNullSafe(F.col("first.turn")))
    laid = known.select(*order, "text", "n", "again").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = scratch.keep(laid.mapInPandas(_blocks, BLOCKS), "blocks")
    facts = blocks.repartition("_c").sortWithinPartitions("_c", "part", "block").mapInPandas(_join_blocks, "_c string, " + FACTS.rpartition(",")[0])
    facts = scratch.keep(facts, "facts")
    no = F.lit(None)
    audits = facts.select("_c", F.lit(0).alias("kind"), no.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("_h"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    whole = audits.union(runs.select("_c", F.lit(1), "turn", "role", "_h", "text", "n"))
    hashes = whole.repartition("_c").sortWithinPartitions("_c", "kind", "turn", "role", "_h").mapInPandas(_hashed, "_c string, repaired_sha256 string")
    return facts.join(hashes, "_c")


def repair(spark: SparkSession, rows: DataFrame, long: int = LONG) -> DataFrame:
    """The structure of each conversation and its cheapest repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    rows: conv_id (of any type that is a key), turn, role, text and optionally alive (false: the row
    only tells that the conversation exists). A conversation's rows are taken by turn, nulls first;
    of equal turns by role and the md5 of the text, so repeated rows are neighbours. A null role or
    text is one space; null conv_ids are one conversation. A row's first fault counts: blank,
    duplicate (role and text seen earlier) or truncated (no . ! or ? at its end). A conversation
    without rows has zeros, an empty audit and the hash of nothing; an empty table gives none.
    Other columns are not read. The result is a written table; see turns() for the repaired rows.
    """
    scratch, named = Scratch(spark, "conversations"), _named(rows)
    sizes = named.groupBy("_c").agg(F.count("*").alias("_n")).where(F.col("_n") > long)
    sizes = scratch.keep(sizes.select("_c"), "long")
    n_long = sizes.count()
    others = named
    if n_long:
        sizes = F.broadcast(sizes) if n_long <= BROADCAST else sizes.hint("merge")
        others = named.join(sizes, "_c", "left_anti")
    order = ["_c", "turn", "role", "_h"]
    laid = others.withColumn("_h", F.md5("text")).repartition("_c").sortWithinPartitions(*order)
    found = laid.mapInPandas(_whole, f"_c string, {FACTS}")
    if n_long:
        found = found.unionByName(_long(scratch, named.join(sizes, "_c", "left_semi")))
    kind = rows.schema["conv_id"].dataType
    conv = F.when(F.col("_c") != "n", F.substring("_c", 2, 2**31 - 1)).cast(kind).alias("conv_id")
    out = Scratch(spark, "conversations-result").keep(found.select(conv, *[f.split()[0] for f in FACTS.split(", ")]), "result")
    scratch.drop()
    return out


def _named(rows: DataFrame) -> DataFrame:
    """conv_id as text (_c: n for null, or v and the id), turn, role, text and alive."""
    some = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    alive = F.coalesce(F.col("alive"), F.lit(True)).alias("alive") if "alive" in rows.columns else F.lit(True).alias("alive")
    return rows.select(F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("_c"), F.col("turn").cast("long").alias("turn"), some("role"), some("text"), alive)


def turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations as rows (conv_id, place, role, text), from repair()'s audits. A conversation passes through one task, as a stream."""
    named = _named(rows).where("alive").withColumn("_h", F.md5("text"))
    kind = rows.schema["conv_id"].dataType
    audits = repairs.select(F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("_c"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("_h"), F.col("audit").alias("text"))

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for key, own in _runs(batches, "role", "text"):
            _, audit = next(own)
            for place, (role, text) in enumerate(edited(audit, own)):
                out.append((key, place, role, text))
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=["_c", "place", "role", "text"])
                    out = []
        yield pd.DataFrame(out, columns=["_c", "place", "role", "text"])

    whole = audits.union(named.select("_c", F.lit(1), "turn", "role", "_h", "text"))
    done = whole.repartition("_c").sortWithinPartitions("_c", "kind", "turn", "role", "_h").mapInPandas(edit, "_c string, place long, role string, text string")
    return done.select(F.when(F.col("_c") != "n", F.substring("_c", 2, 2**31 - 1)).cast(kind).alias("conv_id"), "place", "role", "text")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and alive of conversations with every fault: by crc32 of conv_id:turn modulo 20, a row is lost (0), emptied (1), left without . ! ? (2), repeated (3) or given to the user (4)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    new = F.when(by == 1, "").when(by == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    copies = F.sequence(F.lit(1), F.when(by == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(by == 4, "user").otherwise(text("role")).alias("role"), new.alias("text"), (by != 0).alias("alive"), F.explode(copies).alias("_copy")).drop("_copy")
