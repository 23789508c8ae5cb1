"""Benchmark decontamination by greedy string tiling.

Items and texts are sequences of tokens (lower-cased, punctuation dropped). A text is a candidate
for an item if they share a seed, a run of MIN_MATCH tokens, found by one rolling (Karp-Rabin)
hash over every text. For each candidate pair the longest match of unmarked tokens is marked as a
tile, again and again until none of MIN_MATCH tokens is left; since tiles may stand in any order,
a reordered passage is covered like a verbatim one. A text is contaminated if tiles cover at
least COVERAGE of an item's tokens.

The items are the query set: they pass in blocks of at most BLOCK_BYTES, each held whole by every
task, against all texts, in one scan for every BLOCKS_AT_ONCE blocks. Texts are never shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm.common import columns_of, free_name, slices
from stackwright.llm.textbatch import NOT_ALNUM, Words, windows
from stackwright.sources.scratch import Scratch

MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_BYTES = 4 << 20
BLOCKS_AT_ONCE = 8
#: Pairs of equal windows of a text and the items that are held at once.
PAIRS = 4 << 20
MATCHES = "array<struct<item_id: bigint, coverage: double, tiles: array<struct<item_at: int, text_at: int, words: int>>>>"


def tokens(texts) -> Words:
    return Words([(t or "").lower() for t in texts], between=NOT_ALNUM)


class Block:
    """Items of one block, with the seeds of each length that occurs."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        w = tokens([t for _, t in items])
        self.items = [(i, w.of(n)) for n, (i, _) in enumerate(items) if len(w.of(n))]
        self.seeds = {}
        for k in {min(min_match, len(t)) for _, t in self.items}:
            own = [(n, windows(t, k)) for n, (_, t) in enumerate(self.items) if min(min_match, len(t)) == k]
            h = np.concatenate([x for _, x in own])
            item = np.repeat([n for n, _ in own], [len(x) for _, x in own])
            at = np.concatenate([np.arange(len(x)) for _, x in own])
            order = np.argsort(h, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[h >> np.uint64(44)] = True
            self.seeds[k] = (h[order], item[order], at[order], maybe)


def blocks(items: DataFrame, min_match: int = MIN_MATCH, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Items by and by, a block at a time; rows with a null id or without a token are no items."""
    now, n = [], 0
    for r in items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        now.append((r[0], r[1]))
        n += len(r[1]) + 64
        if n >= size:
            yield Block(now, min_match)
            now, n = [], 0
    if now:
        yield Block(now, min_match)


def maximal(item: np.ndarray, at: np.ndarray, where: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches of an item's windows from ``at`` and a text's from ``where`` on, joined where one follows another on a diagonal.

    size: how many windows each has (default 1). Returns item, at, where and size.
    """
    size = np.ones(len(at), np.int64) if size is None else size
    order = np.lexsort((at, where - at, item))
    item, at, where, size = item[order], at[order], where[order], size[order]
    same = (item[1:] == item[:-1]) & (where[1:] - at[1:] == where[:-1] - at[:-1]) & (at[1:] == at[:-1] + size[:-1])
    new = np.flatnonzero(np.concatenate([[True], ~same])) if len(at) else np.zeros(0, np.int64)
    return item[new], at[new], where[new], np.add.reduceat(size, new) if len(new) else size


def tile(at: np.ndarray, where: np.ndarray, size: np.ndarray, k: int, n_item: int, n_text: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of an item and a text from their maximal matches (starts, and length in tokens).

    The longest match is marked, of equal ones the first of the item, then of the text; matches
    that touch marked tokens are cut to their unmarked runs of at least k. Ends early where the
    item has no k unmarked tokens in a row.
    """
    order = np.lexsort((where, at, -size))
    first = lambda i: (-int(size[order[i]]), int(at[order[i]]), int(where[order[i]]))
    cut, i = [], 0
    in_item, in_text = np.zeros(n_item, bool), np.zeros(n_text, bool)
    out = []
    while i < len(order) or cut:
        if cut and (i == len(order) or cut[0] <= first(i)):
            n, a, b = heapq.heappop(cut)
        else:
            (n, a, b), i = first(i), i + 1
        free = ~(in_item[a : a - n] | in_text[b : b - n])
        if free.all():
            in_item[a : a - n] = in_text[b : b - n] = True
            out.append((a, b, -n))
            if max((y - x for x, y in _runs(~in_item)), default=0) < k:
                break
            continue
        for x, y in _runs(free):
            if y - x >= k:
                heapq.heappush(cut, (x - y, a + x, b + x))
    return sorted(out)


def _runs(free: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _matches(near: np.ndarray, lo: np.ndarray, times: np.ndarray, item: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The maximal matches of one text's windows near with the items' seeds; at most about PAIRS pairs of windows are held at once."""
    ends, parts = np.cumsum(times), []
    first = 0
    while first < len(near):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        t = times[first:last]
        rows = np.repeat(lo[first:last], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        parts.append(maximal(item[rows], at[rows], np.repeat(near[first:last], t)))
        first = last
    return parts[0] if len(parts) == 1 else maximal(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def find(texts, block: Block, coverage: float) -> list[list[dict]]:
    """For each text the items of the block that tiles cover to at least coverage."""
    w = tokens(texts)
    out: list[list[dict]] = [[] for _ in range(len(w))]
    if not len(w.start):
        return out
    for k, (seed, item, at, maybe) in block.seeds.items():
        h = windows(w.hash, k)
        near = np.flatnonzero(maybe[h >> np.uint64(44)])
        lo = np.searchsorted(seed, h[near])
        hit = seed[np.minimum(lo, len(seed) - 1)] == h[near]
        near, lo = near[hit], lo[hit]
        text = np.searchsorted(w.first, near, "right") - 1
        whole = near + k <= w.first[text + 1]  # a window does not cross into the next text
        near, lo, text = near[whole], lo[whole], text[whole]
        times = np.searchsorted(seed, h[near], "right") - lo
        for i in np.unique(text):
            mine = slice(*np.searchsorted(text, [i, i + 1]))
            of, a, b, n = _matches(near[mine] - w.first[i], lo[mine], times[mine], item, at)
            n = n + k - 1
            edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            for x, y in zip(edges, np.append(edges[1:], len(of)), strict=True):
                item_id, words = block.items[of[x]]
                reach = np.bincount(a[x:y], minlength=len(words) + 1) - np.bincount(a[x:y] + n[x:y], minlength=len(words) + 1)
                if (np.cumsum(reach)[:-1] > 0).sum() < coverage * len(words):
                    continue  # tiles lie within the matches
                tiles = tile(a[x:y], b[x:y], n[x:y], k, len(words), w.first[i + 1] - w.first[i])
                share = sum(t[2] for t in tiles) / len(words)
                if share >= coverage:
                    out[i].append({"item_id": item_id, "coverage": share, "tiles": [{"item_at": p, "text_at": q, "words": m} for p, q, m in tiles]})
    return out


def with_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, name: str = "matches") -> DataFrame:
    """docs with an array of (item_id, coverage, tiles) of the items that each text holds.

    docs: text and any other columns; items: item_id, text. A column of the given name is
    replaced. Null or empty texts match nothing, texts of any length are read whole; items shorter
    than min_match must occur whole; equal items under several ids each match, a repeated row of
    items once, a repeated row of docs each time; of equally long matches the first of the item is
    marked first; without items every array is empty, without docs there are no rows.
    """
    scratch, n = Scratch(spark, "decontam"), 0

    def column(held):
        @F.pandas_udf(MATCHES)
        def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                yield pd.Series([m for part in slices(texts) for m in find(texts.iloc[part], held.value, coverage)], index=texts.index, dtype=object)

        return of("text")

    docs = docs.drop(name).withColumn(name, F.expr(f"cast(array() as {MATCHES})"))
    found = []
    for block in blocks(items, min_match):
        found.append(column(spark.sparkContext.broadcast(block)))
        if len(found) == BLOCKS_AT_ONCE:
            docs, n, found = scratch.keep(docs.withColumn(name, F.concat(name, *found)), f"part{n}"), n + 1, []
    return docs.withColumn(name, F.concat(name, *found)) if found else docs


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """The documents that hold no item, with their own columns; for odd rows see with_matches."""
    name = free_name(docs, "_matches")
    return with_matches(spark, docs, items, coverage, min_match, name).where(F.size(name) == 0).select(*columns_of(docs))
