"""Exact set-similarity join on word shingles by a partitioned universe.

Two sets of sizes a and b with a Jaccard similarity of at least p percent differ in at most
(a + b) (100 - p) / (100 + p) shingles. Sets are put in bands of sizes; a band hashes shingles to m
segments. Of a set's m subsets, one a segment, the d first may be matched with one shingle more or
less, the others only whole: a subset counts 2 or 1. If what counts adds up to more than the
differences, some subset of the pair must match (pigeonhole). The keys of a set are its counted
subsets, and those of the d first also with each one of their shingles deleted.

Allocation is by cost. Each band takes the m and d for which keys and accidental partners, by the
number of its sets, cost least. A set counts only as many of its subsets as it needs, and leaves
out those that most others may share: the smallest. Subsets have one order (size, then hash), and a
set counts all above its own edge, so the set of a pair with the higher edge has a matching subset
that the other counts too. A set is also indexed in the band below if its smaller partners may be there.

Keys are buckets of neardup.link, which compares the sets of a bucket without listing its pairs: its
test is exact here (sizes, and the parities of hashed shingles, of which no more can differ than
shingles do), and every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm import neardup
from stackwright.llm.common import slices
from stackwright.llm.textbatch import Words, mix, shingles

#: A band's largest sets are fewer than so many times as large as its smallest.
RATIO = 2
#: The chance that an unrelated set of the band has a given shingle of a subset as well.
SHARED = 0.1
#: Characters a word with its blank, for how many sets a band may have.
CHARS = 6
#: 64-bit words of a set's parities.
PARITY_WORDS = 16


def differences(sizes: int, percent: int) -> int:
    """In how many shingles two sets of so many together may differ."""
    return sizes * (100 - percent) // (100 + percent)


def needed(n: int, percent: int) -> int:
    """What the counted subsets of a set of n shingles must add up to, whatever its partner."""
    return differences(n + 100 * n // percent, percent) + 1


@dataclass(frozen=True)
class Band:
    """Sets of low <= size < high, in m segments of which the first d count double."""

    low: int
    high: int
    m: int
    d: int


def first_size(percent: int) -> int:
    """The smallest size of a set that may differ from a partner; smaller ones have equal partners only."""
    n = 1
    while 100 * n // percent == n:
        n += 1
    return n


def band_of(n, percent: int):
    """The number of the band of sets of n shingles (numbers or arrays)."""
    edges = [first_size(percent)]
    while edges[-1] <= np.max(n):
        edges.append(edges[-1] * RATIO)
    return np.searchsorted(edges, n, "right") - 1


def _cost(n: int, m: int, d: int, sets: int, percent: int, shared: float) -> float:
    """Keys of a set of n shingles, and the sets of the band that share one of its counted subsets by accident."""
    mean, left, keys, met = n / m, needed(n, percent) / (m + d), 0.0, 0.0
    double = d / m
    # sizes of subsets are about Poisson; the largest count, until a share `left` of the weight is reached
    sizes = range(int(mean + 12 * mean**0.5 + 12), -1, -1)
    for z in sizes:
        part = min(left, exp(-mean + z * log(mean) - lgamma(z + 1)))
        left -= part
        keys += m * part * (1 + double * z)
        met += m * part * ((1 - double) * shared**z + double * min(1.0, (z + 1) * shared ** max(z - 1, 0)))
    return keys + sets * met


def allocate(low: int, high: int, sets: int, percent: int, shared: float = SHARED) -> Band:
    """The segments that cost sets of the band least; every option is right for all its sizes."""
    most = needed(high - 1, percent)
    options = {(m, max(0, most - m)) for part in (1.5, 1.25, 1.1, 1, 0.9, 0.75, 0.6, 0.5) for m in [max(1, -(-most // 2), round(most * part))]}
    cost = lambda x: sum(_cost(n, *x, sets, percent, shared) for n in (low, (low + high) // 2, high - 1))
    return Band(low, high, *min(sorted(options), key=cost))


def bands(counts: dict[int, int], percent: int) -> dict[int, Band]:
    """The bands up to the largest set, from the number of sets in each."""
    out, low = {}, first_size(percent)
    for i in range(max(counts, default=-1) + 1):
        out[i] = allocate(low, low * RATIO, counts.get(i, 0) + counts.get(i + 1, 0), percent)
        low *= RATIO
    return out


def keys_in(s: np.ndarray, band: Band, number: int, percent: int) -> np.ndarray:
    """The keys of one set (sorted distinct hashes) in a band."""
    with np.errstate(over="ignore"):
        x = mix(s ^ np.uint64(0x5851F42D4C957F2D * (number + 1) % 2**64))
        at = ((x >> np.uint64(32)) % np.uint64(band.m)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        value, at = mix(x[order] + np.uint64(1)), at[order]
        size = np.bincount(at, minlength=band.m)
        sums = np.zeros(band.m, np.uint64)
        there = np.flatnonzero(size)
        if len(there):
            sums[there] = np.add.reduceat(value, np.concatenate([[0], np.cumsum(size[there])[:-1]]))
        place = mix(np.arange(band.m, dtype=np.uint64) + np.uint64(number << 40))
        whole = mix(sums ^ place)
        # the largest subsets count, of equal sizes those of higher hash, until they add up
        rank = np.lexsort((whole, size))[::-1]
        weight = np.where(rank < band.d, 2, 1)
        last = int(np.searchsorted(np.cumsum(weight), needed(len(s), percent)))
        counted = rank[: last + 1]
        least = size[counted[-1]] if len(counted) else 0
        full = np.zeros(band.m, bool)
        full[counted] = True
        # a partner's double subset may hold one shingle less
        double = np.arange(band.m) < band.d
        full |= double & (size >= least - 1)
        cut = (double & full & (size >= least))[at]
        return np.concatenate([whole[full], mix((sums[at] - value)[cut] ^ place[at[cut]])]).view(np.int64)


def keys(s: np.ndarray, table: dict[int, Band], percent: int) -> np.ndarray:
    """All keys of a set: in its own band, and in the one below if that holds possible partners."""
    i = int(band_of(len(s), percent))
    if i < 0:
        return np.zeros(0, np.int64)
    parts = [keys_in(s, table[i], i, percent)]
    if i and 100 * (table[i].low - 1) >= percent * len(s):
        parts.append(keys_in(s, table[i - 1], i - 1, percent))
    return np.unique(np.concatenate(parts))


def parities(s: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY_WORDS cells whether an odd number of the set's shingles hash to it."""
    odd = np.bincount((mix(s) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Parities:
    """May two sets be as similar as percent asks: sizes and parities, which rule out no pair that is."""

    words = PARITY_WORDS

    def __init__(self, percent: int):
        self.percent = percent

    def column(self, x: str, y: str) -> Column:
        p = self.percent
        fits = f"100L * least({x}.n, {y}.n) >= {p}L * greatest({x}.n, {y}.n)"
        return F.expr(f"{fits} and ({neardup.apart(x, y, self.words)}) * {100 + p}L <= ({x}.n + {y}.n) * {100 - p}L")

    def array(self, n: np.ndarray, sigs: np.ndarray, size: int, sig: np.ndarray) -> np.ndarray:
        p = self.percent
        fits = 100 * np.minimum(n, size) >= p * np.maximum(n, size)
        return fits & (np.bitwise_count(sigs ^ sig).sum(1).astype(np.int64) * (100 + p) <= (n + size) * (100 - p))


def _digests(k: int, table: dict[int, Band], percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run_ in slices(pdf["text"]):
                part = pdf.iloc[run_]
                w = Words(part["text"], lower=True)
                sets = [shingles(w.of(j), k) for j in range(len(part))]
                key = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets], "key": key, "bands": [keys(s, table, percent) if len(s) else None for s in sets], "sig": [parities(s) if len(s) else None for s in sets]})

    return run


def band_table(docs: DataFrame, percent: int) -> dict[int, Band]:
    """The bands for docs. How many sets each has is taken from the lengths of texts, at about CHARS a word."""
    band = F.floor(F.log2(F.length("text") / CHARS / first_size(percent)))
    rows = docs.where("text != ''").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max(F.length("text")).alias("chars")).collect()
    counts = {r["band"]: r["n"] for r in rows if r["band"] >= 0}
    # words have a character and a blank at least
    last = int(band_of(max([1, *((r["chars"] + 1) // 2 for r in rows)]), percent))
    return bands({last: 0} | counts, percent)


def similarity_components(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text; others ignored).

    Two documents link if 100 times the size of their shingle sets' intersection is at least percent
    times that of the union; no link is missed. component_id is the smallest doc_id reachable by
    links. A text of fewer than k words is one shingle; null or blank texts have none and link with
    nothing. Texts of any length are read whole; rows with a null doc_id link with nothing and have
    a null component; repeated rows give repeated results, ids are taken to name one text; an empty
    table gives an empty one. The result is a written table.
    """
    if not 50 <= percent <= 99:
        raise ValueError("percent must be 50 to 99")  # partners further apart would lie beyond the next band
    return neardup.link(spark, docs, "jaccard", _digests(k, band_table(docs, percent), percent), k, Parities(percent))
