"""MinHash near-duplicate detection.

A document's set is its distinct k-word shingles. Documents of equal sets form a class with one
representative. Representatives get PERMUTATIONS universal-hash minima; bands of ROWS minima are
bucket keys: two sets of similarity 0.8 share no bucket with probability 5e-6, two of 0.3 share
one with probability 0.01.
Pairs of a bucket are verified on the signatures, then on the full sets, and the links' connected
components come from alternating large-star and small-star.

No bucket is ever gathered, and its pairs are not listed. Every member is paired with its bucket's
smallest id, so a bucket that is then one component costs a pair a member, however large it is.
Buckets that still hold several components are open. In those of at most LISTED members the members
outside the largest component are joined with the others, and only pairs whose sizes and signatures
allow it meet as texts. Larger ones are compared in cells of at most about BLOCK by GROUP documents,
each bucket for itself or merged into families of such buckets, whichever makes fewer rows: first
by sizes and signatures alone, then, with the texts of those that have a possible partner in their
cell, in full. Cells emit links only. No pair of one bucket that could join two components is left out.

Joins on buckets, hubs, components and families go through join_keyed, so none of them, however
frequent, is dealt to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm.common import columns_of, connected_components, join_keyed, slices
from stackwright.llm.textbatch import Words, each_text, mix, shingles
from stackwright.sources.scratch import Scratch

PERMUTATIONS, ROWS = 364, 7
#: Signatures for verification are a bit of each minimum; a pair whose bits agree less often than
#: its threshold lets expect, by so many standard deviations, is not compared in full.
SIGMAS = 5.5
#: Members compared with one text in one group; signatures, and texts, held at once in a cell of a family.
GROUP, BLOCK, HELD = 256, 2048, 256
#: Members of an open bucket whose pairs are listed, so that a member has fewer pairs than that in it.
LISTED = 32

_rng = np.random.default_rng(977)
_A = _rng.integers(1, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of a x + b (mod 2**32) over 32 bits of each shingle, [sets, PERMUTATIONS]; no set may be empty."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x, out = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), np.empty((len(sets), PERMUTATIONS), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(PERMUTATIONS):
            out[:, j] = np.minimum.reduceat(x * _A[j] + _B[j], at)
    return out


def band_keys(minima: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One bucket key of 64 bits a band; keys of different bands differ."""
    n = minima.shape[1] // rows
    parts = minima[:, : n * rows].reshape(len(minima), n, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)


def bits(minima: np.ndarray) -> np.ndarray:
    """A bit of each minimum, mixed, packed into int64 words."""
    one = (minima * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8)
    one = np.pad(one, ((0, 0), (0, -one.shape[1] % 64)))
    return np.packbits(one, axis=1).view(np.int64)


class Minima:
    """May two sets be as similar as percent asks: their sizes, and a bit of each minimum."""

    def __init__(self, percent: int):
        self.percent, self.words, j = percent, -(-PERMUTATIONS // 64), percent / 100
        #: how many bits of two signatures may differ
        self.most = int(PERMUTATIONS * (1 - j) / 2 + SIGMAS * (PERMUTATIONS * (1 + j) * (1 - j)) ** 0.5 / 2)

    def column(self, x: str, y: str) -> Column:
        """Of rows x and y (sig, n)."""
        return F.expr(f"100L * least({x}.n, {y}.n) >= {self.percent}L * greatest({x}.n, {y}.n) and {apart(x, y, self.words)} <= {self.most}")

    def array(self, n: np.ndarray, sigs: np.ndarray, size: int, sig: np.ndarray) -> np.ndarray:
        """Of each of many sets and one other."""
        return (100 * np.minimum(n, size) >= self.percent * np.maximum(n, size)) & (np.bitwise_count(sigs ^ sig).sum(1) <= self.most)


def apart(x: str, y: str, words: int) -> str:
    """How many bits of the signatures of rows x and y differ."""
    return " + ".join(f"bit_count({x}.sig[{i}] ^ {y}.sig[{i}])" for i in range(words))


def _digests(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run_ in slices(pdf["text"]):
                part = pdf.iloc[run_]
                w = Words(part["text"], lower=True)
                sets = [shingles(w.of(j), k) for j in range(len(part))]
                some = [j for j, s in enumerate(sets) if len(s)]
                key, bands, sig = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if some:
                    minima = signatures([sets[j] for j in some])
                    keys, low = band_keys(minima), bits(minima)
                    for n, j in enumerate(some):
                        key[j], bands[j], sig[j] = blake2b(sets[j].tobytes(), digest_size=16).digest(), keys[n], low[n]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets], "key": key, "bands": bands, "sig": sig})

    return run


def _confirmed(k: int, percent: int):
    """Rows sorted by (hub, salt, role): a hub's text comes before its leaves' and is kept for them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None
        for pdf in batches:
            linked = []
            for hub, role, leaf, words in zip(pdf["hub"], pdf["role"], pdf["id"], each_text(pdf["text"], lower=True), strict=True):
                s = shingles(words, k)
                if role == 0:
                    at, own = hub, s
                elif at == hub:
                    both = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                    if 100 * both >= percent * (len(s) + len(own) - both):
                        linked.append((hub, leaf))
            yield pd.DataFrame(linked, columns=["u", "v"], dtype="int64")

    return run


def _verified(scratch: Scratch, name: str, pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, test) -> DataFrame:
    """Those of the pairs (hub, leaf) whose full sets are as similar as percent asks."""
    pairs = scratch.keep(pairs, f"{name}-pairs")
    of = lambda c: reps.select(F.col("rep").alias(c), F.struct("sig", "n").alias(f"_{c}"))
    hubs = scratch.keep(pairs.groupBy("hub").agg(F.count("*").alias("leaves"), F.ceil(F.count("*") / GROUP).alias("groups")).join(of("hub"), "hub"), f"{name}-hubs")
    likely = join_keyed(pairs, hubs, "hub", pairs.count(), "leaves").join(of("leaf"), "leaf").where(test.column("_hub", "_leaf"))
    # the leaves of a hub are dealt to groups, and its text goes to those that have one
    likely = scratch.keep(likely.select("hub", "leaf", F.expr("pmod(xxhash64(leaf), groups)").alias("salt")), f"{name}-likely")
    leaves = likely.join(texts, likely["leaf"] == texts["rep"]).select("hub", "salt", F.lit(1).alias("role"), F.col("leaf").alias("id"), "text")
    heads = likely.select("hub", "salt").distinct().join(texts, F.col("hub") == texts["rep"]).select("hub", "salt", F.lit(0).alias("role"), F.col("hub").alias("id"), "text")
    laid = heads.union(leaves).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "id")
    return laid.mapInPandas(_confirmed(k, test.percent), "u long, v long")


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct unordered pairs of (hub, leaf); of a pair seen both ways one stays."""
    return rows.where("hub != leaf").groupBy(F.least("hub", "leaf").alias("a"), F.greatest("hub", "leaf").alias("b")).agg(F.min("hub").alias("hub")).select("hub", F.expr("a + b - hub").alias("leaf"))


def _open(sizes: DataFrame) -> DataFrame:
    """Buckets of several components, from (bucket, component c, its n members): the largest component main and its size most, parts and members n."""
    found = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    return found.where("parts > 1")


def _listed(scratch: Scratch, buckets: DataFrame, members: DataFrame, named: DataFrame, reps: DataFrame, test) -> DataFrame:
    """Pairs (hub, leaf) of the smaller open buckets that sizes and signatures allow."""
    rows = join_keyed(members.select("bucket", "rep"), buckets.select("bucket", "main", "n"), "bucket", members.count()).join(named, "rep")
    rows = scratch.keep(rows.join(reps.select("rep", F.struct("sig", "n").alias("s")), "rep"), "of-small")
    of = lambda c: rows.select("bucket", F.col("rep").alias(c), F.col("c").alias(f"c_{c}"), F.col("main").alias(f"m_{c}"), F.col("s").alias(f"_{c}"))
    # of two members outside the largest component, the smaller id is the hub
    between = F.expr("c_hub != c_leaf and (c_leaf = m_hub or hub < leaf)")
    return _pairs(of("hub").where("c_hub != m_hub").join(of("leaf"), "bucket").where(between & test.column("_hub", "_leaf")).select("hub", "leaf"))


def _grouped(scratch: Scratch, buckets: DataFrame, sizes: DataFrame, members: DataFrame, named: DataFrame) -> DataFrame:
    """rep, c and family for the larger open buckets.

    Buckets that share components belong together. Their components' documents are one family, or
    each bucket is one with its members alone, if that makes fewer rows of cells.
    """
    cells = F.expr(f"n * ceil((n - most) / {BLOCK})").alias("rows")
    edges = join_keyed(sizes.select("bucket", "c"), buckets.select("bucket", "main", "parts"), "bucket", sizes.count(), "parts").where("c != main")
    near = connected_components(scratch.spark, edges.select(F.col("c").alias("u"), F.col("main").alias("v")), "families", scratch=scratch).distinct()
    known = scratch.keep(named.groupBy("c").agg(F.count("*").alias("n")).join(near.select(F.col("node").alias("c"), "component"), "c"), "family-of")
    whole = known.groupBy("component").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("parts")).select("component", cells, "parts")
    placed = scratch.keep(buckets.join(known.select(F.col("c").alias("main"), "component"), "main").select("component", "bucket", "n", cells), "placed")
    apart = placed.groupBy("component").agg(F.sum("rows").alias("apart"), F.count("*").alias("buckets"))
    how = scratch.keep(whole.join(apart, "component").select("component", "parts", "buckets", (F.col("apart") < F.col("rows")).alias("split")), "how")
    families = scratch.keep(join_keyed(known, how.drop("buckets"), "component", known.count(), "parts").where("not split").select("c", "n", F.col("component").alias("family")), "whole")
    alone = scratch.keep(join_keyed(placed, how.where("split").select("component", "buckets"), "component", placed.count(), "buckets").select("bucket", "n"), "apart")
    both = join_keyed(named, families, "c", named.count()).select("rep", "c", "family")
    return both.union(join_keyed(members.select("bucket", "rep"), alone, "bucket", members.count()).join(named, "rep").select("rep", "c", F.col("bucket").alias("family")))


def _possible(test):
    """Rows sorted by (family, block, salt, role): those that sizes and signatures let link with another of their cell.

    What a cell holds is cut into subs of HELD rows; a row comes out once for every sub with a possible partner.
    """
    columns = ["family", "block", "salt", "sub", "role", "rep", "c"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, hit, sigs, size, own = None, [], None, None, None, None
        out: list[tuple] = []

        def close():
            if hit is not None:
                out.extend((*at, i // HELD, 0, held[i][0], held[i][1]) for i in np.flatnonzero(hit))

        for pdf in batches:
            sig_of = np.stack(pdf["sig"].to_numpy()).astype(np.int64).view(np.uint64) if len(pdf) else None
            for i, (cell, role, rep, c, n) in enumerate(zip(zip(pdf["family"], pdf["block"], pdf["salt"], strict=True), pdf["role"], pdf["rep"], pdf["c"], pdf["n"], strict=True)):
                if cell != at:
                    close()
                    at, held, hit = cell, [], None
                if role == 0:
                    held.append((rep, c, n, sig_of[i]))
                    continue
                if not held:
                    continue
                if hit is None:
                    hit, sigs = np.zeros(len(held), bool), np.stack([h[3] for h in held])
                    own, size = np.array([h[1] for h in held]), np.array([h[2] for h in held])
                may = (own != c) & test.array(size, sigs, n, sig_of[i])
                if may.any():
                    hit |= may
                    out.extend((*cell, sub, 1, rep, c) for sub in np.unique(np.flatnonzero(may) // HELD))
            yield pd.DataFrame(out, columns=columns, dtype="int64")
            out.clear()
        close()
        yield pd.DataFrame(out, columns=columns, dtype="int64")

    return run


def _cells(k: int, test):
    """Rows sorted by (family, block, salt, sub, role): the held texts of a cell come before those compared with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, index = None, [], None
        for pdf in batches:
            linked = []
            for cell, role, rep, c, sig, words in zip(zip(pdf["family"], pdf["block"], pdf["salt"], pdf["sub"], strict=True), pdf["role"], pdf["rep"], pdf["c"], pdf["sig"], each_text(pdf["text"], lower=True), strict=True):
                if cell != at:
                    at, held, index = cell, [], None
                sig = np.asarray(sig, np.int64).view(np.uint64)
                if role == 0:
                    held.append((rep, c, sig, shingles(words, k)))
                    continue
                if not held:
                    continue
                if index is None:
                    ids, own = np.array([h[0] for h in held]), np.array([h[1] for h in held])
                    sigs, size = np.stack([h[2] for h in held]), np.array([len(h[3]) for h in held])
                    all_, of = np.concatenate([h[3] for h in held]), np.repeat(np.arange(len(held)), size)
                    order = np.argsort(all_, kind="stable")
                    index = all_[order], of[order]
                s = shingles(words, k)
                may = (own != c) & test.array(size, sigs, len(s), sig)
                if not may.any():
                    continue
                lo, hi = np.searchsorted(index[0], s), np.searchsorted(index[0], s, "right")
                times = hi - lo
                spots = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                both = np.bincount(index[1][spots], minlength=len(ids))
                linked += [(int(x), rep) for x in ids[may & (100 * both >= test.percent * (size + len(s) - both))]]
            yield pd.DataFrame(linked, columns=["u", "v"], dtype="int64")

    return run


def _rest(scratch: Scratch, buckets: DataFrame, sizes: DataFrame, members: DataFrame, named: DataFrame, reps: DataFrame, texts: DataFrame, k: int, test) -> DataFrame:
    """Links between components that share one of the open buckets."""
    few = _verified(scratch, "listed", _listed(scratch, buckets.where(F.col("n") <= LISTED), members, named, reps, test), reps, texts, k, test)
    buckets = buckets.where(F.col("n") > LISTED)
    if buckets.isEmpty():
        return few
    docs = scratch.keep(_grouped(scratch, buckets, sizes, members, named), "families")
    parts = docs.groupBy("family", "c").agg(F.count("*").alias("n"))
    families = parts.groupBy("family").agg(F.max_by("c", F.struct("n", "c")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"))
    families = families.select("family", "largest", "n", F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("blocks"), F.ceil(F.col("n") / GROUP).alias("salts"))
    docs = join_keyed(docs, scratch.keep(families, "cells"), "family", docs.count()).join(reps.select("rep", "sig", F.col("n").alias("n")), "rep")
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    part = lambda c: F.expr(f"pmod(xxhash64(rep), {c})")
    held = docs.where("c != largest").select("family", part("blocks").alias("block"), up_to("salts").alias("salt"), F.lit(0).alias("role"), "rep", "c", "sig", "n")
    seen = docs.select("family", up_to("blocks").alias("block"), part("salts").alias("salt"), F.lit(1).alias("role"), "rep", "c", "sig", "n")
    dealt = lambda rows, *cell: rows.repartition(*cell).sortWithinPartitions(*cell, "role", "rep")
    # sizes and signatures first: only rows with a possible partner in their cell come again, with their texts
    likely = dealt(held.union(seen), "family", "block", "salt").mapInPandas(_possible(test), "family long, block long, salt long, sub long, role int, rep long, c long")
    rows = dealt(scratch.keep(likely, "possible").join(texts.join(reps.select("rep", "sig"), "rep"), "rep"), "family", "block", "salt", "sub")
    return few.union(rows.mapInPandas(_cells(k, test), "u long, v long"))


def _merged(scratch: Scratch, named: DataFrame, links: DataFrame) -> DataFrame:
    """named (rep, component c) after further links (u, v): components are joined, not their documents."""
    end = lambda x: named.select(F.col("rep").alias(x), F.col("c").alias(f"c_{x}"))
    between = links.join(end("u"), "u").join(end("v"), "v").select(F.col("c_u").alias("u"), F.col("c_v").alias("v"))
    joined = connected_components(scratch.spark, between, "cc", scratch=scratch).distinct().withColumnRenamed("node", "c")
    known = named.groupBy("c").agg(F.count("*").alias("n")).join(joined, "c", "left").select("c", "n", F.coalesce("component", "c").alias("to"))
    return join_keyed(named, scratch.keep(known, "joined"), "c", named.count()).select("rep", F.col("to").alias("c"))


DIGESTS = "doc_id long, n_shingles long, key binary, bands array<long>, sig array<long>"


def link(spark: SparkSession, docs: DataFrame, label: str, digests, k: int, test) -> DataFrame:
    """doc_id, n_shingles and component_id of docs' rows; sets are compared if they share a bucket.

    digests maps batches of (doc_id, text) to DIGESTS: bands are a set's buckets, sig is what test
    goes by, key names the set (null: none). Of every two sets of one bucket that could join two
    components, those that test admits are compared in full, by similarity of test.percent.
    """
    scratch = Scratch(spark, label)
    digests = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(digests, DIGESTS), "digests")
    # equal sets have equal bands and signatures
    whole = "key is not null and doc_id is not null"
    reps = scratch.keep(digests.where(whole).groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")), "reps")
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = scratch.keep(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1"), "buckets")
    members = scratch.keep(join_keyed(rows, buckets, "bucket", reps.agg(F.sum(F.size("bands"))).first()[0] or 0), "members")
    texts = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members.select("rep").distinct(), "rep", "left_semi"), "texts")

    first = _pairs(members.select(F.col("low").alias("hub"), F.col("rep").alias("leaf")))
    linked = connected_components(spark, _verified(scratch, "first", first, reps, texts, k, test), "first-cc", scratch=scratch)
    named = reps.select("rep").join(linked.distinct().withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.keep(named.select("rep", F.coalesce("component", "rep").alias("c")), "named")
    sizes = scratch.keep(members.select("bucket", "rep").join(named, "rep").groupBy("bucket", "c").agg(F.count("*").alias("n")), "sizes")
    buckets = scratch.keep(_open(sizes), "open")
    if not buckets.isEmpty():
        links = scratch.keep(_rest(scratch, buckets, sizes, members, named, reps, texts, k, test), "links")
        if not links.isEmpty():
            named = scratch.keep(_merged(scratch, named, links), "merged")
    classes = reps.select("key", "rep", "copies").join(named, "rep").select("key", "copies", F.col("c").alias("component_id"))
    known = join_keyed(digests.where(whole).select("doc_id", "n_shingles", "key"), scratch.keep(classes, "classes"), "key", digests.count(), "copies").drop("key")
    alone = digests.where(f"not ({whole})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = Scratch(spark, f"{label}-result").keep(known.union(alone), "result")
    scratch.drop()
    return out


def find_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text; others ignored).

    Two documents are linked if their shingle sets' similarity is at least percent / 100;
    component_id is the smallest doc_id reachable over links, kept says that it is the row's own.
    A text of fewer than k words is one shingle; null or blank texts have none and link with
    nothing. Texts of any length are read whole; an empty table gives an empty one. Rows with a
    null doc_id link with nothing, have a null component and are kept. Repeated rows give repeated
    results; ids are taken to name one text. The result is a written table; everything else that
    was written is deleted again.
    """
    linked = link(spark, docs, "neardup", _digests(k), k, Minima(percent))
    return linked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, one with the smallest doc_id; rows without an id stay."""
    gone = find_duplicates(spark, docs, k, percent).where("not kept").select("doc_id").distinct()
    # the ids that go have no bound on their number, so they are never broadcast
    left = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*columns_of(docs))
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).union(left.where("doc_id is null"))
