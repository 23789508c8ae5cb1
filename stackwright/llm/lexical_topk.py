"""Ranked lexical search as a maximum inner product search over norm buckets.

A document's impact vector has, for each asked term t, x_t = (10^9 tf) div (1000 tf + 8 m), where m
grows with the document's length; an item's query vector has the terms' weights w_t. The score is
the sum of w_t x_t, in integers. For the bounds, half of each weight goes to either side:
p_t = sqrt(w_t) x_t and q_t = sqrt(w_t), so a document that holds what is asked, and each term
about as often, is nearly parallel to its query. Coordinates that no item asks for add nothing to
any score and are left out of the vectors.

Each task takes its documents in order of length |p| and cuts them into buckets. A query whose best
k so far all score at least E passes over a bucket if |q| times its longest vector is less than E
(Cauchy-Schwarz), and over all later buckets with it. Inside a bucket a document survives if the
exact part on the query's heaviest coordinates plus |q| |p| of the rest can reach E. Survivors are
rescored exactly, in 64-bit integers. E starts from the documents with the longest vectors of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackwright.llm.common import slices
from stackwright.llm.textbatch import NOT_ALNUM, Words
from stackwright.sources.scratch import Scratch

#: Characters of item text that are asked for at once; what each task holds is in proportion to it.
BLOCK_CHARS = 1_000_000
#: Documents of a bucket, and of the longest vectors that set the first edges.
BUCKET, FIRST = 512, 4096
#: The share of a query's squared length that its heaviest coordinates hold, for the bound inside a bucket.
HEAVY = 0.6
#: Pairs of a posting and a query that are held at once.
PAIRS = 4_000_000


@dataclass
class Asked:
    """A block of items: what they ask for, as rows of a query and a term (an index into vocabulary)."""

    vocabulary: np.ndarray  # sorted hashes of terms
    query: np.ndarray  # sorted by term, then query
    term: np.ndarray
    n: int
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each term
    edge: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each query: no score below it can matter
    k: int = 10

    def prepared(self) -> Asked:
        """With what bounds need: each query's length, and the rows that are among its heaviest coordinates."""
        self.from_, w = np.searchsorted(self.term, np.arange(len(self.vocabulary) + 1)), self.weight[self.term].astype(np.float64)
        self.square = np.bincount(self.query, w, self.n)
        order = np.lexsort((self.term, -w, self.query))
        before = np.cumsum(w[order]) - w[order]
        first = np.searchsorted(self.query[order], np.arange(self.n))
        before -= before[np.minimum(first, max(len(order) - 1, 0))][self.query[order]] if len(order) else 0
        heavy = np.zeros(len(order), bool)
        heavy[order] = before < HEAVY * self.square[self.query[order]]
        self.heavy_query, self.heavy_from = self.query[heavy], np.searchsorted(self.term[heavy], np.arange(len(self.vocabulary) + 1))
        self.rest = np.sqrt(np.maximum(self.square - np.bincount(self.heavy_query, w[heavy], self.n), 0))
        return self


def _pairs(terms: np.ndarray, from_: np.ndarray, query: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For postings of the given terms: places of postings and the queries that ask for their terms, some at a time."""
    times = from_[terms + 1] - from_[terms]
    ends, first = np.cumsum(times), 0
    while first < len(terms):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        t = times[first:last]
        place = np.repeat(np.arange(first, last), t)
        yield place, query[np.repeat(from_[terms[first:last]], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)]
        first = last


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 ln((2 n + 2) / (2 df + 1))), in doubles."""
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)


class Best:
    """The k best documents of each query so far, by score, then by doc_id (those without one last)."""

    def __init__(self, asked: Asked):
        self.k, self.edge = asked.k, np.maximum(asked.edge, 1)
        self.score = [np.zeros(0, np.int64) for _ in range(asked.n)]
        self.doc = [np.zeros(0, np.int64) for _ in range(asked.n)]

    def add(self, query: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score[query], score]), np.concatenate([self.doc[query], doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score[query], self.doc[query] = score[order], doc[order]
        if len(order) == self.k:
            self.edge[query] = max(self.edge[query], score[order[-1]])


#: Stands for a null doc_id, so that it comes last.
NO_ID = np.iinfo(np.int64).max


def search_bucket(asked: Asked, best: Best, docs: np.ndarray, row: np.ndarray, term: np.ndarray, x: np.ndarray, norm: np.ndarray) -> tuple[int, int]:
    """Adds a bucket's documents to the best; postings are (row, term, impact x). Returns how many queries and pairs were looked into."""
    close = np.sqrt(asked.square) * norm.max(initial=0) * (1 + 1e-9) + 1 >= best.edge  # Cauchy-Schwarz
    if not close.any():
        return 0, 0
    n, w = len(docs), asked.weight[term].astype(np.float64)
    dot, held = np.zeros(n * asked.n), np.zeros(n * asked.n)
    for place, query in _pairs(term, asked.heavy_from, asked.heavy_query):
        cell = row[place] * asked.n + query
        dot += np.bincount(cell, (w * x)[place], n * asked.n)
        held += np.bincount(cell, (w * x * x)[place], n * asked.n)
    rest = np.sqrt(np.maximum(norm[:, None] ** 2 - held.reshape(n, -1), 0))
    bound = (dot.reshape(n, -1) + asked.rest * rest) * (1 + 1e-9) + 1
    alive = close & (bound >= best.edge)
    rows = np.flatnonzero(alive.any(1))
    if not len(rows):
        return int(close.sum()), 0
    kept = alive.any(1)[row]
    row, term, value = row[kept], term[kept], (asked.weight[term] * x)[kept]
    score = np.zeros(n * asked.n, np.int64)
    for place, query in _pairs(term, asked.from_, asked.query):
        np.add.at(score, row[place] * asked.n + query, value[place])
    score = np.where(alive, score.reshape(n, -1), 0)
    for q in np.flatnonzero((score >= best.edge).any(0)):
        at = np.flatnonzero(score[:, q] >= best.edge[q])
        best.add(q, score[at, q], docs[at])
    return int(close.sum()), int(alive.sum())


def _search(held):
    """Rows (doc, norm, terms, xs) in order of norm, the largest first: each task's k best of every query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = held.value.prepared()
        best = Best(asked)
        for pdf in batches:
            norm = pdf["norm"].to_numpy()
            if len(norm) and not (np.sqrt(asked.square) * norm[0] * (1 + 1e-9) + 1 >= best.edge).any():
                continue  # nor can any later one
            for a in range(0, len(pdf), BUCKET):
                part = pdf.iloc[a : a + BUCKET]
                row = np.repeat(np.arange(len(part)), part["terms"].map(len))
                search_bucket(asked, best, part["doc"].to_numpy(), row, np.concatenate(part["terms"].to_numpy()), np.concatenate(part["xs"].to_numpy()), norm[a : a + BUCKET])
        out = [(q, s, d) for q in range(asked.n) for s, d in zip(best.score[q].tolist(), best.doc[q].tolist(), strict=True)]
        yield pd.DataFrame(out, columns=["query", "score", "doc"], dtype="int64")

    return run


HITS = "query int, score long, doc long"


def _postings(held):
    """Each text's number of terms n, and of the asked ones index and tf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = held.value
        for pdf in batches:
            for run_ in slices(pdf["text"]):
                part = pdf.iloc[run_]
                w = Words(part["text"], lower=True, between=NOT_ALNUM)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), max(len(vocabulary) - 1, 0))
                known = np.flatnonzero(vocabulary[at] == w.hash) if len(vocabulary) else np.zeros(0, np.int64)
                text = np.searchsorted(w.first, known, "right") - 1
                cell, tf = np.unique(text * max(len(vocabulary), 1) + at[known], return_counts=True)
                cut = np.searchsorted(cell, np.arange(1, len(part)) * max(len(vocabulary), 1))
                terms = np.split((cell % max(len(vocabulary), 1)).astype(np.int32), cut)
                yield pd.DataFrame({"doc": part["doc_id"], "n": np.diff(w.first), "terms": terms, "tfs": np.split(tf, cut)})

    return run


def _impacts(held, n: int, words: int):
    """Rows of documents with the impacts of their terms and the length of p."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = held.value
        for pdf in batches:
            if not len(pdf):
                continue
            size = pdf["terms"].map(len).to_numpy()
            tf, term = np.concatenate(pdf["tfs"].to_numpy()).astype(np.int64), np.concatenate(pdf["terms"].to_numpy())
            m = np.repeat(100 - 90 + (90 * pdf["n"].to_numpy() * n) // words, size)
            x = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
            at = np.cumsum(size) - size
            norm = np.sqrt(np.add.reduceat(weight[term] * x.astype(np.float64) ** 2, at))
            yield pd.DataFrame({"doc": pdf["doc"], "norm": norm, "terms": pdf["terms"], "xs": np.split(x, at[1:])})

    return run


def blocks(items: DataFrame) -> Iterator[tuple[list, Asked]]:
    """The items in blocks: their ids, and what they ask for. Only one block's texts are on the driver at a time."""
    ids, texts, chars = [], [], 0

    def close() -> tuple[list, Asked]:
        w = Words(texts, lower=True, between=NOT_ALNUM)
        query = np.repeat(np.arange(len(w)), np.diff(w.first))
        vocabulary, term = np.unique(w.hash, return_inverse=True)
        pair = np.unique(term.astype(np.int64) * max(len(w), 1) + query)
        return ids, Asked(vocabulary, pair % max(len(w), 1), pair // max(len(w), 1), len(w))

    for r in items.select("item_id", "text").toLocalIterator():
        if ids and chars + len(r["text"] or "") > BLOCK_CHARS:
            yield close()
            ids, texts, chars = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        chars += len(r["text"] or "") + 8
    if ids:
        yield close()


def _longest(vectors: DataFrame, n: int | None = None) -> DataFrame:
    """About n of the rows with the greatest norms, left where they are: whole bins of norms, and of the last bin a part by hash."""
    n, bin_ = n or FIRST, F.floor(F.log2(F.col("norm") + 1) * 16)
    counts = sorted(((r["b"], r["n"]) for r in vectors.groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most some hundred bins
    above = 0
    for b, own in counts:
        if above + own >= n:
            part = int(1_000_000 * (n - above) / own) + 1
            return vectors.where((bin_ > b) | ((bin_ == b) & (F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < part)))
        above += own
    return vectors


def _one_block(spark: SparkSession, scratch: Scratch, name: str, docs: DataFrame, ids: list, asked: Asked, k: int, stats: tuple[int, int] | None) -> tuple[DataFrame, tuple[int, int]]:
    sc = spark.sparkContext
    asked.k = k
    found = docs.mapInPandas(_postings(sc.broadcast(asked.vocabulary)), "doc long, n long, terms array<int>, tfs array<long>").where("n > 0")
    found = scratch.keep(found, f"{name}-postings")
    n, words = stats or found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(asked.vocabulary), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
        df[r["t"]] = r["df"]
    asked.weight, asked.edge = weights(df, n), np.zeros(asked.n, np.int64)
    vectors = found.where("size(terms) > 0").mapInPandas(_impacts(sc.broadcast(asked.weight), n, max(words, 1)), "doc long, norm double, terms array<int>, xs array<long>")
    vectors = scratch.keep(vectors, f"{name}-vectors")
    # the first edges, from about FIRST of the longest vectors of all, wherever they are
    first = _longest(vectors).sortWithinPartitions(F.desc("norm")).mapInPandas(_search(sc.broadcast(asked)), HITS)
    kth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    edges = first.withColumn("r", kth).where(F.col("r") == k).select("query", F.col("score").alias("edge")).collect()
    for r in edges:
        asked.edge[r["query"]] = r["edge"]
    hits = vectors.sortWithinPartitions(F.desc("norm")).mapInPandas(_search(sc.broadcast(asked)), HITS)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    named = spark.createDataFrame(list(enumerate(ids)), "query int, item_id long")
    top = hits.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(named), "query")
    top = scratch.keep(top.select("item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score"), f"{name}-top")
    scratch.drop(f"{name}-postings", f"{name}-vectors")
    return top, (n, words)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (doc_id, text) of each item (item_id, text).

    Terms are compared by 64-bit hashes. Scores are above 0, equal ones rank by ascending doc_id,
    rows without a doc_id last; equal documents under several ids, and repeated rows, rank each.
    Items without a term or a match, null ones among them, have no row; a repeated row of items is
    an item of its own, with the same id. Texts of any length are read whole; null or empty ones
    have no term. Without documents or items there are no rows. Other columns are not read.

    Items pass through the driver in blocks of BLOCK_CHARS; each block is a scan of the texts. What
    a task holds is a bucket of BUCKET rows and k results a query. The result is a written table.
    """
    scratch, out, stats = Scratch(spark, "lexical"), None, None
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    for i, (ids, asked) in enumerate(blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text"))):
        top, stats = _one_block(spark, scratch, f"block{i}", docs, ids, asked, k, stats)
        out = top if out is None else out.unionByName(top)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
