"""Nearest vectors by an inverted list: cells around centroids, read in the order of a bound.

Centroids are fitted on a bounded sample; every vector belongs to the cell of its nearest one. By
the triangle inequality a cell of radius r around c holds nothing nearer to q than |q - c| - r. A
search first reads the cells with the least bounds until they hold enough vectors; the k-th
distance found there then says which other cells could hold something nearer, and those are read
as well (exact), or not (approximate).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.operators.retrieval import QUERY_BLOCK, Nearest, held_queries, matrix, names_of, query_blocks, ranked_by_distance, squared_distances
from stackwright.sources.scratch import Scratch

#: Vectors that centroids are fitted on at most, and the most cells there can be.
SAMPLE, MOST_CELLS = 20_000, 2048
#: Slack for distances that come from sums of floats.
SLACK = 1e-9


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means on a sample, from distinct rows; a cell that has lost all its rows moves to the row that is worst off."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    at = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        d = squared_distances(x, at)
        own, far = d.argmin(1), d.min(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(at))
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
        empty = np.flatnonzero(n == 0)
        new[empty] = x[np.argsort(-far)[: len(empty)]]
        if np.allclose(new, at, atol=1e-7):
            break
        at = new
    return at


def _found_by(x: np.ndarray, at: np.ndarray, queries: int = 256, k: int = 10) -> list[float]:
    """The share of some of the rows' k nearest others that the first 1, 2, ... cells hold."""
    q, own = x[:queries], squared_distances(x, at).argmin(1)
    d = squared_distances(q, x)
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(squared_distances(q, at), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(place, own[near], axis=1).ravel()
    return [1.0] * len(at) if not len(ranks) else (np.cumsum(np.bincount(ranks, minlength=len(at))) / len(ranks)).tolist()


class VectorIndex:
    """An inverted list under a path: lists (cell, id, embedding and filter columns, a folder a cell) and cells (cell, centroid, radius, n)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, filters: Sequence[str] = ()) -> VectorIndex:
        """Writes the index of vectors (id, embedding; null vectors are left out).

        The sample is that of the least hashes of their ids, at most ``sample`` vectors; cells is by
        default the root of the number of vectors. A large cell is written as several files.
        """
        spark, path = vectors.sparkSession, path.rstrip("/")
        rows = vectors.where("embedding is not null").select("id", "embedding", *filters)
        own = rows.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).collect()
        if cells is None:
            cells = int(rows.count() ** 0.5)
        at = fit_centroids(np.array([r[0] for r in own], np.float64), max(1, min(cells, MOST_CELLS))) if own else np.zeros((0, 1))
        held = spark.sparkContext.broadcast(at)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    d = squared_distances(matrix(pdf["embedding"]), held.value)
                    pdf = pdf.assign(cell=d.argmin(1).astype(np.int32), away=np.sqrt(np.maximum(d.min(1), 0)))
                    yield pdf

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        laid = rows.mapInPandas(assign, f"{kinds}, cell int, away double")
        # one file for small cells, several for those that hold much
        laid.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/lists")
        lists = spark.read.parquet(f"{path}/lists") if own else spark.createDataFrame([], f"{kinds}, away double, cell int")
        facts = lists.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        centroids = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(at)], "cell int, centroid array<double>")
        centroids.join(facts, "cell").coalesce(1).write.parquet(f"{path}/cells")
        shares = list(enumerate(_found_by(np.array([r[0] for r in own], np.float64), at), 1)) if own else []
        spark.createDataFrame(shares, "probes int, share double").coalesce(1).write.parquet(f"{path}/probes")
        return cls(spark, path)

    def probes_for(self, recall: float = 0.95) -> int:
        """How many cells a search should probe for about this recall of 10 neighbours, as measured within the sample when the index was built."""
        rows = self.spark.read.parquet(f"{self.path}/probes").where(F.col("share") >= recall)
        return rows.agg(F.min("probes")).first()[0] or max(1, len(self.cells[0]))

    @cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centroids, radii and sizes of the cells, of which there are at most MOST_CELLS."""
        rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        return np.array([r["cell"] for r in rows], np.int64), np.array([r["centroid"] for r in rows], np.float64), np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows], np.int64)

    def _read(self, held, probes: list[tuple[int, np.ndarray]], k: int, keys: Sequence[str], filters: Sequence[str], schema: str) -> DataFrame:
        """The k nearest in each task of the queries that probe a cell; only files of probed cells are opened."""
        by_cell = self.spark.sparkContext.broadcast(dict(probes))
        lists = self.spark.read.parquet(f"{self.path}/lists").where(F.col("cell").isin([c for c, _ in probes]))

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, names, wants = held.value
            best = Nearest(len(q), k)
            for pdf in batches:
                for cell, part in pdf.groupby("cell", sort=False):
                    x, ids, asked = matrix(part["embedding"]), names_of(part["id"]), by_cell.value[cell]
                    for a in range(0, len(asked), QUERY_BLOCK):
                        own = asked[a : a + QUERY_BLOCK]
                        d = squared_distances(q[own], x)
                        for j, i in enumerate(own):
                            for f, v in zip(filters, wants[i], strict=True):
                                if v is not None:
                                    d[j, part[f].to_numpy() != v] = np.inf
                        best.add(own, d, ids, q[own], x)
            yield pd.DataFrame([(*names[n], i, d, n) for n, i, d in best.rows()], columns=[*keys, "id", "distance", "_n"])

        return lists.select("cell", "id", "embedding", *filters).mapInPandas(local, f"{schema}, _n int")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, filters: Sequence[str] = (), keys: Sequence[str] = ("query_id",)) -> DataFrame:
        """keys, id, distance (squared L2) and rank of the k nearest; see retrieval.vector_topk for queries and filters.

        Without probes the result is exact, in two reads: of the cells with the least bounds that
        hold k vectors, then of all others whose bound is within the k-th distance. With probes only
        so many cells with the nearest centroids are read. Queries go through the driver in blocks.
        """
        keys, filters = list(keys), list(filters)
        wanted = queries.where("embedding is not null").select(*keys, "embedding", *filters)
        numbers, centroids, radii, sizes = self.cells
        ids = self.spark.read.parquet(f"{self.path}/lists").schema["id"].dataType.simpleString() if len(numbers) else "string"
        schema = ", ".join([f"{c} {wanted.schema[c].dataType.simpleString()}" for c in keys] + [f"id {ids}", "distance double"])
        scratch, found = Scratch(self.spark, "vector-index"), []
        for n, block in enumerate(query_blocks(wanted) if len(numbers) else []):
            q, *rest = held_queries(block, keys)
            held = self.spark.sparkContext.broadcast((q, *rest))
            away = np.sqrt(np.maximum(squared_distances(q, centroids), 0))
            bound = np.maximum(away - radii - SLACK, 0)
            order = np.argsort(away if probes else bound + away * 1e-6, axis=1, kind="stable")
            enough = np.cumsum(sizes[order], axis=1) - sizes[order] < k
            first = np.zeros(away.shape, bool)
            np.put_along_axis(first, order, np.arange(len(numbers)) < probes if probes else enough, axis=1)
            rows = scratch.keep(self._read(held, _by_cell(numbers, first), k, keys, filters, schema), f"first{n}")
            if not probes:
                # with filters fewer than k may be found: then nothing bounds the rest
                edges = ranked_by_distance(rows, keys, k).groupBy("_n").agg(F.count("*").alias("n"), F.max("distance").alias("d")).where(F.col("n") >= k).collect()
                edge = np.full(len(q), np.inf)
                for r in edges:
                    edge[r["_n"]] = r["d"]
                more = ~first & (bound <= np.sqrt(np.maximum(edge, 0))[:, None] + SLACK)
                if more.any():
                    rows = rows.unionByName(scratch.keep(self._read(held, _by_cell(numbers, more), k, keys, filters, schema), f"rest{n}"))
            found.append(rows)
            held.destroy()
        out = self.spark.createDataFrame([], f"{schema}, _n int") if not found else found[0]
        for more_rows in found[1:]:
            out = out.unionByName(more_rows)
        return ranked_by_distance(out.drop("_n"), keys, k)


def _by_cell(numbers: np.ndarray, wanted: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each cell that any query wants, those queries."""
    return [(int(numbers[c]), np.flatnonzero(wanted[:, c])) for c in np.flatnonzero(wanted.any(0))]


def recall(found: DataFrame, exact: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """keys, hits (how many of the exact neighbours were found) and wanted (how many there are)."""
    hit = exact.join(found.select(*keys, "id", F.lit(1).alias("_hit")), [*keys, "id"], "left")
    return hit.groupBy(*keys).agg(F.count("_hit").alias("hits"), F.count("*").alias("wanted"))
