import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.operators import retrieval as R
from stackwright.operators.vector_index import VectorIndex, fit_centroids, recall
from stackwright.sources.scratch import Scratch

ROWS = "id long, embedding array<float>, label int"


def _vectors(rng, n=900, dim=8, groups=12):
    centres = rng.normal(size=(groups, dim)) * 4
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.3
    x[: n // 3] = x[0]  # a third are equal
    return [(i, v.astype(np.float32).tolist(), int(i % 3)) for i, v in enumerate(x)] + [(n, None, 0)]


def _brute(rows, queries, k, label=None):
    out = set()
    for q, v in queries:
        d = sorted((round(float(((np.array(x, np.float64) - np.array(v, np.float64)) ** 2).sum()), 9), i) for i, x, g in rows if x is not None and (label is None or g == label))
        out |= {(q, i, r) for r, (_, i) in enumerate(d[:k], 1)}
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows = _vectors(np.random.default_rng(2))
    df = spark.createDataFrame(rows, ROWS)
    path = Scratch(spark, "ivf").path("index")
    return rows, df, VectorIndex.build(df, path, cells=16, filters=("label",)), path


def _queries(spark, rows, label=None):
    own = [(i, rows[i][1]) for i in (0, 5, 400, 500, 601, 777, 899)]
    df = spark.createDataFrame(own + [(9999, None)], "query_id long, embedding array<float>")
    return own, df if label is None else df.withColumn("label", F.lit(label))


def test_exact_search_equals_brute_force(spark, made):
    rows, df, index, _ = made
    own, q = _queries(spark, rows)
    got = {(r["query_id"], r["id"], r["rank"]) for r in index.search(q, 10).collect()}
    assert got == _brute(rows, own, 10)
    assert got == {(r["query_id"], r["id"], r["rank"]) for r in R.vector_topk(q, df, 10).collect()}


def test_filters(spark, made):
    rows, df, index, _ = made
    own, q = _queries(spark, rows, 1)
    want = _brute(rows, own, 10, 1)
    assert {(r["query_id"], r["id"], r["rank"]) for r in index.search(q, 10, filters=("label",)).collect()} == want
    assert {(r["query_id"], r["id"], r["rank"]) for r in R.vector_topk(q, df, 10, ("label",)).collect()} == want


def test_only_needed_cells_are_read(spark, made, monkeypatch):
    rows, _, index, _ = made
    _, q = _queries(spark, rows)
    read, real = [], VectorIndex._read

    def noting(self, held, probes, *more):
        read.append({c for c, _ in probes})
        return real(self, held, probes, *more)

    monkeypatch.setattr(VectorIndex, "_read", noting)
    index.search(q.where("query_id = 500"), 10).collect()
    assert len(set().union(*read)) < len(index.cells[0]) / 2
    plan = spark.read.parquet(f"{index.path}/lists").where(F.col("cell").isin(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_approximate_search_and_its_recall(spark, made):
    rows, df, index, _ = made
    _, q = _queries(spark, rows)
    r = recall(index.search(q, 10, probes=index.probes_for()), R.vector_topk(q, df, 10)).agg(F.sum("hits") / F.sum("wanted")).first()[0]
    assert r >= 0.9 and 1 <= index.probes_for(0.5) <= index.probes_for() <= len(index.cells[0])


def test_recall_without_groups(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(800, 24)).astype(np.float32))], ROWS)
    index = VectorIndex.build(df, Scratch(spark, "ivf").path("flat"))
    q = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    assert recall(index.search(q, 10, probes=index.probes_for()), R.vector_topk(q, df, 10)).agg(F.sum("hits") / F.sum("wanted")).first()[0] >= 0.9


def test_several_blocks_of_queries(spark, made, monkeypatch):
    rows, _, index, _ = made
    own, q = _queries(spark, rows)
    monkeypatch.setattr(R, "QUERIES_A_PASS", 3)
    assert {(r["query_id"], r["id"], r["rank"]) for r in index.search(q, 10).collect()} == _brute(rows, own, 10)


def test_empty_and_small(spark):
    empty = VectorIndex.build(spark.createDataFrame([], ROWS), Scratch(spark, "ivf").path("none"))
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    assert empty.search(q, 3).count() == 0
    two = VectorIndex.build(spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [3.0, 4.0], 0)], ROWS), Scratch(spark, "ivf").path("two"))
    assert [(r["id"], r["distance"]) for r in two.search(q, 5).orderBy("rank").collect()] == [(1, 5.0), (2, 8.0)]
    assert two.search(q.limit(0), 5).count() == 0


def test_ties_take_the_least_ids_of_any_type():
    best = R.Nearest(2, 3)
    for ids in (["q", "c"], ["bbbb", "a", "z"]):
        best.add(np.array([0, 1]), np.zeros((2, len(ids))), np.array(ids))
    assert [r[1] for r in best.rows() if r[0] == 1] == ["a", "bbbb", "c"]


def test_centroids_of_few_distinct_rows():
    x = np.array([[0.0, 1.0]] * 50 + [[5.0, 5.0]])
    assert sorted(fit_centroids(x, 4).tolist()) == [[0.0, 1.0], [5.0, 5.0]]
