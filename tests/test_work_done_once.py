"""What large tables ask for: work that is done once, and rows that are counted before they are shuffled."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.functions import segment as G
from stackwright.functions import text as X
from stackwright.operators import line_scan as L
from stackwright.operators import retrieval as S
from stackwright.plans import fixtures as D
from stackwright.plans import registry as P
from stackwright.sources.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "b a  b_2\tA 微服务x", None, "s", 3), (1, "a c", None, "s", 3), (2, None, None, "s", 0), (3, "", None, "s", 0), (None, "a a", None, "s", 1), (4, "# t\n\n# t\nx  \n", None, "t", 9), (5, "的一在的一在的一", None, "t", 8)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(ROWS, DOCS).coalesce(2).write.parquet(f"{at}/documents.parquet")
    return str(at)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokenize_counts_repeated_and_null_sources(spark, sf):
    rows = D.kb_docs(spark, sf).select("source", F.explode(X.tokenize("text")).alias("token"))
    want = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("source").alias("docs"))
    got = P.tokenize(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema.simpleString() == want.schema.simpleString()
    # sources go along with tokens only if they are in several rows
    assert "again" in _plan(got) and re.search(r"CASE WHEN again#\d+ THEN source", _plan(got))


def test_grams_are_counted_in_runs_of_texts(spark):
    texts = ["的一在的一在x的", None, "", "鿿一\n一一一一一", "plain", "一𠀀一a一"] * 5
    want = Counter()
    for t in texts:
        for run in re.findall("[一-鿿]+", t or ""):
            want.update(run[i : i + n] for n in range(1, 5) for i in range(len(run) - n + 1))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = Counter()
    for w, n in docs.mapInPandas(G._grams, "word string, n long").collect():
        got[w] += n
    assert got == want


def test_checked_docs_shuffle_nothing(spark, sf):
    docs = D.checked_docs(spark, sf)
    assert "Exchange" not in _plan(docs) and docs.count() == len(ROWS)


def test_long_texts_do_not_go_to_the_scan_of_short_ones(spark):
    docs = spark.createDataFrame([("a", "x\n\n\n\n\n" * 3), ("b", "y\n\n\n\n" * 50), ("c", None)], "file_path string, text string")
    scan = L.Scan({"typo": "t", "format": "f", "structure": "s", "readability": "r"}, 2, 400)
    whole = sorted(map(tuple, L.neighbour_issues(docs, scan).collect()))
    assert whole and sorted(map(tuple, L.neighbour_issues(docs, scan, whole=50, block=7).collect())) == whole


def test_markup_of_plain_lines(spark):
    lines = ["plain", "a - b # c 1. d > e", "`x` y", "# h", "- i", "+ i", "12. n", "> q", "![a](b)", "[a](b)", "*a* b", "_a_", "", None, "**# x**", "3.5 m"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    plain = F.col("line")
    for pattern, to in X._MARKUP:
        plain = F.regexp_replace(plain, pattern, to)
    assert df.where(~X.strip_inline_markup("line").eqNullSafe(plain)).count() == 0


def test_texts_are_cleaned_and_made_unique_as_before(spark):
    texts = [" a  b\t c　　d \n", "a b", "", None, " ", "x y", "Ab aB AB ab The the 微服务 微服务 __ b_"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert df.where(~X.clean_text("t").eqNullSafe(X.strip(F.regexp_replace("t", f"[{X.WS}]+", " ")))).count() == 0
    got = df.select(X.overlap_terms("t", ()).alias("a"), X.overlap_terms("t", (), tokens=X.overlap_tokens("t")).alias("b")).collect()[-1]
    assert got["a"] == got["b"] == ["Ab", "The", "微服务", "b_", "微服", "服务"]


def test_text_functions_cut_a_text_into_tokens_once(spark, sf):
    pattern = "regexp_extract_all(text#"
    assert _plan(P.text_functions(spark, sf)).count(pattern) == _plan(D.kb_docs(spark, sf).select(X.overlap_tokens("text"))).count(pattern)


def test_hybrid_search_embeds_chunks_once_and_leaves_them_where_they_lie(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return P.hashed_vectors(texts)

    rows = [(f"i{n}", f"w{n} w{n % 7} w{n % 5}", f"s{n}", n) for n in range(200)]
    chunks = spark.createDataFrame(rows, "id string, content string, source string, chunk_index int")
    for f in ("version", "department", "doc_type", "owner", "effective_date", "doc_id", "confidentiality", "product_line", "model_type", "module"):
        chunks = chunks.withColumn(f, F.lit(""))
    variants = S.embed(spark.createDataFrame([(1, 0, "w3 w4"), (2, 0, "w6 w9")], "query_id long, variant_idx int, variant string"), P.hashed_vectors, "variant")
    got = S.retrieve_hybrid(variants, chunks, S.embed(chunks.select("id", "content"), model).select("id", "embedding"), 5)
    assert got.count() == 150 and seen.value == 200


def test_nearest_keeps_the_best_whatever_comes_first():
    rng = np.random.default_rng(5)
    d = np.round(rng.random((3, 900)), 2)
    d[1, ::3] = np.inf
    ids = rng.permutation(900)
    for parts in ([900], [3, 897], [50] * 18):
        best, at = S.Nearest(3, 8), 0
        for n in parts:
            best.add(np.arange(3), d[:, at : at + n].copy(), ids[at : at + n])
            at += n
        got = [[] for _ in range(3)]
        for q, i, x in best.rows():
            got[q].append((x, int(i)))
        assert [sorted(g) for g in got] == [sorted((x, int(i)) for x, i in zip(r, ids, strict=True) if np.isfinite(x))[:8] for r in d]


def test_many_hits_meet_the_same_chunks(spark, monkeypatch):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "gone", 2)], "query_id long, id string, rank int")
    chunks = spark.createDataFrame([("a", "x", "s"), ("b", None, "t"), ("c", "z", "t")], "id string, content string, source string")
    few = S.with_chunks(hits, chunks)
    monkeypatch.setattr(S, "HITS_AT_ONCE", 3)
    many = S.with_chunks(hits, chunks)
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) and few.count() == 3
    assert few.columns == ["id", "query_id", "rank", "content", "source"]
    assert S.with_chunks(hits.limit(0), chunks).count() == 0


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("asked")
    docs = [(i, f"alpha beta {i}\n\ngamma delta {i % 3}\nalpha gamma", None, "s", 9) for i in range(12)] + [(20, None, None, "s", 0), (21, " \n", None, "s", 0)]
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, "gamma delta 2"), (1, "beta 7"), (2, "nowhere"), (3, None)], "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["passage_sources", "pass_rate_summary", "report", "candidate_pool", "retrieve_text", "retrieve_with_metadata", "rerank_texts", "rerank_bonus", "rerank_with_scores", "critique_evidence", "build_retry_query"])
def test_hits_meet_chunks_where_these_lie(spark, asked, monkeypatch, name):
    plans, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, label: plans.append(_plan(df)) or keep(self, df, label))
    # a session that broadcasts nothing by itself
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = P.queries()[name](spark, asked)
        plans.append(_plan(got))
        assert got.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any(re.search(r"hashpartitioning\(id#", p) for p in plans)
