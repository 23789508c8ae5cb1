import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.operators import evaluation as E
from stackwright.operators import rerank as R
from stackwright.operators import retrieval as S


def test_vector_topk_with_filters_and_passes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist(), "ab"[i % 2]) for i, r in enumerate(x)], "id long, embedding array<float>, kind string").repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist(), "a" if i % 3 == 0 else None) for i in range(20)], "query_id long, embedding array<float>, kind string")
    monkeypatch.setattr(S, "QUERIES_A_PASS", 7)
    got = {}
    for r in S.vector_topk(q, v, 5, ("kind",)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for i in range(20):
        d = ((x.astype(float) - x[i]) ** 2).sum(1)
        ids = [j for j in np.argsort(d, kind="stable") if i % 3 or j % 2 == 0][:5]
        assert [b for _, b in sorted(got[i])] == ids


def test_the_driver_holds_one_block_of_queries(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, embedding array<float>")
    q = spark.createDataFrame([(i, [i + 0.1, 1.0] if i != 5 else None) for i in range(20)], "query_id long, embedding array<float>").repartition(3)
    held, whole = [], type(q).toLocalIterator

    def counted(self, *args, **kwargs):
        rows = list(whole(self, *args, **kwargs))
        held.append(len(rows))
        return iter(rows)

    monkeypatch.setattr(type(q), "toLocalIterator", counted)
    monkeypatch.setattr(S, "QUERIES_A_PASS", 7)
    got = {r["query_id"]: r["id"] for r in S.vector_topk(q, v, 1).collect()}
    assert got == {i: i for i in range(20) if i != 5}
    assert held == [7, 7, 5]
    assert S.vector_topk(q.limit(0), v, 1).count() == 0


def test_bm25_in_a_pool(spark):
    docs = ["a b b", "a c", "a d e f"]
    pool = spark.createDataFrame([(1, str(i), t, i + 1) for i, t in enumerate(docs)], "query_id long, id string, content string, vector_rank int")
    got = {r["id"]: r["bm25"] for r in S.bm25_rank(pool, spark.createDataFrame([(1, "a b b")], "query_id long, variant string")).collect()}
    toks = [t.split() for t in docs]
    df = {w: sum(w in t for t in toks) for t in toks for w in t}
    idf = {w: math.log(3 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    for i, t in enumerate(toks):
        want = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / 3)) for w in ("a", "b", "b") if w in t)
        assert got[str(i)] == pytest.approx(want)


def test_bm25_shuffles_the_best_of_each_task_only(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{min(int(x), 30)}" for x in rng.exponential(6, rng.integers(0, 12))) for _ in range(300)] + ["w1 w2"] * 40
    chunks = spark.createDataFrame([(f"c{i:03}", t) for i, t in enumerate(texts)], "id string, content string").repartition(3)
    questions = spark.createDataFrame([(i, f"w{i} w1 w{i + 9} w{i}") for i in range(9)] + [(9, "unknown"), (10, "")], "query_id int, question string")
    index = S.term_counts(chunks).cache()
    toks = [t.split() for t in texts]
    n, avgdl = sum(map(bool, toks)), sum(map(len, toks)) / sum(map(bool, toks))
    df = {w: sum(w in t for t in toks) for t in toks for w in t}
    idf = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    want = []
    for r in questions.collect():
        ask = r["question"].split()
        score = lambda t: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in ask if w in t)
        found = sorted((-round(score(t), 9), f"c{i:03}") for i, t in enumerate(toks) if set(ask) & set(t))
        want += [(r["query_id"], j + 1, i, round(-s, 6)) for j, (s, i) in enumerate(found[:7])]
    got = S.bm25_corpus(questions, index, 7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan
    rows = lambda d: sorted((r["query_id"], r["rank"], r["id"], round(r["bm25"], 6)) for r in d.collect())
    assert rows(got) == sorted(want) == rows(S.bm25_corpus(questions, S.postings(chunks), 7))
    monkeypatch.setattr(S, "TERMS_A_PASS", 8)
    monkeypatch.setattr(S, "CELLS", 20)
    assert rows(S.bm25_corpus(questions, index, 7)) == sorted(want)


EVIDENCE = "source string, doc_id string, version string, model_type string, content string, doc_type string"


@pytest.mark.parametrize(
    ("question", "row", "exact", "model", "kind"),
    [
        ("8D-2025-0091 结论", ("8D报告-2025-0091.md", "", "", "", "", ""), 0.9, 0.0, 0.0),
        ("WPS-3000 x", ("wps-3000.md", "", "", "WPS-3000", "wps-3000", ""), 2.8, 1.0, 0.0),
        ("WPS-3000 x", ("s", "", "", "WPS-3100", "", ""), 0.0, -1.6, 0.0),
        ("测试规范", ("测试规范.md", "", "", "", "", "test_spec"), 0.8, 0.0, 1.2),
        ("测试用例 测试项", ("s", "", "", "", "", "test_case"), 0.0, 0.0, 0.6),
        ("V2.3", ("s", "", "v2.3", "", "aV2.3", ""), 1.0, 0.0, 0.0),
    ],
)
def test_boosts(spark, question, row, exact, model, kind):
    df = spark.createDataFrame([row], EVIDENCE).withColumn("q", F.lit(question))
    from stackwright.functions import text as X

    r = df.select(S.exact_match_boost(X.exact_terms("q")), S.model_match_adjustment("q"), S.doc_type_adjustment("q")).first()
    assert tuple(r) == pytest.approx((exact, model, kind))


def test_variants_are_fused_in_order_of_sight(spark):
    e = spark.createDataFrame([(1, 0, 1, "a", "x"), (1, 0, 2, "b", "y"), (1, 1, 1, "b", "y"), (1, 1, 9, "c", "z")], "query_id long, variant_idx int, rank int, source string, content string").withColumns({"doc_id": F.lit(""), "score": F.lit(0.0)})
    rows = S.fuse_variants(e, 5).orderBy("rank").collect()
    assert [(r["source"], r["score"]) for r in rows] == [("b", round(1.8 / 62 + 1 / 61, 6)), ("a", round(1.8 / 61, 6))]


def test_rerank_and_caps(spark):
    e = spark.createDataFrame([(1, i, "s" if i < 7 else "t", f"word{i}") for i in range(1, 10)], "query_id long, rank int, source string, content string")
    assert [r["rank"] for r in R.dedupe_sources(e, 6).orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6]
    assert [r["content"] for r in R.dedupe_sources(e, 6).orderBy("rank").collect()][-1] == "word7"
    q = spark.createDataFrame([(1, "word9 word8")], "query_id long, question string")
    assert [r["content"] for r in R.rerank(e, q, 2).orderBy("rank").collect()] == ["word8", "word9"]


def test_case_scores(spark):
    cases = spark.createDataFrame([(1, ["a\\b"], ["c"], ["k"], ["z"]), (2, [], [], [], [])], "query_id long, expected_sources array<string>, forbidden_sources array<string>, expected_keywords array<string>, expected_chunk_keywords array<string>")
    evidence = spark.createDataFrame([(1, 1, " a/b ", "zz"), (1, 2, "c", "")], "query_id long, rank int, source string, content string")
    answers = spark.createDataFrame([(1, "k")], "query_id long, answer string")
    rows = {r["query_id"]: r for r in E.score_case(cases, evidence, answers).collect()}
    assert (rows[1]["score"], rows[1]["passed"], rows[1]["top3_excludes_forbidden"]) == (4, False, False)
    assert (rows[2]["score"], rows[2]["passed"]) == (5, True)
    assert tuple(E.pass_rate_summary(E.score_case(cases, evidence, answers)).first()) == (2, 1, 1, 50.0)
    checks = E.retrieval_checks(cases, E.top_sources(evidence, 5)).where("query_id = 2").first()
    assert (checks["top1_hit"], checks["topk_hit"], checks["forbidden_free"]) == (False, False, True)
