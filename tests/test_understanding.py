"""Questions, intents, routes, filters and retries, as rows of one table each."""

import pytest
from pyspark.sql import functions as F

from stackwright.functions import lexicon
from stackwright.operators import rerank as R
from stackwright.operators import understanding as U

QUESTIONS = [
    (1, "WPS-3000 V2.3 更新 内容", "release_note", "kb", ["WPS-3000"], [], "tighten_filter"),
    (2, "VIS-1002 报警怎么处理", "fault_case", "kb", [], ["VIS-1002"], "exact_match_boost"),
    (3, "QE-2025-0091 的结论", "quality_event", "kb", [], [], "exact_match_boost"),
    (4, "8D-2025-0091 纠正措施", "8d", "kb", [], [], "exact_match_boost"),
    (5, "WO-2025-0001 现在 状态", "work_order", "web", [], [], "relax_filter"),
    (6, "转接 人工 客服", "general", "manual", [], [], "relax_filter"),
    (7, "统计 工单 数量", "work_order", "sql", [], [], "relax_filter"),
    (8, "ABC-1234 故障", "general", "kb", [], ["ABC-1234"], "exact_match_boost"),
    (9, "", "general", "kb", [], [], "relax_filter"),
    (10, None, "general", "kb", [], [], "relax_filter"),
    (11, "ALM-001 怎么调整", "work_order", "kb", [], ["ALM-001"], "exact_match_boost"),
    (12, "测试项 的 判定 要求", "test_spec", "kb", [], [], "relax_filter"),
]


@pytest.fixture(scope="module")
def plans(spark):
    q = spark.createDataFrame([(r[0], r[1]) for r in QUESTIONS], "query_id long, question string")
    return {r["query_id"]: r for r in U.execution_plan(U.build_query_plans(q)).collect()}


@pytest.mark.parametrize("case", QUESTIONS, ids=lambda c: str(c[0]))
def test_plan(plans, case):
    got = plans[case[0]]
    assert (got["intent"], got["route"], got["entities"]["model_types"], got["entities"]["fault_codes"], got["policy"]["strategy"]) == case[2:]


def test_tools_and_filters(plans):
    assert plans[3]["tools"] == ["kb_search", "doc_check"]
    assert plans[5]["tools"] == ["web_search"]
    assert plans[1]["suggested_filters"]["version"] == "V2.3"
    assert plans[1]["suggested_filters"]["doc_type"] == "release_note"


def test_doc_ids_of_five_characters_are_models_too(plans):
    # the year part of an identifier looks like a model; its prefix keeps it out
    assert plans[3]["entities"]["doc_ids"] == ["QE-2025-0091"]
    assert plans[3]["entities"]["model_types"] == []


def test_user_filters_win(spark):
    q = spark.createDataFrame([(1, "WPS-3000 V2.3 规格", "1.5", "fmea")], "query_id long, question string, version string, doc_type string")
    r = U.build_query_plans(q).first()
    assert (r["where"]["version"], r["where"]["doc_type"], r["suggested_filters"]["version"]) == ("V1.5", "fmea", None)


def test_synonym_payloads():
    rows = U.normalize_synonyms({"a": ["bb", "问题"], "c": {"weight": 0.5, "terms": ["d", {"text": "e", "weight": 0.9}, {"text": "e", "weight": 0.1}]}, "alone": [], "x": 3})
    assert [(r[0], r[2], r[3]) for r in rows] == [(0, "a", 1.0), (0, "bb", 0.8), (0, "问题", 0.2), (1, "e", 0.9), (1, "d", 0.8), (1, "c", 0.5)]
    assert U.normalize_synonyms("{") == []


def test_expansion(spark):
    q = spark.createDataFrame([(1, " 报警 版本 "), (2, "无"), (3, " ")], "query_id long, question string")
    extra = spark.createDataFrame([(1, 0, "报警  版本"), (1, 1, "别的")], "query_id long, place int, rewrite string")
    rows = U.expand_queries(q, U.synonym_table(spark), extra).orderBy("query_id", "variant_idx").collect()
    assert [(r[0], r[1], r[2]) for r in rows] == [(1, 0, "报警 版本"), (1, 1, "故障 版本"), (1, 2, "报警 软件版本"), (1, 3, "别的"), (2, 0, "无")]


def _plan(spark, **entities):
    e = {k: [] for k in ("model_types", "versions", "fault_codes", "doc_ids", "work_order_ids", "departments", "customers")} | entities
    row = (1, "raw", "rewritten", ["rewritten", "second"], ["sub"], "spec", e)
    fields = ", ".join(f"{k}: array<string>" for k in e)
    return spark.createDataFrame([row], f"query_id long, question string, rewritten string, variants array<string>, sub_queries array<string>, intent string, entities struct<{fields}>")


@pytest.mark.parametrize(
    ("evidence", "issues"),
    [
        ([("spec", "FOO-100", 0.5)], []),
        ([("spec", "FOO-100", 0.05)], ["low_confidence"]),
        ([("fmea", "foo-100", 0.5)], ["type_mismatch"]),
        ([("spec", "nothing", 0.5)], ["entity_not_found"]),
        ([], ["low_confidence", "entity_not_found"]),
    ],
)
def test_critique(spark, evidence, issues):
    e = spark.createDataFrame([(1, i + 1, *x) for i, x in enumerate(evidence)], "query_id long, rank int, doc_type string, content string, rerank_score double")
    r = R.critique_evidence(_plan(spark, model_types=["FOO-100"]), e).first()
    assert (r["issues"], r["passed"]) == (issues, not issues)


@pytest.mark.parametrize(("strategy", "query", "doc_type"), [("exact_match_boost", "FOO-100 raw", "fmea"), ("tighten_filter", "rewritten", "spec"), ("expand_query", "sub", None), ("relax_filter", "raw", None)])
def test_retry_query(spark, strategy, query, doc_type):
    p = _plan(spark, model_types=["FOO-100"], versions=["V1.0"]).withColumns({"missing_entities": F.array(F.lit("FOO-100")), "where": U.where_struct(doc_type=F.lit("fmea"), version=F.lit("V1"))})
    q, w = R.build_retry_query(F.lit(strategy))
    r = p.select(q.alias("q"), w.alias("w")).first()
    assert (r["q"], r["w"]["doc_type"], r["w"]["version"]) == (query, doc_type, "V1")


@pytest.mark.parametrize(("answer", "rate", "passed"), [("foo-100 v1.0", 1.0, True), ("FOO-100", 0.5, True), ("none", 0.0, False), (None, 0.0, False)])
def test_answer(spark, answer, rate, passed):
    c = _plan(spark, model_types=["FOO-100"], versions=["V1.0"]).select(R.critique_answer(F.col("entities"), F.lit(answer)).alias("c")).first()["c"]
    assert (c["coverage_rate"], c["passed"]) == (rate, passed)


def test_stub_answers(spark):
    rows = spark.createDataFrame([("kb",), ("web",), ("other",)], "route string").select("route", U.stub_answer(F.col("route")).alias("a")).collect()
    assert [r["a"] for r in rows] == [None, lexicon.STUBS["web"], lexicon.OTHER_STUB]
