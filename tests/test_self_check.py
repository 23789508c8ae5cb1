"""The self-check of critiques and retries over a table of cases."""

import pytest

from stackwright.operators import evaluation as E

ENTITIES = "entities struct<fault_codes: array<string>, doc_ids: array<string>, model_types: array<string>, versions: array<string>>"
CASE = (
    f"query_id long, step string, intent string, question string, rewritten string, variants array<string>, sub_queries array<string>, {ENTITIES}, where struct<doc_type: string, version: string>, "
    f"issues array<string>, missing_entities array<string>, policy struct<max_retries: int, trigger_conditions: array<string>, strategy: string>, attempt int, answer string, expect struct<{E.EXPECT.replace(' ', ': ').replace(',: ', ', ')}>"
)
NAMES = [f.split()[0] for f in E.EXPECT.split(", ")]


def _case(step, intent="general", question="how", entities=((), (), (), ()), where=(None, None), given=(), lacks=(), on=("low_confidence",), strategy="relax_filter", attempt=0, answer=None, subs=(), score=None, content="", doc_type=None, new_type=None, **expect):
    expect["doc_type"] = new_type
    row = (step, intent, question, f"{question} again", [question], list(subs), tuple(map(list, entities)), where, list(given), list(lacks), (1, list(on), strategy), attempt, answer, tuple(expect.get(n) for n in NAMES))
    return row, (1, doc_type, content, score)


CODE = (("VIS-1002",), (), (), ())
GOOD = [
    _case("evidence", "fault_code", entities=CODE, content="about vis-1002", doc_type="fault_code", score=0.8, passed=True, issues=[]),
    _case("evidence", "fault_code", entities=CODE, content="VIS-1002", doc_type="fault_code", score=0.05, passed=False, issues=["low_confidence"]),
    _case("evidence", "fault_code", content="sizes", doc_type="spec", score=0.8, passed=False, issues=["type_mismatch"]),
    _case("evidence", "fault_code", entities=(("VIS-9999",), (), (), ()), content="of WPS-3000", doc_type="fault_code", score=0.8, issues=["entity_not_found"], missing=["VIS-9999"]),
    _case("evidence", "fault_code", entities=(("ERR-0001",), (), (), ()), content="else", doc_type="fault_code", score=0.05, issues=["low_confidence", "entity_not_found"]),
    _case("decision", given=["low_confidence"], retry=True),
    _case("decision", given=["type_mismatch"], retry=False),
    _case("decision", given=["low_confidence"], attempt=1, retry=False),
    _case("retry", entities=CODE, lacks=["VIS-1002"], strategy="exact_match_boost", query="VIS-1002 how", query_has=["VIS-1002", "how"]),
    _case("retry", "release_note", strategy="tighten_filter", query="how again", new_type="release_note"),
    _case("retry", where=("spec", "V2.1"), strategy="expand_query", subs=["first", "second"], query="first", new_type=""),
    _case("retry", where=("spec", None), strategy="relax_filter", query="how", new_type=""),
    _case("answer", entities=(("VIS-1002",), (), ("WPS-3000",), ()), answer="wps-3000: vis-1002", passed=True, coverage=1.0),
    _case("answer", entities=(("VIS-9999",), (), ("WPS-9999",), ()), answer="nothing", passed=False, coverage=0.0),
    _case("answer", entities=(("VIS-1002", "ERR-999"), (), ("WPS-3000", "WPS-9999"), ()), answer="VIS-1002 WPS-3000", passed=True, coverage=0.5),
    _case("answer", answer="anything", passed=True, coverage=1.0),
    _case("answer", entities=(("VIS-1002",), ("8D-2024-0088",), ("WPS-3000",), ("V2.1",)), answer="WPS-3000 V2.1 VIS-1002", passed=True, coverage=0.75),
    _case("evidence"),
]
BAD = [
    (_case("evidence", passed=True), ["passed"]),
    (_case("evidence", entities=CODE, content="VIS-1002", score=0.8, missing=["VIS-1002"], issues=["low_confidence"]), ["issues", "missing"]),
    (_case("decision", given=["low_confidence"], retry=False), ["retry"]),
    (_case("retry", query="other", query_has=["how", "not"], new_type="spec"), ["query", "query_has", "doc_type"]),
    (_case("answer", answer=None, entities=CODE, passed=True, coverage=1.0), ["passed", "coverage"]),
    (_case("answer", answer="x", retry=True), ["retry"]),
    (_case("other"), ["step"]),
    (_case(None), ["step"]),
]


def _tables(spark, cases):
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], CASE)
    seen = [(i, *e) for i, (c, e) in enumerate(cases) if c[0] == "evidence" and e[3] is not None]
    return rows, spark.createDataFrame(seen, "query_id long, rank int, doc_type string, content string, max_score double")


def test_cases_that_are_met(spark):
    got = E.self_check(*_tables(spark, GOOD)).collect()
    assert len(got) == len(GOOD) and [(r["query_id"], r["missed"]) for r in got if not r["passed"]] == []


def test_cases_that_fail_say_what(spark):
    got = E.self_check(*_tables(spark, [c for c, _ in BAD])).collect()
    assert {r["query_id"]: r["missed"] for r in got} == {i: want for i, (_, want) in enumerate(BAD)}


@pytest.mark.parametrize(("cases", "accepted"), [(GOOD, True), (GOOD + [BAD[0][0]], False), ([], None)])
def test_gate(spark, cases, accepted):
    whole = [r for r in E.gate(E.self_check(*_tables(spark, cases))).collect() if r["step"] is None]
    assert [(r["n"], r["accepted"]) for r in whole] == ([(len(cases), accepted)] if cases else [])
