import random
import re

import pytest

from stackwright.operators import contain
from stackwright.operators import evaluation as E
from stackwright.operators import understanding as U
from stackwright.operators.contain import holding


@pytest.mark.parametrize(("known", "sought"), [(0, 0), (1000, 0), (1000, 200)])
def test_against_every_pair(spark, monkeypatch, known, sought):
    monkeypatch.setattr(contain, "KNOWN", known)
    monkeypatch.setattr(contain, "SOUGHT", sought)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abxy") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(12)).replace("a b", "a,b") for _ in range(60)] + ["数据库连接超时", "aab", "", None, "a b", "  "]
    terms = [rng.choice(texts[:60])[i : i + n] for i in (0, 3, 7) for n in (1, 2, 3, 5, 9, 20) for _ in range(4)] + ["连接", "库", "数据库连接超时", "", None, "aa", "nowhere at all", "a b"]
    t = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    p = spark.createDataFrame(list(enumerate(terms)), "j long, term string")
    got = sorted((r["i"], r["j"]) for r in holding(t, p, "text", "term").collect())
    assert got == sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(terms) if x and y and y in x)
    assert holding(t.limit(0), p, "text", "term").count() == 0 and holding(t, p.limit(0), "text", "term").count() == 0
    plan = holding(t, p, "text", "term")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_synonym_tables_of_any_size(spark):
    rows = [(g, f"t{g}a", f"t{g}{x}", 1.0, i) for g in range(30_000) for i, x in enumerate("ab")]
    synonyms = spark.createDataFrame(rows, "group_id int, canonical string, text string, weight double, place int")
    got = U.expand_queries(spark.createDataFrame([(1, "so t29999a it")], "query_id long, question string"), synonyms, max_variants=99)
    assert "so t29999b it" in {r["variant"] for r in got.collect()}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_synonym_cases_shuffle_no_whole_text(spark):
    chunks = spark.createDataFrame([(f"s{i}", "some words here with an assertion and more") for i in range(9)], "source string, content string")
    lines = E.generate_synonym_cases(chunks, U.synonym_table(spark))._jdf.queryExecution().executedPlan().toString().split("\n")
    below = [y for x, y in zip(lines, lines[1:], strict=False) if "Exchange" in x]
    assert below and not [y for y in below if re.search(r"(\[|, |AS )doc#\d+[,\]]", y)]
