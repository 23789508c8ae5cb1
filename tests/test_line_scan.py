import random

import pytest

from stackwright.functions import lexicon
from stackwright.operators import checker as C
from stackwright.operators import line_scan as L

LINES = ["", "  ", "# head", "#nospace", "## other", "```", "~~~", "a line of text", "a line of text", "short", "1. one", "2. two", "3. three", "9. nine", "１2 wide", "7 half", "x" * 150, "　ideographic　", "1.", "12345678901234567890. big", "文字 text"]


def _text(rng, n):
    return "".join(rng.choice(LINES) + rng.choice(["\n", "\n", "\r\n", " "]) for _ in range(n)) + rng.choice(["", "end"])


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(f"d{i}", _text(rng, rng.choice([1, 5, 40, 120]))) for i in range(60)] + [("none", None), ("empty", ""), ("blank", "\n" * 50), ("para", "word and word\n" * 90), ("head", "# a\n" * 30)]
    return spark.createDataFrame(rows, "file_path string, text string")


def _rules(docs, most_blank=2, most_para=400):
    """The rules one by one, over a table of lines."""
    lines = C.explode_lines(docs)
    out = C.check_empty_sections(lines)
    for f in (C.check_consecutive_blank_lines(lines, most_blank), C.check_long_paragraphs(lines, most_para), C.check_mixed_digits(lines), C.check_duplicate_lines(lines), C.check_numbered_list(lines)):
        out = out.unionByName(f)
    return sorted(map(tuple, out.collect()))


def _scan(most_blank=2, most_para=400):
    return L.Scan({"typo": C.TYPO, "format": C.FORMAT, "structure": C.STRUCTURE, "readability": C.READABILITY}, most_blank, most_para)


def test_within_documents(docs):
    want = _rules(docs)
    assert len(want) > 200 and len({r[5][:4] for r in want}) >= 6
    assert sorted(map(tuple, L.neighbour_issues(docs, _scan()).collect())) == want


@pytest.mark.parametrize("block", [1, 3, 16])
def test_in_blocks(docs, block):
    got = L.neighbour_issues(docs, _scan(1, 100), whole=0, block=block)
    assert sorted(map(tuple, got.collect())) == _rules(docs, 1, 100)


def test_a_long_document_is_dealt_to_many_tasks(spark):
    text = "\n".join(f"{i}. item {i}" if i % 977 else "" for i in range(1, 60_000)) + "\n```\n" + "code\n" * 40_000
    docs = spark.createDataFrame([("long", text), ("short", "a\n\n\n\n")], "file_path string, text string").repartition(1)
    got = L.neighbour_issues(docs, _scan(), whole=100_000, block=2000)
    assert sorted(map(tuple, got.collect())) == _rules(docs)


def test_check_documents_has_one_pass_for_lines_and_no_exchange(docs):
    plan = C.check_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_configuration_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('﻿{"max_blank_lines": 7, "preferred_terms": {"接口": ["API"]}}', encoding="utf-8")
    got = C.read_config(spark, str(tmp_path / "c.json"))
    assert got["max_blank_lines"] == 7 and got["preferred_terms"] == {"接口": ["API"]} and got["note_keywords"] == lexicon.CHECKER["note_keywords"]
