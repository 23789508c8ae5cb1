import random
import re

import pytest

from stackwright.functions import text as X
from stackwright.operators import checker as C

CASES = {
    "repeated": ("进行进行 的的\n`进行进行`\n", {("error", 1, 1, "重复词语"), ("error", 1, 6, "重复词语")}),
    "heading": ("#bad\n##\n", {("error", 1, 1, "格式规范"), ("error", 2, 1, "文档结构")}),
    "empty": ("# a\n\n## b\ntext\n", {("warning", 1, 1, "文档结构")}),
    "empty_code": ("# a\n```\ncode\n```\n# b\nx\n", {("warning", 1, 1, "文档结构")}),
    "blank": ("a\n\n\n\n\n\n\nb\n", {("warning", 2, 0, "格式规范"), ("warning", 5, 0, "格式规范")}),
    "long": ("x" * 300 + "\n" + "y" * 101 + "\n", {("info", 1, 0, "可读性")}),
    "digits": ("1\n１2\n", {("warning", 2, 1, "格式规范")}),
    "note": ("注意: x\n**注意**: y\n", {("warning", 1, 1, "提示框规范")}),
    "spacing": ("ok 中文 a\n中a b中\n", {("info", 2, 1, "格式规范")}),
    "duplicate": ("same line\nsame line\nabc\nabc\n", {("warning", 2, 1, "重复词语")}),
    "list": ("1. a\n3. b\ntext\n4. c\n\n9. d\n", {("warning", 2, 1, "格式规范")}),
    "term": ("the API x\n", {("info", 1, 5, "术语一致性")}),
    "code": ("~~~\n#bad\nAPI\n```\nAPI\n", {("info", 5, 1, "术语一致性")}),
    "nothing": ("", set()),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = C.check_documents(spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "file_path string, text string")).collect()
    out = {}
    for r in rows:
        out.setdefault(r["file_path"], set()).add((r["level"], r["line"], r["col"], r["category"]))
    return out


@pytest.mark.parametrize("name", CASES)
def test_rules(found, name):
    assert found.get(name, set()) == CASES[name][1]


def test_links(spark):
    docs = spark.createDataFrame([("d/a.md", "[x](b.md#q) [y](../e/none.md) [z](http://w) [f](../d) [g](#h)\n")], "file_path string, text string")
    files = spark.createDataFrame([("d/a.md",), ("d/b.md",)], "path string")
    rows = C.check_broken_links(C.explode_lines(docs), files).collect()
    assert [(r["line"], r["col"], r["message"]) for r in rows] == [(1, 13, '链接目标不存在："../e/none.md"')]


def test_undecodable_and_summary(spark):
    files = spark.createDataFrame([("a", b"\xff\xfe"), ("b", "#bad\n".encode())], "file_path string, content binary")
    issues = C.check_files(spark, files)
    assert {(r["file_path"], r["line"]) for r in issues.collect()} == {("a", 0), ("b", 1)}
    assert {(r["file_path"], r["total"]) for r in C.check_summary(issues).collect()} == {("a", 1), ("b", 1), (None, 2)}
    assert C.filter_level(issues, "error").count() == 2
    assert C.check_config({"max_blank_lines": 5})["max_blank_lines"] == 5


def test_blanks_are_trimmed_and_repeats_placed_as_python_has_it(spark):
    rng = random.Random(5)
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()]
    assert sorted(blanks) == sorted(X.BLANKS)
    texts = ["".join(rng.choices([*blanks, "a", "é", "中", "😀"], k=rng.randint(0, 9))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strip("t").alias("s"), X.rstrip("t").alias("r")).collect()
    assert all(r["s"] == r["t"].strip() and r["r"] == r["t"].rstrip() for r in rows)
    docs = [(str(i), "".join(rng.choices("进行的的了中 进😀", k=rng.randint(0, 24)))) for i in range(500)]
    got = C.check_repeated_words(C.explode_lines(spark.createDataFrame(docs, "file_path string, text string"))).collect()
    rules = ((r"([一-鿿]{2,4})\1", '疑似重复词语："%s%s"'), (r"([的了着过地得也都就还])\1", '助词/副词重复："%s%s"'))
    want = [(f, m.start() + 1, said % (m[1], m[1])) for f, t in docs for p, said in rules for m in re.finditer(p, t)]
    assert sorted((r["file_path"], r["col"], r["message"]) for r in got) == sorted(want)
