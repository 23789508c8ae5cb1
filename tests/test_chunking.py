from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stackwright.operators import chunking as K


def run(spark, f, *docs, **kw):
    df = spark.createDataFrame([(f"d{i}.md", t) for i, t in enumerate(docs)], "source string, text string")
    out: dict = {}
    for r in f(df, **kw).orderBy("source", "chunk_index").collect():
        out.setdefault(r["source"], []).append(r["content"])
    return [out.get(f"d{i}.md", []) for i in range(len(docs))]


def test_blocks():
    text = "intro\n# Head\n\n| a |\n\n| b |\nplain\n- one\n  more\n\n- two\n1. x\n## Next\n"
    assert K.blocks_of(text) == [("para", "intro"), ("heading", "# Head"), ("table", "| a |\n| b |"), ("para", "plain"), ("list", "- one\n  more"), ("list", "- two\n1. x"), ("heading", "## Next")]


@given(st.lists(st.sampled_from(["# h", "| t |", "- i", "  indented", "text", "", "1. n"]), max_size=30))
@settings(max_examples=200, deadline=None)
def test_blocks_keep_all_lines(lines):
    kept = [x for _, b in K.blocks_of("\n".join(lines)) for x in b.split("\n")]
    assert kept == [x.rstrip() for x in lines if x.strip()]


def test_markdown(spark):
    para = "x" * 70
    assert run(spark, K.chunk_markdown, f"# A\n\n{para}\n\n{para}1\n\n{para}2\n\n# B\n\n{para}3", "", "plain") == [[f"# A\n\n{para}\n\n{para}1\n\n{para}2", f"{para}1\n\n{para}2\n\n# B\n\n{para}3"], [""], ["plain"]]


def test_long_sections_become_windows(spark):
    paras = [f"{i}" * 200 for i in range(6)]
    assert run(spark, K.chunk_markdown, "\n\n".join(paras)) == [["\n\n".join(paras[i : i + 4]) for i in (0, 2, 4)]]


def test_merge_short(spark):
    cases = [(["a", "b", "c"], ["a\n\nb", "c"]), (["a" * 60, "b"], ["a" * 60, "b"]), (["a", "b" * 70, "c", "d"], ["a\n\n" + "b" * 70, "c\n\nd"]), ([], [])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<string>")
    assert [r[0] for r in df.orderBy("i").select(K.chunk_merge_short(F.col("c"))).collect()] == [w for _, w in cases]


def test_log(spark):
    assert run(spark, K.chunk_log, "\n".join(["a", "", "b", " ", "c"]), "", n=2) == [["a\nb", "c"], []]


def test_json(spark):
    assert run(spark, K.chunk_json, '[{"a": 1, "b": null, "c": " "}, 3]', '{"k": [1, "é"]}', "no\n\njson", "") == [["a: 1", "3"], ['k: [1, "é"]'], ["no", "json"], []]


def test_xml(spark):
    assert run(spark, K.chunk_xml, "<t><title> A  b </title><body><p>x <b>y</b></p><q>no</q><li>z</li></body></t>", "<broken") == [["A b", "x y\nz"], ["<broken"]]


def test_rows(spark):
    df = spark.createDataFrame([("s", 2, "q", None), ("s", 1, "p", "7"), ("s", 3, " ", None)], "source string, row_no int, a string, b string")
    assert [r["content"] for r in K.chunk_rows(df, ["a", "b"]).orderBy("chunk_index").collect()] == ["字段: a | b", "a: p | b: 7", "a: q"]


def test_runs_and_slides(spark):
    rows = [("s", 0, "Heading 1", "H"), ("s", 1, "Normal", "a"), ("s", 2, "Normal", "b"), ("s", 3, "Normal", " "), ("s", 4, None, "c")]
    df = spark.createDataFrame(rows, "source string, pos int, style string, text string")
    assert [r["content"] for r in K.chunk_runs(df).orderBy("chunk_index").collect()] == ["H", "a b", "c"]
    slides = K.chunk_slides(df.withColumn("slide_no", F.expr("1 + pos div 3"))).orderBy("chunk_index").collect()
    assert [r["content"] for r in slides] == ["[幻灯片 1] H a b", "[幻灯片 2] c"]


def test_pages(spark):
    df = spark.createDataFrame([("a", 0, "x" * 150), ("a", 1, "y\n\nz" * 60), ("b", 0, "s"), ("c", 0, None)], "source string, page_no int, text string")
    text, ocr = K.route_pdf_pages(df)
    assert {r[0] for r in ocr.collect()} == {"b", "c"}
    assert {r["source"] for r in text.collect()} == {"a"}


def test_records_and_dispatch(spark):
    df = spark.createDataFrame([("a/x.md", "# t\n\nbody"), ("y.LOG", "l1\nl2"), ("z.json", '{"k": 1}'), ("plain", "p\n\nq")], "source string, text string")
    rows = K.load_chunks(df).collect()
    assert {(r["source"], r["chunk_index"], r["content"], r["parse_track"], r["file_format"]) for r in rows} == {("a/x.md", 0, "# t\n\nbody", "structured_doc", "md"), ("y.LOG", 0, "l1\nl2", "log", "log"), ("z.json", 0, "k: 1", "log", "json"), ("plain", 0, "p", "rich_text", ""), ("plain", 1, "q", "rich_text", "")}
    assert len({r["id"] for r in rows}) == 5


def test_csv_documents(spark):
    rows = [("a.csv", '﻿name,note\r\nx,"one, ""two""\nthree"\r\n\r\n , \r\ny\r\n'), ("b.csv", "p;q,p;q\n1,NA\n2,3,4\n"), ("c.csv", ""), ("d.csv", " \n"), ("e.csv", None), ("f.csv", "only")]
    got = {}
    for r in K.chunk_dispatch(spark.createDataFrame(rows, "source string, text string")).orderBy("source", "chunk_index").collect():
        got.setdefault(r["source"], []).append(r["content"])
    assert got == {
        "a.csv": ["字段: name | note", 'name: x | note: one, "two"\nthree', "name: y"],
        "b.csv": ["字段: p;q | p;q.1", "p;q: 1", "p;q: 2 | p;q.1: 3 | Unnamed: 2: 4"],
        "f.csv": ["字段: only"],
    }


def test_rows_are_numbered_by_many_tasks(spark):
    rows = spark.range(5000).selectExpr("case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('s', id % 50) end source", "cast(5000 - id as int) row_no", "cast(id as string) a").repartition(7)
    got = K.numbered(rows, F.col("row_no")).collect()
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append((r["row_no"], r["chunk_index"]))
    assert len(got) == 5000
    for own in by.values():
        assert [i for _, i in sorted(own)] == list(range(len(own)))
