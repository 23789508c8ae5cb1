"""What is worked out within a row, against plain loops; and plans that must not shuffle."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stackwright.functions import text as X
from stackwright.operators import checker as C
from stackwright.operators import chunking as K
from stackwright.operators import retrieval as S
from stackwright.operators import understanding as U
from stackwright.plans import answer
from stackwright.plans.registry import hashed_vectors


def _lists(seed, values, n=60, most=12):
    rng = random.Random(seed)
    return [[rng.choice(values) for _ in range(rng.randrange(most))] for _ in range(n)]


def test_counts_and_firsts(spark):
    rows = _lists(1, ["a", "A", "b", "ß", "中"])
    df = spark.createDataFrame(list(enumerate(rows)), "i int, a array<string>")
    for r in df.select("a", X.counts(F.col("a")).alias("c"), X.unique_by(F.col("a"), F.lower).alias("u")).collect():
        assert {x["term"]: x["n"] for x in r["c"]} == Counter(r["a"]) and len(r["c"]) == len(set(r["a"]))
        firsts = []
        for x in r["a"]:
            if x.lower() not in [y.lower() for y in firsts]:
                firsts.append(x)
        assert r["u"] == firsts


def test_short_chunks_are_joined_in_twos(spark):
    rows = _lists(2, ["s", "t", "x" * 60, "y" * 59])
    df = spark.createDataFrame(list(enumerate(rows)), "i int, c array<string>")
    for r in df.select("c", K.chunk_merge_short(F.col("c")).alias("m")).collect():
        out, held = [], None
        for c in r["c"]:
            if held is not None:
                out, held = [*out, f"{held}\n\n{c}"], None
            elif len(c) < K.MIN_CHARS:
                held = c
            else:
                out.append(c)
        assert r["m"] == out + [held] * (held is not None)


def test_code_flags(spark):
    rows = _lists(3, ["```", " ~~~~ x", "text", "", "# h"])
    df = spark.createDataFrame([(str(i), "\n".join(x)) for i, x in enumerate(rows)] + [("null", None)], "file_path string, text string")
    got = {}
    for r in C.explode_lines(df).collect():
        got.setdefault(r["file_path"], {})[r["lineno"]] = (r["line"], r["in_code"])
    for i, own in enumerate(rows):
        code, want = False, {}
        for n, line in enumerate("\n".join(own).splitlines(), 1):
            fence = line.strip().startswith(("```", "~~~"))
            want[n] = (line, code or fence)
            code ^= fence
        assert got.get(str(i), {}) == want
    assert "null" not in got


def test_rows_of_one_source_stay_apart(spark):
    one, two = "# one\n\n" + "first body " * 9, "# two\n\n" + "second body " * 9
    df = spark.createDataFrame([("a.md", one), ("a.md", two), ("b.txt", "p\n\nq"), ("c.json", '{"k": 1}'), ("d.log", "x\n\ny"), ("e.xml", "<t><title>T</title></t>"), ("f", None), (None, "z")], "source string, text string")
    assert sorted(r["content"] for r in K.chunk_markdown(df.where("source = 'a.md'")).collect()) == [one.strip(), two.strip()]
    got = sorted((r["source"] or "", r["chunk_index"], r["content"]) for r in K.chunk_dispatch(df).collect())
    assert got == [("", 0, "z"), ("a.md", 0, one.strip()), ("a.md", 0, two.strip()), ("b.txt", 0, "p"), ("b.txt", 1, "q"), ("c.json", 0, "k: 1"), ("d.log", 0, "x\ny"), ("e.xml", 0, "T")]


@pytest.mark.parametrize("made", [K.chunk_dispatch, K.chunk_markdown, lambda d: S.postings(K.chunk_paragraphs(d).withColumnRenamed("source", "id")), lambda d: C.check_terminology(C.explode_lines(d.withColumnRenamed("source", "file_path")))])
def test_nothing_is_shuffled(spark, made):
    df = spark.createDataFrame([("a.md", "x")], "source string, text string")
    assert "Exchange" not in made(df)._jdf.queryExecution().executedPlan().toString()


def test_frequent_terms_are_dealt_out(spark, monkeypatch):
    rng = random.Random(5)
    chunks = spark.createDataFrame([(f"c{i}", "the " * rng.randrange(1, 4) + " ".join(rng.choice("abcdef") * 2 for _ in range(6))) for i in range(60)] + [("none", "...")], "id string, content string")
    questions = spark.createDataFrame([(1, "the aa bb"), (2, "cc cc unknown"), (3, "")], "query_id long, question string")
    index = S.postings(chunks).cache()
    plain = sorted((r["query_id"], r["rank"], r["id"], round(r["bm25"], 9)) for r in S.bm25_corpus(questions, index, 5).collect())
    monkeypatch.setattr(S, "COMMON", 20)
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["bm25"], 9)) for r in S.bm25_corpus(questions, index, 5).collect()) == plain and len(plain) == 10


def test_a_tokenizer_of_ones_own(spark):
    """A dictionary segmenter as a pandas UDF takes the place of the built-in tokens."""
    import pandas as pd

    words = ["数据库连接", "数据库", "连接", "超时", "失败"]

    @F.pandas_udf("array<string>")
    def segment(texts: pd.Series) -> pd.Series:
        import re

        return texts.map(lambda t: re.findall("|".join(words) + r"|[A-Za-z0-9]+", t or ""))

    chunks = spark.createDataFrame([("a", "数据库连接失败"), ("b", "连接超时"), ("c", "数据库超时"), ("d", "x")], "id string, content string")
    q = spark.createDataFrame([(1, "数据库连接")], "query_id long, question string")
    assert [r["id"] for r in S.bm25_corpus(q, S.postings(chunks, segment), 3, segment).collect()] == ["a"]


def test_supplement(spark):
    """An answer without its key gets evidence that has it; one that is complete gets no more."""
    chunks = K.make_chunk_records(spark.createDataFrame([(f"s{i}.txt", 0, t) for i, t in enumerate(["WPS-3000 limit table", "WPS-3100 other", "unrelated words here"])], "source string, chunk_index int, content string"))
    vectors = S.embed(chunks.select("id", "content"), hashed_vectors).select("id", "embedding")
    plans = U.build_query_plans(spark.createDataFrame([(1, "limit of WPS-3000"), (2, "WPS-3100 other")], "query_id long, question string"))
    first = chunks.where("source = 's2.txt'").select(F.explode(F.expr("array(1L, 2L)")).alias("query_id"), "*", F.lit(1).alias("rank"), F.lit(0.2).alias("rerank_score"), F.lit(0.2).alias("max_score"))
    answers = spark.createDataFrame([(1, "no idea"), (2, "see WPS-3100")], "query_id long, answer string")
    more = answer.supplement_pass(first, plans, answers, chunks, vectors, lambda v: S.embed(v, hashed_vectors, "variant"))
    got = {}
    for r in more.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["source"])
    assert got[1][0] == "s2.txt" and "s0.txt" in got[1] and got[2] == ["s2.txt"]
    judged = answers.withColumn("judge", F.lit('{"relevant": false, "confidence": "high", "reason": "x"}'))
    off = answer.supplement_pass(first, plans, judged, chunks, vectors, lambda v: S.embed(v, hashed_vectors, "variant")).where("query_id = 2").count()
    assert off > 1


def test_texts_are_worked_on_in_small_runs(spark):
    """What Python makes of a batch is at most that of some texts at a time; all rows keep their places."""
    import pandas as pd

    from stackwright.functions import batches

    texts = ["a" * n if n else None for n in (3, 0, 4, 50, 1, 1, 1, 1, 1)]
    got = [list(r) for r in batches.text_runs(iter([pd.Series(texts, dtype=object), pd.Series([], dtype=object)]), 4, 10)]
    assert got == [texts[:3], texts[3:4], texts[4:8], texts[8:], []]
    docs = spark.createDataFrame([(f"s{i}", None if i % 9 == 4 else f"# h{i}\n\np{i}") for i in range(200)], "source string, text string").coalesce(1)
    want = sorted(map(tuple, K.md_blocks(docs).collect()))
    assert len(want) == 2 * sum(i % 9 != 4 for i in range(200))
    xml = K.chunk_xml(docs.withColumn("text", F.format_string("<t><title>%s</title></t>", "source")))
    assert sorted(map(tuple, xml.collect())) == sorted((f"s{i}", 0, f"s{i}") for i in range(200))


def test_chunks_take_their_documents_fields_without_a_shuffle(spark, tmp_path):
    """Chunks that have the fields themselves are not joined with their documents; what is found among them is joined with them where they lie."""
    from stackwright.plans import fixtures, registry

    texts = [(i, f"one word {i}\n\nother line of {i % 3}\n", "en", f"s{i}", 9) for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "word 7"), (2, "line of 2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = fixtures.kb_docs(spark, str(tmp_path))
    chunks = fixtures.kb_chunks(spark, str(tmp_path))
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    joined = K.make_chunk_records(chunks.select("source", "chunk_index", "content"), docs)
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, joined.collect())) and chunks.count() == 60
    rows = registry._hits(spark, str(tmp_path)).select("query_id", "id", "rank").join(chunks, "id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert rows.count() == registry._hits(spark, str(tmp_path)).count() > 0
