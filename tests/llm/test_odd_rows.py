"""Nulls, empty and very long texts, repeats, ties, empty tables and clashing names, for all operators and stages."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from stackwright.llm import common, decontam, langid, mixing, neardup, pii, quality_mil, quality_rules, token_rollup, url_filter, warc_index
from stackwright.sources.scratch import Scratch, cleared

LONG = "the house and the garden with 10.0.0.1 dog " * 60_000  # 2.5 MB
OWN = ("_p", "_pii", "_Matches", "_posterior", "_lang", "_certain", "_predicted", "a.b", "rep", "key", "bucket", "c", "n", "hub", "sig", "host")
_TEXTS = [
    (None, None, None, None), (None, "the of and", "en", "s"), (1, "", "en", "s"), (2, LONG, "en", "s"), (3, "the of and to in is was", "en", "s"), (3, "the of and to in is was", "en", "s"),
    (4, "la de el que en y los", "es", None), (5, " \n\t ", "es", "t"), (6, "mail a@b.cc now", None, "t"), (7, "12 34 !", "en", "t"),
]
ROWS = [(*r, None if r[1] is None else len(r[1])) for r in _TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.coalesce(F.col("doc_id"), F.lit(-1)).alias(c) for c in OWN])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (3, 1, 0), (4, 0, 1), (4, 1, 1), (None, 1, 0), (5, None, None), (6, 2, 0)], "doc_id long, quality int, toxic int")


def _operators(spark, docs, labels):
    items = spark.createDataFrame([(1, "of and to in is"), (1, "of and to in is"), (None, "x"), (2, None)], "item_id long, text string")
    return {
        "op1": lambda d: quality_mil.score(spark, d, quality_mil.fit(d, labels)),
        "op2": lambda d: langid.identify(spark, d, langid.fit(d)),
        "op3": lambda d: token_rollup.count_tokens(spark, d, "byte_bpe_50k"),
        "op4": lambda d: decontam.with_matches(spark, d, items),
        "op6": lambda d: pii.scrub(d, pii.DEMO_KEY),
        "op8": lambda d: mixing.with_rates(spark, d, mixing.domains_of(labels)),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op8"])
def test_one_very_long_word(spark, labels, name):
    words = [("w" * 2_000_000), ("7" * 1_000_000), ("aB3" * 500_000)]
    rows = [(2, "the house and the garden", "en", "s"), (3, "of and to in is", "en", "s"), *[(10 + i, w, "en", "s") for i, w in enumerate(words)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r["doc_id"] for r in _operators(spark, df, labels)[name](df).collect()) == [2, 3, 10, 11, 12]


def _carried(rows):
    """What a caller's own columns hold, however often."""
    return Counter(tuple(r[c] for c in ("doc_id", "lang", "source", *OWN)) for r in rows)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op8"])
def test_columns_are_carried_along(spark, docs, labels, name):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    run = _operators(spark, docs, labels)[name]
    got = run(docs)
    assert set(docs.columns) < set(got.columns)
    rows = got.collect()
    assert _carried(rows) == _carried(docs.collect())
    assert run(docs.limit(0)).count() == 0
    twice = [r.asDict() for r in rows if r["doc_id"] == 3]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    if name == "op2":
        assert [by[i]["lang_pred"] for i in (1, 5, 7)] == ["und"] * 3 and by[2]["lang_pred"] == "en"
    if name == "op3":
        assert by[1]["n_tokens"] == 0 and by[2]["n_tokens"] > 500_000
    if name == "op4":
        assert {i for i, r in by.items() if r["matches"]} == {3}
    if name == "op6":
        assert {i: len(r["pii"]) for i, r in by.items() if r["pii"]} == {2: 60_000, 6: 1}
        assert by[2]["text"].count("10.0.0.1") == 0 and by[1]["text"] == "" and by[5]["text"] == " \n\t "
    if name == "op8":
        assert all(r["rate"] >= 0 for r in rows)


def test_op5(spark, docs):
    pages = docs.select("*", F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.org/"), "source").alias("url"), F.col("text").alias("html"))
    path = Scratch(spark, "odd").root
    captures = warc_index.write_archives(spark, pages, path)
    shards = warc_index.build_index(spark, captures, path)
    rows = warc_index.read_records(warc_index.look_up(spark, captures.select("key"), path, shards), path).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"]) for r in rows) == sorted((r[0] or 0, len((r[1] or "").encode())) for r in ROWS)


def test_op7(spark, docs):
    rows = neardup.find_duplicates(spark, docs, 2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == sorted((r[0] or 0, r[0] or 0) for r in ROWS)
    left = neardup.drop_duplicates(spark, docs)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter({None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1})


def test_op9(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.net/"), "source").alias("url"), F.col("text").alias("html"), *[F.col(f"`{c}`") for c in OWN])
    rows = url_filter.judge_urls(spark, pages).collect()
    assert len(rows) == len(ROWS) and {r["verdict"] for r in rows if r["host"]} == {"block"} and {r["verdict"] for r in rows if not r["host"]} == {"allow"}
    assert url_filter.judge_urls(spark, pages.limit(0)).count() == 0


def test_op10(spark, docs):
    rows = quality_rules.judge_documents(spark, docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in rows) == sorted((r[0] or 0, len((r[1] or "").split())) for r in ROWS)
    assert quality_rules.judge_documents(spark, docs.limit(0)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages(spark, docs, name):
    stage = dict(P.STAGES)[name]
    got = stage(spark, docs, SF)
    assert got.columns == [*docs.columns, *["rate"] * (name == "mix_sources")]
    rows = got.collect()
    want = _carried(docs.collect())
    if name == "language_id":
        want = Counter({k: n for k, n in want.items() if k[0] in (2, 3, 4, 6)} | {k: n for k, n in want.items() if k[0] is None and k[1] == "en"})
    if name == "near_duplicates":
        want = Counter({k: 1 for k in want})
    if name == "language_id":  # a short text may be too uncertain
        assert not _carried(rows) - want and {2, 3, 4} <= {r["doc_id"] for r in rows}
    else:
        assert _carried(rows) == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_slices_bound_rows_and_characters():
    texts = ["a" * 10] * 5 + [None] + ["b" * 100] + ["c"] * 3
    got = list(common.slices(texts, rows=3, chars=25))
    assert [i for s in got for i in range(s.start, s.stop)] == list(range(len(texts)))
    assert all(s.stop - s.start <= 3 and (sum(len(t or "") for t in texts[s]) <= 25 or s.stop - s.start == 1) for s in got)


def test_batches_are_bounded_by_bytes(spark):
    """What slices() relies on: a batch of long texts holds few of them."""
    import pandas as pd

    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"
    rows = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('abcdefghij ', 400000) t")

    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    sizes = [r[0] for r in rows.mapInPandas(count, "n long").collect()]
    assert sum(sizes) == 40 and max(sizes) <= 20


def test_frequent_keys_are_joined_like_the_others(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate("a" * 500 + "b" * 3 + "c")] + [(None, 0)], "k string, i int")
    facts = spark.createDataFrame([("a", 500, 1), ("b", 3, 2), ("d", 9, 3)], "k string, n long, v int")
    for total in (504, 1_000_000):
        got = common.join_keyed(rows, facts, "k", total)
        assert got.columns == ["k", "i", "v"] and Counter(r["v"] for r in got.collect()) == {1: 500, 2: 3}


def test_null_and_frequent_keys_of_a_left_join_are_dealt_evenly(spark):
    rows = spark.range(8000).selectExpr("id i", "case when id % 2 = 0 then null when id % 4 = 1 then 'often' else 'k' || id end k")
    facts = spark.createDataFrame([("often", 1), ("k3", 2), ("other", 3)], "k string, v int")
    got = common.left_join_keyed(Scratch(spark, "dealt"), "t", rows, facts, "k")
    assert got.where("v is not null").groupBy("v").count().orderBy("v").collect() == [(1, 2000), (2, 1)] and got.count() == 8000
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 3000


def test_cleared_deletes_what_operators_leave(spark, tmp_path):
    with cleared():
        scratch = Scratch(spark, "left")
        scratch.keep(spark.range(3).toDF("a"), "t")
        at = scratch.path("t").removeprefix("file://").removeprefix("file:")
        assert os.path.isdir(at)
    assert not os.path.exists(at)
