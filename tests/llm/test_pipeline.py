import os

import pytest

import corpus_pipeline as P
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(now) <= set(kept)
        assert docs.columns == columns or name == P.STAGES[-1][0] and docs.columns == [*columns, "rate"]
        if name == "near_duplicates":
            assert set(now) == {d for d, (_, c) in brute.components(list(kept.items()), 5).items() if c == d}
        if name == "decontaminate":
            items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in t for t in now.values() for i in items)
            assert all(any(i[:60] in kept[d] or i[-60:] in kept[d] for i in items) for d in set(kept) - set(now))
        if name in ("pii", "language_id", "mix_sources"):
            assert len(now) >= 0.95 * len(kept)
        kept = now


def test_stages_take_empty_and_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, "the of and " * 5_000, "en", "s", 9, 3), (2, "the of and " * 5_000, "en", "s", 9, 3), (3, "la de el que " * 10, "es", None, 1, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rate int")
    for _, stage in P.STAGES:
        assert set(df.columns) <= set(stage(spark, df, SF).columns)
        stage(spark, df, SF).collect()
        assert stage(spark, df.limit(0), SF).count() == 0


def test_no_language_learned_keeps_what_has_letters(spark):
    texts = {1: "the of and to in", 2: "la de el que", 3: "12 34 !", 4: "", 5: None, 6: "Ä"}
    for lang in (None, "und"):
        df = spark.createDataFrame([(i, t, lang, "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
        kept = P.language_id(spark, df, SF)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 6]
