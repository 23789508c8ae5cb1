"""Held-out accuracy of the two classifiers, and their edge cases."""

import os

import numpy as np
import pytest

from stackwright.llm import langid, quality_mil, registry

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@tables
def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = registry.op1_quality_mil(spark, SF).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


@tables
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = registry.op2_language_id(spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_attention_gradient():
    rng = np.random.default_rng(0)
    p = {k: rng.standard_normal(s) for k, s in (("E", (5, 4)), ("e", 4), ("V", (4, 3)), ("U", (4, 3)), ("w", 3), ("c", 4))} | {"b": 0.1}
    x, at, y = rng.standard_normal((7, 5)), np.array([0, 3]), np.array([1.0, 0.0])
    loss = lambda q: -np.mean(y * np.log(quality_mil._forward(q, x, at)["y"]) + (1 - y) * np.log(1 - quality_mil._forward(q, x, at)["y"]))
    g = quality_mil._gradients(p, x, at, y)
    for k in "EVUwc":
        step = np.zeros_like(p[k])
        step.flat[1] = 1e-6
        assert (loss(p | {k: p[k] + step}) - loss(p | {k: p[k] - step})) / 2e-6 == pytest.approx(g[k].flat[1], abs=1e-6)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "word " * 30_000), (None, "x"), (1, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_mil.score(spark, docs, quality_mil.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (None, 0), (1, None)], "doc_id long, quality int")
    assert all(0 < r["score"] < 1 for r in quality_mil.score(spark, docs, quality_mil.fit(docs, one)).collect())
    assert quality_mil.score(spark, docs.limit(0), quality_mil.fit(docs, one)).count() == 0


def test_language_edge_cases(spark):
    text = {"en": "the house and the garden with the dog", "de": "das haus und der garten mit dem hund"}
    docs = spark.createDataFrame([(t + f" {'abc' * i}", g) for i in range(12) for g, t in text.items()] + [(None, "en"), ("123", "de"), ("x", None)], "text string, lang string")
    model = langid.fit(docs)
    assert model["langs"] == ["de", "en"]
    new = spark.createDataFrame([(1, "the dog and the house", 5), (2, "der hund und das haus", 5), (3, "12 !", 5), (4, None, 5), (5, "", 5)], "id int, text string, score int")
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark, new, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert got[3][1] == got[4][1] == 0 and 0.5 <= got[1][1] <= 1
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(spark, new, nothing).collect()} == {"und"}


def test_a_rare_language_is_learned(spark):
    """One row in some hundred, where the sample holds fewer rows than that."""
    text = {"en": "the house and the garden with the dog and of", "de": "das haus und der garten mit dem hund und von", "fi": "talo ja puutarha koiran kanssa on suuri"}
    rows = [(f"{text[g]} {i}{'xyz'[i % 3]}", g) for i in range(400) for g in ("en", "de")] + [(f"{text['fi']} {i}{'abc'[i % 3]}", "fi") for i in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), max_docs=60)
    assert model["langs"] == ["de", "en", "fi"]
    seen = langid.identify(spark, spark.createDataFrame([(text["fi"],), (text["en"],)], "text string"), model).collect()
    assert [r["lang_pred"] for r in seen] == ["fi", "en"]
    quotas = langid._quotas({"a": (10**9, 10**9), "b": (10**6, 10**6), "c": (3, 3)}, 3000)
    assert sum(min(q, n) for (_, q, _), n in zip(quotas, (10**9, 10**6, 3), strict=True)) <= 3000 and min(q for _, q, _ in quotas) >= 100
    assert [e == 2**63 - 1 for *_, e in quotas] == [False, False, True]


def test_ftrl_is_sparse():
    rng = np.random.default_rng(2)
    rows = []
    y = rng.integers(0, 2, 200)
    for c in y:
        at = np.unique(np.append(rng.integers(2, 50, 5), c))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)))))
    w = langid.ftrl(rows, y, 2, width=50, l1=0.05)
    assert (w[:-1] == 0).mean() > 0.5 and w[0, 0] > 0 > w[0, 1]


@pytest.mark.parametrize("text", ["la de el que en y los", "una casa y un perro", "el sol"])
def test_a_language_of_one_text_in_many_copies_is_learned(spark, text):
    rows = [(text, "es")] * 6000 + [(f"the house of number {i} and the dog", "en") for i in range(3000)]
    assert langid.fit(spark.createDataFrame(rows, "text string, lang string"))["langs"] == ["en", "es"]
