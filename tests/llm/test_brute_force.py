"""Registered queries that SQL cannot express, against brute force on a small table."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.llm import decontam, langid, mixing, pii, quality_mil, registry, token_rollup
from stackwright.llm.common import crc_mod
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def _rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_op1(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_mil.fit(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = registry.op1_quality_mil(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["score"] == pytest.approx(brute.quality(model, texts[r["doc_id"]]), abs=2e-4)
        assert r["predicted"] == (r["score"] >= 0.3)


def test_op2(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = registry.op2_language_id(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        lang, score = brute.language(model, texts[r["doc_id"]] or "")
        assert r["score"] == pytest.approx(score, abs=2e-4)
        assert r["lang_pred"] == lang or abs(score - 0.5) < 1e-3


def test_document_frequencies(spark):
    docs = spark.createDataFrame([("Aa b",), ("b",), (None,)], "text string")
    n, df = langid.document_frequencies(docs)
    one = lambda c: brute._mask(ord(c) * 0x9E3779B1) >> 18
    assert n == 2 and df[one("a")] >= 1 and df[one("b")] >= 2 and df.max() <= 2


def test_op3(spark):
    import base64
    import re

    import tiktoken

    docs, labels = _rows(spark, "documents"), _rows(spark, "labels")
    poor = {r["doc_id"] for r in labels if r["quality"] == 0}
    toxic = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 1}
    want = {}
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(f"{token_rollup.TOKENIZERS}/{name}.tiktoken", "rb") as f:
            enc = tiktoken.Encoding(name, pat_str=token_rollup.SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}, special_tokens={})
        for r in docs:
            if r["doc_id"] not in poor:
                text = re.sub(r"[#*$%&|<>]+", "", r["text"] or "") if name.startswith("byte_bpe_multi") and r["doc_id"] in toxic else r["text"] or ""
                was = want.get((r["source"], r["lang"], name), (0, 0))
                want[r["source"], r["lang"], name] = was[0] + 1, was[1] + len(enc.encode_ordinary(text))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in registry.op3_token_rollup(spark, SF).collect()}
    assert got == want


def test_op4(spark):
    items, docs = ({r[0]: r["text"] for r in _rows(spark, t)} for t in ("benchmark", "documents"))
    for r in registry.op4_decontaminate(spark, SF).collect():
        held = {i: c for i, t in items.items() if (c := brute.coverage(t, docs[r["doc_id"]], decontam.MIN_MATCH)) >= decontam.COVERAGE}
        best = max(held, key=lambda i: (held[i], -i), default=None)
        assert (r["contaminated"], r["kept"], r["n_items"], r["item_id"]) == (bool(held), not held, len(held), best)
        assert r["coverage"] == pytest.approx(held.get(best, 0.0))


def test_op6(spark):
    docs = {r["doc_id"]: r["text"] for r in _rows(spark, "documents")}
    for r in registry.op6_pii(spark, SF).collect():
        text = docs[r["doc_id"]] or ""
        want, new, done = brute.finds(text, pii.DEMO_KEY), "", 0
        for kind, at, n in want:
            new, done = new + text[done:at] + pii._WORK[kind](pii.DEMO_KEY, text[at : at + n]), at + n
        assert (r["text"] or "") == new + text[done:]
        counts = Counter(k for k, *_ in want)
        assert r["n_found"] == len(want) and all(r[f"n_{k}"] == counts[k] for k in pii.KINDS)


def test_op8(spark):
    rows = registry.op8_mix_sources(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in _rows(spark, "documents")}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["n_tokens"] == len(brute.WORD.findall(texts[r["doc_id"]] or "")) and r["rate"] >= 0 for r in rows)
    p, n, r = (np.array([x[c] for x in rows], float) for c in ("posterior", "n_tokens", "rate"))
    names = sorted(mixing.TARGETS)
    aim = np.array([mixing.TARGETS[x] for x in names])
    assert np.abs((r * n) @ p / n.sum() - brute.nearest(p, n, aim / aim.sum())).max() < 2e-3
    assert [x["domain"] for x in rows if np.diff(np.sort(x["posterior"]))[-1] > 1e-5] == [names[int(np.argmax(x["posterior"]))] for x in rows if np.diff(np.sort(x["posterior"]))[-1] > 1e-5]


@pytest.mark.parametrize("aim", [[0.5, 0.3, 0.2], [0.05, 0.05, 0.9], [0.3, 0.69, 0.01]])
def test_rates_are_the_nearest_possible(spark, aim):
    rng = np.random.default_rng(6)
    p, n = rng.dirichlet([5, 1, 0.4], 60), rng.integers(1, 300, 60)
    p[:, 2] = np.minimum(p[:, 2], 0.35)  # so that a share of 0.9 is out of reach
    p /= p.sum(1, keepdims=True)
    df = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(p, n, strict=True)], "posterior array<double>, n_tokens long").coalesce(2).cache()
    fit = mixing.fit_rates(df, ["a", "b", "c"], dict(zip("abc", aim, strict=True)), steps=40)
    want = brute.nearest(p, n.astype(float), np.array(aim))
    assert fit.settled and np.abs(np.array(fit.reached) - want).max() < 2e-3
    missed = np.abs(want - aim).max() > 0.01
    if missed:
        with pytest.warns(UserWarning, match="nearest possible"):
            fit.report(["a", "b", "c"], 0.005, False)
        with pytest.raises(ValueError, match="nearest possible"):
            fit.report(["a", "b", "c"], 0.005, True)
    else:
        fit.report(["a", "b", "c"], 0.005, True)
