import base64
import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.llm import mixing, token_rollup, warc_index
from stackwright.sources.scratch import Scratch

PAGES = [
    (1, "http://a.example.com/x?q=1#f", "<p>é</p>"), (2, "https://b.example.com", "<p>é</p>"), (3, None, None), (4, "http://a.example.com/x?q=1", ""),
    (5, "no url", "<p>\r\n\r\nlong " + "x" * 50_000), (6, "http://a.example.com/a b", "same"), (6, "http://a.example.com/a b", "same"), (None, "http://c.org/", "same"), (None, "http://d.org/", "alone"),
]


def test_round_trip_through_the_index(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, sha string").repartition(3)
    path = Scratch(spark, "warc-test").root
    captures = warc_index.write_archives(spark, pages, path)
    shards = warc_index.build_index(spark, captures, path, block=2)
    assert warc_index.open_index(path) == shards
    keys = pages.select(warc_index.url_key(F.col("url")).alias("key"))
    found = warc_index.look_up(spark, keys, path, shards)
    got = sorted((r.asDict() for r in warc_index.read_records(found, path, payload=True).collect()), key=lambda r: (r["page_id"] or 0, r["url"] or ""))
    assert len(got) == len(PAGES)
    html = {p[0]: (p[2] or "").encode() for p in PAGES if p[0]}
    top = {}
    for p in PAGES:
        top[p[2] or ""] = max(top.get(p[2] or "", 0), p[0] or 0)
    for r in got:
        if r["page_id"]:
            body = html[r["page_id"]]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
            keeper = top[body.decode()]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if keeper == r["page_id"] else ("revisit", keeper))
            assert bytes(r["payload"]) == (body if r["record_type"] == "response" else b"")
    nulls = [r for r in got if r["page_id"] is None]
    assert sorted((r["record_type"], r["refers_to"]) for r in nulls) == [("response", None), ("revisit", 6)]
    none = spark.createDataFrame([("zz,nothing)/",), ("",), (None,)], "key string")
    assert warc_index.look_up(spark, none, path, shards).count() == 0


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x"), (3, "http://c/", "yyyy"), (4, "http://d/", "yyyy")], "page_id long, url string, html string")
    path = Scratch(spark, "warc-test").root
    rows = warc_index.read_records(warc_index.write_archives(spark, pages, path, least=2), path).collect()
    assert {r["page_id"]: r["record_type"] for r in rows} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_records_are_plain_gzip_members():
    raw = zlib.decompress(warc_index.record(1, "http://a/ b", b"p", 1, "D", None), 31)
    assert raw.startswith(b"WARC/1.0\r\nWARC-Type: response\r\n") and raw.endswith(b"p\r\n\r\n") and b"http://a/%20b" in raw


def test_empty_pages(spark):
    path = Scratch(spark, "warc-test").root
    captures = warc_index.write_archives(spark, spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_index.build_index(spark, captures, path) == [] == warc_index.open_index(path)
    found = warc_index.look_up(spark, spark.createDataFrame([("a)/",), (None,)], "key string"), path, [])
    assert found.count() == 0 and warc_index.read_records(found, path).count() == 0


def test_files_of_attempts_that_did_not_count_go(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", f"body {i}") for i in range(20)], "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/w"
    for folder, stale in (("archive", "part-00000-0-dead.warc.gz"), ("index", "part-00000-0-dead.dir")):
        os.makedirs(f"{tmp_path}/w/{folder}")
        open(f"{tmp_path}/w/{folder}/{stale}", "w").close()
    captures = warc_index.write_archives(spark, pages, path)
    shards = warc_index.build_index(spark, captures, path)
    files = {r["file"] for r in captures.select("file").collect()}
    assert set(os.listdir(f"{tmp_path}/w/archive")) == files
    assert {x for x in os.listdir(f"{tmp_path}/w/index") if x.startswith("part-")} == {f"{s}{e}" for _, s in shards for e in (".cdx.gz", ".dir")}
    assert warc_index.read_records(warc_index.look_up(spark, captures.select("key"), path, shards), path).count() == 20


CHANGE = "op string, source string, lang string, tokenizer string, n_tokens long, old_source string, old_lang string, old_tokenizer string, old_n_tokens long"


def test_batches_count_once(spark):
    r = token_rollup.Rollup(spark, Scratch(spark, "rollup-test").root)
    assert r.totals().count() == 0
    one = spark.createDataFrame([("insert", "a", "en", "t", 5, None, None, None, None), ("insert", "a", None, "t", 2, None, None, None, None), ("insert", "b", "en", "t", None, None, None, None, None)], CHANGE)
    two = spark.createDataFrame([("revise", "b", "en", "u", 7, "a", "en", "t", 5), ("delete", "b", "en", "t", 0, None, None, None, None)], CHANGE)
    assert r.commit("x/1", one) and not r.commit("x/1", one)
    assert r.commit("x/2", two)
    want = [("a", None, "t", 1, 2), ("b", "en", "u", 1, 7)]
    assert sorted(tuple(t) for t in r.totals().collect()) == want
    r.compact()
    assert not r.commit("x/2", two) and r.committed() == {"x/1", "x/2"}
    assert sorted(tuple(t) for t in r.totals().collect()) == want
    assert r.commit("x/3", two.where("op = 'nothing'"))
    with pytest.raises(Exception, match="a change needs op"):
        r.commit("x/4", one.withColumn("op", F.lit("?")))
    assert "x/4" not in r.committed()


def test_token_counts(spark):
    import tiktoken

    docs = spark.createDataFrame([(1, "Hello, world! é"), (2, None), (3, ""), (4, "a" * 50_000)], "doc_id int, text string")
    with open(f"{token_rollup.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    enc = tiktoken.Encoding("t", pat_str=token_rollup.SPLIT, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["n_tokens"] for r in token_rollup.count_tokens(spark, docs, "byte_bpe_50k").collect()}
    assert got == {1: len(enc.encode_ordinary("Hello, world! é")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("a" * 50_000))}
    assert [r["n_tokens"] for r in token_rollup.count_tokens(spark, docs, "words").orderBy("doc_id").collect()] == [3, 0, 0, 1]


def test_rates_reach_their_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([5, 1, 0.3], 400)
    n = rng.integers(0, 500, 400)
    df = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(p, n, strict=True)], "posterior array<double>, n_tokens long").cache()
    for target in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.9, "b": 0.08, "c": 0.02}):
        fit = mixing.fit_rates(df, ["a", "b", "c"], target, steps=12)
        history, share = fit.steps, fit.reached
        r = np.ones(400)
        for step in history:  # the same projected steps by hand
            r = np.maximum(0, r - p @ np.array(step))
        by_hand = (r * n) @ p / n.sum()
        assert np.allclose(share, by_hand, atol=1e-9) and (r >= 0).all()
        got = np.array([x[0] for x in df.select(mixing._rate(history)).collect()])
        assert np.allclose(got, r)
        if min(target.values()) > 0:
            assert np.allclose(share, list(target.values()), atol=2e-3)


def test_mixing_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good text here", 3), (2, "bad bad words", 3), (3, None, 3), (4, "", 3), (None, "good", 3)], "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(spark, docs, mixing.domains_of(labels)).collect()
    assert len(rows) == 5 and all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-6 for r in rows)
    assert {r["rate"] for r in mixing.mix(spark, docs, mixing.domains_of(labels.limit(0))).collect()} == {1.0}
    assert mixing.with_rates(spark, docs, mixing.domains_of(labels)).columns == ["doc_id", "text", "rate"]
    assert mixing.mix(spark, docs.limit(0), mixing.domains_of(labels)).count() == 0


@pytest.mark.parametrize("lacks", ["old_source", "old_n_tokens", None])
def test_a_revision_that_cannot_be_applied_raises(spark, lacks):
    row = {"op": "revise", "source": "a", "lang": "en", "tokenizer": "t", "n_tokens": 3, "old_source": "b", "old_lang": "en", "old_tokenizer": "t", "old_n_tokens": 5 if lacks else None}
    row.pop(lacks, None)
    kinds = {"n_tokens": "long", "old_n_tokens": "long"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))
    with pytest.raises(Exception, match="a revised row needs old"):
        token_rollup.signed(df).collect()
    assert token_rollup.signed(df.withColumn("op", F.lit("insert"))).count() == 1


def test_publishing_onto_a_table_raises(spark):
    rollup = token_rollup.Rollup(spark, Scratch(spark, "twice").path("r"))
    one = spark.createDataFrame([("a", "en", "t", 1, 1)], token_rollup.DELTA)
    rollup._publish(one, "batch-x")
    with pytest.raises(OSError):
        rollup._publish(one, "batch-x")
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 1)]
