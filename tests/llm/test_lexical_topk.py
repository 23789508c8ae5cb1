import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stackwright.llm import lexical_topk as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score), every document scored for every item."""
    terms = lambda t: TERM.findall((t or "").translate(LOW))
    bags = [(d, terms(t)) for d, t in docs]
    n, words = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    out = []
    for i, text in items:
        found = []
        for d, w in bags:
            tf = Counter(w)
            m = 100 - 90 + (90 * len(w) * n) // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if t in tf)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def _tables(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice(["", "x", "é", "Ü", "7"])
    texts = [" ".join(word() for _ in range(rng.choice([1, 3, 20, 200]))) for _ in range(n)]
    texts[3:6] = [texts[2]] * 3
    docs = list(enumerate(texts)) + [(None, texts[2]), (n, None), (n + 1, ""), (n + 2, " -_.,\x7f "), (2, texts[2])]
    items = [(i, rng.choice(texts)[:300]) for i in range(12)] + [(1, "AAx aax, b"), (None, texts[2]), (20, None), (21, "."), (22, "nowhere")]
    return docs, items


@pytest.mark.parametrize(("bucket", "first", "chars"), [(512, 4096, 1_000_000), (3, 5, 400)])
def test_against_all_documents(spark, monkeypatch, bucket, first, chars):
    monkeypatch.setattr(X, "FIRST", first)
    monkeypatch.setattr(X, "BLOCK_CHARS", chars)
    docs, items = _tables(3, 120)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3)
    got = X.search(spark, df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(docs, items)))


def _asked(rng, queries, terms, k):
    pair = np.unique(rng.integers(0, terms, queries * 6) * queries + rng.integers(0, queries, queries * 6))
    return X.Asked(np.arange(terms, dtype=np.uint64), pair % queries, pair // queries, queries, rng.integers(0, 9000, terms), np.zeros(queries, np.int64), k)


@pytest.mark.parametrize("heavy", [0, 0.6, 1])
def test_buckets_and_bounds_lose_nothing(monkeypatch, heavy):
    monkeypatch.setattr(X, "HEAVY", heavy)
    monkeypatch.setattr(X, "PAIRS", 7)
    rng = np.random.default_rng(4)
    asked = _asked(rng, 9, 40, 3).prepared()
    docs = [np.sort(rng.choice(40, rng.integers(1, 20), replace=False)) for _ in range(400)]
    xs = [rng.integers(1, 10 ** rng.integers(2, 7), len(d)) for d in docs]
    norm = np.array([np.sqrt((asked.weight[d] * x.astype(float) ** 2).sum()) for d, x in zip(docs, xs, strict=True)])
    order, best, looked = np.argsort(-norm), X.Best(asked), [0, 0]
    for a in range(0, 400, 16):
        part = order[a : a + 16]
        row = np.repeat(np.arange(len(part)), [len(docs[i]) for i in part])
        seen = X.search_bucket(asked, best, part, row, np.concatenate([docs[i] for i in part]), np.concatenate([xs[i] for i in part]), norm[part])
        looked = [x + y for x, y in zip(looked, seen, strict=True)]
    whole = np.zeros((400, 9), np.int64)
    for q, t in zip(asked.query, asked.term, strict=True):
        for i in range(400):
            whole[i, q] += (asked.weight[t] * xs[i][docs[i] == t]).sum()
    for q in range(9):
        want = [i for i in np.lexsort((np.arange(400), -whole[:, q]))[:3] if whole[i, q] > 0]
        assert best.doc[q].tolist() == want and best.score[q].tolist() == whole[want, q].tolist()
    assert looked[0] < 25 * 9 and looked[1] < 400 * 9 / 2  # whole buckets and most pairs were passed over


def test_weights_are_those_of_doubles():
    df = np.array([0, 1, 5, 99, 100])
    assert X.weights(df, 100).tolist() == [math.floor(1000 * math.log(202 / (2 * d + 1))) for d in df.tolist()]


def test_odd_rows(spark):
    long = "word " * 400_000 + "needle"
    docs = spark.createDataFrame([(1, long), (2, "w" * 3_000_000), (3, "Needle")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "needle")], "item_id long, text string")
    assert [tuple(r) for r in X.search(spark, docs, items).orderBy("rank").collect()] == brute([(1, long), (2, "w" * 3_000_000), (3, "Needle")], [(1, "needle")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id > 9"), items)):
        assert X.search(spark, d, i).columns == ["item_id", "rank", "doc_id", "score"] and X.search(spark, d, i).count() == 0


def test_the_longest_vectors_are_taken_where_they_are(spark):
    rows = spark.range(20_000).selectExpr("id doc", "case when id < 15000 then 7.0D else cast(id as double) end norm")
    for n in (100, 1000, 5000, 12_000):
        got = X._longest(rows, n)
        assert 0.8 * n <= got.count() <= 1.2 * n + 50
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert X._longest(rows, 10**6).count() == 20_000 and X._longest(rows.limit(0), 5).count() == 0
