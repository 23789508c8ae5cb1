import random

import numpy as np
import pytest

from stackwright.llm import jaccard_join as J
from stackwright.llm import neardup as N
from tests.llm import brute
from tests.llm.test_neardup import _corpus

DOCS = "doc_id long, text string"


def _set(rng, n):
    return np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_bands_allow_for_all_differences(percent):
    for counts in ({}, {0: 10, 3: 10}, {i: 10**10 for i in range(8)}):
        for b in J.bands({7: 0} | counts, percent).values():
            assert 0 <= b.d <= b.m and b.m + b.d >= J.needed(b.high - 1, percent)
    # exact arithmetic: sets that differ in more are less alike
    for a in range(1, 60):
        for b in range(a, 100 * a // percent + 1):
            apart = J.differences(a + b, percent)
            both = (a + b - apart) // 2
            assert (a + b - apart) % 2 or 100 * both >= percent * (a + b - both)
            less = (a + b - apart - 1) // 2
            assert 100 * less < percent * (a + b - less)


def test_costs_choose_deletions_for_many_sets():
    few, many = J.allocate(18, 36, 10, 90), J.allocate(18, 36, 10**10, 90)
    assert few.d < many.d and few.m > many.m


@pytest.mark.parametrize("double", [0, 0.3, 1])
@pytest.mark.parametrize("percent", [80, 90])
def test_every_similar_pair_shares_a_key(double, percent):
    rng = np.random.default_rng(5)
    table = {}
    for i, b in J.bands({9: 0}, percent).items():
        most = J.needed(b.high - 1, percent)
        m = max(-(-most // 2), round(most * (1 - double / 2)))
        table[i] = J.Band(b.low, b.high, m, most - m)
    met = 0
    for _ in range(1500):
        a = _set(rng, int(rng.choice([5, 9, 10, 17, 19, 35, 40, 80, 300])))
        more, less = rng.integers(0, len(a) // 8 + 2, 2)
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[less:]], _set(rng, int(more))]))
        both = len(np.intersect1d(a, b))
        if len(b) and not np.array_equal(a, b) and 100 * both >= percent * (len(a) + len(b) - both):
            met += 1
            assert len(np.intersect1d(J.keys(a, table, percent), J.keys(b, table, percent)))
            assert J.Parities(percent).array(np.array([len(a)]), J.parities(a).view(np.uint64)[None], len(b), J.parities(b).view(np.uint64))[0]
    assert met > 200


def test_keys_grow_with_what_is_needed_only():
    rng = np.random.default_rng(1)
    table = J.bands({12: 0, 5: 100_000}, 90)
    s = _set(rng, 20_000)
    assert len(J.keys(s, table, 90)) <= 2.2 * J.needed(len(s), 90)


@pytest.mark.parametrize(("k", "percent", "listed"), [(1, 80, 0), (3, 90, 32)])
def test_against_all_pairs(spark, monkeypatch, k, percent, listed):
    monkeypatch.setattr(N, "LISTED", listed)
    rows = _corpus(k, 8, 20)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similarity_components(spark, spark.createDataFrame(rows, DOCS), k, percent).collect()}
    assert got == brute.components(rows, k, percent)


def test_small_sets_against_all_pairs(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4) for _ in range(n)] for n in (1, 2, 3, 8, 9, 10, 11, 12, 18, 19, 20)]
    rows = [(i * 100 + j, " ".join(w[:cut] + w[cut + 1 :] * (j % 3 != 2))) for i, w in enumerate(base) for j, cut in enumerate(range(len(w)))]
    rows += [(i * 100 + 99, " ".join(w)) for i, w in enumerate(base)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similarity_components(spark, spark.createDataFrame(rows, DOCS), 1, 90).collect()}
    assert got == brute.components(rows, 1, 90)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 9001}" for i in range(300_000))
    rows = [(1, "A b c d", 1), (1, "A b c d", 2), (2, "a B c d", 3), (None, "a b c d", 4), (3, None, 5), (4, " \n ", 6), (5, long, 7), (6, long + " x", 8), (7, "w" * 3_000_000, 9), (8, "a b c d e", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(tuple(-1 if v is None else v for v in (r["doc_id"], r["component_id"])) for r in J.similarity_components(spark, df, 3, 90).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8)]
    assert J.similarity_components(spark, df.limit(0), 3, 90).count() == 0
    with pytest.raises(ValueError):
        J.similarity_components(spark, df, 3, 100)
