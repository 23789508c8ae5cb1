import random
import uuid

import pytest

from stackwright.llm import neardup as N
from stackwright.llm.common import connected_components
from tests.llm import brute

DOCS = "doc_id long, text string"


def _corpus(seed, families=6, members=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for f in range(families):
        base = [word() for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 16])):
                w[rng.randrange(len(w))] = word()
            rows.append((n, rng.choice([" ", "\n"]).join(w)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "one"), (n + 3, "ONE"), (n + 4, " \n "), (n + 5, "Ä b"), (n + 6, "ä b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_against_all_pairs(spark, k):
    rows = _corpus(k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.find_duplicates(spark, spark.createDataFrame(rows, DOCS), k).collect()}
    assert got == brute.components(rows, k)


def test_repeats_nulls_and_clashing_names(spark):
    rows = [(1, "a b c d e f", 9), (1, "a b c d e f", 9), (2, "a b c d e f", 8), (None, "a b c d e f", 7), (3, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(tuple(r) for r in N.find_duplicates(spark, df).select("doc_id", "component_id", "kept").fillna(-1).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = N.drop_duplicates(spark, df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3]


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert N.find_duplicates(spark, df).count() == 0
    assert N.drop_duplicates(spark, df).count() == 0


def test_long_chain_of_links(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (None, 5), (200, 201)], "u long, v long").where("u is not null")
    got = {r["node"]: r["component"] for r in connected_components(spark, edges).distinct().collect()}
    assert got == {i: 0 for i in range(n + 1)} | {200: 200, 201: 200}


@pytest.mark.parametrize("listed", [0, 2])
def test_larger_buckets_against_all_pairs(spark, monkeypatch, listed):
    monkeypatch.setattr(N, "LISTED", listed)
    rows = _corpus(9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.find_duplicates(spark, spark.createDataFrame(rows, DOCS), 2).collect()}
    assert got == brute.components(rows, 2)


@pytest.mark.parametrize(("listed", "most"), [(32, 0), (2, 400)])
def test_a_template_of_low_similarity_is_not_one_family(spark, monkeypatch, tmp_path, listed, most):
    rng = random.Random(4)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n))
    shared = own(46)
    rows = [(i, f"{shared} {own(54)}") for i in range(400)]  # similarity 0.3
    rows += [(400, rows[7][1] + " x"), (401, rows[8][1] + " y")]
    cells, folder = N._cells, str(tmp_path)

    def counting(k, test):
        real = cells(k, test)

        def run(batches):
            def seen():
                for pdf in batches:
                    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                        f.write(str(len(pdf)))
                    yield pdf

            return real(seen())

        return run

    monkeypatch.setattr(N, "_cells", counting)
    if hasattr(N, "LISTED"):
        monkeypatch.setattr(N, "LISTED", listed)
    got = {r["doc_id"]: r["component_id"] for r in N.find_duplicates(spark, spark.createDataFrame(rows, DOCS), 1).collect()}
    assert got == {i: i for i in range(400)} | {400: 7, 401: 8}
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) <= most


@pytest.mark.parametrize(("edges", "rounds"), [([(5, 1), (1, 3), (7, 2)], 0), ([(2, 1), (2, 3)], 1), ([], 0)])
def test_components_take_no_round_once_edges_are_stars(spark, monkeypatch, edges, rounds):
    from stackwright.llm import common

    made, real = [], common._large_star
    monkeypatch.setattr(common, "_large_star", lambda *a: made.append(1) or real(*a))
    got = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame([*edges, (4, 4), (None, 1)], "u long, v long")).collect()}
    assert len(made) == rounds
    assert got == {n: min(x for e in edges if any(n in f and set(e) & set(f) for f in edges) for x in e) for n in {n for e in edges for n in e}}
