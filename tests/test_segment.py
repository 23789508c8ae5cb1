import random
from itertools import combinations

import pytest

from stackwright.functions import lexicon
from stackwright.functions import segment as S
from stackwright.operators import retrieval as R


def _cuts(atoms):
    """All ways to cut a row of atoms."""
    for n in range(len(atoms)):
        for at in combinations(range(1, len(atoms)), n):
            edges = [0, *at, len(atoms)]
            yield ["".join(atoms[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def test_best_cut_against_all_cuts():
    rng = random.Random(5)
    chars = "数据库连接配置A"
    words = {"".join(rng.choices(chars, k=rng.randint(1, 4))): rng.randint(1, 500) for _ in range(60)}
    trie = S.Trie(words)
    known = lambda cut: all(t in trie.rows or len(S._ATOM.findall(t)) == 1 for t in cut)
    for _ in range(150):
        text = "".join(rng.choices(chars, k=rng.randint(1, 9)))
        got = trie.cut([text])[0]
        assert "".join(got) == text and known(got)
        assert trie.score(got) == pytest.approx(max(trie.score(c) for c in _cuts(S._ATOM.findall(text)) if known(c)))


def test_a_batch_is_cut_like_its_texts_alone():
    rng = random.Random(2)
    trie = S.Trie({"数据": 9, "数据库": 5, "连接": 7, "库": 1}, lexicon.USER_WORDS)
    texts = ["".join(rng.choices("数据库连接 ，x1", k=rng.randint(0, 30))) for _ in range(200)] + [None, ""]
    assert trie.cut(texts) == [trie.cut([t])[0] for t in texts]


def test_user_words_are_kept():
    trie = S.Trie({"接口": 10**6, "测试": 10**6, "占用": 10**6, "接": 10**7, "口": 10**7}, lexicon.USER_WORDS)
    for w in lexicon.USER_WORDS:
        assert trie.cut([f"（{w}）"]) == [[w]], w
    assert trie.cut(["接口测试用CPU占用, XCPU占用"])[0] == ["接口测试", "用", "CPU占用", "XCPU", "占用"]


def test_a_long_run_and_no_words():
    trie = S.Trie({"数据": 3, "据数": 2})
    assert trie.cut(["数据" * 20_000])[0] == ["数据"] * 20_000
    assert S.Trie({}).cut(["数据 ab"])[0] == ["数", "据", "ab"]


def test_learned_words(spark):
    rng = random.Random(1)
    words = ["网络", "超时", "服务器", "重启", "磁盘空间"]
    docs = spark.createDataFrame([("".join(rng.choices(words, k=20)),) for _ in range(80)] + [(None,), ("none",)], "text string")
    learned = S.learn_words(docs, least=5, cohesion=1.5)
    got = {r["word"]: r["n"] for r in learned.collect()}
    assert set(words) <= set(got) and got["网络"] > 100
    tokens = S.segmenter(spark, learned, ())
    cut = spark.createDataFrame([("服务器重启，磁盘空间超时",), (None,)], "text string").select(tokens("text").alias("t")).collect()
    assert [r["t"] for r in cut] == [["服务器", "重启", "磁盘空间", "超时"], []]
    assert [r["word"] for r in S.learn_words(docs, most=1).collect()] and S.learn_words(docs.limit(0)).count() == 0


def test_the_segmenter_is_a_tokenizer_of_bm25(spark):
    words = spark.createDataFrame([("网络", 9), ("超时", 9), ("重启", 9)], "word string, n long")
    tokens = S.segmenter(spark, words, ())
    chunks = spark.createDataFrame([("a", "网络超时"), ("b", "网络重启"), ("c", "其他内容"), ("d", "别的内容"), ("e", "还有内容")], "id string, content string")
    questions = spark.createDataFrame([(1, "重启网络")], "query_id long, question string")
    top = R.bm25_corpus(questions, R.postings(chunks, tokens), 3, tokens).orderBy("rank").collect()
    assert [r["id"] for r in top] == ["b", "a"]


def _plain(trie, text):
    """The best cut of each run by a loop over its places from the end, the longest first words of equal ones."""
    out, runs, end = [], [], -1
    for m in S._ATOM.finditer(text):
        if m.start() != end:
            runs.append([])
        runs[-1].append(m[0])
        end = m.end()
    for run in runs:
        best, step = [0.0] * (len(run) + 1), [1] * len(run)
        for i in range(len(run) - 1, -1, -1):
            top = -float("inf")
            for w in range(min(trie.depth, len(run) - i), 0, -1):
                own = "".join(run[i : i + w])
                value = trie.rows.get(own, S.log(1 / trie.total) if w == 1 else -float("inf")) + best[i + w]
                if value > top + 1e-12:
                    top, step[i] = value, w
            best[i] = top
        i = 0
        while i < len(run):
            out.append("".join(run[i : i + step[i]]))
            i += step[i]
    return out


@pytest.mark.parametrize(("together", "table", "part"), [(16, 1 << 23, 1 << 17), (1, 0, 40), (10**6, 1 << 23, 7)])
def test_cuts_of_many_texts_against_a_plain_loop(monkeypatch, together, table, part):
    """However many pieces go together, however the trie is read, wherever a text is parted."""
    for name, value in (("TOGETHER", together), ("TABLE", table), ("PART", part)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(7)
    words = {"".join(rng.choices("数据库连接a", k=rng.randint(1, 4))): rng.randint(1, 500) for _ in range(90)} | {"CPU占用": 9, "ab": 4, "x数": 6}
    trie = S.Trie(words, ["Token刷新"])
    texts = ["".join(rng.choices([*"数据库连接数据库连接aX ，\n\U0001f600é", "CPU占用", "ab", "Token刷新"], k=rng.choice([0, 1, 3, 30, 400]))) for _ in range(120)]
    assert trie.cut(texts) == [_plain(trie, t) for t in texts]


@pytest.mark.parametrize("at_once", [100_000, 0])
def test_tokens_are_counted_where_they_are_cut(spark, monkeypatch, at_once):
    monkeypatch.setattr(S, "SOURCES_AT_ONCE", at_once)
    rng = random.Random(3)
    words = spark.createDataFrame([("数据", 9), ("数据库", 5), ("连接", 7), ("库", 1)], "word string, n long")
    texts = ["".join(rng.choices("数据库连接xyé ，12", k=rng.randint(0, 60))) for _ in range(80)] + [None, "", "，", "数据" * 9]
    sources = [None if i % 9 == 0 else f"s{i // 2}" if i % 4 < 2 else f"t{i}" for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(sources, texts, strict=True)), "source string, text string").repartition(3)
    trie, n, holds = S.Trie({"数据": 9, "数据库": 5, "连接": 7, "库": 1}, lexicon.USER_WORDS), {}, {}
    for s, t in zip(sources, texts, strict=True):
        for token in trie.cut([t])[0]:
            n[token] = n.get(token, 0) + 1
            holds.setdefault(token, set()).update({s} - {None})
    got = S.token_counts(docs, words).collect()
    assert {r["token"]: (r["n"], r["docs"]) for r in got} == {t: (k, len(holds[t])) for t, k in n.items()} and len(got) == len(n)
    assert S.token_counts(docs.limit(0), words).count() == 0


def test_texts_of_sources_with_one_row_give_a_row_a_token():
    trie, texts = S.Trie({"数据": 9}, ()), S.pd.Series(["数据 数据 x12"] * 500)
    names = S.np.array([f"s{i}" for i in range(500)], object)
    one = S.pd.concat(S._token_rows(texts, names, S.np.zeros(500, bool), trie))
    assert sorted(one[["token", "n", "docs"]].itertuples(index=False, name=None)) == [("x12", 500, 500), ("数据", 1000, 500)] and one["source"].isna().all()
    again = S.pd.concat(S._token_rows(texts, names, S.np.arange(500) == 7, trie))
    assert sorted(again.query("source == 's7'")[["token", "n", "docs"]].itertuples(index=False, name=None)) == [("x12", 1, 0), ("数据", 2, 0)] and len(again) == 4
