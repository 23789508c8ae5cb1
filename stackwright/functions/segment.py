"""Word segmentation of Han text by a dictionary: the path of highest probability through the graph of its words.

Frequencies are learned from a corpus in one grouped count. A text is a row of atoms, single Han
characters and whole runs of other letters and digits; words are rows of atoms. All places of a
batch walk the dictionary's trie at once, an atom a step; runs are parted where no word lies across,
and the paths of all parts are found together, from their ends. Tokens can be counted by their
numbers where they are cut, so that none of them becomes a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from math import log

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.functions import lexicon
from stackwright.functions import text as X
from stackwright.functions.batches import text_runs
from stackwright.sources.scratch import Scratch

#: Words of a learned dictionary at most (it goes to every task), and characters of one.
MOST_WORDS, LONGEST = 200_000, 4
#: Texts whose groups of characters are counted together at most (1 M characters together, as in batches).
GRAM_TEXTS = 4096
_HAN = "一-鿿"
_ATOM = re.compile(f"[{_HAN}]|(?:(?![{_HAN}])\\w)+")


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups of 1 to LONGEST Han characters of each run of texts with their numbers; a group is a number of 15 bits a character."""
    for texts in text_runs((pdf["text"] for pdf in batches), rows=GRAM_TEXTS):
        code = np.frombuffer("\n".join(t for t in texts if t).encode("utf-32-le"), np.uint32).astype(np.int64) - 0x4E00
        own = (code >= 0) & (code < 0x5200)
        key, whole = code, own
        for n in range(1, LONGEST + 1):
            if n > 1:
                key, whole = (key[:-1] << 15) | code[n - 1 :], whole[:-1] & own[n - 1 :]
            seen, times = np.unique(key[whole], return_counts=True)
            if len(seen):
                chars = (seen[:, None] >> (15 * np.arange(n - 1, -1, -1))) & 0x7FFF
                yield pd.DataFrame({"word": (chars + 0x4E00).astype(np.uint32).view(f"<U{n}").ravel().astype(object), "n": times})


def learn_words(docs: DataFrame, least: int = 10, cohesion: float = 4.0, most: int = MOST_WORDS, column: str = "text") -> DataFrame:
    """word and n: Han characters, and what holds together of 2 to LONGEST of them, by how often they occur.

    A group is a word if it occurs least times and, wherever it is cut in two, cohesion times as
    often as its parts would meet by chance. The most frequent words stay. Null texts hold none.
    """
    counts = docs.select(F.col(column).alias("text")).mapInPandas(_grams, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # grams are as many as the corpus is varied; those that are too rare go before anything is joined
    counts = Scratch(docs.sparkSession, "grams").keep(counts.where((F.col("n") >= least) | (F.length("word") == 1)), "counts")
    total = counts.where(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = counts.where(F.length("word") > 1)
    for cut in range(1, LONGEST):
        left = counts.select(F.col("word").alias("a"), F.col("n").alias(f"a{cut}"))
        right = counts.select(F.col("word").alias("b"), F.col("n").alias(f"b{cut}"))
        words = words.withColumns({"a": F.substring("word", 1, cut), "b": F.expr(f"substring(word, {cut + 1})")}).join(left, "a", "left").join(right, "b", "left").drop("a", "b")
    holds = F.lit(True)
    for cut in range(1, LONGEST):
        chance = F.col("n").cast("double") * F.lit(total) >= F.lit(cohesion) * F.col(f"a{cut}") * F.col(f"b{cut}")
        holds &= F.when(F.length("word") > cut, chance).otherwise(True)
    words = words.where(holds).select("word", "n")
    return words.unionByName(counts.where(F.length("word") == 1)).orderBy(F.desc("n"), "word").limit(most)


#: What a character is: no part of a token, part of a run of letters and digits, or an atom by itself. Known as they are met.
_GAP, _LETTER, _OWN, _UNKNOWN = range(4)
_KINDS = np.full(0x110000, _UNKNOWN, np.int8)
#: Characters of a text that are cut at once, so that what is made of them stays in a processor's cache.
PART = 1 << 17
#: Entries of a trie as a table of nodes by atoms at most; a larger trie is searched.
TABLE = 1 << 23
#: Pieces that are dealt with together at least; of fewer, each is gone through by itself.
TOGETHER = 16


def _kinds(code: np.ndarray) -> np.ndarray:
    found = _KINDS[code]
    new = found == _UNKNOWN
    if new.any():
        for c in np.unique(code[new]).tolist():
            m = _ATOM.match(chr(c))
            _KINDS[c] = _GAP if not m else _OWN if 0x4E00 <= c <= 0x9FFF else _LETTER
        found = _KINDS[code]
    return found


class Trie:
    """Words as rows of atoms with the logarithms of their probabilities; a piece of plain data that tasks share."""

    def __init__(self, words: Mapping[str, int], user_words: Sequence[str] = ()):
        own = {w: n for w, n in words.items() if n > 0}
        self.total = float(sum(own.values()) + 1)
        rows = {tuple(_ATOM.findall(w)): log(n / self.total) for w, n in own.items() if "".join(_ATOM.findall(w)) == w}
        users = {a for w in user_words if "".join(a := tuple(_ATOM.findall(w))) == w and a}
        self._build(rows)
        # a user's word is twice as likely as its best cut, so that it is kept
        for atoms in sorted(users, key=len):
            text = "".join(atoms)
            best = self.score(self.cut([text])[0])
            rows[atoms] = max(rows.get(atoms, -np.inf), best + log(2))
            self._build(rows)

    def _build(self, rows: Mapping[tuple, float]) -> None:
        """Nodes by (node, atom), the root is 0; atoms of words are numbers from 1, all others 0."""
        nodes: dict[tuple[int, int], int] = {}
        weight = [-np.inf]
        self.atoms = {a: i for i, a in enumerate(dict.fromkeys(a for atoms in rows for a in atoms), 1)}
        for atoms, w in rows.items():
            at = 0
            for a in atoms:
                at = nodes.setdefault((at, self.atoms[a]), len(weight))
                if at == len(weight):
                    weight.append(-np.inf)
            weight[at] = w
        keys = np.array([n * (len(self.atoms) + 1) + a for n, a in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()), np.int32)[order]
        self.weight, self.depth = np.array(weight), max((len(a) for a in rows), default=1)
        self.inner = np.zeros(len(weight), bool)
        self.inner[[n for n, _ in nodes if n]] = True
        self.pieces = {a: i for a, i in self.atoms.items() if len(a) > 1}
        self.rows = {"".join(a): w for a, w in rows.items()}
        self._tables = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def tables(self) -> tuple[np.ndarray, np.ndarray | None]:
        """The atom of each character, and the node after each node and atom; made where they are used."""
        if self._tables is None:
            letter, size = np.zeros(0x110000, np.int32), len(self.weight) * (len(self.atoms) + 1)
            for a, i in self.atoms.items():
                if len(a) == 1:
                    letter[ord(a)] = i
            after = np.zeros(size, np.int32) if size <= TABLE else None
            if after is not None:
                after[self.keys] = self.to
            self._tables = letter, after
        return self._tables

    def score(self, tokens: Sequence[str]) -> float:
        """The logarithm of a cut's probability; an unknown atom counts as seen once."""
        return sum(self.rows.get(t, log(1 / self.total)) for t in tokens)

    def _after(self, node: np.ndarray, atom: np.ndarray) -> np.ndarray:
        key, table = node.astype(np.int64) * (len(self.atoms) + 1) + atom, self.tables()[1]
        if table is not None:
            return table[key]
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[spot] == key, self.to[spot], 0)

    def walk(self, atoms: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and weights of the 1, 2, ... atoms from each place, [depth, places], within its run, and places that lie inside a word.

        Where no word begins like them the node is 0, where they are none the weight is minus infinity; single atoms are always taken.
        """
        n = len(atoms)
        node, weight, inside = np.zeros((self.depth, n), np.int32), np.full((self.depth, n), -np.inf), np.zeros(n, bool)
        node[0] = self._after(np.zeros(1, np.int32), atoms)
        weight[0] = np.where(self.weight > -np.inf, self.weight, log(1 / self.total))[node[0]]
        at = np.flatnonzero(self.inner[node[0]])
        for step in range(1, self.depth):
            at = at[at + step < n]
            at = at[~begins[at + step]]
            own = self._after(node[step - 1, at], atoms[at + step])
            at, own = at[own > 0], own[own > 0]
            node[step, at] = own
            weight[step, at] = self.weight[own]
            words = at[self.weight[own] > -np.inf]
            for k in range(1, step + 1):
                inside[words + k] = True
            at = at[self.inner[own]]
        return node, weight, inside

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each token of a text begins and ends, and its number: its word's node, or past these a character; -1 for a run that is no word."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind, at, out = _kinds(code), 0, [(np.zeros(0, np.int64),) * 3]
        gaps = np.flatnonzero(kind == _GAP) if len(code) > PART else np.zeros(0, np.int64)
        while at < len(code):
            # between its runs
            spot = np.searchsorted(gaps, at + PART)
            to = int(gaps[spot]) if spot < len(gaps) else len(code)
            begin, end, number = self._part(text, at, code[at:to], kind[at:to])
            out.append((begin + at, end + at, number))
            at = to
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _part(self, text: str, base: int, code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before = np.concatenate([np.zeros(1, np.int8), kind[:-1]])
        begin = np.flatnonzero((kind == _OWN) | ((kind == _LETTER) & (before != _LETTER)))
        if not len(begin):
            return begin, begin, begin
        end, letters = begin + 1, kind == _LETTER
        end[letters[begin]] = np.flatnonzero(letters & ~np.concatenate([letters[1:], np.zeros(1, bool)])) + 1
        atoms = self.tables()[0][code[begin]]
        several = np.flatnonzero(end - begin > 1)
        atoms[several] = 0
        if self.pieces:
            heads, sizes = np.array([ord(p[0]) for p in self.pieces], np.uint32), np.array([len(p) for p in self.pieces])
            for i in several[np.isin(code[begin[several]], heads) & np.isin((end - begin)[several], sizes)].tolist():
                atoms[i] = self.pieces.get(text[base + begin[i] : base + end[i]], 0)
        nodes, weight, inside = self.walk(atoms, before[begin] == _GAP)
        first, size = self.steps(weight, inside)
        node, begin, end = nodes[size - 1, first], begin[first], end[first + size - 1]
        return begin, end, np.where(self.weight[node] > -np.inf, node, np.where(end - begin == 1, len(self.weight) + code[begin].astype(np.int64), -1))

    def cut(self, texts: Sequence[str | None]) -> list[list[str]]:
        """The tokens of each text: of cuts of equal probability that with the longest first words."""
        whole = "\n".join(t or "" for t in texts)
        begin, end, _ = self.tokens(whole)
        tokens = [whole[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        ends = np.searchsorted(begin, np.cumsum([len(t or "") + 1 for t in texts])).tolist()
        return [tokens[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def steps(self, weight: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word of the best cut, and how many atoms it has.

        Where no word lies over the border of two places, paths before and after it are chosen apart. The
        pieces between such borders lie by their places' distance from the end, longest first, so that
        the best paths of all of them are found together, one place of each at a time.
        """
        depth, n = weight.shape
        first = np.flatnonzero(~inside)
        size = np.diff(first, append=n)
        step, start = np.ones(n, np.int64), ~inside
        own = np.flatnonzero(size > 1)
        own = own[np.argsort(-size[own], kind="stable")]
        if not len(own):
            return first, step[first]
        first, size = first[own], size[own]
        end, most = first + size, int(size[0])
        live = len(own) - np.cumsum(np.bincount(size, minlength=most + 1))[:-1]  # live[t]: pieces of more than t places
        tall = int(np.searchsorted(-live, -TOGETHER, "right"))  # so many places from the end are dealt with together
        base = np.concatenate([[0], np.cumsum(live[:tall])])
        place = end[np.arange(base[-1]) - np.repeat(base[:-1], live[:tall])] - np.repeat(np.arange(1, tall + 1), live[:tall])
        laid, best, chosen = weight[:, place], np.zeros(len(own) + base[-1]), np.ones(base[-1], np.int64)
        # of t places from the end, best has its paths from base[t - 1] + len(own); what is past the end comes first
        past = np.concatenate([[0], base[:-1] + len(own)])
        for t in range(1, tall + 1):
            a, c = base[t - 1], live[t - 1]
            top, to = best[past[t] : past[t] + c], chosen[a : a + c]
            top[:] = -np.inf
            for w in range(min(depth, t), 0, -1):
                value = laid[w - 1, a : a + c] + best[past[t - w] : past[t - w] + c]
                better = value > top + 1e-12
                np.copyto(top, value, where=better)
                np.copyto(to, w, where=better)
        step[place] = chosen
        for r in range(int(live[tall]) if tall < most else 0):
            held = [float(best[past[t] + r]) for t in range(max(tall - depth + 1, 0), tall + 1)]
            rows = weight[:, first[r] : end[r] - tall].T.tolist()
            picked = []
            for t in range(tall + 1, int(size[r]) + 1):
                row, top, to = rows[-(t - tall)], -np.inf, 1
                for w in range(min(depth, t), 0, -1):
                    if row[w - 1] + held[-w] > top + 1e-12:
                        top, to = row[w - 1] + held[-w], w
                held.append(top)
                picked.append(to)
            step[first[r] : end[r] - tall] = picked[::-1]
        at, end = first + step[first], end
        while len(at) >= TOGETHER:
            on = at < end
            at, end = at[on], end[on]
            start[at] = True
            at = at + step[at]
        for i, to in zip(at.tolist(), end.tolist(), strict=True):
            while i < to:
                start[i] = True
                i += int(step[i])
        first = np.flatnonzero(start)
        return first, step[first]


def _held(spark: SparkSession, words: DataFrame, user_words: Sequence[str], most: int) -> Broadcast:
    rows = words.orderBy(F.desc("n"), "word").limit(most).collect()
    return spark.sparkContext.broadcast(Trie({r["word"]: r["n"] for r in rows}, user_words))


def segmenter(spark: SparkSession, words: DataFrame, user_words: Sequence[str] = lexicon.USER_WORDS, most: int = MOST_WORDS) -> Callable[[Column | str], Column]:
    """A tokenizer like text.tokenize that cuts by learned words (word, n) and keeps user words; at most ``most`` words, the most frequent, are used."""
    held = _held(spark, words, user_words, most)

    @F.pandas_udf("array<string>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in text_runs(parts):
            yield pd.Series(held.value.cut(texts.tolist()), index=texts.index, dtype=object)

    return lambda c: of(X.col(c))


#: Sources of several rows that go to every task; of more, texts are joined with them as Spark plans it.
SOURCES_AT_ONCE = 100_000


def _token_rows(texts: pd.Series, sources: np.ndarray, again: np.ndarray, trie: Trie) -> Iterator[pd.DataFrame]:
    """token, n, docs and source: the tokens of texts whose sources have one row together, those of others by source."""
    whole = "\n".join(t or "" for t in texts)
    begin, end, term = trie.tokens(whole)
    if not len(term):
        return
    ends = np.searchsorted(begin, np.cumsum([len(t or "") + 1 for t in texts]))
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    runs, base = np.flatnonzero(term < 0), len(trie.weight) + 0x110000
    numbers, names = pd.factorize(np.array([whole[a:b] for a, b in zip(begin[runs].tolist(), end[runs].tolist(), strict=True)], object))
    term[runs] = base + numbers
    seen = np.zeros(base + len(names), bool)
    seen[term] = True
    own = np.flatnonzero(seen)
    place, some = np.zeros(len(seen), np.int64), np.zeros(len(own), np.int64)
    place[own] = np.arange(len(own))
    term = place[term]
    some[term] = np.arange(len(term))
    words = np.array([whole[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)], object)
    pairs, n = np.unique(row * len(own) + term, return_counts=True)
    row, term = np.divmod(pairs, len(own))
    one = ~again[row]
    total = np.bincount(term[one], n[one], len(own)).astype(np.int64)
    held = total > 0
    docs = np.bincount(term[one & (sources != None)[row]], minlength=len(own))  # noqa: E711
    yield pd.DataFrame({"token": words[held], "n": total[held], "docs": docs[held], "source": pd.Series([None] * int(held.sum()), dtype=object)})
    if not one.all():
        yield pd.DataFrame({"token": words[term[~one]], "n": n[~one], "docs": 0, "source": sources[row[~one]]})


def token_counts(docs: DataFrame, words: DataFrame, user_words: Sequence[str] = lexicon.USER_WORDS, most: int = MOST_WORDS) -> DataFrame:
    """token, n and docs: how often the segmenter's tokens occur in the texts of docs (source, text), and in how many sources (a null is none).

    Tokens are counted where they are cut; only those of sources of several rows are shuffled with their sources.
    """
    spark, held = docs.sparkSession, _held(docs.sparkSession, words, user_words, most)
    again = docs.groupBy("source").agg(F.count("*").alias("rows")).where("source is not null and rows > 1").select("source", F.lit(True).alias("again"))
    again = Scratch(spark, "tokens").keep(again, "again")
    rows = docs.select("source", "text").join(F.broadcast(again) if again.count() <= SOURCES_AT_ONCE else again, "source", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = 0
            for texts in text_runs([pdf["text"]], rows=GRAM_TEXTS):
                part = pdf.iloc[at : at + len(texts)]
                at += len(texts)
                yield from _token_rows(texts, part["source"].astype(object).where(part["source"].notna(), None).to_numpy(), part["again"].notna().to_numpy(), held.value)

    counted = rows.mapInPandas(run, f"token string, n long, docs long, source {docs.schema['source'].dataType.simpleString()}")
    return counted.groupBy("token").agg(F.sum("n").alias("n"), (F.sum("docs") + F.count_distinct("source")).alias("docs"))
