"""Brute-force versions for small tables."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np

from stackwright.llm import pii
from stackwright.llm import quality_mil as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(rows, k, percent=80):
    """{doc_id: (n_shingles, component)} with every pair compared."""
    sets = {d: shingles(t, k) for d, t in rows}
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    top[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def tiles(item, text, k):
    """Greedy string tiling by trying every pair of places."""
    a, b, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and a[i + n] and b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            return sorted((i, j, n) for n, i, j in out)
        out.append(best)
        n, i, j = best
        for x in range(n):
            a[i + x] = b[j + x] = False


def _mask(x, bits=32):
    return x & ((1 << bits) - 1)


def language(model, text):
    """Language and score by a loop over characters."""
    letters = [c if unicodedata.category(c)[0] in "LM" else " " for c in f" {text.lower()}  "]
    if all(c == " " for c in letters):
        return "und", 0.0
    grams = Counter()
    for i, c in enumerate(letters):
        one = _mask(ord(c) * 0x9E3779B1)
        if c != " ":
            grams[one >> 18] += 1
        if i + 1 < len(letters):
            two = _mask((one ^ 0x5BD1E995) * 31 + ord(letters[i + 1]) * 0x85EBCA77)
            if c != " " or letters[i + 1] != " ":
                grams[_mask(two * 0x2545F491) >> 18] += 1
            if i + 2 < len(letters) and letters[i + 1] != " ":
                three = _mask((two ^ 0x27D4EB2F) * 31 + ord(letters[i + 2]) * 0xC2B2AE3D)
                grams[_mask(three * 0x2545F491) >> 18] += 1
    x = {g: math.sqrt(n) * float(model["idf"][g]) for g, n in grams.items()}
    size = math.sqrt(sum(v * v for v in x.values()))
    s = [(sum(v / size * float(model["w"][g, j]) for g, v in x.items()) + float(model["w"][-1, j])) / model["t"] for j in range(len(model["langs"]))]
    e = [math.exp(v - max(s)) for v in s]
    return model["langs"][e.index(max(e))], max(e) / sum(e)


def quality(model, text):
    """A document's score by loops over passages, bytes and words."""
    raw = (text or "").strip(" \t\n\x0b\x0c\r").encode() + b" "
    words, bags = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)], []
    for p in range(0, max(len(words), 1), M.PASSAGE_WORDS):
        x, own = [0.0] * M.FEATURES, words[p : p + M.PASSAGE_WORDS]
        if own:
            a, b = own[0][0], words[p + M.PASSAGE_WORDS][0] if p + M.PASSAGE_WORDS < len(words) else len(raw)
            grams = Counter(_mask(raw[i] * 0x9E3779B1 + raw[i + 1] * 0x85EBCA77 + raw[i + 2] * 0xC2B2AE3D) >> 24 for i in range(a, min(b, len(raw) - 2)))
            for g, n in grams.items():
                x[g] = math.sqrt(n / sum(grams.values())) * 4
            k = M.BUCKETS
            for i, c in enumerate(M.CLASSES):
                x[k + i] = math.sqrt(sum(y in set(c) for y in raw[a:b]) / (b - a)) * 2
            k, n = k + len(M.CLASSES), len(own)
            again = sum(own[i][1] == own[i - 1][1] for i in range(1, n))
            x[k:] = [len({w for _, w in own}) / n * 2, again / n * 4, (b - a) / n / 8, math.log1p(n) / 4, math.log1p(len(words)) / 8]
        bags.append(x)
    dot = lambda v, w: [sum(a * float(b) for a, b in zip(v, w[:, j], strict=True)) for j in range(w.shape[1])]
    h = [[math.tanh(a + float(e)) for a, e in zip(dot(x, model["E"]), model["e"], strict=True)] for x in bags]
    s = [sum(math.tanh(t) / (1 + math.exp(-u)) * float(w) for t, u, w in zip(dot(y, model["V"]), dot(y, model["U"]), model["w"], strict=True)) for y in h]
    a = [math.exp(v - max(s)) for v in s]
    z = [sum(w * y[j] for w, y in zip(a, h, strict=True)) / sum(a) for j in range(len(h[0]))]
    return 1 / (1 + math.exp(-(sum(v * float(c) for v, c in zip(z, model["c"], strict=True)) + float(model["b"]))))


def finds(text, key):
    """(kind, at, n) of personal data by trying every place in turn."""
    out, at = [], 0
    while at < len(text):
        for kind, pattern in pii.PATTERNS.items():
            p = re.compile(pattern, re.ASCII)
            first = p.match(text, at)
            if not first:
                continue
            ends = [first.end()]
            if kind in ("iban", "phone"):
                ends += [e for e in range(first.end() - 1, at, -1) if text[e] in " .(-" and (text[e - 1].isalnum() or text[e - 1] == ")") and p.fullmatch(text, at, e)]
            valid = [e for e in ends if pii._WORK[kind](key, text[at:e]) is not None]
            clear = [e for e in valid if kind not in ("iban", "phone") or not _splits(text, at, e, key)]
            if valid:
                end = (clear or valid)[0]
                out.append((kind, at, end - at))
                at = end - 1
                break
        at += 1
    return out


def _splits(text, at, end, key):
    for start in range(at + 1, end):
        if text[start - 1] in " .(-":
            for kind in ("ipv4", "date", "ssn", "card"):
                m = re.compile(pii.PATTERNS[kind], re.ASCII).match(text, start)
                if m and m.end() > end and pii._WORK[kind](key, m[0]) is not None:
                    return True
    return False


def coverage(item, text, k):
    """Share of an item's tokens that tiles cover; both are texts."""
    a, b = (re.findall(r"[^\W_]+", (t or "").lower()) for t in (item, text))
    if not a:
        return 0.0
    k = min(k, len(a))
    have = {tuple(a[i : i + k]) for i in range(len(a) - k + 1)}
    if not any(tuple(b[i : i + k]) in have for i in range(len(b) - k + 1)):
        return 0.0
    return sum(n for *_, n in tiles(a, b, k)) / len(a)


def nearest(p, n, aim):
    """Rates of at least 0 whose totals are nearest to aim * sum(n), by the active-set method of Lawson and Hanson."""
    a, b = (p * n[:, None]).T, aim * n.sum()
    x, free = np.zeros(len(n)), np.zeros(len(n), bool)
    for _ in range(50 * len(n)):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if w.max() <= 1e-9 * np.abs(b).max() * np.abs(a).max():
            break
        free[w.argmax()] = True
        while True:
            z = np.zeros(len(n))
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min() > 0:
                x = z
                break
            low = free & (z <= 0)
            step = np.min(x[low] / (x[low] - z[low]))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
    return a @ x / n.sum()
