"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded (hashed byte trigrams and
a few densities, through a learned tanh layer); gated attention, learned from document labels
alone, weighs the passages; the weighted passage representation is scored by a logistic unit.

Fitting uses a bounded sample of rows: at most MAX_TRAIN_DOCS labelled documents, which hold at most
MAX_TRAIN_PASSAGES passages together, each document with all of its passages. Scoring encodes every
passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm.common import WORD, slices
from stackwright.llm.textbatch import Words

PASSAGE_WORDS = 64
BUCKETS = 256
MAX_TRAIN_DOCS = 3000
MAX_TRAIN_PASSAGES = 100_000
HIDDEN, GATES = 24, 12

#: Byte classes whose share of a passage is a feature.
CLASSES = [range(65, 91), range(97, 123), range(48, 58), b"#*$%&|<>", b"!", b"?", b".", b",;:", b"\n", b"|", b"\"'()[]{}=/\\_@+-", range(128, 256)]
_CLASS = np.zeros((len(CLASSES), 256), np.float32)
for _i, _c in enumerate(CLASSES):
    _CLASS[_i, list(_c)] = 1
FEATURES = BUCKETS + len(CLASSES) + 5


def encode(texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and where each text's passages start.

    A text without words is one passage of zeros, so it gets a score too.
    """
    w = Words(texts)
    n = np.diff(w.first)
    bags = np.maximum(1, -(-n // PASSAGE_WORDS))
    at = np.concatenate([[0], np.cumsum(bags)])
    x = np.zeros((at[-1], FEATURES), np.float32)
    if not len(w.start):
        return x, at[:-1]
    text = np.repeat(np.arange(len(n)), n)
    passage = at[text] + (np.arange(len(text)) - w.first[text]) // PASSAGE_WORDS
    # bytes of texts that have words; a trigram may reach the space after its text, not the next text
    of = np.repeat(np.arange(len(n)), np.diff(w.text_at))
    at_byte = np.flatnonzero(n[of] > 0)
    by_byte = passage[w.word_of_byte[at_byte]]
    within = at_byte + 2 < w.text_at[of[at_byte] + 1]
    b = w.buf.astype(np.uint32)
    with np.errstate(over="ignore"):
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(24)
    grams = np.bincount(by_byte[within] * BUCKETS + h[at_byte[within]], minlength=len(x) * BUCKETS).reshape(-1, BUCKETS)
    x[:, :BUCKETS] = np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1)) * 4
    counts = np.bincount(by_byte * 256 + w.buf[at_byte], minlength=len(x) * 256).reshape(-1, 256).astype(np.float32)
    size = np.maximum(counts.sum(1), 1)
    k = BUCKETS + len(CLASSES)
    x[:, BUCKETS:k] = np.sqrt(counts @ _CLASS.T / size[:, None]) * 2
    words = np.bincount(passage, minlength=len(x)).astype(np.float32)
    some = np.maximum(words, 1)
    pair = (passage.astype(np.uint64) << np.uint64(32)) | (w.hash >> np.uint64(32))
    pair.sort()
    kinds = np.bincount((pair[np.concatenate([[True], pair[1:] != pair[:-1]])] >> np.uint64(32)).astype(np.int64), minlength=len(x))
    again = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (passage[1:] == passage[:-1])])
    x[:, k] = kinds / some * 2
    x[:, k + 1] = np.bincount(passage, again, len(x)) / some * 4
    x[:, k + 2] = size / some / 8
    x[:, k + 3] = np.log1p(words) / 4
    x[:, k + 4] = np.log1p(np.repeat(n, bags)) / 8
    return x, at[:-1]


def _forward(p: dict, x: np.ndarray, at: np.ndarray) -> dict:
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    s = (t * g) @ p["w"]
    bag = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(x))))
    a = np.exp(s - np.maximum.reduceat(s, at)[bag])
    a /= np.add.reduceat(a, at)[bag]
    z = np.add.reduceat(a[:, None] * h, at)
    return {"h": h, "t": t, "g": g, "a": a, "bag": bag, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["b"])))}


def _gradients(p: dict, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(p, x, at)
    d = (f["y"] - y) / len(y)
    dz = d[:, None] * p["c"]
    da = (dz[f["bag"]] * f["h"]).sum(1)
    ds = f["a"] * (da - np.add.reduceat(f["a"] * da, at)[f["bag"]])
    dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ d, "b": d.sum()}


def train(x: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 40, decay: float = 2e-3, seed: int = 7) -> dict:
    """Attention weights, encoder and classifier from bag labels, by Adam with weight decay."""
    rng = np.random.default_rng(seed)
    rand = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"E": rand(x.shape[1], HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": rand(HIDDEN, GATES), "U": rand(HIDDEN, GATES), "w": rand(GATES), "c": rand(HIDDEN), "b": np.float32(0)}
    m, v = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    ends, step = np.append(at, len(x)), 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(y)), 3e-3 * (1 - epoch / epochs) + 1e-4
        for i in range(0, len(order), 32):
            docs = order[i : i + 32]
            size = ends[docs + 1] - ends[docs]
            own = np.concatenate([[0], np.cumsum(size)[:-1]])
            rows = np.repeat(ends[docs] - own, size) + np.arange(size.sum())
            step += 1
            for k, grad in _gradients(p, x[rows].astype(np.float32), own, y[docs]).items():
                grad = grad + decay * p[k] if k in "EVUwc" else grad
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {k: np.asarray(q, np.float32) for k, q in p.items()}


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for run in slices(pdf["text"]):
            part = pdf.iloc[run]
            x, at = encode(part["text"])
            bags = [x[a:b].astype(np.float16).tobytes() for a, b in zip(at, np.append(at[1:], len(x)), strict=True)]
            yield pd.DataFrame({"label": part["label"].astype("int64"), "bag": bags, "place": part["place"]})


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_docs: int = MAX_TRAIN_DOCS, max_passages: int = MAX_TRAIN_PASSAGES) -> dict:
    """A model of the 0/1 column target of labels, from the texts of docs with the same doc_id.

    The sample is the max_docs labelled ids of the smallest hash, whatever the table's order; of
    these a row that would bring the passages over max_passages is left out, whole. An id that is
    labelled twice has the larger label; a row of docs that is repeated counts as often as it is
    there. Null ids and labels other than 0 and 1 teach nothing, null and empty texts are empty
    bags. Without labelled texts the model is a constant 0.5; with one class, that class's share.
    """
    wanted = labels.select("doc_id", F.col(target).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "label", "text", F.xxhash64("doc_id", "text").alias("place"))  # at most max_docs ids
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    sizes = rows.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(1), F.ceil(words / PASSAGE_WORDS))).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most max_docs rows
    total, over = 0, []
    for doc_id, n in sizes:
        if total + n > max_passages:
            over.append(doc_id)
        else:
            total += n
    if over:
        rows = rows.where(~F.col("doc_id").isin(over))
    got = sorted(rows.drop("doc_id").mapInPandas(_encoded, "label long, bag binary, place long").collect(), key=lambda r: r["place"])
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, FEATURES) for r in got]
    y = np.array([r["label"] for r in got], np.float32)
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return {"b": np.float32(np.log(share / (1 - share)))}
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    return train(np.concatenate(bags), at, y)


def predict(model: dict, texts) -> np.ndarray:
    if "E" not in model:
        return np.full(len(texts), 1 / (1 + np.exp(-float(model["b"]))))
    if not len(texts):
        return np.zeros(0)
    return _forward(model, *encode(texts))["y"].astype(np.float64)


def score(spark: SparkSession, docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1, one of that name being replaced.

    Null and empty texts are scored as empty bags, texts of any length whole; repeated rows get
    equal scores; an empty table gives an empty one. Other columns stay, whatever their names.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([s for run in slices(texts) for s in predict(held.value, texts.iloc[run])], index=texts.index, dtype="float64")

    return docs.withColumn(name, of("text"))
