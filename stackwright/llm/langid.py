"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of 1 to 3 characters
are hashed into 2**14 buckets. Document frequencies are counted over every learnable document;
the weights are fitted to a bounded sample (MAX_TRAIN_DOCS rows, some of every language) by
follow-the-regularised-leader with L1 and L2 penalties, which leaves most weights exactly 0; a temperature fitted to a part of
the sample that the weights never saw calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackwright.llm.common import columns_of, free_name, slices

BUCKETS = 1 << 14
MAX_TRAIN_DOCS = 3000
LEAST_DOCS = 100
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself for letters and marks of words, else a space."""
    import unicodedata

    out = np.full(0x110000, 32, np.uint32)
    keep = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"]
    out[keep] = keep
    return out


def gram_counts(texts) -> np.ndarray:
    """Hashed counts of the 1- to 3-grams of each text, one row a text."""
    raw = [(" " + (t or "").lower() + "  ").encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 4 for r in raw])
    c = _letters()[np.frombuffer(b"".join(raw), np.uint32)]
    base = (np.repeat(np.arange(len(raw)), size) * BUCKETS).astype(np.int64)
    shift = np.uint32(32 - 14)
    with np.errstate(over="ignore"):
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(31) + c[1:] * np.uint32(0x85EBCA77)
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(31) + c[2:] * np.uint32(0xC2B2AE3D)
        two, three = two * np.uint32(0x2545F491), three * np.uint32(0x2545F491)
    letter = c != 32
    out = np.zeros(len(raw) * BUCKETS, np.int64)
    # a gram counts if it begins or ends in a letter; the padding keeps it within its text
    for h, ok in ((one, letter), (two, letter[:-1] | letter[1:]), (three, letter[1:-1])):
        at = np.flatnonzero(ok)
        out += np.bincount(base[at] + (h[at] >> shift), minlength=len(out))
    return out.reshape(-1, BUCKETS)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1: square roots of the shares, times idf."""
    x = np.sqrt(counts, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, width: int = BUCKETS, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-3, seed: int = 3) -> np.ndarray:
    """Weights [width + 1, classes] by FTRL-proximal on the softmax loss, one row (places, values) at a time.

    Only the coordinates of a row's features are read and moved; a coordinate whose gradient sum
    stays within l1 is exactly 0. The last row is the bias, which has no penalty.
    """
    rng = np.random.default_rng(seed)
    z, n = np.zeros((width + 1, classes), np.float64), np.zeros((width + 1, classes), np.float64)
    lasso, ridge = l1 * len(rows), l2 * len(rows)

    def weights(z, n):
        return np.where(np.abs(z) <= lasso, 0.0, -(z - np.sign(z) * lasso) / ((beta + np.sqrt(n)) / alpha + ridge))

    def moved(at, g, w):
        new = n[at] + g * g
        z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / alpha * w
        n[at] = new

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            w, bias = weights(z[at], n[at]), -z[-1] / ((beta + np.sqrt(n[-1])) / alpha)
            p = _softmax((v @ w + bias)[None])[0]
            p[y[i]] -= 1
            moved(at, v[:, None] * p, w)
            moved(-1, p, bias)
    return np.vstack([weights(z[:-1], n[:-1]), -z[-1:] / ((beta + np.sqrt(n[-1:])) / alpha)]).astype(np.float32)


def _softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def temperature(s: np.ndarray, y: np.ndarray) -> float:
    """What the logits are divided by to give the least log loss, between 1/16 and 8."""
    if not len(y):
        return 1.0
    tried = np.exp(np.linspace(np.log(1 / 16), np.log(8), 121))
    return float(tried[np.argmin([-np.log(_softmax(s / t)[np.arange(len(y)), y] + 1e-12).mean() for t in tried])])


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of those with each bucket, over all rows; BUCKETS numbers at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            for run in slices(pdf["text"]):
                df += (gram_counts(pdf["text"].iloc[run]) > 0).sum(0)
            n += len(pdf)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], n)})

    got = docs.select("text").where("text is not null").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total, df = 0, np.zeros(BUCKETS, np.int64)
    for r in got:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return total, df


def _quotas(counts: dict[str, tuple[int, int]], max_docs: int) -> list[tuple[str, int, int]]:
    """(language, rows to take, hash under which they are found) from each language's numbers of rows and of different texts."""
    whole, least = sum(n for n, _ in counts.values()), min(LEAST_DOCS, max_docs // (2 * max(len(counts), 1)))
    out = []
    for lang, (n, texts) in counts.items():
        quota = max(1, least + (max_docs - least * len(counts)) * n // whole)
        # hashes are spread evenly: twice the quota and some more are under this one, of which the smallest are taken
        share = min(1.0, (2 * quota + 100) / max(texts, 1))
        out.append((lang, quota, min(2**63 - 1, -(2**63) + int(2**64 * share))))
    return out


def fit(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> dict:
    """A model from (text, lang) of docs; rows with null or letterless text or null lang teach nothing.

    The sample is of at most max_docs rows, those of each language with the smallest hashes of their
    text: LEAST_DOCS of every language, however rare, as far as they go, and more by its share of all
    rows. (Of more than max_docs languages the rarest are not learned.) Every fifth row only sets the
    temperature. Without any row the model predicts 'und'; with one language, that one.
    """
    usable = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    total, df = document_frequencies(usable)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    different = F.approx_count_distinct(F.xxhash64("text", "lang"), 0.02)  # copies of a text have one hash
    quota = _quotas({r[0]: (r[1], r[2]) for r in usable.groupBy("lang").agg(F.count("*").alias("n"), different).orderBy(F.desc("n"), "lang").limit(max_docs).collect()}, max_docs)
    rows = usable.select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    if quota:
        known = docs.sparkSession.createDataFrame(quota, "lang string, quota long, edge long")
        rows = rows.join(F.broadcast(known), "lang").where("h <= edge")  # a row a language, at most max_docs
    # copies of one text share a hash: one row of each stands for all
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = rows.dropDuplicates(["lang", "h"]).withColumn("place", place).where("place <= quota") if quota else rows.where("false")
    rows = rows.select("lang", "h", "text")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run in slices(pdf["text"]):
                part = pdf.iloc[run]
                x = tfidf(gram_counts(part["text"]), idf)
                at = [np.flatnonzero(r) for r in x]
                yield pd.DataFrame({"lang": part["lang"].to_numpy(), "h": part["h"].to_numpy(), "at": [a.astype(np.uint16).tobytes() for a in at], "x": [r[a].astype(np.float16).tobytes() for r, a in zip(x, at, strict=True)]})

    got = sorted(rows.mapInPandas(features, "lang string, h long, at binary, x binary").collect(), key=lambda r: r["h"])
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return {"langs": [UNKNOWN], "idf": idf, "w": np.zeros((BUCKETS + 1, 1), np.float32), "t": 1.0}
    rows = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["x"], np.float16).astype(np.float64)) for r in got]
    y = np.array([langs.index(r["lang"]) for r in got])
    held = np.arange(len(y)) % 5 == 4
    w = ftrl([r for r, h in zip(rows, held, strict=True) if not h], y[~held], len(langs))
    logits = np.array([v @ w[at] + w[-1] for (at, v), h in zip(rows, held, strict=True) if h])
    return {"langs": langs, "idf": idf, "w": w, "t": temperature(logits, y[held])}


def predict(model: dict, texts) -> tuple[np.ndarray, np.ndarray]:
    """Language and calibrated probability of each text."""
    best, score = [], []
    for run in slices(texts):
        p = _softmax((tfidf(gram_counts(texts[run]), model["idf"]) @ model["w"][:-1] + model["w"][-1]) / model["t"])
        best.append(p.argmax(1))
        score.append(p.max(1))
    if not best:
        return np.zeros(0, object), np.zeros(0)
    return np.array(model["langs"], object)[np.concatenate(best)], np.concatenate(score).astype(np.float64)


def identify(spark: SparkSession, docs: DataFrame, model: dict, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with columns of the predicted language and its score; 'und' with score 0 where text is null or has no letter.

    Columns of these names are replaced; all others stay, whatever their names. Whole texts of any
    length are read; repeated rows give repeated results; an empty table gives none; of equally
    likely languages the first by name is taken. Texts without a letter never reach Python.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            lang, score = predict(held.value, texts)
            none = texts.isna().to_numpy()
            lang, score = lang.copy(), score.copy()
            lang[none], score[none] = UNKNOWN, 0.0
            yield pd.DataFrame({"lang": lang, "score": score})

    text = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    made = free_name(docs, "_predicted")
    return docs.withColumn(made, of(text)).select(*columns_of(docs, *names), F.col(f"{made}.lang").alias(names[0]), F.col(f"{made}.score").alias(names[1]))
