"""Mixing sources to target weights, with soft membership.

A classifier fitted to a labelled table gives every document posterior probabilities of the
domains. Rates r >= 0 of documents are then fitted by distributed projected-gradient least squares
so that expected domain totals, the sums of r * tokens * posterior, match the target shares. The
start is one everywhere; a step moves each document along its posteriors, so a rate depends only on
posteriors and the few step vectors so far, and an iteration is one pass
over the table of posteriors that gives a few numbers a pair of domains.

The classifier is a multinomial logistic regression on hashed words, fitted to at most
MAX_TRAIN_DOCS labelled documents of the smallest hashes.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm.common import WORD, columns_of, free_name, slices
from stackwright.llm.textbatch import Words
from stackwright.sources.scratch import Scratch

BUCKETS = 4096
MAX_TRAIN_DOCS = 3000
#: Domains are quality/toxic pairs of labels; tokens go to clean text first.
TARGETS = {"good": 0.84, "good-toxic": 0.05, "poor": 0.1, "poor-toxic": 0.01}
STEPS = 40
TOLERANCE = 1e-4
#: A step that makes the squared distance to the targets less by a smaller share than this has gained nothing.
SETTLED = 1e-9
#: Steps after which the rates so far are written out.
REST = 8


def features(texts) -> np.ndarray:
    """Square roots of hashed word shares, twice: words as they are, and the symbols and case around them."""
    w = Words(texts)
    n = np.diff(w.first)
    text = np.repeat(np.arange(len(n)), n)
    x = np.bincount(text * BUCKETS + (w.hash >> np.uint64(52)).astype(np.int64), minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS).astype(np.float32)
    x = np.sqrt(x / np.maximum(n, 1)[:, None]) * 8
    by_text = np.repeat(np.arange(len(n)), np.diff(w.text_at))
    chars = np.bincount(by_text * 256 + w.buf, minlength=len(n) * 256).reshape(len(n), 256).astype(np.float32)
    return np.hstack([x, np.sqrt(chars / np.maximum(chars.sum(1, keepdims=True), 1)) * 4])


def _softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit_domains(docs: DataFrame, labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS, epochs: int = 30, seed: int = 5) -> dict:
    """A model of labelled (doc_id, domain) from the texts of docs; null ids and domains are left out."""
    wanted = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("domain", "text", F.xxhash64("doc_id", "text").alias("place"))  # at most max_docs ids

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run in slices(pdf["text"]):
                part = pdf.iloc[run]
                yield pd.DataFrame({"domain": part["domain"], "place": part["place"], "x": [r.astype(np.float16).tobytes() for r in features(part["text"])]})

    got = sorted(rows.mapInPandas(encoded, "domain string, place long, x binary").collect(), key=lambda r: r["place"])
    names = sorted({r["domain"] for r in got})
    if not names:
        return {"names": [], "w": np.zeros((1, 0), np.float32)}
    x = np.ones((len(got), BUCKETS + 257), np.float32)  # the last column is the bias's
    for i, r in enumerate(got):
        x[i, :-1] = np.frombuffer(r["x"], np.float16)
    y = np.array([names.index(r["domain"]) for r in got])
    w, m, v = (np.zeros((x.shape[1], len(names)), np.float32) for _ in range(3))
    step = 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            rows_ = order[i : i + 64]
            p = _softmax(x[rows_] @ w)
            p[np.arange(len(rows_)), y[rows_]] -= 1
            g = x[rows_].T @ p / len(rows_) + 1e-4 * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.02 * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"names": names, "w": w}


def posteriors(spark: SparkSession, docs: DataFrame, model: dict, name: str = "posterior") -> DataFrame:
    """docs with an array of the domains' probabilities, in the order of model['names']."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            w, p = held.value["w"], []
            for run in slices(texts):
                p += list(_softmax(features(texts.iloc[run]) @ w[:-1] + w[-1]).astype(np.float64))
            yield pd.Series(p, index=texts.index, dtype=object)

    return docs.withColumn(name, of("text"))


@dataclass
class Fit:
    """Step vectors, the shares of tokens that they reach, the shares aimed at, and whether more steps would gain nothing."""

    steps: list[list[float]]
    reached: list[float]
    aimed: list[float]
    settled: bool

    def report(self, names: list[str], tolerance: float, strict: bool) -> None:
        """Warns, or raises, where a domain is off its target by more than the tolerance."""
        if not names or max(abs(r - a) for r, a in zip(self.reached, self.aimed, strict=True)) <= tolerance:
            return
        said = ", ".join(f"{x} {r:.4f} (target {a:.4f})" for x, r, a in zip(names, self.reached, self.aimed, strict=True))
        said = f"shares reached {'are the nearest possible' if self.settled else 'may be off for want of steps'}: {said}"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=3)


def _rate(history: list[list[float]], posterior="posterior", start=None):
    """The rate after these steps from the start (1); one expression, evaluated row by row in the JVM."""
    start = F.lit(1.0) if start is None else start
    if not history:
        return start
    steps = F.array(*[F.array(*[F.lit(float(c)) for c in h]) for h in history])
    dot = lambda h: F.aggregate(F.zip_with(F.col(posterior), h, lambda p, c: p * c), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(steps, start, lambda r, h: F.greatest(F.lit(0.0), r - dot(h)))


def fit_rates(weighed: DataFrame, names: list[str], targets: dict[str, float], steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """Fits rates to weighed (posterior, n_tokens): the step vectors for _rate, and how far they came.

    Least squares of the distance between totals and targets over rates of at least 0. A step is
    taken in the metric of the inverse curvature of the documents that are free to move, where it
    is exact if it pushes no rate to 0. As projection may spoil that, several dampings and lengths
    of the step, and the plain gradient step, which always gains, are tried in one pass, and the
    best is taken. Targets are shares of all tokens; domains without one keep what they have, and
    shares are scaled to sum to 1.
    Ends when every domain is within tolerance of its target, as a share of all tokens; when no
    step gains anything, so that the targets cannot be met and the totals are the nearest that
    can; or after so many steps. Rates are written out every REST steps, so that a pass evaluates
    few of them.
    """
    d = range(len(names))
    p = [F.col("posterior")[i] for i in d]
    n = F.col("n_tokens")
    pairs = [(i, j) for i in d for j in d if i <= j]
    scratch = Scratch(weighed.sparkSession, "rates")
    rated, since = weighed.select("posterior", "n_tokens", F.lit(1.0).alias("at")), []

    def rows(more):
        return rated.select("posterior", "n_tokens", _rate(more, "posterior", F.col("at")).alias("r"))

    def state(more):
        """Totals, and the curvature over documents whose rate is above 0, after these further steps."""
        free = F.when(F.col("r") > 0, n).otherwise(0)
        one = rows(more).agg(F.coalesce(F.sum(n), F.lit(0)).alias("all"), *[F.sum(F.col("r") * n * p[i]).alias(f"t{i}") for i in d], *[F.sum(free * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
        g = np.array([[one[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in d] for i in d])
        return float(one["all"]), np.array([one[f"t{i}"] or 0.0 for i in d]), g

    def totals(more, tried):
        """Totals after these further steps and each of those tried."""
        moved = [F.greatest(F.lit(0.0), F.col("r") - sum((F.lit(c) * p[i] for i, c in enumerate(step)), F.lit(0.0))) for step in tried]
        one = rows(more).select("posterior", "n_tokens", *[m.alias(f"m{j}") for j, m in enumerate(moved)]).agg(*[F.sum(F.col(f"m{j}") * n * p[i]) for j in range(len(tried)) for i in d]).first()
        return np.array(one, float).reshape(len(tried), len(names))

    history: list[list[float]] = []
    whole, total, g = state([])
    if not whole:
        return Fit([], [0.0] * len(names), [0.0] * len(names), True)
    aim = np.array([targets.get(x, total[i] / whole) for i, x in enumerate(names)])
    aim = aim / aim.sum()
    steepest = np.linalg.eigvalsh(g).max()
    settled = False
    while np.abs(total / whole - aim).max() > tolerance and len(history) < steps:
        off, size = total - aim * whole, np.trace(g) / len(names)
        tried = [t * np.linalg.solve(g + (damp * size + 1e-9) * np.eye(len(names)), off) for damp in (1e-6, 1e-3, 1e-1) for t in (1, 2, 0.3, 0.1)]
        tried = [[float(c) for c in step] for step in (*tried, off / steepest)]
        gap = np.square(totals(since, tried) / whole - aim).sum(1)
        best = int(gap.argmin())
        if settled := bool(gap[best] > np.square(off / whole).sum() * (1 - SETTLED)):
            break
        history.append(tried[best])
        since.append(tried[best])
        if len(since) == REST:
            rated, since = scratch.keep(rated.withColumn("at", _rate(since, "posterior", F.col("at"))), f"after{len(history)}"), []
        _, total, g = state(since)
    scratch.drop()
    share = total / whole
    return Fit(history, [float(x) for x in share], [float(x) for x in aim], bool(settled or np.abs(share - aim).max() <= tolerance))


def _n_tokens():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _weighed(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    rows = posteriors(spark, docs.select("doc_id", "text"), model).select("doc_id", "posterior", _n_tokens().alias("n_tokens"))
    return Scratch(spark, "mixing").keep(rows, "posteriors")


def mix(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, max_docs: int = MAX_TRAIN_DOCS, steps: int = STEPS, strict: bool = False) -> DataFrame:
    """Per document doc_id, domain (the likeliest), posterior, n_tokens (words) and rate.

    A rate is how often a document should be drawn, in expectation; 0 means never. Null and empty
    texts have no tokens and no say; their rate follows their posteriors like any other's. Without
    labels there are no domains and every rate is 1. Repeated rows are counted and rated each; of
    equally likely domains the first by name is the document's; other columns are ignored; an
    empty table gives no rows. Targets that are missed give a warning, or raise if strict.
    """
    model = fit_domains(docs, labelled, max_docs)
    if not model["names"]:
        return docs.select("doc_id", F.lit(None).cast("string").alias("domain"), F.expr("cast(array() as array<double>)").alias("posterior"), _n_tokens().alias("n_tokens"), F.lit(1.0).alias("rate"))
    weighed = _weighed(spark, docs, model)
    fit = fit_rates(weighed, model["names"], targets, steps)
    fit.report(model["names"], TOLERANCE, strict)
    names = F.array(*[F.lit(x) for x in model["names"]])
    best = F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    return weighed.select("doc_id", best.alias("domain"), "posterior", "n_tokens", F.round(_rate(fit.steps), 6).alias("rate"))


def with_rates(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, max_docs: int = MAX_TRAIN_DOCS, steps: int = STEPS, name: str = "rate", strict: bool = False) -> DataFrame:
    """docs with a column of the rates that mix() gives; one of that name is replaced, the others stay.

    Posteriors are computed again beside the texts, so that no text is shuffled.
    """
    model = fit_domains(docs, labelled, max_docs)
    if not model["names"]:
        return docs.withColumn(name, F.lit(1.0))
    fit = fit_rates(_weighed(spark, docs, model), model["names"], targets, steps)
    fit.report(model["names"], TOLERANCE, strict)
    made = free_name(docs, "_posterior")
    return posteriors(spark, docs, model, made).select(*columns_of(docs, name), F.round(_rate(fit.steps, made), 6).alias(name))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic flags; a null flag labels nothing."""
    return labels.select("doc_id", F.concat(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor"), F.when(F.col("toxic") == 1, "-toxic").when(F.col("toxic") == 0, "")).alias("domain"))
