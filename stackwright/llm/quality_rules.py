"""Quality rules with host-level verdicts.

Base rules count words, symbols, repeated lines and repeated windows in every whole text. Failures
are then aggregated by host (``source``): each host's failure rate is shrunk with a beta prior
whose parameters are fitted to all hosts by the moments of the beta-binomial, and documents of a
host whose shrunk rate is over the limit are dropped with it.

Main path: DataFrame functions only. Texts never leave the scan: only the counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm.common import join_keyed
from stackwright.sources.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: A host is dropped if over this share of its documents fails, after shrinking.
HOST_LIMIT = 0.5
#: The most documents that the prior may weigh.
STRONGEST = 10_000.0


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _covered(hashes: Column) -> Column:
    """How many words stand in 3-word windows found twice or more; hashes: one per window."""

    def count(order: Column) -> Column:
        # order: windows sorted by (hash, place); a window repeats if a neighbour has its hash
        found = F.filter(
            F.transform(order, lambda x, i: F.when((F.get(order, i - 1)["h"] == x["h"]) | (F.get(order, i + 1)["h"] == x["h"]), x["i"])),
            lambda p: p.isNotNull(),
        )
        return _let(F.array_sort(found), lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x))

    placed = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(placed(h), count)))


def _counts(text: Column) -> Column:
    def of(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _covered(windows).cast("long").alias("n_repeat_words"),
        )

    return _let(words_of(text), of)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the five counts and base_failed of every document; one narrow pass."""
    text = F.col("text")
    return (
        docs.select("doc_id", F.col(host).alias("host"), _counts(text).alias("c"), F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"), _dup_lines(text).alias("n_dup_lines"))
        .select("doc_id", "host", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")
        .withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    )


def _prior(hosts: int, n: float | None, k: float | None, k2_n: float | None, n2: float | None) -> tuple[float, float]:
    """Mean and strength from the number of hosts and the sums of n, k, k^2/n and n^2 over them."""
    if not n:
        return 0.0, STRONGEST
    m = k / n
    noise = m * (1 - m)
    known = n - n2 / n - (hosts - 1)
    if noise == 0 or known <= 0:
        return m, STRONGEST
    r = ((k2_n - k * k / n) / noise - (hosts - 1)) / known
    return m, min(max(1 / r - 1, 1.0), STRONGEST) if r > 0 else STRONGEST


def host_verdicts(counted: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, failed, shrunk rate and host_failed.

    The prior's mean m is the share of all documents that fail. Of the spread of the hosts' rates
    around it, weighted by n, what drawing n documents a host would give anyway is taken off; the
    rest, as a correlation r within hosts, gives the strength s = 1/r - 1, kept between 1 and 10,000
    (10,000 where hosts of one document each tell nothing of it). The shrunk rate is
    (failed + m s)/(n + s). A null host is a host of its own; without rows there are none.
    """
    hosts = counted.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    k, n = F.col("failed").cast("double"), F.col("n").cast("double")
    m, strength = _prior(*hosts.agg(F.count("*"), F.sum(n), F.sum(k), F.sum(k * k / n), F.sum(n * n)).first())  # five numbers, whatever the size
    shrunk = hosts.withColumn("rate", (F.col("failed") + m * strength) / (F.col("n") + strength))
    return shrunk.select("host", "n", "failed", "rate", (F.col("rate") > limit).alias("host_failed"))


def judge_documents(spark: SparkSession, docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Per document its counts, base_failed, host_failed and kept.

    A null or blank text has no words and fails; a null host groups with the other null hosts;
    repeated rows give repeated results; an empty table gives none. Other columns are ignored.
    """
    scratch = Scratch(spark, "quality-rules")
    counted = scratch.keep(base_counts(docs, host), "counts")
    named = F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit("")).alias("_host")  # a null host is one, too
    verdicts = scratch.keep(host_verdicts(counted, limit).select(named, "n", "host_failed"), "verdicts")
    both = join_keyed(counted.select("*", named), verdicts, "_host", counted.count()).drop("_host")
    return both.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
