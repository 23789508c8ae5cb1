"""Shared parts of the training-data operators: names, slices of batches, skewed joins, connected components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.sources.scratch import Scratch

#: White space of the word rule: words are runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _same(df: DataFrame):
    """What two names must have in common to be one name to this session."""
    return str if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame, *but: str) -> list[Column]:
    """The columns of df, whatever characters their names have, without those named."""
    key = _same(df)
    gone = {key(n) for n in but}
    return [F.col(quoted(c)) for c in df.columns if key(c) not in gone]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many _ as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(col.cast("string").cast("binary")) % n


def slices(texts, rows: int = 64, chars: int = 1 << 20) -> Iterator[slice]:
    """Runs of at most so many texts and characters (a longer text is a run of its own).

    Arrow batches are bounded by the session's spark.sql.execution.arrow settings, rows and bytes;
    these runs bound what a task builds from one, so no setting needs to be changed for long texts.
    """
    first = n = 0
    for i, t in enumerate(texts):
        size = len(t) if isinstance(t, str) else 0
        if i > first and (i - first == rows or n + size > chars):
            yield slice(first, i)
            first, n = i, 0
        n += size
    if len(texts) > first:
        yield slice(first, len(texts))


#: A key of more than one in so many rows is joined by broadcast; there can be no more such keys than this.
HEAVY = 1000


def join_keyed(rows: DataFrame, facts: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """rows.join(facts, key) that no frequent key sends to one task.

    facts has one row a key, with the number of rows that hold it in a column, which is left out of
    the result; total is at least the number of rows. Keys of more than total / HEAVY rows, at most
    HEAVY of them, are broadcast; the rest are dealt by hash. facts should be a written table: it is read thrice.
    """
    often = F.col(count) * HEAVY > total
    heavy, light = facts.where(often).drop(count), facts.where(~often).drop(count)
    # at most HEAVY rows are broadcast, because the counts add up to total
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light.hint("merge"), key)
    return rest.unionByName(rows.join(F.broadcast(heavy), key))


def left_join_keyed(scratch: Scratch, name: str, rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows.join(facts, key, "left") that sends neither null nor frequent keys to one task; facts has at most one row a key."""
    counts = scratch.keep(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")), f"{name}-counts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # fewer than HEAVY keys can be so frequent
    often = scratch.keep(counts.where(F.col("_n") * HEAVY > total).drop("_n").join(facts, key, "left"), f"{name}-often")
    rest = rows.where(F.col(key).isNotNull()).join(F.broadcast(often.select(key)), key, "left_anti").join(facts, key, "left")
    nothing = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema if f.name != key])
    return rest.unionByName(rows.join(F.broadcast(often), key)).unionByName(nothing)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(scratch: Scratch, name: str, near: DataFrame, total: int) -> DataFrame:
    """Rows (u, v) with the least v of each u as m."""
    low = scratch.keep(near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
    return join_keyed(near, low, "u", total)


def _large_star(scratch: Scratch, name: str, edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour above a node moves to the node's smallest neighbour."""
    near = _stars(scratch, name, _both_ways(edges), 2 * total)
    return near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v")


def _small_star(scratch: Scratch, name: str, edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = _stars(scratch, name, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), total)
    return down.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def _settled(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (u above v) there are, and whether they are stars: every upper end has one edge and is no lower end."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
    total, odd = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("low") == 0))).first()
    return total, not odd


def connected_components(spark: SparkSession, edges: DataFrame, label: str = "cc", most_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star.

    edges: columns u, v of one comparable type; null ends and self-loops are ignored.
    Returns (node, component): every node that has an edge, with the smallest node it reaches.
    Each round is joins and grouped minima only: no list of neighbours is built, and a hub's edges
    stay where they are while its minimum is broadcast to them. Tables are written to the shared
    folder (under the label, if a scratch is given); all but the last are deleted. Rounds grow with
    the logarithm of the longest path. Raises if ``most_rounds`` do not suffice, rather than return a part.
    """
    scratch = scratch or Scratch(spark, label)
    at = lambda name: f"{label}-{name}"
    now = scratch.keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), at("e0"))
    for i in range(1, most_rounds + 1):
        total, settled = _settled(now)
        if settled:
            break
        half = scratch.keep(_large_star(scratch, at(f"l{i}"), now, total).distinct(), at(f"h{i}"))
        after = scratch.keep(_small_star(scratch, at(f"s{i}"), half, total).distinct(), at(f"e{i}"))
        scratch.drop(at(f"e{i - 1}"), at(f"l{i}"), at(f"h{i}"), at(f"s{i}"))
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
