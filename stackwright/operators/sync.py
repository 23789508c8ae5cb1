"""Incremental synchronisation of a chunk table with its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = ("file_hash", "meta_hash", "mtime_ns")


def diff_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """source and change (added, changed, deleted or unchanged) of two state tables.

    A document is changed if any of file_hash, meta_hash and mtime_ns differs; a touch counts.
    """
    a, b = old.select("source", F.struct(*STATE).alias("was")), new.select("source", F.struct(*STATE).alias("now"))
    both = a.join(b, "source", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return both.select("source", change.alias("change"))


def diff_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The new chunks with an action: add (unseen id), update (other content_hash) or skip. Nothing is deleted."""
    was = existing.select("id", F.col("content_hash").alias("_was"), F.lit(True).alias("_seen"))
    joined = new.join(was, "id", "left")
    return joined.withColumn("action", F.when(F.col("_seen").isNull(), "add").when(F.col("content_hash").eqNullSafe(F.col("_was")), "skip").otherwise("update")).drop("_was", "_seen")


def chunks_by_source(chunks: DataFrame) -> DataFrame:
    """source and its sorted chunk ids, of which a row has as many as its one document has chunks; chunks without a source are left out."""
    return chunks.where("source != ''").groupBy("source").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def delete_by_sources(chunks: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks that stay, and one row with the number of deleted ones."""
    gone = sources.select("source").distinct()
    return chunks.join(gone, "source", "left_anti"), chunks.join(gone, "source", "left_semi").agg(F.count("*").alias("deleted"))


def sync_incremental(existing: DataFrame, changes: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """existing without changed and deleted sources, plus the rebuilt chunks of added and changed ones.

    rebuilt may hold chunks of other sources too; they are not taken.
    """
    gone = changes.where("change in ('changed', 'deleted')").select("source")
    fresh = changes.where("change in ('added', 'changed')").select("source")
    return existing.join(gone, "source", "left_anti").unionByName(rebuilt.join(fresh, "source", "left_semi").select(*existing.columns))


def upsert_chunks(existing: DataFrame, incoming: DataFrame, prune: bool = False) -> DataFrame:
    """incoming replaces chunks of equal id and adds the others.

    Chunks of higher index of a document that is now shorter stay, unless prune is set.
    """
    kept = existing.join(incoming.select("id"), "id", "left_anti")
    if prune:
        kept = kept.join(incoming.select("source").distinct(), "source", "left_anti")
    return kept.select(*existing.columns).unionByName(incoming.select(*existing.columns))


def sync_summary(changes: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: documents by change, and chunks by action."""
    both = changes.select("change", F.lit(None).cast("string").alias("action")).union(actions.select(F.lit(None).cast("string"), "action"))
    files = [F.count_if(F.col("change") == c).alias(f"files_{c}") for c in ("added", "changed", "deleted", "unchanged")]
    chunks = [F.count_if(F.col("action") == a).alias(n) for a, n in (("add", "added"), ("update", "updated"), ("skip", "skipped"))]
    return both.agg(*files, F.count("action").alias("total"), *chunks)


def ingest_summary(chunks: DataFrame) -> DataFrame:
    """Chunks of each source, and of all in a row with a null source."""
    return chunks.rollup("source").agg(F.count("*").alias("n_chunks"))
