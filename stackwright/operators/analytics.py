"""Reports on the corpus and on the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def meta_options(chunks: DataFrame, fields: tuple[str, ...] = ("product_line", "version")) -> DataFrame:
    """field and value: the distinct values that are not empty, sorted."""
    values = [chunks.select(F.lit(f).alias("field"), F.col(f).alias("value")).where("value != ''").distinct() for f in fields]
    out = values[0]
    for v in values[1:]:
        out = out.unionByName(v)
    return out.orderBy("field", "value")


def gap_events(audit: DataFrame) -> DataFrame:
    """Audited questions that were answered with low confidence."""
    return audit.where("event = 'query' and low_confidence")


def knowledge_gaps(audit: DataFrame, limit: int = 50) -> DataFrame:
    """The newest gaps first, with the number of all gaps beside each."""
    gaps = gap_events(audit)
    total = gaps.agg(F.count("*").alias("total"))
    return gaps.orderBy(F.col("ts").desc(), "question").limit(limit).join(F.broadcast(total), F.lit(True))  # total: one row


def corpus_by_dir(files: DataFrame) -> DataFrame:
    """Top folder, sub folder ('' if none) and number of files; files_by_dir has their names."""
    return files_by_dir(files).groupBy("top", "sub").agg(F.count("*").alias("n"))


def files_by_dir(files: DataFrame) -> DataFrame:
    """Top folder, sub folder ('' if none) and name of every file, a row each, as a folder may hold any number."""
    parts = F.split("source", "/")
    sub = F.when(F.size(parts) > 2, parts[1]).otherwise("")
    top = F.when(F.size(parts) > 1, parts[0]).otherwise("")
    return files.select(top.alias("top"), sub.alias("sub"), F.element_at(parts, -1).alias("name"))


def meta_coverage(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """One row: files, those with a sidecar, and those without; missing_sidecars has the sources of these."""
    has = sidecars.select("source", F.lit(True).alias("has")).distinct()
    return files.join(has, "source", "left").agg(F.count("*").alias("total"), F.count_if("has").alias("covered"), F.count_if(F.col("has").isNull()).alias("missing"))


def missing_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The sources without a sidecar, a row each."""
    return files.join(sidecars.select("source").distinct(), "source", "left_anti").select("source")


def doc_type_distribution(sidecars: DataFrame) -> DataFrame:
    """Files of each doc_type, 'unknown' where it is missing or empty."""
    kind = F.when(F.coalesce(F.col("doc_type"), F.lit("")) == "", "unknown").otherwise(F.col("doc_type"))
    return sidecars.groupBy(kind.alias("doc_type")).agg(F.count("*").alias("n"))


def audit_schema() -> str:
    texts, flags, lists = ("ts", "event", "question", "rewritten_query", "intent", "route", "retry_policy"), ("is_complex", "retried", "low_confidence"), ("sub_queries", "expanded_queries", "tools", "evidence_sources")
    return ", ".join([f"{c} string" for c in texts] + [f"{c} boolean" for c in flags] + [f"{c} array<string>" for c in lists] + ["filters map<string,string>", "suggested_filters map<string,string>", "evidence_critique map<string,string>", "max_rerank_score double"])


