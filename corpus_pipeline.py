"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, whatever they are and whatever their names. ``run`` writes every stage's result to
the shared folder and reads it again, so a lost executor never sends the work back beyond one
stage; what a stage and its predecessor have left there is deleted once its result is written.

In every stage null and empty texts, texts of any length and repeated rows are as its docstring
says, an empty table gives an empty one, and columns other than doc_id, text, lang and n_chars are
only carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm import decontam, langid, mixing, neardup, pii
from stackwright.llm.common import columns_of, free_name, table
from stackwright.sources.scratch import Scratch, cleared

#: Documents whose language is less certain than this are rejected with those that have none.
LEAST_CERTAIN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose language the model cannot tell.

    Null and empty texts go; of repeated rows all stay or all go. Where no row teaches a language
    (lang is null or 'und' in all), only documents without a letter go.
    """
    model = langid.fit(docs)
    if model["langs"] == [langid.UNKNOWN]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, sure = free_name(docs, "_lang"), free_name(docs, "_certain")
    seen = langid.identify(spark, docs, model, names=(lang, sure))
    return seen.where((F.col(lang) != langid.UNKNOWN) & (F.col(sure) >= LEAST_CERTAIN)).select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 and more, on five-word shingles: that of the smallest doc_id.

    Null and blank texts are like nothing and stay, as do rows without a doc_id; of rows that repeat a doc_id one stays.
    """
    return neardup.drop_duplicates(spark, docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, verbatim or in another order.

    Null and empty texts hold none and stay; of repeated rows all stay or all go.
    """
    return decontam.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts, with the key that the session names; every row stays.

    n_chars, where there is one, stays true as lengths may change; with a null text it is left alone.
    """
    out = pii.scrub(docs, pii.key_of(spark), finds=free_name(docs, "_pii")).select(*columns_of(docs))
    chars = next((c for c in docs.columns if c.lower() == "n_chars"), None)
    if chars is None:
        return out
    return out.withColumn(chars, F.when(F.col("text").isNull(), F.col(chars)).otherwise(F.length("text")).cast(docs.schema[chars].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the rate at which to draw each document; those never to be drawn go.

    A column that is called rate already is replaced. Null and empty texts have the rate of their
    posteriors; repeated rows have equal rates and are counted each.
    """
    return mixing.with_rates(spark, docs, mixing.domains_of(table(spark, sf_dir, "labels"))).where("rate > 0")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", pseudonyms),
    ("mix_sources", mix_sources),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        with cleared():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
