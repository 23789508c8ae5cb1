"""Answering a table of questions with evidence, end to end but for generation."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.operators import rerank as R
from stackwright.operators import retrieval as S
from stackwright.operators import understanding as U
from stackwright.sources.scratch import Scratch

#: Cuts lineage between the passes: a written or checkpointed copy of a table.
Keep = Callable[[DataFrame, str], DataFrame]


def checkpoints(spark: SparkSession) -> Keep:
    """keep by tables written to the folder that executors share."""
    scratch, numbers = Scratch(spark, "answer"), itertools.count()
    return lambda df, name: scratch.keep(df, f"{name}-{next(numbers)}")


def _retrieve(variants: DataFrame, chunks: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame], retrieve_k: int) -> DataFrame:
    return S.retrieve_hybrid_multi(embed(variants), chunks, vectors, retrieve_k)


def _ranked(evidence: DataFrame, questions: DataFrame, rerank_k: int, scorer) -> DataFrame:
    return R.dedupe_sources(R.rerank_with_scores(evidence, questions, R.rerank_pool(rerank_k), scorer), rerank_k)


def retry_pass(plans: DataFrame, critique: DataFrame, first: DataFrame, synonyms: DataFrame, chunks: DataFrame, vectors: DataFrame, embed, keep: Keep, retrieve_k: int, rerank_k: int, scorer=R.token_share) -> DataFrame:
    """first, with the evidence of one more retrieval where the critique asks for it and it finds any.

    What the user filtered by holds in the retry too. Adds a column retried.
    """
    rows = plans.join(critique.select("query_id", "issues", "missing_entities"), "query_id").where(R.should_retry(F.col("issues"), F.col("policy")))
    query, where = R.build_retry_query(F.col("policy.strategy"))
    again = keep(rows.select("query_id", "question", query.alias("retry_query"), U.merge_where(F.col("user_where"), where).alias("where")), "retry")
    variants = U.expand_queries(again.select("query_id", F.col("retry_query").alias("question")), synonyms).join(again.select("query_id", "where"), "query_id")
    second = keep(_ranked(_retrieve(variants, chunks, vectors, embed, retrieve_k), again.select("query_id", "question"), rerank_k, scorer), "second")
    stays = first.join(second.select("query_id").distinct(), "query_id", "left_anti")
    return stays.withColumn("retried", F.lit(False)).unionByName(second.withColumn("retried", F.lit(True)).select(*first.columns, "retried"))


def answer_questions(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, synonyms: DataFrame, embed: Callable[[DataFrame], DataFrame], keep: Keep, rewrites: DataFrame | None = None, retrieve_k: int = 5, rerank_k: int = 3, scorer=R.token_share) -> tuple[DataFrame, DataFrame]:
    """(evidence, audit). embed adds an embedding to rows with a variant; keep cuts lineage.

    Every question gets an audit row: those for other routes without evidence or doubt, those that
    find nothing with low confidence, the others with their sources and best score.
    """
    plans = keep(U.execution_plan(U.build_query_plans(questions, rewrites)), "plans")
    kb = plans.where("route = 'kb'")
    extras = kb.select("query_id", F.posexplode(F.concat(F.expr("slice(variants, 2, size(variants))"), "sub_queries")).alias("place", "rewrite"))
    variants = U.expand_queries(kb.select("query_id", F.col("rewritten").alias("question")), synonyms, extras).join(kb.select("query_id", "where"), "query_id")
    asked = kb.select("query_id", "question")
    first = keep(_ranked(_retrieve(variants, chunks, vectors, embed, retrieve_k), asked, rerank_k, scorer), "first")
    critique = keep(R.critique_evidence(kb.join(first.select("query_id").distinct(), "query_id", "left_semi"), first), "critique")
    evidence = keep(retry_pass(kb, critique, first, synonyms, chunks, vectors, embed, keep, retrieve_k, rerank_k, scorer), "evidence")
    found = evidence.groupBy("query_id").agg(F.max("max_score").alias("max_rerank_score"), F.max("retried").alias("retried"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("evidence_sources"))
    rows = plans.join(found, "query_id", "left")
    nothing = F.array().cast("array<string>")
    best = F.coalesce("max_rerank_score", F.lit(0.0))
    audit = rows.select(
        "query_id", F.lit("query").alias("event"), "question", F.col("rewritten").alias("rewritten_query"), "intent", "is_complex", "sub_queries", "route", "tools",
        F.col("policy.strategy").alias("retry_policy"), F.coalesce("retried", F.lit(False)).alias("retried"), F.coalesce("evidence_sources", nothing).alias("evidence_sources"),
        best.alias("max_rerank_score"), F.when(F.col("route") == "kb", R.low_confidence(best)).otherwise(False).alias("low_confidence"), U.stub_answer(F.col("route")).alias("answer"),
    )
    return evidence, audit


def supplement_pass(evidence: DataFrame, plans: DataFrame, answers: DataFrame, chunks: DataFrame, vectors: DataFrame, embed, retrieve_k: int = 5, rerank_k: int = 3, scorer=R.token_share) -> DataFrame:
    """evidence with more after it for answers that miss their keys, or that a judge found irrelevant.

    answers: query_id, answer and optionally judge, a judge's reply. The first are searched with the
    missing keys before the question, the others with the question; no filter holds.
    """
    from stackwright.functions.text import judge_reply

    rows = plans.select("query_id", "question", "entities").join(answers, "query_id").withColumn("c", R.critique_answer(F.col("entities"), F.col("answer")))
    missing = ~F.col("c.passed") & (F.size("c.missing_keywords") > 0)
    off = ~judge_reply("judge")["relevant"] if "judge" in answers.columns else F.lit(False)
    wanted = rows.where(missing | off).select("query_id", F.when(missing, F.concat(F.array_join("c.missing_keywords", " "), F.lit(" "), F.col("question"))).otherwise(F.col("question")).alias("question"))
    variants = wanted.select("query_id", F.lit(0).alias("variant_idx"), F.col("question").alias("variant"))
    more = R.rerank_with_scores(_retrieve(variants, chunks, vectors, embed, retrieve_k), wanted, R.rerank_pool(rerank_k), scorer)
    return R.merge_evidence(evidence, more, rerank_k)
