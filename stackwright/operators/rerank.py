"""Reranking, per-source caps and self-checks of evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from stackwright.functions import lexicon
from stackwright.functions import text as X
from stackwright.operators.retrieval import _by_model, doc_type_adjustment, with_chunks
from stackwright.operators.understanding import drop_doc_type

LOW_CONFIDENCE = 0.1
MAX_PER_SOURCE = 5


def rerank_bonus(query: Column | str) -> Column:
    """What identifiers, shared tokens, models and document types add to a model's score."""
    field = lambda f: F.coalesce(F.col(f), F.lit(""))
    source = F.concat_ws(" ", field("source"), field("doc_id"), field("version"), field("doc_type"))
    content = field("content")
    named = lambda text, w: F.size(F.filter(X.identifiers(query), lambda t: F.contains(F.lower(text), F.lower(t)))) * w
    tokens = X.overlap_terms(query)
    bonus = (
        named(source, 1.0) + named(content, 0.8)
        + F.least(X.count_token_hits(tokens, source) * 0.18, F.lit(0.9)) + F.least(X.count_token_hits(tokens, content) * 0.06, F.lit(0.9))
        + _by_model(X.model_terms(query), F.concat_ws(" ", source, content), 0.6, -1.0)
        + doc_type_adjustment(query, (1.0, -0.5, 1.0, -0.3))
    )
    return F.round(F.greatest(F.least(bonus, F.lit(2.5)), F.lit(-1.5)), 4)


def pair_scorer(model: Callable[[Sequence[str], Sequence[str]], np.ndarray]):
    """A column function (query, text) -> score from a model of pairs, which is sent to every task."""

    @F.pandas_udf("double")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            yield pd.Series(np.asarray(model(q.tolist(), t.tolist()), np.float64), index=q.index)

    return of


def scorer_by(load: Callable[[], Callable[[Sequence[str], Sequence[str]], np.ndarray]], batch: int = 64):
    """A column function (query, text) -> score from a model of pairs that each Python worker loads once."""

    def make():
        model = load()
        return lambda q, t: np.asarray(model(q.tolist(), t.tolist()), np.float64)

    return predict_batch_udf(make, return_type=DoubleType(), batch_size=batch)


def token_share(query: Column, text: Column) -> Column:
    """A scorer without a model: the share of the query's terms that the text contains."""
    terms = X.overlap_terms(query)
    return F.coalesce(F.try_divide(X.count_token_hits(terms, text).cast("double"), F.size(terms).cast("double")), F.lit(0.0))


def rerank(evidence: DataFrame, queries: DataFrame, top_k: int, scorer=token_share) -> DataFrame:
    """query_id, content, rerank_score and rank of the top_k contents by the scorer; ties keep their order."""
    rows = evidence.select("query_id", "rank", "content").join(queries.select("query_id", "question"), "query_id").withColumn("rerank_score", scorer(F.col("question"), F.col("content")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank"))
    return rows.withColumn("rank", place).where(F.col("rank") <= top_k).select("query_id", "rank", "content", "rerank_score")


def rerank_with_scores(evidence: DataFrame, queries: DataFrame, top_k: int, scorer=token_share) -> DataFrame:
    """The top_k evidence rows a question by model score plus bonus (4 places), and max_score of each.

    The model sees a text with its source in front.
    """
    rows = evidence.withColumnRenamed("rank", "_was").join(queries.select("query_id", "question"), "query_id")
    told = F.concat(F.lit("[来源: "), F.coalesce("source", F.lit("")), F.lit("]\n"), F.coalesce("content", F.lit("")))
    rows = rows.withColumn("rerank_score", F.round(scorer(F.col("question"), told) + rerank_bonus("question"), 4))
    w = Window.partitionBy("query_id")
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(F.col("rerank_score").desc(), "_was"))).where(F.col("rank") <= top_k)
    return ranked.withColumn("max_score", F.max("rerank_score").over(w)).drop("_was", "question")


def rerank_pool(top_k: int) -> int:
    return max(top_k * 4, 12)


def dedupe_sources(evidence: DataFrame, top_k: int, max_per_source: int = MAX_PER_SOURCE) -> DataFrame:
    """At most so many rows of a source, in rank order, then the first top_k; ranks close up."""
    own = evidence.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank"))).where(F.col("_n") <= max_per_source)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= top_k).drop("_n")


def simple_answer_pool(questions: DataFrame, hits: DataFrame, chunks: DataFrame, top_k: int = 3, scorer=token_share) -> DataFrame:
    """The plain flow: the texts of vector hits, reranked to top_k."""
    return rerank(with_chunks(hits, chunks.select("id", "content")), questions, top_k, scorer)


def low_confidence(max_score: Column) -> Column:
    return F.coalesce(max_score, F.lit(0.0)) < LOW_CONFIDENCE


def _keys(entities: Column, *names: str) -> Column:
    return F.concat(*[entities[n] for n in names])


def critique_evidence(plans: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row a plan: passed, issues, type_ok, score_ok, matched_entities, missing_entities, max_score.

    Issues: low_confidence (best score under 0.1), type_mismatch (the intent has a doc_type which
    none of the top 3 has), entity_not_found (a code or id that no content mentions). evidence may
    have max_score; else the best rerank_score counts.
    """
    best = F.max("max_score") if "max_score" in evidence.columns else F.max("rerank_score")
    seen = evidence.groupBy("query_id").agg(best.alias("max_score"), F.array_sort(F.collect_list(F.struct("rank", F.coalesce("doc_type", F.lit("")).alias("doc_type"), F.coalesce("content", F.lit("")).alias("content")))).alias("e"))
    rows = plans.select("query_id", "intent", "entities").join(seen, "query_id", "left")
    score = F.coalesce("max_score", F.lit(0.0))
    types = F.transform(F.slice("e", 1, 3), lambda x: x["doc_type"])
    type_ok = ~F.col("intent").isin(*lexicon.INTENTS) | F.col("e").isNull() | F.array_contains(types, F.col("intent"))
    told = F.upper(F.array_join(F.transform(F.coalesce("e", F.array().cast("array<struct<rank:int,doc_type:string,content:string>>")), lambda x: x["content"]), " "))
    keys = _keys(F.col("entities"), "fault_codes", "doc_ids", "model_types")
    rows = rows.withColumns({"max_score": score, "score_ok": score >= LOW_CONFIDENCE, "type_ok": type_ok, "_told": told})
    rows = rows.withColumns({"matched_entities": F.filter(keys, lambda k: F.contains(F.col("_told"), F.upper(k))), "missing_entities": F.filter(keys, lambda k: ~F.contains(F.col("_told"), F.upper(k)))})
    issues = F.filter(F.array(F.when(~F.col("score_ok"), "low_confidence"), F.when(~F.col("type_ok"), "type_mismatch"), F.when(F.size("missing_entities") > 0, "entity_not_found")), lambda x: x.isNotNull())
    return rows.withColumn("issues", issues).select("query_id", (F.size("issues") == 0).alias("passed"), "issues", "type_ok", "score_ok", "matched_entities", "missing_entities", "max_score")


def should_retry(issues: Column, policy: Column, attempt: int = 0) -> Column:
    return (F.lit(attempt) < policy["max_retries"]) & F.arrays_overlap(issues, policy["trigger_conditions"])


def build_retry_query(strategy: Column, plan=F.col, missing: Column | None = None, where: Column | None = None) -> tuple[Column, Column]:
    """New query and new where of a retry, by strategy; plan(name) gives a plan's column."""
    missing = F.col("missing_entities") if missing is None else missing
    where = F.col("where") if where is None else where
    ids = _keys(plan("entities"), "fault_codes", "doc_ids", "model_types", "versions")
    wanted = F.filter(ids, lambda x: (F.size(missing) == 0) | F.array_contains(missing, x))
    prefix = F.array_join(F.when(F.size(wanted) > 0, wanted).otherwise(ids), " ")
    raw = plan("question")
    boosted = F.when(prefix != "", X.strip(F.concat(prefix, F.lit(" "), raw))).otherwise(raw)
    expanded = F.coalesce(F.get(plan("sub_queries"), 0), F.get(plan("variants"), 1), raw)
    query = F.when(strategy == "exact_match_boost", boosted).when(strategy == "tighten_filter", plan("rewritten")).when(strategy == "expand_query", expanded).otherwise(raw)
    tight = where.withField("doc_type", F.when(plan("intent").isin(*lexicon.INTENTS), plan("intent")).otherwise(where["doc_type"]))
    return query, F.when(strategy == "exact_match_boost", where).when(strategy == "tighten_filter", tight).otherwise(drop_doc_type(where))


def critique_answer(entities: Column, answer: Column) -> Column:
    """passed, coverage_rate (2 places), covered_keywords and missing_keywords; no keys: passed, 1."""
    keys = _keys(entities, "fault_codes", "doc_ids", "model_types", "versions")
    has = lambda k: F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(k))
    rate = F.round(F.coalesce(F.try_divide(F.size(F.filter(keys, has)).cast("double"), F.size(keys).cast("double")), F.lit(1.0)), 2)
    return F.struct((rate >= 0.5).alias("passed"), rate.alias("coverage_rate"), F.filter(keys, has).alias("covered_keywords"), F.filter(keys, lambda k: ~has(k)).alias("missing_keywords"))


def merge_evidence(first: DataFrame, more: DataFrame, top_k: int) -> DataFrame:
    """more after first, capped per source and to top_k."""
    columns = [c for c in first.columns if c in more.columns and c != "rank"]
    part = lambda df, i: df.select(*columns, F.struct(F.lit(i).alias("part"), F.col("rank").alias("r")).alias("rank"))
    return dedupe_sources(part(first, 0).unionByName(part(more, 1)), top_k)


def assemble_context(evidence: DataFrame) -> DataFrame:
    """query_id and context: each chunk after a line with its source, version and department, in rank order."""
    said = lambda f, other: F.coalesce(F.col(f), F.lit(other))
    block = F.concat(F.lit("[来源: "), said("source", "未知"), F.lit(" | 版本: "), said("version", "-"), F.lit(" | 部门: "), said("department", "-"), F.lit("]\n"), said("content", ""))
    return evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("b")).select("query_id", F.array_join("b.b", "\n").alias("context"))
