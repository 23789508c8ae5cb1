"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm import conversation_repair, decontam, jaccard_join, langid, lexical_topk, mixing, neardup, pii, quality_mil, quality_rules, token_rollup, url_filter, warc_index
from stackwright.llm.common import crc_mod, table
from stackwright.llm.oracles import SQL
from stackwright.sources.scratch import Scratch


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled rows with crc32(doc_id) mod 5 other than 0; scores every text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_mil.fit(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return quality_mil.score(spark, docs.select("doc_id", "text"), model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows with crc32(doc_id) mod 4 other than 2; predicts for every text."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(spark, docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a history of batches over all documents.

    Two tokenizers' counts of every document are inserted, a batch each; documents labelled as
    poor are deleted under both; toxic ones have their symbols removed and their counts revised.
    The first and the third batch arrive twice.
    """
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels")
    old, new = "byte_bpe_50k", "byte_bpe_multi_50k"
    scratch = Scratch(spark, "token-rollup")
    # all counts in one scan; the cleaned text is counted again only where it differs
    symbols = r"[#*$%&|<>]+"
    cleaned = F.when(F.col("text").rlike(symbols), F.regexp_replace("text", symbols, ""))
    counts = docs
    for name in (old, new):
        counts = token_rollup.count_tokens(spark, counts, name, name=name)
    counts = token_rollup.count_tokens(spark, counts.withColumn("cleaned", cleaned), new, name="n_tokens", column="cleaned")
    counts = scratch.keep(counts.select("doc_id", "source", "lang", old, new, F.when(F.col("cleaned").isNull(), F.col(new)).otherwise(F.col("n_tokens")).alias("n_cleaned")), "counts")
    of = lambda df, t: df.select("doc_id", "source", "lang", F.lit(t).alias("tokenizer"), F.col(t).alias("n_tokens"))
    flagged = lambda what: labels.where(what).select("doc_id").distinct()
    gone = of(counts, old).union(of(counts, new)).join(flagged("quality = 0"), "doc_id", "left_semi")
    was = [F.col(c).alias(f"old_{c}") for c in ("source", "lang")] + [F.lit(new).alias("old_tokenizer"), F.col(new).alias("old_n_tokens")]
    revised = counts.join(flagged("toxic = 1 and quality = 1"), "doc_id", "left_semi").select(*was, "source", "lang", F.lit(new).alias("tokenizer"), F.col("n_cleaned").alias("n_tokens"))
    rollup = token_rollup.Rollup(spark, scratch.path("rollup"))
    insert, delete, revise = ("op", F.lit("insert")), ("op", F.lit("delete")), ("op", F.lit("revise"))
    history = [("load-1", of(counts, old).withColumn(*insert)), ("load-2", of(counts, new).withColumn(*insert)), ("drop-poor", gone.withColumn(*delete)), ("load-1", of(counts, old).withColumn(*insert)), ("clean-toxic", revised.withColumn(*revise)), ("drop-poor", gone.withColumn(*delete))]
    for batch, changes in history:
        rollup.commit(batch, changes)
    return rollup.totals()


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark item that tiles cover best, if one is covered enough."""
    docs = decontam.with_matches(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = F.sort_array(F.transform("matches", lambda m: F.struct(m["coverage"].alias("c"), (-m["item_id"]).alias("i"))), asc=False)
    best = F.when(F.size("matches") > 0, F.get(best, 0))
    dirty = F.size("matches") > 0
    return docs.select("doc_id", dirty.alias("contaminated"), (-best["i"]).alias("item_id"), F.coalesce(best["c"], F.lit(0.0)).alias("coverage"), F.size("matches").alias("n_items"), (~dirty).alias("kept"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives and their index, then finds and reads every page's record by its key."""
    pages, path = table(spark, sf_dir, "pages"), Scratch(spark, "warc").root
    shards = warc_index.build_index(spark, warc_index.write_archives(spark, pages, path), path)
    found = warc_index.look_up(spark, pages.select(warc_index.url_key(F.col("url")).alias("key")), path, shards)
    return warc_index.read_records(found, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text and how many values of each kind it held."""
    docs = pii.scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark))
    counts = [F.expr(f"size(filter(pii, x -> x.kind = '{k}'))").alias(f"n_{k}") for k in pii.KINDS]
    return docs.select("doc_id", "text", F.size("pii").alias("n_found"), *counts)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find_duplicates(spark, table(spark, sf_dir, "documents"), k=2)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, table(spark, sf_dir, "documents"), mixing.domains_of(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "domain", "n_tokens", F.transform("posterior", lambda p: F.round(p, 6)).alias("posterior"), "rate")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(spark, table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_topk.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(spark, conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(spark, table(spark, sf_dir, "documents"), k=3, percent=90)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_mil, op2_language_id, op3_token_rollup, op4_decontaminate, op5_warc_index, op6_pii, op7_minhash_dedup, op8_mix_sources, op9_url_filter, op10_quality_rules, op11_lexical_topk, op12_conversation_repair, op13_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
