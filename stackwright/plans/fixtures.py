"""Document-base tables derived from the star-schema and text tables, for the registered queries.

Expressions are plain SQL that both Spark and DuckDB read, so that both sides derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.functions import text as X
from stackwright.operators import chunking
from stackwright.operators.contain import holding

KB = {
    "source": "'dir' || (doc_id % 7) || '/' || source || '-' || doc_id || (case when doc_id % 3 = 0 then '.md' when doc_id % 3 = 1 then '.txt' else '.log' end)",
    "doc_type": "case doc_id % 6 when 0 then 'spec' when 1 then 'test_spec' when 2 then 'test_case' when 3 then 'fault_case' when 4 then 'release_note' else '' end",
    "version": "'V' || (1 + doc_id % 3) || '.' || (doc_id % 4)",
    "department": "'dept' || (doc_id % 4)",
    "model_type": "'WPS-' || (3000 + 100 * (doc_id % 4))",
    "product_line": "'line' || (doc_id % 5)",
}
#: Benchmark passages with identifiers and signal words after them.
QUESTION = """text || ' WPS-' || (3000 + 100 * (item_id % 4)) || ' V' || (1 + item_id % 3) || '.' || (item_id % 4) || ' '
 || (case item_id % 8 when 0 then '规格 参数' when 1 then 'VIS-' || (1000 + item_id) || ' 怎么处理' when 2 then 'QE-2025-' || (1000 + item_id) when 3 then '测试用例' when 4 then '统计 数量'
 when 5 then '故障 SCT-200 对比' when 6 then '今天 版本 更新' else '接口 api 转接' end)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def kb_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", *[F.expr(e).alias(c) for c, e in KB.items()])


def kb_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk a line that is not blank, as full records."""
    return _line_chunks(kb_docs(spark, sf))


def _line_chunks(docs: DataFrame) -> DataFrame:
    """Chunks that have their documents' fields from the row itself."""
    rows = docs.select("doc_id", *KB, F.posexplode(F.filter(X.lines("text"), lambda x: X.strip(x) != "")).alias("chunk_index", "content"))
    return chunking.make_chunk_records(rows)


def md_docs(spark: SparkSession, sf: str, *also: str) -> DataFrame:
    """Lines become headings, items, table rows and paragraphs by their place, with blank lines between."""
    mark = lambda x, i: F.when((i + 1) % 6 == 1, F.concat(F.lit("# "), x)).when((i + 1) % 6 == 3, F.concat(F.lit("- "), x)).when((i + 1) % 6 == 4, F.concat(F.lit("| "), x, F.lit(" |"))).otherwise(x)
    own = F.filter(X.lines("text"), lambda x: X.strip(x) != "")
    return kb_docs(spark, sf).select("source", F.array_join(F.transform(own, mark), "\n\n").alias("text"), *also)


def checked_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(file_path, text): the Markdown texts with defects at places that follow from the ids."""
    fault = F.expr(
        "case doc_id % 9 when 0 then '\n\n\n\n\nAPI response\n' when 1 then '\n#bad\n#  \n# a\n# b\n' when 2 then '\n```\n# code\nAPI\n```\n注意: x\n' when 3 then '\n1. a\n2. b\n4. c\n\n7. d\n' "
        "when 4 then '\n中文abc 和 １２ 34\n' when 5 then '\nsame line here\nsame line here\n' when 6 then '\n[a](missing.md) [b](../dir1/none.md#x) [c](http://x.y)\n' when 7 then '\n进行进行 的的\n' else '\nassertion timeout\n' end"
    )
    return md_docs(spark, sf, "doc_id").select(F.col("source").alias("file_path"), F.concat("text", fault).alias("text"))


#: A line of a document as a record: every third lacks its last cell, every fifth is blank.
CSV = "case when i % 5 = 4 then ' ,' else i || ',\"' || replace(x, '\"', '\"\"') || '\n.\"\"q\"\"\"' || case when i % 3 = 2 then '' else ',' || length(x) end end"


def csv_docs(spark: SparkSession, sf: str) -> DataFrame:
    own = F.filter(X.lines("text"), lambda x: X.strip(x) != "")
    rows = kb_docs(spark, sf).select("doc_id", F.posexplode(F.concat(F.array(F.lit("")), own)).alias("i", "x"))
    text = F.when(F.col("i") == 0, F.expr("case when doc_id % 2 = 0 then 'no,line,size' else 'id,,id' end")).otherwise(F.expr(CSV))
    whole = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda r: r["t"]), "\r\n").alias("text"))
    return whole.select(F.format_string("t%d.csv", "doc_id").alias("source"), "text")


#: Letters become Han characters and blanks go, as in text that is written without them.
HAN = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz ', '的一是不了在人有我他这个们中来上大为和国地到以说时要')"


def han_docs(spark: SparkSession, sf: str) -> DataFrame:
    return kb_docs(spark, sf).select("source", F.expr(HAN).alias("text"))


def states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    kb = kb_docs(spark, sf).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    row = lambda h: ("source", h.alias("file_hash"), F.lit("").alias("meta_hash"), (F.col("doc_id") * 1000).alias("mtime_ns"))
    old = kb.where("doc_id % 11 != 0").select(*row(F.col("h")))
    new = kb.where("doc_id % 13 != 0").select(*row(F.when(F.col("doc_id") % 5 == 0, F.reverse("h")).otherwise(F.col("h"))))
    return old, new


def changed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A new version of the chunks: documents with ids of 5's multiples have their letters e changed, 13's are gone."""
    docs = kb_docs(spark, sf).where("doc_id % 13 != 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("text", "e", "E")).otherwise(F.col("text")))
    return _line_chunks(docs)


def old_chunks(spark: SparkSession, sf: str) -> DataFrame:
    gone = kb_docs(spark, sf).where("doc_id % 11 = 0").select("source")
    return kb_chunks(spark, sf).join(gone, "source", "left_anti")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(QUESTION).alias("question"))


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def expected(spark: SparkSession, sf: str) -> DataFrame:
    """query_id and the sources of documents that hold the passage word for word."""
    found = holding(kb_docs(spark, sf).select("source", "text"), passages(spark, sf), "text", "question")
    return found.groupBy("query_id").agg(F.array_sort(F.collect_set("source")).alias("expected_sources"))


def audit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    score = F.col("value") / 1000
    return e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.lit("query").alias("event"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("question"), score.alias("max_rerank_score"), (score < 0.1).alias("low_confidence"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every vector whose id is a multiple of 100."""
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def reflection_cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A case of the self-check for each document, and the evidence of every fourth; some expect what does not come."""
    none, code = "cast(array() as array<string>)", "concat('VIS-', 1000 + doc_id % 50)"
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, want = "(doc_id div 4)", lambda step, value, kind: f"case when doc_id % 4 = {step} then cast({value} as {kind}) end"
    expect = {
        "passed": "case doc_id % 4 when 0 then doc_id % 20 >= 10 when 3 then doc_id % 3 = 0 end", "issues": want(0, "case when doc_id % 20 < 10 then array('low_confidence') end", "array<string>"),
        "missing": want(0, f"case when doc_id % 8 <> 0 then array({code}) end", "array<string>"), "retry": want(1, "doc_id % 3 = 0", "boolean"),
        "query": want(2, f"case {n} % 4 when 2 then 'part ' || doc_id when 3 then md5(text) end", "string"), "query_has": want(2, "array(md5(text))", "array<string>"),
        "doc_type": want(2, "''", "string"), "coverage": want(3, "0.5", "double"),
    }
    cases = docs.select(
        F.col("doc_id").alias("query_id"), F.expr("case doc_id % 4 when 0 then 'evidence' when 1 then 'decision' when 2 then 'retry' else 'answer' end").alias("step"),
        F.expr("if(doc_id % 3 = 0, 'release_note', 'general')").alias("intent"), F.md5("text").alias("question"), F.expr("'r ' || md5(text)").alias("rewritten"),
        F.expr("array(md5(text), 'v ' || doc_id)").alias("variants"), F.expr(f"if(doc_id % 3 = 0, array('part ' || doc_id), {none})").alias("sub_queries"),
        F.expr(f"named_struct('fault_codes', array({code}), 'doc_ids', {none}, 'model_types', if(doc_id % 4 = 3, array('WPS-3000'), {none}), 'versions', {none})").alias("entities"),
        F.expr("named_struct('doc_type', 'spec', 'version', 'V1.0')").alias("where"), F.expr("array(if(doc_id % 3 = 0, 'low_confidence', 'type_mismatch'))").alias("issues"), F.expr(none).alias("missing_entities"),
        F.expr(f"named_struct('max_retries', 1, 'trigger_conditions', array('low_confidence'), 'strategy', element_at(array('exact_match_boost', 'tighten_filter', 'expand_query', 'relax_filter'), cast({n} % 4 + 1 as int)))").alias("policy"),
        F.expr(f"cast({n} % 2 as int)").alias("attempt"), F.expr(f"text || if(doc_id % 3 = 0, lower({code}), '') || if(doc_id % 5 = 0, ' WPS-3000', '')").alias("answer"),
        F.struct(*[F.expr(x).alias(name) for name, x in expect.items()]).alias("expect"),
    )
    evidence = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), F.expr("if(doc_id % 5 = 0, 'release_note', 'spec')").alias("doc_type"), F.expr(f"text || if(doc_id % 8 = 0, ' ' || lower({code}), '')").alias("content"), F.expr("(doc_id % 20) / 100.0D").alias("max_score"))
    return cases, evidence
