"""Continuous ingestion and continuous gap reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.operators.analytics import audit_schema, gap_events
from stackwright.operators.chunking import load_chunks
from stackwright.sources.chunk_table import ChunkTable
from stackwright.sources.files import under
from stackwright.sources.scratch import Scratch

def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """New files under root as (source, text, modificationTime); the source is the path under root."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    return files.select(under(root).alias("source"), F.col("content").cast("string").alias("text"), "modificationTime")


def ingest_stream(docs: DataFrame, table: ChunkTable, checkpoint: str):
    """Starts a query that chunks arriving documents (source, text) into a chunk table.

    A document takes the place of what the table has of its source; one with a null text is
    deleted. Of several of one source in a batch the one with the latest modificationTime counts,
    if docs has that column. A batch that runs again changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        newest = df.dropDuplicates(["source"])
        if "modificationTime" in df.columns:
            newest = df.groupBy("source").agg(F.max_by(F.struct("text"), "modificationTime").alias("d")).select("source", "d.text")
        scratch = Scratch(df.sparkSession, "arrived")
        newest = scratch.keep(newest.select("source", "text"), "documents")
        table.apply(load_chunks(newest.where("text is not null")), newest)
        scratch.drop()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(audit_schema()).json(path)


def knowledge_gaps_stream(audit: DataFrame) -> DataFrame:
    """The gaps among arriving events: a filter, for an append sink."""
    return gap_events(audit)


def gap_counts(audit: DataFrame, window: str = "1 hour", late: str = "10 minutes", ids: Sequence[str] = ("ts", "question")) -> DataFrame:
    """Questions and gaps in tumbling windows of event time, each once it is over, for an append sink.

    Events are the same if they agree in ids: of those that arrive within ``late`` of each other
    one counts. Events later than ``late`` are not counted.
    """
    rows = audit.where("event = 'query'").withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    rows = rows.dropDuplicatesWithinWatermark(list(ids))
    return rows.groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("questions"), F.count_if("low_confidence").alias("gaps")).select("w.start", "w.end", "questions", "gaps")


