"""A chunk table whose batches rewrite only what they touch."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.operators.sync import upsert_chunks
from stackwright.sources.scratch import Scratch

#: Folders of a table; chunks are dealt to them by a hash of their source.
BUCKETS = 64


class ChunkTable:
    """Parquet files under a path, in a folder for each bucket of sources. One writer at a time.

    A batch is merged with the buckets that its sources are in; those rows are written in whole
    beside the table and then overwrite these buckets alone. A writer that fails on the way leaves
    the rows there, and the next one puts them in place first, so a batch counts whole or not at
    all, and once however often it is repeated. A bucket is read and written by several tasks if
    it is large, as that of a source with very many chunks is.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.expr(f"cast(pmod(xxhash64(source), {self.buckets}) as int)").alias("bucket")

    def _names(self, at: str, prefix: str) -> list[str]:
        p = self._path(at)
        return sorted(n for s in self._fs.listStatus(p) if (n := s.getPath().getName()).startswith(prefix)) if self._fs.exists(p) else []

    def _rows(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if self._names(self.path, "bucket=") else None

    def read(self) -> DataFrame | None:
        """The chunks; None before the first batch, and after one that has left nothing."""
        rows = self._rows()
        return None if rows is None else rows.drop("bucket")

    def _put_in_place(self) -> None:
        """Finishes what an earlier writer has written aside in whole, and drops what it has not."""
        for name in self._names(f"{self.path}/_aside", ""):
            at = f"{self.path}/_aside/{name}"
            if self._fs.exists(self._path(f"{at}/touched/_SUCCESS")):
                touched = self.spark.read.schema("bucket int, n long").parquet(f"{at}/touched").collect()
                if any(r["n"] for r in touched):
                    # its files hold a bucket each, so nothing is dealt out again
                    self.spark.read.parquet(f"{at}/rows").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
                for r in touched:
                    if not r["n"]:
                        self._fs.delete(self._path(f"{self.path}/bucket={r['bucket']}"), True)
            self._fs.delete(self._path(at), True)

    @staticmethod
    def _repeated(*hashes: DataFrame) -> bool:
        """May an id be there twice? By its 64-bit hash, so that no whole row is shuffled to find that none is."""
        return not reduce(DataFrame.union, hashes).groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def apply(self, incoming: DataFrame, gone: DataFrame | None = None, prune: bool = True) -> int:
        """Puts chunks in the place of those of their sources (without prune: of their ids) and deletes those of the sources in gone; says how many buckets that touched."""
        self._put_in_place()
        scratch = Scratch(self.spark, "chunk-batch")
        incoming = scratch.keep(incoming.withColumn("bucket", self._bucket()), "incoming")
        if self._repeated(incoming.select(F.xxhash64("id").alias("_hash"))):
            incoming = scratch.keep(incoming.dropDuplicates(["id"]), "distinct")
        leaving = scratch.keep(gone.select("source").distinct().withColumn("bucket", self._bucket()), "gone") if gone is not None else None
        buckets = incoming.select("bucket") if leaving is None else incoming.select("bucket").union(leaving.select("bucket"))
        touched = sorted(r[0] for r in buckets.distinct().collect())  # at most self.buckets numbers
        if touched:
            merged, old = incoming, self._rows()
            if old is not None:
                # whole rows go through one join by source; by id only where an id is met again
                leave = [d.select("source") for d in (leaving, incoming if prune else None) if d is not None]
                old = old.where(F.col("bucket").isin(touched)).select(*incoming.columns, F.xxhash64("id").alias("_hash"))
                if leave:
                    old = old.join(reduce(DataFrame.union, leave).distinct(), "source", "left_anti")
                met, old = self._repeated(old.select("_hash"), incoming.select(F.xxhash64("id").alias("_hash"))), old.drop("_hash")
                merged = upsert_chunks(old, incoming) if met else old.unionByName(incoming)
            aside = f"{self.path}/_aside/{uuid.uuid4().hex}"
            merged.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{aside}/rows")
            there = set(self._names(f"{aside}/rows", "bucket="))
            counts = [(b, int(f"bucket={b}" in there)) for b in touched]
            self.spark.createDataFrame(counts, "bucket int, n long").coalesce(1).write.parquet(f"{aside}/touched")
            self._put_in_place()
        scratch.drop()
        return len(touched)

    def sync(self, changes: DataFrame, rebuilt: DataFrame) -> int:
        """Applies what sync.diff_states has found: chunks of changed and deleted sources go, those of added and changed ones come from rebuilt."""
        gone = changes.where("change in ('changed', 'deleted')").select("source")
        fresh = changes.where("change in ('added', 'changed')").select("source")
        return self.apply(rebuilt.join(fresh, "source", "left_semi"), gone)
