"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session (tests) may leave it unset; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables of one operator run, written to the shared folder to cut lineage.

    A written table survives lost executors, so later stages never recompute what made it.
    """

    _noted: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        for noted in self._noted:
            noted.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; without a name, all of them."""
        jvm = self.spark.sparkContext._jvm
        for at in [self.path(n) for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def cleared() -> Iterator[None]:
    """Deletes, at its end, what operators called inside have left in the shared folder.

    For callers that have written down by then what they want of the results. What they keep
    themselves must come from a Scratch that is older.
    """
    noted: list[Scratch] = []
    Scratch._noted.append(noted)
    try:
        yield
    finally:
        Scratch._noted.remove(noted)
        for scratch in noted:
            scratch.drop()
