"""Token counts as delta-maintained rollups.

Counts are additive, so totals by (source, lang, tokenizer) are kept from signed rows: +n for an
insert, -n for a delete, both for a revised count. A batch of changes is summed by key and
committed under its id, once: a batch that arrives again changes nothing, and a job that died half
way left nothing that counts. Totals are the sum of committed batches; compaction folds them.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm.common import WORD

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
TOKENIZERS = "/opt/tokenizers"
#: How the byte-level vocabularies split text before they merge bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _counter(spark: SparkSession, vocabulary: str):
    """A pandas UDF of token counts; the vocabulary file is read here and broadcast."""
    with open(vocabulary, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in held.value.splitlines() if x)}
        enc = tiktoken.Encoding("rollup", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], index=texts.index, dtype="int64")

    return count


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str = TOKENIZERS, name: str = "n_tokens", column: str = "text") -> DataFrame:
    """docs with the number of tokens of a text column: 'words', or a .tiktoken file of the folder.

    Null and empty texts have none; texts of any length are counted whole; repeated rows give
    repeated counts, an empty table none. A column of the given name is replaced.
    """
    if tokenizer == "words":
        n = F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
    else:
        n = _counter(spark, os.path.join(folder, f"{tokenizer}.tiktoken"))(column)
    return docs.withColumn(name, n)


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of changes: op (insert, delete, revise), the KEYS, n_tokens, and for revise
    old_source, old_lang, old_tokenizer and old_n_tokens, which may differ from the new ones.

    Unknown or null ops raise, as do revised rows without one of the old columns or with a null
    old_n_tokens: a change that cannot be applied must not be lost. A null n_tokens counts as 0;
    every repeated row counts; an empty table is no change.
    """
    row = lambda sign, p="": F.struct(*[F.col(p + k).cast("string").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("docs"), (F.coalesce(F.col(p + "n_tokens"), F.lit(0)) * sign).cast("long").alias("tokens"))
    lacking = [c for c in ("old_n_tokens", *("old_" + k for k in KEYS)) if c not in changes.columns]
    if lacking:
        old = F.raise_error(F.lit(f"a revised row needs {', '.join(lacking)}")).cast(f"struct<{', '.join(f'{k}: string' for k in KEYS)}, docs: bigint, tokens: bigint>")
    else:
        old = F.when(F.col("old_n_tokens").isNull(), F.raise_error(F.lit("a revised row needs old_n_tokens"))).otherwise(row(-1, "old_"))
    rows = F.when(F.col("op") == "insert", F.array(row(1))).when(F.col("op") == "delete", F.array(row(-1))).when(F.col("op") == "revise", F.array(old, row(1)))
    return changes.select(F.explode(F.coalesce(rows, F.raise_error(F.lit("a change needs op insert, delete or revise")))).alias("d")).select("d.*")


class Rollup:
    """Totals under a path; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        return sorted(n for s in self._fs.listStatus(root) if (n := s.getPath().getName()).startswith(prefix))

    def _publish(self, df: DataFrame, name: str) -> None:
        """Written aside, then renamed: the name exists only with all of its rows."""
        aside, target = f"{self.path}/.aside-{uuid.uuid4().hex}", self._path(f"{self.path}/{name}")
        df.write.parquet(aside)
        # renaming onto a folder that exists would put the table inside it
        if self._fs.exists(target) or not self._fs.rename(self._path(aside), target) or self._fs.exists(self._path(f"{self.path}/{name}/{aside.rpartition('/')[2]}")):
            raise OSError(f"{name} could not be put in place")

    def _base(self) -> tuple[str | None, set[str]]:
        bases = [n for n in self._names("base-") if self._fs.exists(self._path(f"{self.path}/folded-{n[5:]}"))]
        if not bases:
            return None, set()
        ids = {r[0] for r in self.spark.read.schema("id string").parquet(f"{self.path}/folded-{bases[-1][5:]}").collect()}
        return bases[-1], ids

    def committed(self) -> set[str]:
        return self._base()[1] | {unquote(n[6:]) for n in self._names("batch-")}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False, and nothing done, if it is committed already."""
        if batch_id in self.committed():
            return False
        summed = signed(changes).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")
        self._publish(summed, "batch-" + quote(batch_id, safe=""))
        return True

    def totals(self) -> DataFrame:
        """KEYS, docs and tokens; keys whose counts have come to nothing are gone. Null keys are keys."""
        base, folded = self._base()
        paths = [f"{self.path}/{n}" for n in [*([base] if base else []), *(n for n in self._names("batch-") if unquote(n[6:]) not in folded)]]
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")

    def compact(self) -> None:
        """Folds all batches into one table. The list of folded ids is published after the totals
        and before the batches go, so a crash at any point counts every batch once."""
        ids, n = sorted(self.committed()), uuid.uuid4().hex
        number = f"{len(self._names('base-')) + 1:09}-{n}"
        self._publish(self.totals(), f"base-{number}")
        self._publish(self.spark.createDataFrame([(i,) for i in ids], "id string"), f"folded-{number}")
        for name in self._names("batch-"):
            if unquote(name[6:]) in set(ids):
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
