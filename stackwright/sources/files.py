"""Files, sidecars, manifests, cases and the audit log as tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.functions import lexicon
from stackwright.functions import text as X
from stackwright.operators.analytics import audit_schema
from stackwright.operators.chunking import suffix_of
from stackwright.sources.scratch import Scratch

SIDECAR = ".meta.json"
STATE = "source string, file_hash string, meta_hash string, mtime_ns long"
META_FIELDS = tuple(f for f in lexicon.META_DEFAULTS if f not in ("parse_track", "file_format"))


def under(root: str) -> Column:
    """The column path as a path under root."""
    path = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    base = "/" + re.sub(r"^[a-z0-9]+:/*", "", root).strip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 2**31 - 1)).otherwise(path)


def scan_files(spark: SparkSession, root: str, include_sidecars: bool = True) -> DataFrame:
    """source (path under root), modificationTime, length and content of files with a known suffix.

    A sidecar ends in .json and so counts as a document, unless it is left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.withColumn("source", under(root)).where(suffix_of("source").isin(*lexicon.TRACKS))
    if not include_sidecars:
        rows = rows.where(~F.col("source").endswith(SIDECAR))
    return rows.select("source", "modificationTime", "length", "content")


def doc_state(files: DataFrame) -> DataFrame:
    """source, file_hash, meta_hash ('' without a sidecar) and mtime_ns of every file."""
    hashed = files.select("source", F.sha2("content", 256).alias("file_hash"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    return _with_sidecars(hashed)


def changed_states(spark: SparkSession, root: str, manifest: DataFrame, at_once: int = 10_000) -> DataFrame:
    """doc_state() of all files under root, where only those are opened whose time differs from the manifest's, or that it lacks.

    Files are listed without their content and compared with the manifest; the others' paths pass
    through the driver ``at_once`` at a time. A file that is rewritten within one tick of its
    modification time, as a copy that keeps the time, is taken for unchanged.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime")
    listed = files.select("path", under(root).alias("source"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")).where(suffix_of("source").isin(*lexicon.TRACKS))
    scratch = Scratch(spark, "changed-files")
    known = manifest.select("source", F.col("mtime_ns").alias("_was"), "file_hash")
    both = scratch.keep(listed.join(known, "source", "left").withColumn("file_hash", F.when(F.col("_was") == F.col("mtime_ns"), F.col("file_hash"))), "listed")
    hashed, paths = both.where("file_hash is not null").select("source", "mtime_ns", "file_hash"), []

    def read(n: int) -> DataFrame:
        own = spark.read.format("binaryFile").load(paths).select(under(root).alias("source"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("file_hash"))
        return scratch.keep(own, f"hashed{n}")

    for n, r in enumerate(both.where("file_hash is null").select("path").toLocalIterator(), 1):
        paths.append(re.sub(r"([*?\[\]{}\\])", r"\\\1", r["path"]))
        if n % at_once == 0:
            hashed, paths = hashed.unionByName(read(n)), []
    if paths:
        hashed = hashed.unionByName(read(0))
    return _with_sidecars(hashed)


def _with_sidecars(hashed: DataFrame) -> DataFrame:
    side = hashed.where(F.col("source").endswith(SIDECAR)).select(F.col("source").alias("_side"), F.col("file_hash").alias("_hash"))
    joined = hashed.join(side, F.concat("source", F.lit(SIDECAR)) == F.col("_side"), "left")
    return joined.select("source", "file_hash", F.coalesce("_hash", F.lit("")).alias("meta_hash"), "mtime_ns")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The state table of the last run; empty if there is none."""
    p, fs = _fs(spark, path)
    return spark.read.schema(STATE).parquet(path) if fs.exists(p) else spark.createDataFrame([], STATE)


def write_manifest(state: DataFrame, path: str) -> None:
    """Written aside in whole, then put in the place of the old one, which it may have been read from."""
    spark = state.sparkSession
    aside, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}.old"
    state.select("source", "file_hash", "meta_hash", "mtime_ns").write.parquet(aside)
    p, fs = _fs(spark, path)
    if fs.exists(p):
        fs.rename(p, _fs(spark, old)[0])
    fs.rename(_fs(spark, aside)[0], p)
    fs.delete(_fs(spark, old)[0], True)


def metadata_columns(raw: Column) -> dict[str, Column]:
    """The metadata fields of a sidecar's JSON text, with defaults; an unreadable one has only these.

    An old 'classification' stands for confidentiality; versions get their V.
    """
    data = F.from_json(raw, ", ".join(f"{f} string" for f in (*META_FIELDS, "classification")))
    value = {f: F.coalesce(data[f], F.lit(lexicon.META_DEFAULTS[f])) for f in META_FIELDS}
    value["confidentiality"] = F.coalesce(data["confidentiality"], data["classification"], F.lit(lexicon.META_DEFAULTS["confidentiality"]))
    value["version"] = X.normalize_version(value["version"])
    return value


def load_metadata(files: DataFrame) -> DataFrame:
    """source and the metadata fields of every file that is no sidecar."""
    side = files.where(F.col("source").endswith(SIDECAR)).select(F.expr(f"substring(source, 1, length(source) - {len(SIDECAR)})").alias("source"), F.col("content").cast("string").alias("_raw"))
    rows = files.where(~F.col("source").endswith(SIDECAR)).select("source").join(side, "source", "left")
    return rows.select("source", *[c.alias(f) for f, c in metadata_columns(F.col("_raw")).items()])


def xml_metadata(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    try:
        nodes = ElementTree.fromstring(text).iter()
    except (ElementTree.ParseError, ValueError):
        return out
    for e in nodes:
        tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
        name, value = {
            "prodname": ("product_line", e.text),
            "vrm": ("version", e.get("version") or e.get("release")),
            "othermeta": (e.get("name", ""), e.get("content")),
        }.get(tag, ("", None))
        if value and name in lexicon.META_DEFAULTS:
            out[name] = value.strip()
    return out


def extract_xml_metadata(docs: DataFrame) -> DataFrame:
    """source and what the markup of (source, text) tells; null where it is silent; the last of equals counts."""
    schema = ", ".join(f"{f} string" for f in META_FIELDS)

    @F.pandas_udf(schema)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [xml_metadata(t or "") for t in texts]
        return pd.DataFrame([{f: r.get(f) for f in META_FIELDS} for r in rows], columns=list(META_FIELDS), dtype=object)

    return docs.select("source", of("text").alias("_m")).select("source", "_m.*")


def fill_metadata(meta: DataFrame, found: DataFrame) -> DataFrame:
    """meta with its empty fields filled from found; defaults that are not empty stay."""
    other = found.select("source", *[F.col(f).alias(f"_{f}") for f in META_FIELDS])
    return meta.join(other, "source", "left").select("source", *[F.when((F.col(f) == "") & F.col(f"_{f}").isNotNull(), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in META_FIELDS])


def read_chunk_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_chunk_table(chunks: DataFrame, path: str, mode: str = "errorifexists", by: Sequence[str] = ()) -> None:
    chunks.write.mode(mode).partitionBy(*by).parquet(path)


def read_cases_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """id, query, expected_sources and where of a file with a JSON object a line, in file order.

    Lines without a query or a source are dropped; one without an id gets the number of its line
    among those that stay. A case file is small and is read as one partition.
    """
    rows = spark.read.schema("id string, query string, expected_sources array<string>, where map<string,string>").json(path).coalesce(1).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("query", X.strip(F.coalesce("query", F.lit("")))).withColumn("expected_sources", F.filter(F.transform("expected_sources", X.strip), lambda s: s != ""))
    rows = rows.where("query != '' and size(expected_sources) > 0")
    from pyspark.sql.window import Window

    number = F.format_string("T%03d", F.row_number().over(Window.orderBy("_at")))  # over a case file
    return rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), number)).drop("_at")


def read_cases_json(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a {"cases": [...]} document."""
    filters = ", ".join(f"{f}: string" for f in lexicon.FILTER_FIELDS)
    lists = ", ".join(f"{c}: array<string>" for c in ("expected_sources", "forbidden_sources", "expected_keywords", "expected_chunk_keywords"))
    schema = f"cases array<struct<id: string, category: string, question: string, filters: struct<{filters}>, {lists}, notes: string>>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("cases").alias("c")).select("c.*")


def filter_cases(cases: DataFrame, category: str | None = None, ids: Sequence[str] = ()) -> DataFrame:
    """Cases of a category and of listed ids; what is not given does not constrain."""
    out = cases if category is None else cases.where(F.col("category") == category)
    return out.where(F.col("id").isin(*ids)) if ids else out


def write_audit(events: DataFrame, path: str) -> None:
    """Appends events (event and any fields) as JSON lines, with the time where ts is missing."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    events = events.withColumn("ts", F.coalesce("ts", now) if "ts" in events.columns else now)
    events.select("ts", "event", *[c for c in events.columns if c not in ("ts", "event")]).write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events; lines that are no JSON are skipped."""
    return spark.read.schema(audit_schema()).option("mode", "DROPMALFORMED").json(path)


def write_report(summary: DataFrame, details: DataFrame, path: str) -> None:
    """A summary and its per-case rows as JSON, in two folders."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")
