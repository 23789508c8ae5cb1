"""WARC archives with a two-level capture index.

Pages become WARC/1.0 records, one gzip member each. Of pages with equal payloads one is written
in full and the others as revisits of it. The capture index sorts reversed-host URL keys into
gzip blocks of BLOCK lines (one shard file a task), with a sparse directory of each shard's blocks
beside it. A look-up finds shards by their first keys, then a block by binary search in the shard's
directory, then lines by binary search in the block, and reads a record by its byte range.

Tasks write files to a folder that all executors share (any file system that pyarrow.fs knows by
its URI), under names of their own attempt, which are never changed. Which attempts count is what
the captures and the list of shards say, tables that only tasks that succeeded get into; files of
other attempts are deleted once those are written.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm.common import join_keyed
from stackwright.sources.scratch import Scratch

BLOCK = 3000
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CAPTURE = "page_id long, file string, offset long, length long"


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: Column) -> Column:
    """Reversed host, ')' and the rest: com,example,www)/path?query; '-' for a null or hostless url."""
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(url.isNull() | (host == ""), "-").otherwise(F.regexp_replace(key, r"\s", "%20"))


# ---- records


def record(page_id, url: str | None, payload: bytes | None, n: int, digest: str, refers_to, date: str = DATE) -> bytes:
    """One gzip member; payload None: a revisit of refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.0", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> dict:
    """The fields of an unzipped record; the payload is whole for responses."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x is None or x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number(fields.get("WARC-Refers-To")), "bytes": size, "payload": payload}


class _Out:
    """Files part-PPPPP-N-ATTEMPT of one task."""

    def __init__(self, uri: str, suffix: str):
        self.fs, self.root = _files(uri)
        self.suffix, self.n, self.out = suffix, 0, None
        self.part, self.attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        self.fs.create_dir(self.root, recursive=True)

    def put(self, data: bytes, most: int = FILE_BYTES) -> tuple[str, int]:
        if self.out is not None and self.at + len(data) > most:
            self.close()
        if self.out is None:
            self.name, self.at = f"part-{self.part:05}-{self.n}-{self.attempt}{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out, self.n = None, self.n + 1


def _only(uri: str, names: set[str]) -> None:
    """Deletes the files of a folder that attempts which did not count have left."""
    from pyarrow import fs

    system, root = _files(uri)
    for found in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith("part-") and found.base_name not in names:
            system.delete_file(found.path)


def write_archives(spark: SparkSession, pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) as records under path/archive; returns their captures.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response and the
    others are revisits. A null html is an empty payload; rows that repeat the largest page_id
    are responses too; a null page_id refers to its group's largest, or is a response if the
    group has none. The captures (key, page_id, file, offset, length) are a written table. A path
    takes one call: files that are there already and not in its captures are deleted. Other columns
    are ignored; an empty table gives no captures; a record holds its whole payload in memory.
    """
    scratch = Scratch(spark, "warc-captures")
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    facts = scratch.keep(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("sha"), F.octet_length(body).cast("long").alias("n")), "facts")
    large = facts.where(F.col("n") >= least)
    firsts = scratch.keep(large.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("times")).where("times > 1 and refers_to is not null"), "firsts")
    revisits = join_keyed(large, firsts, "sha", facts.count(), "times").where("not page_id <=> refers_to").select(F.col("page_id").alias("id"), F.col("sha").alias("same"), "refers_to").distinct()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", url_key(F.col("url")).alias("key"), "html", F.sha1(body).alias("sha"))
    rows = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["id"]) & (F.col("sha") == F.col("same")), "left")
    rows = rows.select("key", "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "sha", F.octet_length(body).cast("long").alias("n"), "refers_to").sortWithinPartitions("page_id", "url", "sha")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Out(f"{path}/archive", ".warc.gz")
        for pdf in batches:
            got = []
            for key, page, url, html, sha, n, refers in pdf.itertuples(index=False):
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                payload = (html or "").encode("utf-8", "surrogatepass") if refers is None else None
                data = record(page, url, payload, int(n), base64.b32encode(bytes.fromhex(sha)).decode(), refers, date)
                got.append((key, page, *out.put(data), len(data)))
            frame = pd.DataFrame(got, columns=["key", "page_id", "file", "offset", "length"])
            frame["page_id"] = frame["page_id"].astype("Int64")
            yield frame
        out.close()

    captures = scratch.keep(rows.mapInPandas(write, f"key string, {CAPTURE}"), "captures")
    scratch.drop("facts", "firsts")
    _only(f"{path}/archive", {r[0] for r in captures.select("file").distinct().collect()})  # a file a task, or a GB
    return captures


# ---- the capture index


def build_index(spark: SparkSession, captures: DataFrame, path: str, block: int = BLOCK) -> list[tuple[str, str]]:
    """Writes captures as sorted shards under path/index; returns (first key, shard) in order.

    The list has an entry for each task's shard, whatever the number of captures, and is written
    to path/index/shards.json too. Equal keys may span blocks and shards.
    """
    laid = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, lines, directory = _Out(f"{path}/index", ".cdx.gz"), [], []

        def flush():
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = z.compress("".join(x for _, x in lines).encode("utf-8", "surrogatepass")) + z.flush()
            name, at = out.put(data, 1 << 62)
            directory.append((lines[0][0], at, len(data)))
            lines.clear()
            return name

        name = None
        for pdf in batches:
            for key, page, file, offset, length in pdf.itertuples(index=False):
                lines.append((key, f"{key} {json.dumps([None if pd.isna(page) else int(page), file, offset, length])}\n"))
                if len(lines) == block:
                    name = flush()
        if lines:
            name = flush()
        out.close()
        if name:
            side = _Out(f"{path}/index", ".dir")
            side.attempt = out.attempt
            side.put("".join(f"{k} {a} {n}\n" for k, a, n in directory).encode("utf-8", "surrogatepass"))
            side.close()
            yield pd.DataFrame({"first": [directory[0][0]], "shard": [name.removesuffix(".cdx.gz")]})

    shards = sorted((r["first"], r["shard"]) for r in laid.mapInPandas(write, "first string, shard string").collect())  # one row a shard
    _only(f"{path}/index", {x for _, shard in shards for x in (f"{shard}.cdx.gz", f"{shard}.dir")})
    fs, root = _files(f"{path}/index")
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/shards.json") as f:
        f.write(json.dumps(shards).encode())
    return shards


def open_index(path: str) -> list[tuple[str, str]]:
    fs, root = _files(f"{path}/index")
    with fs.open_input_stream(f"{root}/shards.json") as f:
        return [tuple(x) for x in json.loads(f.read())]


class Shard:
    """One shard: its directory in memory, the block last used kept unzipped."""

    def __init__(self, fs, root: str, shard: str):
        with fs.open_input_stream(f"{root}/{shard}.dir", compression=None) as f:
            rows = [x.rsplit(" ", 2) for x in f.read().decode("utf-8", "surrogatepass").splitlines()]
        self.first, self.at = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.file, self.held, self.lines = fs.open_input_file(f"{root}/{shard}.cdx.gz"), -1, ([], [])

    def block(self, i: int) -> tuple[list[str], list[str]]:
        if i != self.held:
            self.file.seek(self.at[i][0])
            lines = zlib.decompress(self.file.read(self.at[i][1]), 31).decode("utf-8", "surrogatepass").split("\n")[:-1]
            self.held, self.lines = i, ([x.partition(" ")[0] for x in lines], lines)
        return self.lines

    def find(self, key: str) -> Iterator[list]:
        for i in range(max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key)):
            keys, lines = self.block(i)
            for j in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                yield json.loads(lines[j].partition(" ")[2])


def look_up(spark: SparkSession, keys: DataFrame, path: str, shards: list[tuple[str, str]]) -> DataFrame:
    """Captures (key, page_id, file, offset, length) of every distinct key of a table with a column key.

    A null key finds nothing, and nothing is found in an index without shards; a key that several
    captures share gives all of them.
    """
    firsts, names = [s[0] for s in shards], [s[1] for s in shards]

    @F.pandas_udf("array<int>")
    def places(column: pd.Series) -> pd.Series:
        return pd.Series([list(range(max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k))) for k in column], index=column.index)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _files(f"{path}/index")
        at, shard = None, None
        for pdf in batches:
            got = []
            for place, key in zip(pdf["place"], pdf["key"], strict=True):
                if place != at:
                    at, shard = place, Shard(fs, root, names[place])
                got += [(key, *x) for x in shard.find(key)]
            frame = pd.DataFrame(got, columns=["key", "page_id", "file", "offset", "length"])
            frame["page_id"] = frame["page_id"].astype("Int64")
            yield frame

    wanted = keys.select("key").where("key is not null").distinct().select("key", F.explode(places("key")).alias("place"))
    laid = wanted.repartitionByRange("place", "key").sortWithinPartitions("place", "key")
    return laid.mapInPandas(find, f"key string, {CAPTURE}")


def read_records(captures: DataFrame, path: str, payload: bool = False) -> DataFrame:
    """The records at the captures' byte ranges, in file order; each response's digest is checked.

    A capture that is repeated is read each time; without captures there are no records.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _files(f"{path}/archive")
        at, f = None, None
        for pdf in batches:
            got, held = [], 0
            for file, offset, length in zip(pdf["file"], pdf["offset"], pdf["length"], strict=True):
                if file != at:
                    at, f = file, fs.open_input_file(f"{root}/{file}")
                f.seek(offset)
                r = parse(zlib.decompress(f.read(length), 31))
                if r["type"] == "response" and (payload_digest(r["payload"]) != r["digest"] or len(r["payload"]) != r["bytes"]):
                    raise ValueError(f"{file} at {offset}: the payload does not have its digest")
                got.append((r["page_id"], r["url"], r["bytes"], r["digest"], r["type"], r["refers_to"], *[r["payload"]] * payload))
                held += len(r["payload"]) * payload
                if held > 16 << 20:
                    yield frame(got)
                    got, held = [], 0
            yield frame(got)

    def frame(got: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(got, columns=[x.split()[0] for x in schema.split(", ")])
        for c in ("page_id", "refers_to"):
            out[c] = out[c].astype("Int64")
        return out

    laid = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return laid.mapInPandas(read, schema)
