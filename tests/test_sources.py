import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stackwright.operators import sync as Y
from stackwright.sources import files as N
from stackwright.sources.chunk_table import ChunkTable
from stackwright.streaming import jobs as J


@pytest.fixture
def root(tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/a b+c.md").write_text("# x\n\ny")
    (tmp_path / "docs/sub/b.MD").write_text("b")
    (tmp_path / "docs/skip.exe").write_text("no")
    (tmp_path / "docs/a b+c.md.meta.json").write_text(json.dumps({"version": "1.0", "classification": "secret", "doc_type": "spec"}))
    (tmp_path / "docs/sub/b.MD.meta.json").write_text("{broken")
    return str(tmp_path / "docs")


def test_scan_state_and_metadata(spark, root):
    files = N.scan_files(spark, root).cache()
    assert sorted(r["source"] for r in files.collect()) == ["a b+c.md", "a b+c.md.meta.json", "sub/b.MD", "sub/b.MD.meta.json"]
    assert sorted(r["source"] for r in N.scan_files(spark, root, include_sidecars=False).collect()) == ["a b+c.md", "sub/b.MD"]
    state = {r["source"]: r for r in N.doc_state(files).collect()}
    assert state["a b+c.md"]["meta_hash"] == state["a b+c.md.meta.json"]["file_hash"] and state["a b+c.md.meta.json"]["meta_hash"] == ""
    meta = {r["source"]: r for r in N.load_metadata(files).collect()}
    assert (meta["a b+c.md"]["version"], meta["a b+c.md"]["confidentiality"], meta["sub/b.MD"]["confidentiality"], meta["sub/b.MD"]["doc_type"]) == ("V1.0", "secret", "公开", "")


def test_manifest_round_trip(spark, root, tmp_path):
    path = str(tmp_path / "manifest")
    assert N.read_manifest(spark, path).count() == 0
    now = N.doc_state(N.scan_files(spark, root))
    N.write_manifest(now, path)
    assert {r["change"] for r in Y.diff_states(N.read_manifest(spark, path), now).collect()} == {"unchanged"}
    N.write_manifest(N.read_manifest(spark, path).where("source not like 'sub%'"), path)
    assert N.read_manifest(spark, path).count() == 2


def test_cases(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"query": " q ", "expected_sources": ["s", " "]}\n{"query": "", "expected_sources": ["s"]}\n{"id": "X", "query": "r", "expected_sources": ["t"]}\n{"query": "no"}\n')
    rows = N.read_cases_jsonl(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r["id"], r["query"], r["expected_sources"]) for r in rows] == [("T001", "q", ["s"]), ("X", "r", ["t"])]
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"id": "R1", "category": "retrieval", "question": "q", "filters": {"version": "V1"}, "expected_sources": ["s"]}, {"id": "M1", "category": "metadata_filter", "question": "p"}]}))
    cases = N.read_cases_json(spark, str(tmp_path / "c.json"))
    assert [r["id"] for r in N.filter_cases(cases, "retrieval").collect()] == ["R1"]
    assert [r["id"] for r in N.filter_cases(cases, ids=("M1",)).collect()] == ["M1"]


def test_audit_and_streams(spark, tmp_path, root):
    path = str(tmp_path / "audit")
    N.write_audit(spark.createDataFrame([("query", "a", True), ("query", "b", False), ("check", "c", True)], "event string, question string, low_confidence boolean"), path)
    with open(os.path.join(path, "bad.json"), "w") as f:
        f.write("not json\n")
    assert N.read_audit(spark, path).where("event is not null").count() == 3
    q = J.knowledge_gaps_stream(J.audit_stream(spark, path)).writeStream.format("memory").queryName("gaps").start()
    q.processAllAvailable()
    q.stop()
    assert [r["question"] for r in spark.table("gaps").collect()] == ["a"]
    table = ChunkTable(spark, str(tmp_path / "chunks"))
    docs = J.file_stream(spark, root).where(F.lower("source").endswith(".md"))
    for _ in range(2):  # the second run sees no new files
        J.ingest_stream(docs, table, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["source"] for r in table.read().collect()) == ["a b+c.md", "sub/b.MD"]


def test_files_of_one_name_are_two_documents_and_the_newest_version_counts(spark, tmp_path):
    for i, folder in enumerate(("a", "b", "c (1)+[x]")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "readme.txt").write_text(f"text {i}")
    table = ChunkTable(spark, str(tmp_path / "chunks"), 4)
    docs = J.file_stream(spark, str(tmp_path / "in"))
    J.ingest_stream(docs, table, str(tmp_path / "cp")).awaitTermination()
    names = ["a/readme.txt", "b/readme.txt", "c (1)+[x]/readme.txt"]
    assert sorted(r["source"] for r in table.read().collect()) == names
    rows = [("a/readme.txt", "old", 1), ("a/readme.txt", "new\n\nlonger", 9), ("a/readme.txt", "older", 0), ("b/readme.txt", None, 3)]
    spark.createDataFrame(rows, "source string, text string, t int").selectExpr("source", "text", "timestamp_seconds(t) modificationTime").coalesce(1).write.parquet(str(tmp_path / "more"))
    more = spark.readStream.schema("source string, text string, modificationTime timestamp").parquet(str(tmp_path / "more"))
    J.ingest_stream(more, table, str(tmp_path / "cp2")).awaitTermination()
    assert sorted((r["source"], r["content"]) for r in table.read().collect()) == [(names[0], "longer"), (names[0], "new"), (names[2], "text 2")]


CHUNK = "id string, source string, chunk_index int, content_hash string"


def _chunks(spark, sources, version):
    return spark.createDataFrame([(f"{s}:{i}", s, i, f"{version}{i}") for s, n in sources.items() for i in range(n)], CHUNK)


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    table = ChunkTable(spark, path, 8)
    assert table.read() is None
    table.apply(_chunks(spark, {f"s{i}": 3 for i in range(40)}, "a"))
    before, rows = _files(path), Counter(tuple(r) for r in table.read().collect())
    assert table.apply(_chunks(spark, {"s1": 2, "new": 1}, "b")) <= 2
    changed = {os.path.dirname(f) for f in before ^ _files(path)}
    assert 1 <= len(changed) <= 2
    after = Counter(tuple(r) for r in table.read().select(*CHUNK.replace(" string", "").replace(" int", "").split(", ")).collect())
    want = {r for r in rows if r[1] != "s1"} | {("s1:0", "s1", 0, "b0"), ("s1:1", "s1", 1, "b1"), ("new:0", "new", 0, "b0")}
    assert after == Counter(want)
    for _ in range(2):  # again, and without pruning
        table.apply(_chunks(spark, {"s1": 2, "new": 1}, "b"), prune=False)
    assert Counter(tuple(r) for r in table.read().select("id", "source", "chunk_index", "content_hash").collect()) == after
    assert table.apply(_chunks(spark, {}, ""), spark.createDataFrame([("s1",), ("nowhere",)], "source string")) <= 2
    assert {r["source"] for r in table.read().collect()} == {r[1] for r in want} - {"s1"}
    assert table.apply(_chunks(spark, {}, "")) == 0


def test_a_table_can_become_empty_and_full_again(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), 2)
    table.apply(_chunks(spark, {"a": 1, "b": 2}, "x"))
    table.apply(_chunks(spark, {}, ""), spark.createDataFrame([("a",), ("b",)], "source string"))
    assert table.read() is None
    table.apply(_chunks(spark, {"a": 1}, "y"))
    assert [r["content_hash"] for r in table.read().collect()] == ["y0"]


def test_a_writer_that_failed_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    table = ChunkTable(spark, str(tmp_path / "t"), 4)
    table.apply(_chunks(spark, {f"s{i}": 2 for i in range(9)}, "a"))
    real, calls = ChunkTable._put_in_place, []

    def failing(self):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        real(self)

    monkeypatch.setattr(ChunkTable, "_put_in_place", failing)
    with pytest.raises(OSError):
        table.apply(_chunks(spark, {"s1": 1}, "b"))
    assert {r["content_hash"] for r in table.read().where("source = 's1'").collect()} == {"a0", "a1"}
    table.apply(_chunks(spark, {"s2": 1}, "c"))
    got = {s: {r["content_hash"] for r in table.read().where(F.col("source") == s).collect()} for s in ("s1", "s2", "s3")}
    assert got == {"s1": {"b0"}, "s2": {"c0"}, "s3": {"a0", "a1"}}
    os.makedirs(tmp_path / "t/_aside/half/rows")
    table.apply(_chunks(spark, {"s2": 1}, "d"))
    assert not os.listdir(tmp_path / "t/_aside")


def test_upsert_leaves_stale_chunks_unless_pruned(spark):
    row = lambda s, i, h: (f"{s}{i}", s, h)
    old = spark.createDataFrame([row("a", 0, "x"), row("a", 1, "y"), row("b", 0, "z")], "id string, source string, content_hash string")
    new = spark.createDataFrame([row("a", 0, "n")], old.schema)
    assert sorted(r["id"] for r in Y.upsert_chunks(old, new).collect()) == ["a0", "a1", "b0"]
    assert sorted(r["id"] for r in Y.upsert_chunks(old, new, prune=True).collect()) == ["a0", "b0"]


def test_only_changed_files_are_opened(spark, tmp_path):
    names = ["a.md", "b c+d%20.txt", "sub/x[1]{y}*?.md", "sub/new.log", "a.md.meta.json", "no.exe"]
    (tmp_path / "in/sub").mkdir(parents=True)
    for n in names:
        (tmp_path / "in" / n).write_text(n)
    root = str(tmp_path / "in")
    whole = {r["source"]: tuple(r) for r in N.doc_state(N.scan_files(spark, root)).collect()}
    assert set(whole) == set(names) - {"no.exe"}
    none = N.read_manifest(spark, str(tmp_path / "manifest"))
    assert {r["source"]: tuple(r) for r in N.changed_states(spark, root, none, at_once=2).collect()} == whole
    # what a manifest knows by its time is not read again: its hash is taken as it is
    known = [("a.md", "known", "", whole["a.md"][3]), ("sub/new.log", "old", "", 1), ("gone.md", "g", "", 2)]
    got = {r["source"]: tuple(r) for r in N.changed_states(spark, root, spark.createDataFrame(known, N.STATE)).collect()}
    assert got == whole | {"a.md": ("a.md", "known", whole["a.md"][2], whole["a.md"][3])}


def test_whole_rows_are_joined_by_id_only_where_ids_meet(spark, tmp_path, monkeypatch):
    from stackwright.sources import chunk_table as T

    rows = lambda *r: spark.createDataFrame(list(r), "id string, source string, content string")
    table, real, calls = ChunkTable(spark, str(tmp_path / "t"), 2), T.upsert_chunks, []
    monkeypatch.setattr(T, "upsert_chunks", lambda *a: (calls.append(1), real(*a))[1])
    got = lambda: {tuple(r) for r in table.read().select("id", "source", "content").collect()}
    table.apply(rows(("1", "a", "x"), ("1", "a", "x"), ("2", "a", "y"), ("3", "b", "z"), ("6", None, "n")))
    table.apply(rows(("1", "a", "new"), ("4", "c", "w")), rows(("0", "b", "")).select("source"))
    assert got() == {("1", "a", "new"), ("4", "c", "w"), ("6", None, "n")} and not calls
    table.apply(rows(("4", "d", "moved"), ("5", "d", "v")))
    assert got() == {("1", "a", "new"), ("4", "d", "moved"), ("5", "d", "v"), ("6", None, "n")} and calls
