"""Documents become chunks: (source, chunk_index, content).

Input texts are rows (source, text) unless a function says otherwise.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackwright.functions import lexicon
from stackwright.functions import text as X
from stackwright.functions.batches import text_runs
from stackwright.sources.scratch import Scratch

MAX_CHARS, MIN_CHARS = 800, 60
WINDOW, STEP, OVERLAP = 4, 2, 2
LOG_LINES = 30
OCR_CHARS = 100

# Elements whose whole text is read.
TEXT_TAGS = ("title", "shortdesc", "p", "li", "note", "codeblock", "codeph", "term", "dd", "dt", "section", "result", "context", "steps")
# Cells that stand for a missing value.
MISSING = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def suffix_of(source: Column | str) -> Column:
    return F.lower(F.regexp_extract(X.col(source), r"[^/.](\.[^./]*)$", 1))


def parse_track(suffix: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in lexicon.TRACKS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(suffix)), F.lit(lexicon.OTHER_TRACK))


def file_format(suffix: Column) -> Column:
    return F.regexp_replace(F.lower(suffix), r"^\.", "")


def _chunks(df: DataFrame, contents: Column) -> DataFrame:
    return df.select("source", F.posexplode(contents).alias("chunk_index", "content"))


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(X.col(text), F.lit("")), "\n\n"), X.strip), lambda x: x != "")


def chunk_paragraphs(docs: DataFrame) -> DataFrame:
    """Texts between empty lines, trimmed, without blank ones."""
    return _chunks(docs, paragraphs("text"))


def chunk_window_split(chunk: Column, most: int = MAX_CHARS, window: int = WINDOW, step: int = STEP) -> Column:
    """A chunk that is too long, as windows of its paragraphs; with no more than a window of them, as it is."""
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(step)), lambda i: F.array_join(F.slice(p, i + 1, window), "\n\n"))
    return X.let(paragraphs(chunk), lambda p: F.when((F.length(chunk) <= most) | (F.size(p) <= window), F.array(chunk)).otherwise(cut(p)))


def chunk_merge_short(chunks: Column, least: int = MIN_CHARS) -> Column:
    """A short chunk is joined with the next one, and both are done with; the last is never joined.

    Of a run of short chunks and what follows it, every two are joined, from the first on.
    """
    pairs = lambda c, a, end: F.transform(F.sequence(a, end - 1, F.lit(2)), lambda i: F.array_join(F.slice(c, i + 1, F.least(F.lit(2), end - i)), "\n\n"))
    heads = lambda c: F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.length(F.get(c, i - 1)) >= least))
    joined = lambda c: X.let(heads(c), lambda h: F.flatten(F.transform(h, lambda a, i: pairs(c, a, F.coalesce(F.get(h, i + 1), F.size(c))))))
    return X.let(chunks, lambda c: F.when(F.size(c) > 0, joined(c)).otherwise(c))


# What begins a heading, a table's line and a list's item.
_HEADING, _TABLE, _ITEM = re.compile(r"#{1,6}\s+\S"), re.compile(r"\s*\|"), re.compile(r"\s*(?:[-*+]|\d+\.)\s+\S")


def _kind(line: str) -> str:
    return "" if not line.strip() else "heading" if _HEADING.match(line) else "table" if _TABLE.match(line) else "list" if _ITEM.match(line) else "para"


def blocks_of(text: str) -> list[tuple[str, str]]:
    """(kind, body) of a Markdown text's blocks: heading, table, list or para.

    Tables go on over blank lines; lists take indented lines with them; both other kinds end at one.
    """
    out: list[tuple[str, list[str]]] = []
    now = ""  # the kind of block that the next line may go on with
    for line in text.splitlines():
        kind = _kind(line)
        if not kind:
            now = now if now == "table" else ""
        elif now == "list" and (kind == "list" or line[0] in " \t") or kind == now and kind in ("table", "para"):
            out[-1][1].append(line.rstrip())
        else:
            out.append((kind, [line.rstrip()]))
            now = "" if kind == "heading" else kind
    return [(k, "\n".join(b)) for k, b in out]


def _blocks(text: Column | str) -> Column:
    @F.pandas_udf("array<struct<kind: string, body: string>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in text_runs(parts):
            yield pd.Series([[{"kind": k, "body": b} for k, b in blocks_of(t)] if t else [] for t in texts], index=texts.index, dtype=object)

    return of(text)


def _sections(blocks: Column) -> Column:
    """The blocks from each heading to the next, and those before the first, as arrays."""
    heads = lambda b: F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: (i == 0) | (F.get(b, i)["kind"] == "heading"))
    return X.let(blocks, lambda b: F.when(F.size(b) > 0, X.runs(b, heads(b))))


def _overlapped(sections: Column, overlap: int) -> Column:
    """Each section's text after the last blocks of the one before that are no heading; '' where nothing is left."""
    before = lambda s, i: F.filter(F.coalesce(F.get(s, i - 1), F.slice(F.get(s, i), 1, 0)), lambda b: b["kind"] != "heading")
    tail = lambda b: F.slice(b, F.greatest(F.size(b) - overlap + 1, F.lit(1)), overlap)
    bodies = lambda b: X.strip(F.array_join(F.filter(F.transform(b, lambda x: x["body"]), lambda x: X.strip(x) != ""), "\n\n"))
    return X.let(sections, lambda s: F.transform(s, lambda own, i: bodies(F.concat(X.let(before(s, i), tail), own) if overlap > 0 else own)))


def _markdown(docs: DataFrame) -> DataFrame:
    """Rows with their blocks, so that no row is mixed with another of its source."""
    return docs.select("source", "text", _blocks("text").alias("blocks"))


def _number(blocks: str = "blocks") -> Column:
    """The number of a text's first section: 0 if it comes before any heading, else 1."""
    return F.when(F.get(F.col(blocks), 0)["kind"] == "heading", 1).otherwise(0)


def md_blocks(docs: DataFrame) -> DataFrame:
    """source, pos, kind and body of every block; one pass over each text."""
    return _markdown(docs).select("source", F.posexplode("blocks").alias("pos", "b")).select("source", "pos", "b.kind", "b.body")


def md_sections(docs: DataFrame) -> DataFrame:
    """source, section and its blocks in order; a heading begins a section, what comes before the first is one too."""
    return _markdown(docs).select("source", _number().alias("n"), F.posexplode(_sections(F.col("blocks"))).alias("p", "blocks")).select("source", (F.col("p") + F.col("n")).alias("section"), "blocks")


def md_overlap(docs: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """source, section and content: each section after the last blocks of the one before that are no heading."""
    rows = _markdown(docs).select("source", _number().alias("n"), F.posexplode(_overlapped(_sections(F.col("blocks")), overlap)).alias("p", "content"))
    return rows.select("source", (F.col("p") + F.col("n")).alias("section"), "content").where("content != ''")


def _markdown_chunks(text: Column, blocks: Column, overlap: int = OVERLAP) -> Column:
    parts = F.filter(F.coalesce(_overlapped(_sections(blocks), overlap), F.array().cast("array<string>")), lambda x: x != "")
    cut = lambda p: chunk_merge_short(F.flatten(F.transform(p, lambda c: chunk_window_split(c))))
    return X.let(parts, lambda p: F.when(F.size(p) > 0, cut(p)).otherwise(F.array(X.strip(F.coalesce(text, F.lit(""))))))


def chunk_markdown(docs: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Blocks, sections, overlap, windows of long chunks, joining of short ones; else the whole text.

    All of it is within a row: nothing is shuffled, and rows of equal source stay apart.
    """
    return _chunks(_markdown(docs), _markdown_chunks(F.col("text"), F.col("blocks"), overlap))


def numbered(rows: DataFrame, *order: Column, label: str = "numbered") -> DataFrame:
    """rows with chunk_index: the place, from 0, of each among those of its source in the given order.

    Rows are dealt by ranges of source and order, each task numbers its own, and each source's
    counts of the tasks before are added: a source with any number of rows is numbered by many
    tasks. Rows of one source and one order have any order among them. The rows are written once.
    """
    keys = [F.col("source"), *order]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    laid = Scratch(rows.sparkSession, label).keep(laid, "rows").withColumn("_p", F.shiftright("_m", 33))
    parts = laid.groupBy("source", "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("_s"), F.col("_p").alias("_q"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    # a source that is null has its numbers too
    joined = laid.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn("chunk_index", (F.col("_before") + F.col("_m") - F.col("_first")).cast("int")).drop("_m", "_p", "_s", "_q", "_first", "_before")


def chunk_rows(rows: DataFrame, columns: list[str], order: str = "row_no") -> DataFrame:
    """Table rows (source, row_no, columns) as a line of the columns' names, then a chunk a row.

    Blank values are left out, rows of blanks too; numbers are printed as they were read.
    """
    cell = lambda c: F.when(X.strip(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
    body = rows.select("source", F.col(order).alias("at"), F.array_join(F.filter(F.array(*[cell(c) for c in columns]), lambda x: x.isNotNull()), " | ").alias("content")).where("content != ''")
    head = rows.select("source").distinct().select("source", F.lit(None).alias("at"), F.lit("字段: " + " | ".join(columns)).alias("content"))
    return numbered(head.unionByName(body), F.col("at").asc_nulls_first(), label="table-rows").select("source", "chunk_index", "content")


def csv_names(header: list[str]) -> list[str]:
    """Column names of a header: blank ones are called by their place, a repeated one gets a number."""
    out: list[str] = []
    for i, h in enumerate(header):
        name, n = h if h.strip() else f"Unnamed: {i}", 0
        while name in out:
            n += 1
            name = f"{h}.{n}"
        out.append(name)
    return out


def csv_chunks(text: str, missing: Sequence[str] = MISSING) -> list[str]:
    """A table's own header, then its rows as 'name: value'; blank and missing values and rows of these are left out.

    Quoted cells may hold commas, quotes (doubled) and line breaks; a row may lack its last cells;
    cells beyond the header are called by their place. A text without a header has no chunks.
    """
    csv.field_size_limit(2**31 - 1)
    records = (r for r in csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")) if any(c.strip() for c in r))
    names = csv_names(next(records, []))
    if not names:
        return []
    out = ["字段: " + " | ".join(names)]
    for r in records:
        cells = zip(names + [f"Unnamed: {i}" for i in range(len(names), len(r))], r, strict=False)
        row = " | ".join(f"{n}: {c}" for n, c in cells if c.strip() and c not in missing)
        out += [row] if row else []
    return out


def chunk_csv(docs: DataFrame) -> DataFrame:
    """Texts of comma-separated values, each with a header of its own, by rows."""
    return _chunks(docs, _cutter(csv_chunks)("text"))


def _log_chunks(text: Column, n: int = LOG_LINES) -> Column:
    own = F.filter(X.lines(text), lambda x: X.strip(x) != "")
    return X.let(own, lambda a: F.when(F.size(a) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(n)), lambda i: F.array_join(F.slice(a, i + 1, n), "\n"))))


def chunk_log(docs: DataFrame, n: int = LOG_LINES) -> DataFrame:
    """Blocks of n lines that are not blank."""
    return _chunks(docs, _log_chunks(F.col("text"), n))


def json_chunks(text: str) -> list[str]:
    try:
        data = json.loads(text)
    except ValueError:
        return [p for p in (x.strip() for x in text.split("\n\n")) if p]
    if isinstance(data, dict):
        return [f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in data.items()]
    row = lambda x: " | ".join(f"{k}: {v}" for k, v in x.items() if v is not None and str(v).strip()) if isinstance(x, dict) else str(x)
    return [r for r in map(row, data if isinstance(data, list) else [str(data)]) if r]


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _readable(e) -> str:
    if _local(e.tag) in TEXT_TAGS:
        return " ".join("".join(e.itertext()).split())
    return "\n".join(t for t in map(_readable, e) if t)


def xml_chunks(text: str) -> list[str]:
    """The title's text, then the paragraphs of every other top element; a malformed text as plain."""
    plain = lambda t: [p for p in (x.strip() for x in t.split("\n\n")) if p]
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return plain(text)
    titles = [e for e in root if _local(e.tag) == "title"]
    first = " ".join((titles[0].text or "").split()) if titles else ""
    return [first] * bool(first) + [p for e in root if _local(e.tag) != "title" for p in plain(_readable(e))]


def _cutter(cut: Callable[[str], list[str]]):
    @F.pandas_udf("array<string>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in text_runs(parts):
            yield pd.Series([cut(t) if t else [] for t in texts], index=texts.index, dtype=object)

    return of


def chunk_json(docs: DataFrame) -> DataFrame:
    """An array's items or an object's keys; what is no JSON as paragraphs."""
    return _chunks(docs, _cutter(json_chunks)("text"))


def chunk_xml(docs: DataFrame) -> DataFrame:
    return _chunks(docs, _cutter(xml_chunks)("text"))


def chunk_runs(paras: DataFrame) -> DataFrame:
    """Paragraphs (source, pos, style, text): body paragraphs joined by blanks up to a blank or a heading; headings alone."""
    own = paras.withColumn("text", X.strip(F.coalesce("text", F.lit(""))))
    head = F.coalesce(F.col("style").startswith("Heading"), F.lit(False)) & (F.col("text") != "")
    w = Window.partitionBy("source").orderBy("pos")
    rows = own.withColumn("head", head).withColumn("stop", F.col("head") | (F.col("text") == "") | F.coalesce(F.lag(head).over(w), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("stop").cast("int")).over(w)).where("text != ''")
    whole = rows.groupBy("source", "run").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("content"))
    return whole.select("source", (F.row_number().over(w) - 1).alias("chunk_index"), "content")


def chunk_slides(lines: DataFrame) -> DataFrame:
    """Lines of slides (source, slide_no, pos, text): one chunk a slide that has text."""
    own = lines.withColumn("text", X.strip(F.coalesce("text", F.lit("")))).where("text != ''")
    whole = own.groupBy("source", "slide_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("t"))
    return whole.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("slide_no")) - 1).alias("chunk_index"), F.concat(F.lit("[幻灯片 "), F.col("slide_no").cast("string"), F.lit("] "), F.col("t")).alias("content"))


def route_pdf_pages(pages: DataFrame, least: int = OCR_CHARS) -> tuple[DataFrame, DataFrame]:
    """Pages (source, page_no, text): chunks of files with enough text a page, and the sources that need OCR."""
    mean = pages.groupBy("source").agg((F.sum(F.length(X.strip(F.coalesce("text", F.lit(""))))) / F.greatest(F.count("*"), F.lit(1))).alias("mean"))
    text = pages.join(mean.where(F.col("mean") >= least), "source", "left_semi").select("source", "page_no", F.posexplode(paragraphs("text")).alias("p", "content"))
    return numbered(text, F.col("page_no"), F.col("p"), label="pages").select("source", "chunk_index", "content"), mean.where(F.col("mean") < least).select("source")


def chunk_dispatch(docs: DataFrame) -> DataFrame:
    """Each document by the chunker of its suffix; unknown ones as plain text. Sheets come as rows elsewhere (chunk_rows).

    One scan: a row is read by one chunker only, the others get a null.
    """
    suffix, text = F.col("suffix"), F.col("text")
    md, xml, js, table = suffix == ".md", suffix.isin(".xml", ".dita", ".ditamap"), suffix == ".json", suffix == ".csv"
    rows = docs.select("source", "text", suffix_of("source").alias("suffix"))
    rows = rows.select("*", _blocks(F.when(md, text)).alias("blocks"), _cutter(xml_chunks)(F.when(xml, text)).alias("xml"), _cutter(json_chunks)(F.when(js, text)).alias("json"), _cutter(csv_chunks)(F.when(table, text)).alias("csv"))
    own = F.when(md, _markdown_chunks(text, F.col("blocks"))).when(xml, F.col("xml")).when(js, F.col("json")).when(table, F.col("csv")).when(suffix == ".log", _log_chunks(text)).otherwise(paragraphs(text))
    return _chunks(rows, own)


def make_chunk_records(chunks: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Chunks with id, content_hash and the metadata columns.

    meta: source and any metadata fields; track and format follow from the suffix whatever it says.
    Without meta, chunks may have such fields themselves; then nothing is joined.
    """
    suffix, fixed = suffix_of("source"), ("parse_track", "file_format")
    given = [f for f in lexicon.META_DEFAULTS if f in (chunks if meta is None else meta).columns and f not in fixed]
    rows = chunks.select("source", "chunk_index", "content", *(given if meta is None else []))
    if given and meta is not None:
        rows = rows.join(meta.select("source", *given), "source", "left")
    fields = {f: F.coalesce(F.col(f), F.lit(d)) if f in given else F.lit(d) for f, d in lexicon.META_DEFAULTS.items()}
    fields |= {"parse_track": parse_track(suffix), "file_format": file_format(suffix)}
    return rows.select(F.sha2(F.concat_ws(":", "source", F.col("chunk_index").cast("string")), 256).alias("id"), "content", "source", "chunk_index", F.sha2("content", 256).alias("content_hash"), *[c.alias(f) for f, c in fields.items()])


def load_chunks(docs: DataFrame, meta: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Chunk records of all documents, or of those listed in sources."""
    if sources is not None:
        docs = docs.join(sources.select("source").distinct(), "source", "left_semi")
    return make_chunk_records(chunk_dispatch(docs), meta)
