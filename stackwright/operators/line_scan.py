"""The checker's rules on neighbouring lines as one scan with a small state.

A document is scanned within its row. A very long one is cut into blocks of lines, which are dealt
to tasks: each block first gives a summary of what it does to the state, the summaries of a
document are joined up in order, and each block is then scanned with the state that it begins in.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackwright.functions import text as X
from stackwright.sources.scratch import Scratch

#: Characters of a document that is scanned in one go, and lines of a block of a longer one.
WHOLE, BLOCK = 4_000_000, 20_000
#: Characters of a paragraph that are shown.
SHOWN = 80

_FENCE, _HEADING, _TITLE = re.compile(r"(?:`{3,}|~{3,})"), re.compile(r"#{1,6}\s+\S", re.ASCII), re.compile(r"#{1,6}\s", re.ASCII)
_ITEM, _WIDE, _HALF = re.compile(r"([0-9]+)\.(?:\s|$)", re.ASCII), re.compile("[０-９]"), re.compile("[0-9]")

ISSUES = "file_path string, line int, col int, level string, category string, message string, context string, suggestion string"


@dataclass
class State:
    """What the lines so far leave open."""

    code: bool = False
    #: line and text of a heading that nothing has followed
    heading: list | None = None
    blank: int = 0
    #: first line, characters and shown text of an open paragraph
    para: list | None = None
    half: bool = False
    #: line, column, digit and context of the first full-width digit
    wide: list | None = None
    #: the line before, if it was no code
    before: str | None = None
    number: int | None = None


@dataclass
class Summary:
    """What a block does: the state it leaves after beginning with nothing open, and what it passes on from before."""

    end: State
    heading_kept: bool = True
    all_blank: bool = True
    all_para: bool = True
    number_kept: bool = True
    lines: int = 0

    def after(self, s: State) -> State:
        """The state after the block, from that before it."""
        e = self.end
        para = e.para
        if self.all_para and s.para:
            para = [s.para[0], s.para[1] + (e.para[1] if e.para else 0), (s.para[2] + (e.para[2] if e.para else ""))[:SHOWN]]
        return State(e.code, s.heading if self.heading_kept else e.heading, e.blank + s.blank * self.all_blank, para, s.half or e.half, s.wide or e.wide, e.before if self.lines else s.before, s.number if self.number_kept else e.number)


class Scan:
    def __init__(self, categories: dict[str, str], most_blank: int, most_para: int):
        self.of, self.most_blank, self.most_para = categories, most_blank, most_para

    def run(self, lines: list[str], first: int, state: State, last: bool) -> tuple[list[tuple], Summary]:
        """Issues (line, col, level, category, message, context, suggestion) of lines numbered from first; last: the document ends with them."""
        out: list[tuple] = []
        s, told, n_blank = state, Summary(state), self.most_blank + 1
        for n, line in enumerate(lines, first):
            told.lines += 1
            own = line.strip()
            fence = bool(_FENCE.match(own))
            if fence:
                s.code = not s.code
            if fence or s.code:
                told.all_blank = told.all_para = told.number_kept = False
                self._close(s, out)
                s.blank, s.before, s.number = 0, None, None
                continue
            if not own:
                s.blank += 1
                told.all_para = told.number_kept = False
                self._close(s, out)
                s.number = None
                if s.blank % n_blank == 0:
                    out.append((n - self.most_blank, 0, "warning", self.of["format"], f"连续空行超过 {self.most_blank} 行（共 {n_blank} 行）", "", f"减少连续空行至不超过 {self.most_blank} 行"))
                s.before = own
                continue
            s.blank, told.all_blank = 0, False
            heading = bool(_HEADING.match(own))
            if heading and s.heading:
                out.append((s.heading[0], 1, "warning", self.of["structure"], f'章节 "{s.heading[1]}" 内容为空', s.heading[1], "在标题下方补充内容，或删除该标题"))
            s.heading, told.heading_kept = [n, own] if heading else None, False
            if _TITLE.match(own):
                told.all_para = False
                self._close(s, out)
            elif s.para:
                s.para[1] += len(own)
                s.para[2] = (s.para[2] + own)[:SHOWN] if len(s.para[2]) < SHOWN else s.para[2]
            else:
                s.para = [n, len(own), own[:SHOWN]]
            if not s.wide and (m := _WIDE.search(line)):
                s.wide = [n, m.start() + 1, m[0], line.rstrip()[:SHOWN]]
            s.half = s.half or bool(_HALF.search(line))
            if s.before == own and len(own) > 5:
                out.append((n, 1, "warning", self.of["typo"], "与上一行完全重复", own[:SHOWN], "删除重复行"))
            s.before = own
            if (m := _ITEM.match(line.lstrip())) and len(m[1].lstrip("0")) <= 38:
                number = int(m[1])
                if s.number is not None and number != s.number + 1:
                    out.append((n, 1, "warning", self.of["format"], f"有序列表编号不连续：期望 {s.number + 1}，实际 {number}", line.rstrip()[:SHOWN], f"将编号改为 {s.number + 1}"))
                s.number, told.number_kept = number, False
        if last:
            self._close(s, out)
            if s.wide and s.half:
                n, col, digit, context = s.wide
                out.append((n, col, "warning", self.of["format"], f'文档中混用了全角数字（如 "{digit}"）和半角数字', context, "统一使用半角数字（0-9）"))
        return out, told

    def _close(self, s: State, out: list[tuple]) -> None:
        if s.para and s.para[1] > self.most_para:
            out.append((s.para[0], 0, "info", self.of["readability"], f"段落过长（{s.para[1]} 字符，建议不超过 {self.most_para}）", s.para[2] + "…", "将长段落拆分为多个较短段落"))
        s.para = None


_COLUMNS = [c.split()[0] for c in ISSUES.split(", ")]


def _whole(scan: Scan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(path, *i) for path, text in zip(pdf["file_path"], pdf["text"], strict=True) for i in scan.run((text or "").splitlines(), 1, State(), True)[0]], columns=_COLUMNS)

    return run


def _summaries(scan: Scan):
    """Of blocks that know whether they begin in code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = [scan.run(list(lines), first, State(code=bool(code)), False)[1] for lines, first, code in zip(pdf["lines"], pdf["first"], pdf["code"], strict=True)]
            yield pd.DataFrame({"file_path": pdf["file_path"], "first": pdf["first"], "told": [json.dumps(asdict(t)) for t in told]})

    return run


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Summaries in order of (file_path, first), as the states that their blocks begin in."""
    path, state = None, State()
    for pdf in batches:
        out = []
        for own, first, told in zip(pdf["file_path"], pdf["first"], pdf["told"], strict=True):
            if own != path or first == 1:
                path, state = own, State()
            out.append((own, first, json.dumps(asdict(state))))
            t = json.loads(told)
            state = Summary(State(**t.pop("end")), **t).after(state)
        yield pd.DataFrame(out, columns=["file_path", "first", "state"])


def _judged(scan: Scan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["file_path"], pdf["lines"], pdf["first"], pdf["state"], pdf["last"], strict=True)
            yield pd.DataFrame([(path, *i) for path, lines, first, state, last in rows for i in scan.run(list(lines), first, State(**json.loads(state)), last)[0]], columns=_COLUMNS)

    return run


def neighbour_issues(docs: DataFrame, scan: Scan, whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """Issues of the rules on neighbouring lines of (file_path, text); documents of over ``whole`` characters are scanned in blocks. Paths name one document each."""
    # a condition on the rows would work out a derived text once more
    short = X.let(F.col("text"), lambda t: F.when(F.length(t) <= whole, t))
    out = docs.select("file_path", short.alias("text")).mapInPandas(_whole(scan), ISSUES)
    long = docs.where(F.length("text") > whole)
    if long.isEmpty():
        return out
    scratch = Scratch(docs.sparkSession, "long-documents")
    lines = long.select("file_path", X.lines("text").alias("a")).select("file_path", "a", F.explode(F.sequence(F.lit(0), F.size("a") - 1, F.lit(block))).alias("i"))
    blocks = lines.select("file_path", (F.col("i") + 1).alias("first"), F.slice("a", F.col("i") + 1, block).alias("lines"), (F.col("i") + block >= F.size("a")).alias("last"))
    blocks = scratch.keep(blocks.repartition("file_path", "first"), "blocks")
    fences = blocks.select("file_path", "first", F.size(F.filter("lines", lambda x: X.strip(x).rlike(r"^(?:`{3,}|~{3,})"))).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    code = fences.select("file_path", "first", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("code"))
    told = blocks.join(code, ["file_path", "first"]).select("file_path", "first", "lines", "code").mapInPandas(_summaries(scan), "file_path string, first int, told string")
    entries = scratch.keep(told, "told").repartition("file_path").sortWithinPartitions("file_path", "first").mapInPandas(_entries, "file_path string, first int, state string")
    judged = blocks.join(scratch.keep(entries, "entries"), ["file_path", "first"]).mapInPandas(_judged(scan), ISSUES)
    return out.unionByName(judged)
