"""Twelve rules for Markdown documents: documents become issues.

The rules by themselves read a table of lines (file_path, lineno, line, plain, in_code): those on a
single line shuffle nothing, those that look at neighbours the lines and columns they ask for.
check_documents, which applies them all, scans neighbours within the documents (see line_scan).
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackwright.functions import lexicon
from stackwright.functions import text as X
from stackwright.operators.line_scan import Scan, neighbour_issues

FENCE = rf"^[{X.WS}]*(?:`{{3,}}|~{{3,}})"
HEADING = r"^#{1,6}\s+\S"
ISSUE = ("file_path", "line", "col", "level", "category", "message", "context", "suggestion")

# Categories of issues.
TYPO, FORMAT, LINK, STRUCTURE, TERM, READABILITY, NOTE = "重复词语", "格式规范", "链接有效性", "文档结构", "术语一致性", "可读性", "提示框规范"


def check_config(overrides: Mapping | None = None) -> dict:
    """The defaults, with whole keys replaced."""
    return {**lexicon.CHECKER, **(overrides or {})}


def read_config(spark: SparkSession, path: str) -> dict:
    """The configuration of a JSON file, a small one, over the defaults."""
    return check_config(json.loads(spark.read.text(path, wholetext=True).first()[0].removeprefix("\ufeff")))


def explode_lines(docs: DataFrame) -> DataFrame:
    """file_path, lineno (from 1), line, stripped, plain and in_code of every line of (file_path, text).

    A document is cut at its fences, and every second part is code: all of it within the row, so
    that rules which look at one line alone need no shuffle at all.
    """
    fenced = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i).rlike(FENCE))
    parts = lambda a, f: X.runs(a, F.array_distinct(F.concat(F.array(F.lit(0)), f)))
    # a part that begins with a fence is code if an even number of fences came before it; the fence that ends code is code itself
    flags = lambda p: F.transform(p, lambda x, i: X.let(F.when(F.get(p, 0)[0].rlike(FENCE), i).otherwise(i - 1), lambda n: F.transform(x, lambda y, j: F.struct(y.alias("line"), ((n >= 0) & ((n % 2 == 0) | (j == 0))).alias("in_code")))))
    own = X.let(X.lines("text"), lambda a: F.when(F.size(a) > 0, F.flatten(X.let(X.let(fenced(a), lambda f: parts(a, f)), flags))))
    rows = docs.select("file_path", F.posexplode(own).alias("p", "x")).select("file_path", (F.col("p") + 1).alias("lineno"), "x.line", X.strip("x.line").alias("stripped"), "x.in_code")
    return rows.withColumn("plain", X.strip_inline_markup("line"))


def code_block_flag(docs: DataFrame) -> DataFrame:
    return explode_lines(docs).select("file_path", "lineno", "in_code")


def _issue(rows: DataFrame, line, col, level: str, category: str, message, context, suggestion="") -> DataFrame:
    c = lambda x: F.lit(x) if isinstance(x, str | int) else x
    return rows.select("file_path", c(line).cast("int").alias("line"), c(col).cast("int").alias("col"), F.lit(level).alias("level"), F.lit(category).alias("category"), c(message).alias("message"), c(context).alias("context"), c(suggestion).alias("suggestion"))


def _said(form: str, *args: Column) -> Column:
    return F.format_string(form, *args)


def _context(n: int = 100) -> Column:
    return F.substring(X.rstrip("line"), 1, n)


def _text(lines: DataFrame) -> DataFrame:
    return lines.where("not in_code")


def _issues(when: Column, col, level: str, category: str, message, context, suggestion="") -> Column:
    """An array with the issue of a line, if it has it."""
    c = lambda x: F.lit(x) if isinstance(x, str | int) else x
    said = {"col": c(col).cast("int"), "level": F.lit(level), "category": F.lit(category), "message": c(message), "context": c(context), "suggestion": c(suggestion)}
    return F.when(when, F.array(F.struct(*[v.alias(k) for k, v in said.items()])))


def _each(lines: DataFrame, *found: Column) -> DataFrame:
    """The issues of rules that look at one line alone, in one pass over the lines outside code."""
    any_ = F.filter(F.array(*found), lambda x: x.isNotNull())
    rows = _text(lines).select("file_path", "lineno", F.explode(F.flatten(any_)).alias("x"))
    return rows.select("file_path", F.col("lineno").cast("int").alias("line"), *[f"x.{c}" for c in ISSUE[2:]])


def _repeated_issues() -> list[Column]:
    """Every match is an issue, at its own place: it is looked for from the end of the one before, as what reads the same is a match itself."""
    none = "array<struct<at:int,w:string>>"

    def of(pattern: str, message: str, fix: str) -> Column:
        found = F.regexp_extract_all("plain", F.lit(pattern), F.lit(0))
        half = lambda m: F.substring(m, F.lit(1), (F.length(m) / 2).cast("int"))
        step = lambda s, m: X.let(F.call_function("locate", m, F.col("plain"), s["p"]), lambda at: F.struct((at + F.length(m)).alias("p"), F.concat(s["x"], F.array(F.struct(at.alias("at"), half(m).alias("w")))).alias("x")))
        placed = F.aggregate(found, F.struct(F.lit(1).alias("p"), F.array().cast(none).alias("x")), step)["x"]
        said = lambda x: {
            "col": x["at"], "level": F.lit("error"), "category": F.lit(TYPO), "message": F.format_string(message, *[x["w"]] * message.count("%s")), "context": _context(), "suggestion": F.format_string(fix, x["w"]),
        }
        return F.when(F.col("plain").rlike(pattern), F.transform(placed, lambda x: F.struct(*[v.alias(k) for k, v in said(x).items()])))

    return [of(rf"([{X.HAN}]{{2,4}})\1", '疑似重复词语："%s%s"', '检查是否误写重复，应为："%s"'), of(r"([的了着过地得也都就还])\1", '助词/副词重复："%s%s"', '删除多余的"%s"')]


def check_repeated_words(lines: DataFrame) -> DataFrame:
    """A group of 2 to 4 Han characters twice in a row, and a doubled particle; each match is an error."""
    return _each(lines, *_repeated_issues())


def _heading_issues() -> list[Column]:
    r = X.rstrip("line")
    close = _issues(r.rlike(r"^#{1,6}[^#\s\n]"), 1, "error", FORMAT, "标题 # 号后缺少空格", F.substring(r, 1, 80), _said('改为："%s"', F.regexp_replace(r, r"^(#{1,6})", "$1 ")))
    return [close, _issues(r.rlike(r"^#{1,6}\s*$"), 1, "error", STRUCTURE, "标题内容为空", F.substring(r, 1, 80))]


def check_heading_format(lines: DataFrame) -> DataFrame:
    return _each(lines, *_heading_issues())


def check_empty_sections(lines: DataFrame) -> DataFrame:
    """A heading that the next line with content outside code follows as a heading, of any level."""
    rows = _text(lines).where("stripped != ''").withColumn("h", F.col("stripped").rlike(HEADING))
    after = rows.withColumn("next", F.lead("h").over(Window.partitionBy("file_path").orderBy("lineno"))).where("h and next")
    return _issue(after, F.col("lineno"), 1, "warning", STRUCTURE, _said('章节 "%s" 内容为空', F.col("stripped")), F.col("stripped"), "在标题下方补充内容，或删除该标题")


def resolve_path(base: Column, link: Column) -> Column:
    """A relative link of the file base as a path: '.' and '..' steps taken; above the root nothing is left out."""
    parts = F.concat(F.slice(F.split(base, "/"), 1, F.size(F.split(base, "/")) - 1), F.split(link, "/"))
    step = lambda s, p: F.when(p.isin("", "."), s).when((p == "..") & (F.size(s) > 0) & (F.element_at(F.concat(F.array(F.lit("")), s), -1) != ".."), F.slice(s, 1, F.size(s) - 1)).otherwise(F.concat(s, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def check_broken_links(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Relative links to what is neither a path in files (path) nor a folder of one."""
    link = r"\[([^\]]*)\]\(([^\)]+)\)"
    rows = _text(lines).where(F.col("line").rlike(link)).withColumn("m", F.regexp_extract_all("line", F.lit(link), F.lit(0)))
    # places: every match is found from the end of the one before
    places = F.expr("aggregate(m, named_struct('p', 1, 'at', cast(array() as array<int>)), (s, x) -> named_struct('p', cast(locate(x, line, s.p) + length(x) as int), 'at', concat(s.at, array(cast(locate(x, line, s.p) as int))))).at")
    found = rows.select("file_path", "lineno", "line", F.explode(F.arrays_zip(F.col("m").alias("m"), places.alias("at"))).alias("x")).select("file_path", "lineno", "line", F.col("x.at").alias("at"), X.strip(F.split(F.regexp_extract("x.m", link, 2), "#")[0]).alias("url"))
    found = found.where("url != ''").where(~F.col("url").rlike("^(?:http://|https://|ftp://|mailto:|/)")).withColumn("path", resolve_path(F.col("file_path"), F.col("url")))
    parts = F.split("path", "/")
    known = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    broken = found.where("path != ''").join(known, "path", "left_anti")
    return _issue(broken, F.col("lineno"), F.col("at"), "error", LINK, _said('链接目标不存在："%s"', F.col("url")), _context(), _said("确认文件路径 %s 是否正确", F.col("url")))


def check_consecutive_blank_lines(lines: DataFrame, most: int = 2) -> DataFrame:
    """One warning for every most + 1 blank lines of a run, at the first of them; code ends a run."""
    blank = lines.where("not in_code and stripped = ''")
    w = Window.partitionBy("file_path")
    runs = blank.withColumn("run", F.col("lineno") - F.row_number().over(w.orderBy("lineno")))
    place = F.row_number().over(Window.partitionBy("file_path", "run").orderBy("lineno"))
    full = runs.withColumn("n", place).where(F.col("n") % (most + 1) == 0)
    return _issue(full, F.col("lineno") - most, 0, "warning", FORMAT, f"连续空行超过 {most} 行（共 {most + 1} 行）", "", f"减少连续空行至不超过 {most} 行")


def check_long_paragraphs(lines: DataFrame, most: int = 400) -> DataFrame:
    """Paragraphs (neighbouring lines outside code that are neither blank nor headings) of too many characters."""
    own = (~F.col("in_code")) & (F.col("stripped") != "") & ~F.col("stripped").rlike(r"^#{1,6}\s")
    rows = lines.select("file_path", "lineno", "stripped", own.alias("own")).where("own").withColumn("run", F.col("lineno") - F.row_number().over(Window.partitionBy("file_path").orderBy("lineno")))
    # no line is empty, so the first 80 have the 80 characters that are shown
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("file_path", "run").orderBy("lineno")))
    whole = rows.groupBy("file_path", "run").agg(F.min("lineno").alias("lineno"), F.sum(F.length("stripped")).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 80, F.struct("lineno", F.substring("stripped", 1, 80).alias("t"))))), lambda x: x["t"]), "").alias("text")).where(F.col("n") > most)
    return _issue(whole, F.col("lineno"), 0, "info", READABILITY, _said(f"段落过长（%d 字符，建议不超过 {most}）", F.col("n")), F.concat(F.substring("text", 1, 80), F.lit("…")), "将长段落拆分为多个较短段落")


def check_mixed_digits(lines: DataFrame) -> DataFrame:
    """A file with full-width and half-width digits: one warning, at the first full-width one."""
    wide = F.regexp_extract("line", "[０-９]", 0)
    rows = _text(lines).select("file_path", "lineno", "line", wide.alias("wide"), F.col("line").rlike("[0-9]").alias("half"))
    per = rows.groupBy("file_path").agg(F.max("half").alias("half"), F.min_by(F.struct("lineno", "wide", "line"), F.when(F.col("wide") != "", F.col("lineno"))).alias("first")).where("half and first is not null").select("file_path", "first.*").where("wide != ''")
    return _issue(per, F.col("lineno"), F.expr("instr(line, wide)"), "warning", FORMAT, _said('文档中混用了全角数字（如 "%s"）和半角数字', F.col("wide")), _context(80), "统一使用半角数字（0-9）")


def _note_issues(keywords=None) -> Column:
    words = "|".join(re.escape(k) for k in (keywords or lexicon.CHECKER["note_keywords"]))
    return _issues(F.col("stripped").rlike(rf"^(?:{words})[：:]\s*\S"), 1, "warning", NOTE, _said('提示框关键词未加粗："%s"', F.substring("stripped", 1, 30)), F.substring("stripped", 1, 80), "使用加粗格式，如：**注意**：内容")


def check_note_format(lines: DataFrame, keywords=None) -> DataFrame:
    return _each(lines, _note_issues(keywords))


def _spacing_issues() -> Column:
    han, latin = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]", "[A-Za-z0-9]"
    at = F.expr(f"regexp_instr(plain, r'{han}{latin}|{latin}{han}')")
    return _issues(at > 0, at, "info", FORMAT, "中英文之间建议添加空格", _context(), '在中文与英文/数字之间插入一个空格，如"接口 API"')


def check_cjk_latin_spacing(lines: DataFrame) -> DataFrame:
    """The first place of each line where Han and Latin characters or digits touch."""
    return _each(lines, _spacing_issues())


def check_duplicate_lines(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_path").orderBy("lineno")
    rows = lines.withColumn("was", F.lag("stripped").over(w)).withColumn("was_code", F.lag("in_code").over(w)).where("not in_code and not was_code and stripped = was and length(stripped) > 5")
    return _issue(rows, F.col("lineno"), 1, "warning", TYPO, "与上一行完全重复", F.substring("stripped", 1, 80), "删除重复行")


def check_numbered_list(lines: DataFrame) -> DataFrame:
    """Items whose number is not one more than the item's before; a blank or code line begins anew."""
    w = Window.partitionBy("file_path").orderBy("lineno")
    number = F.regexp_extract(F.regexp_replace("line", f"^[{X.WS}]+", ""), r"^(\d+)\.(?:\s|$)", 1)
    rows = lines.withColumn("run", F.sum((F.col("in_code") | (F.col("stripped") == "")).cast("int")).over(w)).withColumn("n", F.when(~F.col("in_code") & (number != ""), number.try_cast("decimal(38,0)")))
    items = rows.where("n is not null").withColumn("was", F.lag("n").over(Window.partitionBy("file_path", "run").orderBy("lineno"))).where("n != was + 1")
    want = (F.col("was") + 1).cast("string")
    return _issue(items, F.col("lineno"), 1, "warning", FORMAT, _said("有序列表编号不连续：期望 %s，实际 %s", want, F.col("n").cast("string")), _context(80), _said("将编号改为 %s", want))


def _term_issues(preferred: Mapping[str, list[str]] | None = None) -> list[Column]:
    preferred = lexicon.CHECKER["preferred_terms"] if preferred is None else preferred
    pairs = [(p, a) for p, others in preferred.items() for a in others]
    if not pairs:
        return []
    terms = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(a).alias("a")) for p, a in pairs])
    said = lambda t: {
        "col": F.instr(F.col("plain"), t["a"]).cast("int"), "level": F.lit("info"), "category": F.lit(TERM), "message": _said('建议使用"%s"替代"%s"（术语统一）', t["p"], t["a"]),
        "context": _context(80), "suggestion": _said('将 "%s" 改为 "%s"', t["a"], t["p"]),
    }
    found = F.transform(F.filter(terms, lambda t: F.contains(F.col("plain"), t["a"])), lambda t: F.struct(*[v.alias(k) for k, v in said(t).items()]))
    return [F.when(X.has_any("plain", [a for _, a in pairs]), found)]


def check_terminology(lines: DataFrame, preferred: Mapping[str, list[str]] | None = None) -> DataFrame:
    """The first place in a line of each wording that has a preferred one. The terms are a configuration."""
    found = _term_issues(preferred)
    return _each(lines, *found) if found else _issue(lines.where("false"), 0, 0, "info", TERM, "", "")


def undecodable(files: DataFrame) -> DataFrame:
    """One error for each file (file_path, content) whose bytes are not UTF-8."""
    rows = files.where(~F.expr("is_valid_utf8(cast(content as string))"))
    return _issue(rows, 0, 0, "error", FORMAT, "文件编码不是 UTF-8，无法解析", "")


def check_documents(docs: DataFrame, config: Mapping | None = None, files: DataFrame | None = None) -> DataFrame:
    """All issues of (file_path, text), without those on links unless a listing of files (path) is given.

    Nothing is shuffled but links and very long documents: one pass over the lines for the rules on
    single ones, and one over the documents for the rules on neighbours.
    """
    cfg = check_config(config)
    lines = explode_lines(docs)
    scan = Scan({"typo": TYPO, "format": FORMAT, "structure": STRUCTURE, "readability": READABILITY}, cfg["max_blank_lines"], cfg["max_paragraph_length"])
    found = [
        _each(lines, *_repeated_issues(), *_heading_issues(), _note_issues(cfg["note_keywords"]), _spacing_issues(), *_term_issues(cfg["preferred_terms"])),
        neighbour_issues(docs, scan).select(*ISSUE),
    ]
    if files is not None:
        found.append(check_broken_links(explode_lines(docs.where(F.contains("text", F.lit("](")))), files))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def check_files(spark: SparkSession, files: DataFrame, config: Mapping | None = None, listing: DataFrame | None = None) -> DataFrame:
    """Issues of binary files (file_path, content): those that are not UTF-8 have that one error."""
    good = files.where(F.expr("is_valid_utf8(cast(content as string))")).select("file_path", F.col("content").cast("string").alias("text"))
    return check_documents(good, config, listing).unionByName(undecodable(files))


def filter_level(issues: DataFrame, least: str) -> DataFrame:
    """Issues of this level and above (error, warning, info)."""
    return issues.where(F.col("level").isin(*lexicon.LEVELS[: lexicon.LEVELS.index(least) + 1]))


def check_summary(issues: DataFrame) -> DataFrame:
    """Errors, warnings, infos and all issues of each file, and of the corpus in a row with a null file_path."""
    return issues.rollup("file_path").agg(*[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in lexicon.LEVELS], F.count("*").alias("total"))
