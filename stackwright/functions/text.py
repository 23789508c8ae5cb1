"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackwright.functions import lexicon

#: White space and line breaks as Python's str.strip and str.splitlines know them.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
HAN = r"\x{4e00}-\x{9fff}"
#: A character of the Han script: all are from U+2E80 on, so that others are told without a look at the tables of scripts.
HAN_SCRIPT = r"[\x{2e80}-\x{10ffff}&&\p{IsHan}]"
#: The characters of WS one by one: trimming them takes linear time, a pattern tries every place of a run of blanks.
BLANKS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# How identifiers look.
DOC_ID = r"(?iU)\b(?:QE|8D)-\d{4}-\d{4}\b"
MODEL = r"(?iU)\b[A-Z]{2,6}-\d{3,5}\b"
VERSION = r"(?iU)\bV\d+(?:\.\d+){1,2}\b"
DASHED = r"(?iU)\b[A-Z]{2,}(?:-[A-Z0-9]+)+\b"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(BLANKS))


def lines(c: Column | str) -> Column:
    """The lines of a text; a break at its end makes no further line."""
    parts = F.split(F.coalesce(col(c), F.lit("")), BREAK)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def find_all(c: Column | str, pattern: str) -> Column:
    """All matches, in order; null has none."""
    return F.coalesce(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def has_any(c: Column | str, words: Sequence[str]) -> Column:
    """Does the text contain one of the words."""
    if not words:
        return F.lit(False)
    return F.coalesce(col(c).rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def unique_by(array: Column, key=F.upper) -> Column:
    """The first of each group of equal keys, in order."""
    # equal strings go by hash before the sort; sort_array compares values, array_sort evaluates an expression for every two
    placed = F.sort_array(F.transform(F.array_distinct(array), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = let(placed, lambda p: F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i - 1)["k"] == x["k"], F.lit(False))))
    return F.transform(F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"], x["x"]))), lambda x: x["x"])


def runs(array: Column, first: Column) -> Column:
    """array cut before each of the places in first (from 0, ascending, its own first place among them): arrays in order."""
    return let(first, lambda f: F.transform(f, lambda a, i: F.slice(array, a + 1, F.coalesce(F.get(f, i + 1), F.size(array)) - a)))


def counts(array: Column) -> Column:
    """Each of an array's strings once, with how often it occurs: structs of term and n."""
    heads = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.coalesce(F.get(s, i - 1) == F.get(s, i), F.lit(False)))
    of = lambda s: let(heads(s), lambda h: F.transform(h, lambda a, i: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(h, i + 1), F.size(s)) - a).cast("long").alias("n"))))
    return let(F.sort_array(array), lambda s: F.when(F.size(s) > 0, of(s)).otherwise(F.array().cast("array<struct<term:string,n:bigint>>")))


def normalize_version(c: Column | str) -> Column:
    """Trimmed, with a V in front unless it has one or is empty."""
    return let(strip(c), lambda v: F.when((v == "") | F.upper(v).startswith("V"), v).otherwise(F.concat(F.lit("V"), v)))


def norm_query(c: Column | str) -> Column:
    return F.lower(clean_text(c))


def clean_text(c: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends."""
    # a single blank is left as it is
    return strip(F.regexp_replace(col(c), f"[{WS}]{{2,}}|[{WS}&&[^ ]]", " "))


def normalize_source(c: Column | str) -> Column:
    return strip(F.translate(col(c), "\\", "/"))


def token_pattern(user_words: Sequence[str] = lexicon.USER_WORDS) -> str:
    """User words, longest first; else runs of letters and digits; else single Han characters."""
    words = sorted(user_words, key=lambda w: (-len(w), w))
    begins_han = lambda w: re.match("[\u4e00-\u9fff]", w) is not None
    known = "|".join(re.escape(w) for w in words if not begins_han(w))
    han = "|".join(re.escape(w) for w in words if begins_han(w))
    # words that begin with a Han character are only tried where one stands
    return (f"{known}|" if known else "") + (rf"(?={HAN_SCRIPT})(?:{han})|" if han else "") + rf"[A-Za-z0-9_[\p{{L}}\p{{N}}&&[^{HAN_SCRIPT}]]]+|{HAN_SCRIPT}"


def tokenize(c: Column | str, user_words: Sequence[str] = lexicon.USER_WORDS) -> Column:
    """Tokens in order, case kept. Punctuation and blanks are dropped."""
    return find_all(c, token_pattern(user_words))


def overlap_tokens(c: Column | str, user_words: Sequence[str] = lexicon.USER_WORDS) -> Column:
    """Tokens of two characters and more, and every pair of neighbouring Han characters."""
    han = F.flatten(F.transform(find_all(c, HAN_SCRIPT + "{2,}"), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(F.filter(tokenize(c, user_words), lambda t: F.length(t) >= 2), han)


def query_tokens_for_source(c: Column | str, weak: Sequence[str] = lexicon.WEAK_WORDS, tokens: Column | None = None) -> Column:
    """Tokens that a source path is compared with: no weak words, the first form of each. tokens: the text's overlap_tokens, if they are at hand."""
    return unique_by(F.filter(F.array_distinct(overlap_tokens(c) if tokens is None else tokens), lambda t: ~t.isin(*weak)), F.lower)


def overlap_terms(c: Column | str, stop: Sequence[str] = lexicon.STOP_WORDS, tokens: Column | None = None) -> Column:
    """Tokens that texts are compared by: no stop words, the first form of each. tokens: as above."""
    return unique_by(F.filter(F.array_distinct(overlap_tokens(c) if tokens is None else tokens), lambda t: ~F.lower(t).isin(*stop) & ~t.rlike(r"(?U)^[\W_]+$")), F.lower)


def count_token_hits(tokens: Column, text: Column | str) -> Column:
    """How many of the tokens stand somewhere in the text, whatever their case."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.size(F.filter(tokens, lambda t: F.contains(low, F.lower(t))))


def identifiers(c: Column | str, patterns: Sequence[str] = (DOC_ID, MODEL, VERSION), least: int = 1) -> Column:
    """Matches of the patterns, in the patterns' order; the first of each upper-case form."""
    return unique_by(F.filter(F.concat(*[find_all(c, p) for p in patterns]), lambda t: F.length(t) >= least))


def han_windows(c: Column | str) -> Column:
    """All windows of 4, 5, then 6 characters of each run of Han characters, without repeats."""
    window = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(find_all(c, f"[{HAN}]+"), lambda r: F.concat(window(r, 4), window(r, 5), window(r, 6)))))


def exact_terms(c: Column | str) -> Column:
    """Identifiers of three characters and more, then the windows of Han runs."""
    return F.concat(identifiers(c, (DOC_ID, MODEL, VERSION, DASHED), 3), han_windows(c))


def model_terms(c: Column | str) -> Column:
    return F.transform(find_all(c, MODEL), F.upper)


def contains_exact_term(text: Column, term: Column) -> Column:
    """Does the term stand in the text, in any case, with no letter or digit at its sides."""
    quoted = F.concat(F.lit(r"(?iu)(?<![A-Z0-9])\Q"), F.regexp_replace(term, r"\\E", r"\\\\E\\\\E\\\\Q"), F.lit(r"\E(?![A-Z0-9])"))
    return F.coalesce((F.length(term) > 0) & F.rlike(text, quoted), F.lit(False))


# Inline marks that are removed, in this order.
_MARKUP = (
    (r"`[^`\n]+`", "  "), (r"!\[[^\]]*\]\([^\)]*\)", " "), (r"\[([^\]]+)\]\([^\)]*\)", "$1"), (r"\*{1,2}([^*\n]+)\*{1,2}", "$1"),
    (r"_{1,2}([^_\n]+)_{1,2}", "$1"), (r"^#{1,6}\s+", ""), (r"^[-*+]\s+", ""), (r"^\d+\.\s+", ""), (r"^>\s*", ""),
)


def strip_inline_markup(c: Column | str) -> Column:
    out = col(c)
    for pattern, to in _MARKUP:
        out = F.regexp_replace(out, pattern, to)
    # most lines have none of the characters that a mark needs
    return F.when(col(c).rlike(r"[`\[*_]|^(?:[#>+-]|\d+\.)"), out).otherwise(col(c))


def json_strings(c: Column | str, most: int, fallback: Column) -> Column:
    """A model's reply as a list: code fences dropped, a JSON array of texts, at most so many.

    A reply that is none, or holds nothing, gives the fallback.
    """
    bare = strip(F.regexp_replace(col(c), r"```(?:json)?", ""))
    found = F.slice(F.filter(F.transform(F.from_json(bare, "array<string>"), strip), lambda x: x != ""), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def judge_reply(c: Column | str) -> Column:
    """relevant, confidence and reason of a judge's reply; an unreadable one passes with low confidence."""
    data = F.from_json(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), "relevant boolean, confidence string, reason string")
    ok = F.regexp_extract(col(c), r"(?s)\{.*\}", 0).rlike(r"(?s)^\{") & F.coalesce(data["relevant"].isNotNull() | data["confidence"].isNotNull() | data["reason"].isNotNull(), F.lit(False))
    return F.when(ok, F.struct(F.coalesce(data["relevant"], F.lit(False)).alias("relevant"), F.coalesce(data["confidence"], F.lit("low")).alias("confidence"), F.coalesce(data["reason"], F.lit("")).alias("reason"))).otherwise(
        F.struct(F.lit(True).alias("relevant"), F.lit("low").alias("confidence"), F.lit("LLM 判断失败，跳过").alias("reason"))
    )
