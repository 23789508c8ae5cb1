"""Which texts contain which terms, as an equality join: no term is tried on every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwright.functions import text as X

#: Characters of the grams by which terms without a word of their own inside are looked up.
GRAM = 3
#: So many terms, of so many characters together, go to the tasks, which then lay out no other keys of a text; so many grams are sought one by one.
KNOWN, CHARS, SOUGHT = 1_000, 1 << 20, 200
_WORD = r"[\p{L}\p{N}]+"
_INNER = r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]+(?=[^\p{L}\p{N}])"


def _grams(text: Column, n: int) -> Column:
    """The distinct windows of n characters, from an array of characters: a place in a long string is not found at once."""
    none = F.array().cast("array<string>")
    windows = lambda a: F.when(F.size(a) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.concat(F.lit("g"), F.array_join(F.slice(a, i, n), ""))))).otherwise(none)
    return X.let(F.filter(F.split(text, ""), lambda c: c != ""), windows)


def holding(texts: DataFrame, terms: DataFrame, text: str, term: str) -> DataFrame:
    """The rows of texts with those of terms whose term stands somewhere in the text, as contains() says.

    A term with words inside (with something else on both sides) is looked up by the longest of
    them, which is then a whole word of the text as well; other terms by their first GRAM
    characters, or all if they have fewer, among the windows of the text. What has met is checked.
    Column names must differ; null and empty texts and terms meet nothing.
    """
    inner = F.array_sort(X.find_all(term, _INNER), lambda a, b: F.length(b) - F.length(a))
    first = F.get(inner, 0)
    named = terms.where(F.length(term) > 0)
    keyed = named.withColumn("_key", F.when(first.isNotNull(), F.concat(F.lit("w"), first)).otherwise(F.concat(F.lit("g"), F.substring(term, 1, GRAM))))
    kind = F.when(F.col("_key").startswith("w"), 0).otherwise(F.length("_key") - 1)
    kinds, n, chars = keyed.agg(F.collect_set(kind), F.count("*"), F.sum(F.length(term))).first()  # at most 1 + GRAM kinds
    few = n <= KNOWN and (chars or 0) <= CHARS
    known = sorted({r[0] for r in keyed.select("_key").collect()}) if few else []
    own, grams = F.coalesce(F.col(text), F.lit("")), [k for k in known if k.startswith("g")]
    some = (lambda keys: F.filter(keys, lambda k: k.isin(known))) if few else (lambda keys: keys)
    looked = [some(F.transform(F.array_distinct(X.find_all(own, _WORD)), lambda w: F.concat(F.lit("w"), w)))] if 0 in kinds else []
    if 0 < len(grams) <= SOUGHT:
        looked.append(F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(own, F.substring(g, 2, GRAM))))
    else:
        looked += [some(_grams(own, n)) for n in sorted(kinds) if n]
    if not looked:
        looked = [F.array().cast("array<string>")]
    rows = texts.withColumn("_key", F.explode(F.concat(*looked)))
    return rows.join(F.broadcast(keyed) if few else keyed, "_key").where(F.contains(F.col(text), F.col(term))).drop("_key")
