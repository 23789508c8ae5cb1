"""URL filter with redirect equivalence.

Rules block or allow hosts (with their subdomains) and path prefixes. URLs that redirect to each
other or name one canonical address are aliases: components over those links carry a block
decision to aliases that no rule fits. An explicit allow takes precedence: a rule's own verdict
is never overturned, and a component with an explicitly allowed member is not blocked.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm.common import connected_components, free_name, left_join_keyed
from stackwright.sources.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule); a rule is a host, then a path prefix from its first slash on.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Up to so many rules are an expression on each row; more are joined on the host's suffixes.
INLINE_RULES = 64

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; null or no :// gives ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def url_key(url: Column) -> Column:
    """What names a page: host, path and query without scheme and fragment; null without a host."""
    path = path_of(url)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", "/").otherwise(path), F.coalesce(F.regexp_extract(url, URL, 3), F.lit(""))))


def _key_host(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^([^/?]*)", 1)


def _key_path(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^[^/?]*([^?]*)", 1)


def _parts(rules) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path), the longest first; of equal length allow, then by name."""
    out = [(verdict, rule, rule.partition("/")[0].lower(), "/" + rule.partition("/")[2]) for verdict, rule in rules]
    return sorted(out, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))


def match_rules(spark: SparkSession, df: DataFrame, rules=RULES, inline: int = INLINE_RULES) -> DataFrame:
    """Adds rule and rule_verdict (null: none fits) to rows with host and path.

    Long lists are joined by equality on every suffix of the distinct hosts, so neither side has
    to fit anywhere.
    """
    parts = _parts(rules)
    if len(parts) <= inline:
        fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = verdict = F.lit(None).cast("string")
        for v, r, h, p in reversed(parts):
            rule, verdict = F.when(fits(h, p), r).otherwise(rule), F.when(fits(h, p), v).otherwise(verdict)
        return df.withColumns({"rule": rule, "rule_verdict": verdict})
    known = spark.createDataFrame([(v, r, h, p, -i) for i, (v, r, h, p) in enumerate(parts)], "rule_verdict string, rule string, rule_host string, rule_path string, place int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (
        df.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes)).join(known, "rule_host")
        .where(F.expr("startswith(path, rule_path)"))
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), "place").alias("r"))
    )
    at = free_name(df, "_at")
    found = found.select(F.concat("host", F.lit("\n"), "path").alias(at), "r")
    scratch = Scratch(spark, "rules")
    joined = left_join_keyed(scratch, "rules", df.withColumn(at, F.concat("host", F.lit("\n"), "path")), scratch.keep(found, "found"), at)
    return joined.withColumns({"rule": F.col("r.rule"), "rule_verdict": F.col("r.rule_verdict")}).drop("r", at)


def _resolved(base: Column, href: Column) -> Column:
    """The key of a link found on the page with key base; null if it names no page."""
    host, path = _key_host(base), _key_path(base)
    return (
        F.when(href.isNull() | (href == ""), None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), url_key(href))
        .when(href.startswith("//"), url_key(F.concat(F.lit("x:"), href)))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(href.startswith("/"), url_key(F.concat(F.lit("x://"), host, href)))
        .when(href.rlike(r"^[?#]"), url_key(F.concat(F.lit("x://"), host, path, href)))
        .otherwise(url_key(F.concat(F.lit("x://"), host, F.regexp_replace(path, r"[^/]*$", ""), href)))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """Links (u, v) between url keys: a page's canonical link, and its refresh redirect."""
    tag = lambda pattern, word: F.when(F.lower("html").contains(word), F.regexp_extract("html", pattern, 0))
    base = pages.select(url_key(F.col("url")).alias("u"), tag(CANONICAL, "canonical").alias("c"), tag(REFRESH, "refresh").alias("r")).where("u is not null and (c != '' or r != '')")
    links = base.select("u", F.explode(F.array(F.regexp_extract("c", HREF, 1), F.regexp_extract("r", TO, 1))).alias("href"))
    return links.select("u", _resolved(F.col("u"), F.regexp_replace("href", "&amp;", "&")).alias("v")).where("v is not null and u != v")


def judge_urls(spark: SparkSession, pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), via (rule, alias or default) per page.

    pages: page_id, url, html (other columns are ignored). redirects: further url pairs
    (from_url, to_url), as a crawler records them. A null url has no host and is allowed; a null
    html has no links, one of any length is read whole; repeated rows give repeated results; without
    pages there are no rows. Null and frequent urls are dealt to all tasks.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(url_key(F.col("from_url")), url_key(F.col("to_url")))).where("u is not null and v is not null and u != v")
    edges = Scratch(spark, "alias-edges").keep(edges.distinct(), "edges")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_key(F.col("url")).alias("key"))
    own = match_rules(spark, own, rules)
    nodes = connected_components(spark, edges, "alias").select(F.col("node").alias("key"), "component", _key_host(F.col("node")).alias("host"), _key_path(F.col("node")).alias("path"))
    judged = match_rules(spark, nodes, rules)
    groups = judged.groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    blocked = groups.where("blocked and not coalesce(allowed, false)").select("component")
    aliases = judged.select("key", "component").join(blocked, "component", "left_semi").select("key", F.lit(True).alias("alias_block"))
    scratch = Scratch(spark, "alias-blocks")
    return left_join_keyed(scratch, "aliases", own, scratch.keep(aliases, "aliases"), "key").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("alias_block"), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias_block"), "alias").otherwise("default").alias("via"),
    )
