"""Evaluation of retrieval, routing and answers: cases x evidence -> metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackwright.functions import text as X
from stackwright.operators import rerank
from stackwright.operators.contain import holding

UPLIFT = 0.15


def generate_synonym_cases(chunks: DataFrame, synonyms: DataFrame, size: int = 100, seed: int = 42, window: int = 18, per_source: int = 2) -> DataFrame:
    """id, query and expected_sources of generated cases.

    Chunks (source, content) come in the order of a seeded hash. In each, the first synonym group
    with a term in the text gives a query: the text around the term, with the group's longest other
    term in its place; else the first 36 characters are it. At most per_source of each source and
    size in all. synonyms: groups of terms, of any number.
    """
    rows = chunks.where("coalesce(source, '') != ''").select(X.strip("source").alias("source"), X.clean_text("content").alias("doc")).where(F.length("doc") >= 20).withColumn("at", F.md5(F.concat_ws(":", F.lit(str(seed)), "source", "doc")))
    order = F.struct((F.col("text") != F.col("canonical")).alias("c"), "place")
    terms = synonyms.select("group_id", order.alias("order"), "text")
    at = F.instr("doc", F.col("text"))
    around = F.substring(F.col("doc"), F.greatest(at - window, F.lit(1)), F.least(at - 1, F.lit(window)) + F.length("text") + window)
    # of each group the first term in the text, with what stands around it, and the longest other one, the first of equals
    first = holding(rows.select("at", "doc"), terms, "doc", "text").select("at", "group_id", "order", F.struct(F.col("text").alias("hit"), around.alias("around")).alias("h")).groupBy("at", "group_id").agg(F.min_by("h", "order").alias("h")).select("at", "group_id", "h.*")
    other = first.join(terms, "group_id").where(F.col("text") != F.col("hit")).groupBy("at", "group_id", "hit", "around").agg(F.min_by("text", F.struct((-F.length("text")).alias("l"), "order")).alias("to"))
    found = other.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("group_id", "hit", "to", "around"))).alias("options"))
    # no whole text goes further than here
    rows = rows.select("source", "at", F.substring("doc", 1, 36).alias("begins")).join(found, "at", "left")
    swapped = lambda o: X.let(o["around"], lambda s: X.clean_text(F.concat(F.substring(s, F.lit(1), F.instr(s, o["hit"]) - 1), o["to"], F.substring(s, F.instr(s, o["hit"]) + F.length(o["hit"]), F.length(s)))))
    made = F.get(F.filter(F.transform("options", swapped), lambda q: F.length(q) >= 6), 0)
    rows = rows.select("source", "at", F.coalesce(made, X.clean_text("begins")).alias("query")).where(F.length("query") >= 6)
    own = rows.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("at", "query"))).where(F.col("r") <= per_source)
    best = own.orderBy("at", "source", "query").limit(size)
    number = F.row_number().over(Window.orderBy("at", "source", "query"))  # over at most size rows
    return best.select(F.format_string("T%03d", number).alias("id"), "query", F.array("source").alias("expected_sources"))


def top_sources(evidence: DataFrame, k: int) -> DataFrame:
    """query_id and the distinct sources among its first k rows, in order: fewer than k if they repeat."""
    rows = evidence.where(F.col("rank") <= k).where("coalesce(source, '') != ''").groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("sources"))


def _sources(cases: DataFrame, tops: DataFrame, name: str) -> DataFrame:
    return cases.join(tops.select("query_id", F.col("sources").alias(name)), "query_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def ab_hits(cases: DataFrame, before: DataFrame, after: DataFrame, k: int = 5) -> DataFrame:
    """cases (query_id, expected_sources) with pre_hit and post_hit."""
    rows = _sources(_sources(cases, top_sources(before, k), "pre_sources"), top_sources(after, k), "post_sources")
    hit = lambda c: F.coalesce(F.arrays_overlap("expected_sources", c), F.lit(False))
    return rows.withColumns({"pre_hit": hit("pre_sources"), "post_hit": hit("post_sources")})


def ab_hit_rate(hits: DataFrame, uplift: float = UPLIFT) -> DataFrame:
    """One row: cases, hits and rates before and after, the uplift (4 places) and whether it is enough."""
    one = hits.agg(F.count("*").alias("total_cases"), F.count_if("pre_hit").alias("pre_hits"), F.count_if("post_hit").alias("post_hits"))
    rate = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("total_cases").cast("double")), F.lit(0.0))
    gain = rate("post_hits") - rate("pre_hits")
    return one.select("*", F.round(rate("pre_hits"), 4).alias("pre_hit_rate"), F.round(rate("post_hits"), 4).alias("post_hit_rate"), F.round(gain, 4).alias("uplift"), (gain >= uplift).alias("passed"))


def retrieval_checks(cases: DataFrame, tops: DataFrame) -> DataFrame:
    """cases (query_id, expected_sources, forbidden_sources) with top1_hit, topk_hit and forbidden_free.

    Without expected sources nothing is hit.
    """
    rows = _sources(cases, tops, "sources")
    none = F.array().cast("array<string>")
    want, bad = F.coalesce("expected_sources", none), F.coalesce("forbidden_sources", none)
    return rows.withColumns({"top1_hit": F.coalesce(F.array_contains(want, F.get("sources", 0)), F.lit(False)), "topk_hit": F.arrays_overlap(want, "sources"), "forbidden_free": ~F.arrays_overlap(bad, "sources")})


def improved_degraded(base: DataFrame, other: DataFrame) -> DataFrame:
    """query_id, improved and degraded: the cases whose first source became right, or wrong."""
    pair = base.select("query_id", F.col("top1_hit").alias("was")).join(other.select("query_id", F.col("top1_hit").alias("now")), "query_id")
    return pair.select("query_id", (~F.col("was") & F.col("now")).alias("improved"), (F.col("was") & ~F.col("now")).alias("degraded"))


def stats_by_category(checks: DataFrame, names: tuple[str, ...] = ("top1_hit", "topk_hit", "forbidden_free")) -> DataFrame:
    """Cases, counts and rates (4 places) of each category, and of all in a row with a null category."""
    return checks.rollup("category").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in names], *[F.round(F.avg(F.col(c).cast("int")), 4).alias(f"rate_{c}") for c in names])


def score_case(cases: DataFrame, evidence: DataFrame, answers: DataFrame) -> DataFrame:
    """The five checks of each case, score, max_score, passed and missing keywords; an empty expectation is met.

    cases: query_id, expected_sources, forbidden_sources, expected_keywords,
    expected_chunk_keywords; evidence: query_id, rank, source, content; answers: query_id, answer.
    """
    seen = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", X.normalize_source(F.coalesce("source", F.lit(""))).alias("source"), F.coalesce("content", F.lit("")).alias("content")))).alias("e"))
    rows = cases.join(seen, "query_id", "left").join(answers.select("query_id", "answer"), "query_id", "left")
    none = F.array().cast("array<string>")
    listed = lambda c: F.transform(F.coalesce(F.col(c), none), X.normalize_source)
    sources, told = F.coalesce("e.source", none), F.array_join(F.coalesce("e.content", none), " ")
    want, bad, top3 = listed("expected_sources"), listed("forbidden_sources"), F.slice(sources, 1, 3)
    missing = lambda words, text: F.filter(F.coalesce(F.col(words), none), lambda w: ~F.contains(text, w))
    free = F.size(want) == 0
    answer = F.coalesce("answer", F.lit(""))
    checks = {
        "top1_matches_expected": free | F.array_contains(want, F.coalesce(F.get(sources, 0), F.lit(""))),
        "top3_contains_expected": free | F.arrays_overlap(want, top3),
        "top3_excludes_forbidden": ~F.arrays_overlap(bad, top3),
        "answer_contains_keywords": F.size(missing("expected_keywords", answer)) == 0,
        "chunks_contain_keywords": F.size(missing("expected_chunk_keywords", told)) == 0,
    }
    rows = rows.withColumns({**checks, "missing_keywords": missing("expected_keywords", answer), "missing_chunk_keywords": missing("expected_chunk_keywords", told), "top1_source": F.coalesce(F.get(sources, 0), F.lit("")), "top3_sources": top3})
    points: Column = sum((F.col(c).cast("int") for c in checks), F.lit(0))
    return rows.withColumns({"score": points, "max_score": F.lit(len(checks)), "passed": points == len(checks)}).drop("e", "answer")


def pass_rate_summary(scored: DataFrame) -> DataFrame:
    """One row: selected, passed and failed cases and the rate in percent (2 places)."""
    one = scored.agg(F.count("*").alias("selected"), F.count_if("passed").alias("passed"))
    return one.select("selected", "passed", (F.col("selected") - F.col("passed")).alias("failed"), F.round(F.coalesce(F.try_divide(F.col("passed") * 100.0, F.col("selected").cast("double")), F.lit(0.0)), 2).alias("pass_rate"))


def routing_scorecard(plans: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: cases, right routes, accuracy, documents' questions sent elsewhere, and mismatches.

    plans: query_id, route, tools, policy, filters; expected: query_id, expected_route and, where
    they matter, expected_tools, expected_strategy and expected_filters.
    """
    rows = plans.join(expected, "query_id")
    ok = F.col("route") == F.col("expected_route")
    wrong = lambda want, got: F.count_if(F.col(want).isNotNull() & ~got.eqNullSafe(F.col(want))) if want in expected.columns else F.lit(0).cast("long")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("route_ok"), F.round(F.avg(ok.cast("int")), 4).alias("accuracy"),
        F.count_if((F.col("expected_route") == "kb") & ~ok).alias("kb_misrouted"), wrong("expected_tools", F.col("tools")).alias("tool_mismatch"),
        wrong("expected_strategy", F.col("policy.strategy")).alias("strategy_mismatch"), wrong("expected_filters", F.col("filters")).alias("filter_mismatch"),
    )


#: What a case of the self-check may expect of its step; null expects nothing. Listed issues, missing entities and parts of a query
#: must all be there; doc_type is that of the new filter, empty for a filter that must have none; coverage is to 2 places.
EXPECT = "passed boolean, issues array<string>, missing array<string>, retry boolean, query string, query_has array<string>, doc_type string, coverage double"
STEPS = ("evidence", "decision", "retry", "answer")


def self_check(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, step, passed and missed: what each case expects of its critique or retry, and which expectations fail.

    cases: query_id (one case each), step (evidence: its critique; decision: is there a retry; retry:
    its query and filter; answer: its critique), the plan (intent, question, rewritten, variants,
    sub_queries, entities, where), what the step is given (issues, missing_entities, policy, attempt,
    answer) and expect (fields of EXPECT). evidence: query_id, rank, doc_type, content and max_score of
    the first step's cases; it is shuffled with them once, other cases meet no evidence. A case of
    another step, or that expects what its step does not tell, fails; one that expects nothing passes.
    """
    critique = rerank.critique_evidence(cases.where(F.col("step") == "evidence"), evidence)
    seen = critique.select("query_id", F.struct("passed", "issues", "missing_entities").alias("_seen"))
    of = lambda step, value: F.when(F.col("step") == step, value)
    query, where = rerank.build_retry_query(F.col("policy.strategy"))
    found = cases.where(F.col("step") == "evidence").join(seen, "query_id", "left")
    rest = cases.where(~F.col("step").eqNullSafe(F.lit("evidence"))).withColumn("_seen", F.lit(None).cast(found.schema["_seen"].dataType))
    answer = rerank.critique_answer(F.col("entities"), F.col("answer"))
    rows = found.unionByName(rest).withColumns({
        "_answer": of("answer", answer), "_retry": of("decision", rerank.should_retry(F.col("issues"), F.col("policy"), F.coalesce("attempt", F.lit(0)))),
        "_query": of("retry", query), "_type": of("retry", F.coalesce(where["doc_type"], F.lit(""))),
    })
    e = lambda name: F.col("expect")[name]
    within = lambda name, got: F.size(F.array_except(e(name), got)) == 0
    met = {
        "passed": F.coalesce(F.col("_seen.passed"), F.col("_answer.passed")) == e("passed"), "issues": within("issues", F.col("_seen.issues")), "missing": within("missing", F.col("_seen.missing_entities")),
        "retry": F.col("_retry") == e("retry"), "query": F.col("_query") == e("query"), "query_has": F.forall(e("query_has"), lambda x: F.contains(F.col("_query"), x)),
        "doc_type": F.col("_type") == e("doc_type"), "coverage": F.col("_answer.coverage_rate") == e("coverage"),
    }
    failed = [F.when(~F.coalesce(F.col("step").isin(*STEPS), F.lit(False)), "step"), *[F.when(e(name).isNotNull() & ~F.coalesce(ok, F.lit(False)), name) for name, ok in met.items()]]
    out = rows.select("query_id", "step", F.filter(F.array(*failed), lambda x: x.isNotNull()).alias("missed"))
    return out.select("query_id", "step", (F.size("missed") == 0).alias("passed"), "missed")


def gate(checks: DataFrame) -> DataFrame:
    """Cases, passed ones, their rate (4 places) and whether all passed, of each step and in a row with a null step of all; no case, no pass."""
    rows = checks.select(F.coalesce("step", F.lit("")).alias("step"), "passed").rollup("step")
    return rows.agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("rate"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("accepted"))
