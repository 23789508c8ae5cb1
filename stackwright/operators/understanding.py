"""Query understanding: questions become plans by rules, as column expressions over a table.

A questions table has query_id and question, and may have the filter fields a user set
(empty or null: not set). A where is a struct of the filter fields, null where not constrained.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackwright.functions import lexicon
from stackwright.functions import text as X
from stackwright.operators.contain import holding

# How identifiers look.
MODEL_CASED = r"(?U)\b[A-Z]{2,6}-\d{3,5}\b"
DOC_IDS = r"(?iU)\b(?:QE|8D|FMEA|NCR|CAR)-\d{4}-\d{4}\b"
WORK_ORDER = r"(?iU)\bWO-\d{4}-\d{4}\b"
WHERE = "struct<" + ", ".join(f"{f}: string" for f in lexicon.FILTER_FIELDS) + ">"


def fault_pattern(prefixes: Sequence[str] = lexicon.FAULT_PREFIXES) -> str:
    return r"(?iU)\b(?:" + "|".join(prefixes) + r")-\d{3,5}\b"


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _named(question: Column, words: Sequence[str]) -> Column:
    return F.filter(_texts(words), lambda w: F.contains(question, w))


def _prefix(code: Column) -> Column:
    return F.upper(F.split(code, "-")[0])


def extract_entities(question: Column | str, fault_prefixes: Sequence[str] = lexicon.FAULT_PREFIXES, model_prefixes: Sequence[str] = lexicon.MODEL_PREFIXES, doc_prefixes: Sequence[str] = lexicon.DOC_PREFIXES, alarm: Sequence[str] = lexicon.ALARM_WORDS, departments: Sequence[str] = lexicon.DEPARTMENTS, customers: Sequence[str] = lexicon.CUSTOMERS) -> Column:
    """A struct of the model_types, versions, fault_codes, doc_ids, work_order_ids, departments and customers named.

    A model-like code is a fault code if its prefix is a fault prefix, or if the question has an
    alarm word and the prefix is no model prefix.
    """
    q = F.coalesce(X.col(question), F.lit(""))
    codes = X.find_all(q, MODEL_CASED)
    docs = F.array_distinct(X.find_all(q, DOC_IDS))
    fault = lambda c: _prefix(c).isin(*fault_prefixes) | (X.has_any(q, alarm) & ~_prefix(c).isin(*model_prefixes))
    faults = F.array_distinct(F.concat(X.find_all(q, fault_pattern(fault_prefixes)), F.filter(codes, fault)))
    models = X.let(faults, lambda f: X.let(F.transform(docs, _prefix), lambda p: F.filter(F.array_distinct(codes), lambda c: ~F.array_contains(F.transform(f, F.upper), F.upper(c)) & ~_prefix(c).isin(*doc_prefixes) & ~F.array_contains(p, _prefix(c)))))
    return F.struct(
        models.alias("model_types"),
        F.array_distinct(F.transform(X.find_all(q, X.VERSION), F.upper)).alias("versions"),
        faults.alias("fault_codes"),
        docs.alias("doc_ids"),
        F.array_distinct(X.find_all(q, WORK_ORDER)).alias("work_order_ids"),
        _named(q, departments).alias("departments"),
        _named(q, customers).alias("customers"),
    )


def classify_intent(question: Column | str, intents: Mapping[str, Sequence[str]] = lexicon.INTENTS) -> Column:
    """Eight rules in order, then the intent with most of its keywords in the question; ties to the first."""
    q = F.coalesce(X.col(question), F.lit(""))
    low = F.lower(q)
    fault = q.rlike(fault_pattern())
    counts = [F.struct(F.size(F.filter(_texts(sorted({w.lower() for w in words})), lambda w: F.contains(low, w))).alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("intent")) for i, (name, words) in enumerate(intents.items())]
    best = F.array_max(F.array(*counts))
    # The words of the rules.
    return (
        F.when(X.has_any(q, ("判定标准", "测试规范", "定义与规范")), "test_spec")
        .when(F.contains(q, F.lit("测试项")) & X.has_any(q, ("标准", "规范", "定义", "要求")), "test_spec")
        .when(X.has_any(q, ("测试用例", "前置条件", "预期输出")), "test_case")
        .when(q.rlike(WORK_ORDER), "work_order")
        .when(q.rlike(r"(?iU)\bQE-\d{4}-\d{4}\b"), "quality_event")
        .when(q.rlike(r"(?iU)\b8D-\d{4}-\d{4}\b"), "8d")
        .when(fault & X.has_any(q, ("怎么调整", "如何调整", "参数怎么", "参数如何", "Over-Drive", "清针")), "work_order")
        .when(fault & X.has_any(q, ("怎么处理", "如何处理", "如何解决", "怎么解决", "处理方法", "解决方法")), "fault_case")
        .otherwise(X.let(best, lambda b: F.when(b["n"] > 0, b["intent"]).otherwise(lexicon.NO_INTENT)))
    )


def _one(values: Column) -> Column:
    return F.when(F.size(values) == 1, F.get(values, 0))


def where_struct(**fields: Column) -> Column:
    return F.struct(*[fields.get(f, F.lit(None)).cast("string").alias(f) for f in lexicon.FILTER_FIELDS])


def suggest_filters(entities: Column, intent: Column, user: Column | None = None) -> Column:
    """A where of the only version, the intent's doc_type and the only department, unless the user set them."""
    free = lambda f, value: value if user is None else F.when(user[f].isNull(), value)
    return where_struct(version=free("version", _one(entities["versions"])), doc_type=free("doc_type", F.when(intent.isin(*lexicon.INTENTS), intent)), department=free("department", _one(entities["departments"])))


def should_decompose(question: Column | str, entities: Column, words: Sequence[str] = lexicon.CONJUNCTIONS) -> Column:
    q = X.col(question)
    return (F.size(entities["model_types"]) > 1) | (F.size(entities["versions"]) > 1) | (X.has_any(q, words) & (F.length(q) > 25))


def is_vague(question: Column | str, entities: Column, intent: Column, words: Sequence[str] = lexicon.VAGUE) -> Column:
    q = X.col(question)
    none = F.size(F.concat(entities["model_types"], entities["fault_codes"], entities["doc_ids"], entities["versions"])) == 0
    return X.has_any(q, words) | ((intent == lexicon.NO_INTENT) & none & (F.length(q) < 30))


def build_where(df: DataFrame) -> Column:
    """The where of the filter fields that df has; a version is normalised, an empty value constrains nothing."""
    value = lambda f: X.normalize_version(f) if f == "version" else F.col(f)
    return where_struct(**{f: F.nullif(value(f), F.lit("")) for f in lexicon.FILTER_FIELDS if f in df.columns})


def where_fields(where: Column) -> Column:
    """Names of the constrained fields."""
    return F.filter(F.array(*[F.when(where[f].isNotNull(), F.lit(f)) for f in lexicon.FILTER_FIELDS]), lambda x: x.isNotNull())


def merge_where(user: Column, auto: Column) -> Column:
    """The user's value of each field, else the suggested one."""
    return where_struct(**{f: F.coalesce(user[f], auto[f]) for f in lexicon.FILTER_FIELDS})


def drop_doc_type(where: Column) -> Column:
    return where.withField("doc_type", F.lit(None).cast("string"))


def where_matches(where: Column, row) -> Column:
    """Does a row fit a where; row: field name -> column."""
    out = F.lit(True)
    for f in lexicon.FILTER_FIELDS:
        out = out & (where[f].isNull() | (where[f] == row(f)))
    return out


# ---- synonyms

def normalize_synonyms(payload: Mapping | str, weak: Sequence[str] = lexicon.WEAK_WORDS) -> list[tuple[int, str, str, float, int]]:
    """(group, canonical, text, weight, place) rows of a synonym dictionary: a small configuration.

    A group is a list of terms, or {weight, terms: [text or {text, weight}]}. Without a weight the
    canonical term has 1, a weak word 0.2 and any other 0.8; a repeated text keeps its highest. The
    order is by weight, then length, falling; groups of one term are dropped.
    """
    if isinstance(payload, str):
        try:
            payload = json.loads(payload)
        except ValueError:
            return []
    rows: list[tuple[int, str, str, float, int]] = []
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    for canonical, value in payload.items() if isinstance(payload, Mapping) else ():
        name, given = str(canonical).strip(), value.get("terms", []) if isinstance(value, Mapping) else value
        if not name or not isinstance(value, list | Mapping):
            continue
        weights = {name: float(value["weight"]) if isinstance(value, Mapping) and number(value.get("weight")) else 1.0}
        for term in given if isinstance(given, list) else ():
            own = term if isinstance(term, Mapping) else {"text": term}
            t = str(own.get("text", "")).strip()
            w = float(own["weight"]) if number(own.get("weight")) else 0.2 if t.lower() in weak else 0.8
            if t and w > weights.get(t, float("-inf")):
                weights[t] = w
        if len(weights) > 1:
            ordered = sorted(weights.items(), key=lambda x: (-x[1], -len(x[0])))
            group = len({r[0] for r in rows})
            rows += [(group, name, t, w, i) for i, (t, w) in enumerate(ordered)]
    return rows


def synonym_table(spark: SparkSession, payload: Mapping | str = lexicon.SYNONYMS) -> DataFrame:
    return spark.createDataFrame(normalize_synonyms(payload), "group_id int, canonical string, text string, weight double, place int")


def expand_queries(questions: DataFrame, synonyms: DataFrame, rewrites: DataFrame | None = None, max_variants: int = 5, min_weight: float = 0.65, per_group: int = 2) -> DataFrame:
    """query_id, variant_idx, variant: each question, its synonym variants, then given rewrites.

    In each group the heaviest contained term is replaced, at its first occurrence, by at most
    per_group other terms that are heavy enough and not lighter. Variants that are equal but for
    case and white space are dropped; max_variants stay. rewrites: query_id, place, rewrite.
    A synonym table may have any size: questions and terms meet by equality.
    """
    base = questions.select("query_id", X.strip("question").alias("base")).where("base != ''")
    terms = synonyms.select("group_id", "text", "weight", "place")
    hits = holding(base, terms, "base", "text")
    first = Window.partitionBy("query_id", "group_id").orderBy("place")
    hit = hits.withColumn("r", F.row_number().over(first)).where("r = 1").where(F.col("weight") >= min_weight).select("query_id", "base", "group_id", F.col("text").alias("hit"), F.col("weight").alias("hit_weight"))
    other = terms.select("group_id", F.col("text").alias("to"), F.col("weight").alias("to_weight"), "place")
    options = hit.join(other, "group_id").where(F.col("to") != F.col("hit")).where((F.col("to_weight") >= min_weight) & (F.col("to_weight") + 1e-9 >= F.col("hit_weight")))
    options = options.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "group_id").orderBy("place"))).where(F.col("r") <= per_group)
    replaced = F.concat(F.expr("substring(base, 1, instr(base, hit) - 1)"), F.col("to"), F.expr("substring(base, instr(base, hit) + length(hit))"))
    rows = base.select("query_id", F.struct(F.lit(0).alias("kind"), F.lit(0).alias("a"), F.lit(0).alias("b")).alias("at"), F.col("base").alias("variant"))
    rows = rows.unionByName(options.select("query_id", F.struct(F.lit(1).alias("kind"), F.col("group_id").alias("a"), F.col("place").alias("b")).alias("at"), X.strip(replaced).alias("variant")))
    if rewrites is not None:
        rows = rows.unionByName(rewrites.join(base.select("query_id"), "query_id").select("query_id", F.struct(F.lit(2).alias("kind"), F.col("place").cast("int").alias("a"), F.lit(0).alias("b")).alias("at"), X.strip("rewrite").alias("variant")))
    rows = rows.where("variant != ''")
    return dedupe_queries(rows, "at").where(F.col("variant_idx") < max_variants)


def dedupe_queries(rows: DataFrame, order: str = "variant_idx") -> DataFrame:
    """query_id, variant_idx, variant: blank variants and repeats (but for case and blanks) dropped, order kept."""
    rows = rows.select("query_id", F.col(order).alias("_at"), X.strip("variant").alias("variant")).where("variant != ''").withColumn("_key", X.norm_query("variant"))
    rows = rows.groupBy("query_id", "_key").agg(F.min(F.struct("_at", "variant")).alias("v")).select("query_id", "v.*")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_at")) - 1
    return rows.select("query_id", place.alias("variant_idx"), "variant")


# ---- plans


def route_query(question: Column | str, routes: Mapping[str, Sequence[str]] = lexicon.ROUTES) -> Column:
    out = F.lit("kb")
    for name, words in reversed(routes.items()):
        out = F.when(X.has_any(question, words), name).otherwise(out)
    return out


def retry_policy(entities: Column, intent: Column, is_complex: Column) -> Column:
    """max_retries, trigger_conditions and strategy of a plan."""
    policy = lambda strategy, *on: F.struct(F.lit(1).alias("max_retries"), _texts(on).alias("trigger_conditions"), F.lit(strategy).alias("strategy"))
    named = lambda *f: F.size(F.concat(*[entities[x] for x in f])) > 0
    return (
        F.when(named("doc_ids", "fault_codes"), policy("exact_match_boost", "entity_not_found", "low_confidence"))
        .when(named("versions", "model_types") & intent.isin("spec", "release_note", "fmea", "8d"), policy("tighten_filter", "low_confidence", "type_mismatch"))
        .when(is_complex, policy("expand_query", "low_confidence"))
        .otherwise(policy("relax_filter", "low_confidence"))
    )


def route_tools(route: Column, entities: Column, tools: Mapping[str, str] = lexicon.TOOLS) -> Column:
    kb = F.when(F.size(entities["doc_ids"]) > 0, _texts(("kb_search", "doc_check"))).otherwise(_texts(("kb_search",)))
    out = F.array(route)
    for name, tool in tools.items():
        if name != "kb":
            out = F.when(route == name, _texts((tool,))).otherwise(out)
    return F.when(route == "kb", kb).otherwise(out)


def execution_plan(plans: DataFrame) -> DataFrame:
    """plans with route, tools, filters and policy."""
    route = route_query("question")
    return plans.withColumn("route", route).withColumns({"tools": route_tools(F.col("route"), F.col("entities")), "filters": F.col("suggested_filters"), "policy": retry_policy(F.col("entities"), F.col("intent"), F.col("is_complex"))})


def stub_answer(route: Column, stubs: Mapping[str, str] = lexicon.STUBS) -> Column:
    """The answer where a question is not for the documents; null where it is."""
    out = F.lit(lexicon.OTHER_STUB)
    for name, answer in stubs.items():
        out = F.when(route == name, answer).otherwise(out)
    return F.when(route != "kb", out)


def build_query_plans(questions: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
    """One row a question: query_id, question, rewritten, variants, sub_queries, intent, entities,
    user_where, suggested_filters, where and is_complex.

    rewrites: query_id, variants, sub_queries (what a model answered elsewhere). Without one, and
    for questions that name a document id, the question stands for itself; sub-questions are taken
    for complex questions only.
    """
    q = questions.select("query_id", "question", build_where(questions).alias("user_where")).withColumn("entities", extract_entities("question")).withColumn("intent", classify_intent("question"))
    q = q.withColumns({"is_complex": should_decompose("question", F.col("entities")), "suggested_filters": suggest_filters(F.col("entities"), F.col("intent"), F.col("user_where"))})
    q = q.withColumn("where", merge_where(F.col("user_where"), F.col("suggested_filters")))
    none = F.array().cast("array<string>")
    if rewrites is None:
        q = q.withColumns({"variants": F.array("question"), "sub_queries": none})
    else:
        given = rewrites.select("query_id", F.col("variants").alias("_v"), F.col("sub_queries").alias("_s"))
        by_id = F.size("entities.doc_ids") > 0
        q = q.join(given, "query_id", "left").withColumns({"variants": F.when(by_id | (F.coalesce(F.size("_v"), F.lit(0)) == 0), F.array("question")).otherwise(F.col("_v")), "sub_queries": F.when(~by_id & F.col("is_complex"), F.coalesce("_s", none)).otherwise(none)}).drop("_v", "_s")
    return q.withColumn("rewritten", F.col("variants")[0])
