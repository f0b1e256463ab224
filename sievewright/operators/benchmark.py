"""Benchmark scores, comparison of runs and regression gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import lexicon as L
from sievewright.functions import text as T
from sievewright.operators import retrieval, routing
from sievewright.operators.review import last_per_key

METRICS = ("overall", "routing", "context", "growth")


def coverage(expected: Column, observed: Column) -> Column:
    """Share of expected labels that are observed, any case, three digits; 1 without expectations.  Repeated ones count."""
    lowered = F.transform(F.coalesce(observed, F.array().cast("array<string>")), F.lower)
    hits = T.let(lowered, lambda seen: F.size(F.filter(expected, lambda e: F.array_contains(seen, F.lower(e)))))
    return F.when(F.size(F.coalesce(expected, F.array().cast("array<string>"))) == 0, 1.0).otherwise(F.round(hits / F.size(expected), 3))


def overall_score(routing: Column, context: Column, growth: Column) -> Column:
    """0.5 routing, 0.35 context, 0.15 growth, each within 0 and 1, three digits."""
    return T.rounded(T.clamped(routing) * 0.5 + T.clamped(context) * 0.35 + T.clamped(growth) * 0.15, 3)


def growth_scores(cases: DataFrame, growth: DataFrame) -> DataFrame:
    """(case_id, growth): 0.4 of the domains' and 0.6 of the keywords' coverage by the terms of a growth plan's texts (text), three digits; 0 without a plan.

    The plan's terms are one row: distinct terms, of which a case needs those that it expects only, are joined and counted.
    """
    terms = growth.select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    wanted = cases.select("case_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("l")) for k, c in (("domain", "expected_domains"), ("keyword", "expected_keywords"))])).alias("w"))
    each = wanted.select("case_id", "w.kind", F.explode(F.coalesce("w.l", F.array().cast("array<string>"))).alias("label"))
    hits = each.withColumn("term", F.lower("label")).join(terms.withColumn("hit", F.lit(1)), "term", "left").groupBy("case_id", "kind").agg(F.round(F.count("hit") / F.count(F.lit(1)), 3).alias("s"))
    one = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("s"))), F.lit(1.0))
    scored = hits.groupBy("case_id").agg(F.round(one("domain") * 0.4 + one("keyword") * 0.6, 3).alias("g"))
    rows = cases.select("case_id").join(scored, "case_id", "left")
    return rows.select("case_id", (F.lit(0.0) if growth.isEmpty() else F.coalesce("g", F.lit(1.0))).alias("growth"))


def context_texts(cases: DataFrame, context: DataFrame, growth: DataFrame | None = None) -> DataFrame:
    """(case_id, text): a case's task with the contents of its context items in order, and the distinct terms of a growth plan that the case expects.

    Coverage looks terms up only, so of a plan, which is the same for all cases, a case needs no more than those.
    """
    held = context.groupBy(F.col("task_id").alias("case_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "content"))), lambda s: s["content"]).alias("parts"))
    rows = cases.select("case_id", "task").join(held, "case_id", "left")
    extra = F.array().cast("array<string>")
    if growth is not None:
        terms = growth.select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
        mine = cases.select("case_id", F.explode(F.transform("expected_keywords", F.lower)).alias("term")).join(terms, "term").groupBy("case_id").agg(F.array_sort(F.collect_set("term")).alias("planned"))
        rows, extra = rows.join(mine, "case_id", "left"), F.coalesce("planned", extra)
    return rows.select("case_id", F.concat_ws(" ", F.col("task"), F.array_join(F.coalesce("parts", F.array().cast("array<string>")), " "), F.array_join(extra, " ")).alias("text"))


def score_cases(cases: DataFrame, routes: DataFrame, context: DataFrame, growth: DataFrame | None = None, labels: Mapping[str, str] = L.MODULE_LABELS) -> DataFrame:
    """(case_id, routing, context, growth, overall) of cases from their routes (task_id = case_id), context items and growth plan (text).

    ``cases``: case_id, task, expected_domains, expected_modules, expected_keywords.
    """
    name = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    chosen = routes.where("selected").groupBy(F.col("task_id").alias("case_id")).agg(F.collect_set("module").alias("modules"), F.collect_set(F.coalesce(name[F.col("module")], F.col("module"))).alias("domains"))
    rows = cases.join(chosen, "case_id", "left").join(context_texts(cases, context, growth), "case_id")
    routing = F.round(coverage(F.col("expected_domains"), F.col("domains")) * 0.45 + coverage(F.col("expected_modules"), F.col("modules")) * 0.55, 3)
    rows = rows.select("case_id", routing.alias("routing"), coverage(F.col("expected_keywords"), T.terms(F.col("text"))).alias("context"))
    rows = rows.join(growth_scores(cases, growth), "case_id") if growth is not None else rows.withColumn("growth", F.lit(0.0))
    return rows.withColumn("overall", overall_score(F.col("routing"), F.col("context"), F.col("growth")))


def run_cases(cases: DataFrame, modules: DataFrame, memory: DataFrame | None = None, growth: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Scores of all cases in one run: routes among the modules that a case's workspace allows, context, and the four scores.

    ``allowed`` (workspace, module); a workspace that it doesn't name, or null, allows all modules.
    """
    tasks = cases.select(F.col("case_id").alias("task_id"), "task")
    routes = routing.route(tasks, modules)
    if allowed is not None:
        # Ranks are of the modules that are left, so the choice is made again on what was scored.
        of = cases.select(F.col("case_id").alias("task_id"), "workspace")
        named = of.join(F.broadcast(allowed.select("workspace").distinct().withColumn("limited", F.lit(True))), "workspace", "left")
        open_ = named.where("limited is null").select("task_id")
        pairs = named.where("limited").join(F.broadcast(allowed), "workspace").select("task_id", "module")
        kept = routes.join(open_, "task_id", "left_semi").unionByName(routes.join(pairs, ["task_id", "module"], "left_semi").select(*routes.columns))
        routes = routing.ranked(kept.drop("rank", "selected"))
    if memory is None:
        none = memory_schema(cases.sparkSession)
        context = retrieval.build_context(routes, retrieval.search_memory(tasks.limit(0), none), none)
    else:
        context = retrieval.build_context(routes, retrieval.search_memory(tasks, memory), memory)
    return score_cases(cases, routes, context, growth)


def memory_schema(spark: SparkSession) -> DataFrame:
    """A memory without records."""
    return spark.createDataFrame([], "record_id string, content string, domains array<string>, keywords array<string>, source string")


def run_configs(cases: DataFrame, modules: DataFrame, configs: Mapping[str, tuple[DataFrame | None, DataFrame | None]]) -> DataFrame:
    """(run_id, case_id, scores) of each configuration: its memory and its growth plan, either of which may be None."""
    out = None
    for name, (memory, growth) in configs.items():
        part = run_cases(cases, modules, memory, growth).withColumn("run_id", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no configuration")
    return out


def run_report(results: DataFrame) -> DataFrame:
    """Mean scores per run (run_id), three digits, and number of cases."""
    return results.groupBy("run_id").agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(m), 3).alias(m) for m in METRICS])


def compare_runs(baseline: DataFrame, candidate: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(case_id, delta per metric, status) of all cases of two runs (case_id, scores).

    A score that is missing counts 0.  A case only the candidate has is improved, one that it lacks regressed; others by
    the overall delta against the threshold, which itself counts.
    """
    side = lambda f, c: f.select("case_id", F.lit(True).alias(f"in_{c}"), *[F.col(m).alias(f"{m}_{c}") for m in METRICS])
    both = side(baseline, "b").join(side(candidate, "c"), "case_id", "full_outer")
    delta = {m: F.round(F.round(F.coalesce(f"{m}_c", F.lit(0.0)) - F.coalesce(f"{m}_b", F.lit(0.0)), 9), 3) for m in METRICS}  # first without the noise of binary fractions
    status = F.when(F.col("in_b").isNull(), "improved").when(F.col("in_c").isNull(), "regressed").when(delta["overall"] >= threshold, "improved").when(delta["overall"] <= -threshold, "regressed").otherwise("unchanged")
    return both.select("case_id", *[d.alias(f"{m}_delta") for m, d in delta.items()], status.alias("status"))


def gate(deltas: DataFrame, metric_threshold: float = 0.05, case_threshold: float = 0.1) -> DataFrame:
    """Regressions (label, delta): mean deltas and single cases that fall by a threshold or more.  A null delta, of a missing score, is none."""
    long = deltas.select("case_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_delta").alias("delta")) for m in METRICS])).alias("x")).select("case_id", "x.metric", "x.delta")
    means = long.groupBy("metric").agg(F.round(F.avg("delta"), 3).alias("delta")).where(F.col("delta") <= -metric_threshold).select(F.concat(F.lit("metric:"), "metric").alias("label"), "delta")
    cases = long.where((F.col("metric") == "overall") & (F.col("delta") <= -case_threshold)).select(F.concat(F.lit("case:"), "case_id").alias("label"), "delta")
    return means.unionByName(cases)


def best_per_case(results: DataFrame) -> DataFrame:
    """(case_id, run_id, overall): the run with the best overall score, ties by name."""
    return results.groupBy("case_id").agg(F.min(F.struct((-F.col("overall")).alias("o"), "run_id")).alias("b")).select("case_id", "b.run_id", (-F.col("b.o")).alias("overall"))


def score_pivot(results: DataFrame, runs: Sequence[str]) -> DataFrame:
    """One row per case, one column per run with the overall score."""
    return results.groupBy("case_id").pivot("run_id", list(runs)).agg(F.max("overall"))


def check_responses(responses: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, id, passed, missing) of responses (case_id, id, text) against cases (case_id, required, forbidden, opening).

    All required substrings occur, no forbidden one does, and the first line starts with the opening, any case.
    """
    low = F.lower(T.text_or_empty(F.col("text")))
    missing = F.filter("required", lambda r: ~F.contains(low, F.lower(r)))
    bad = F.exists("forbidden", lambda r: F.contains(low, F.lower(r)))
    first = F.trim(F.split(F.trim(low), "\n")[0])
    starts = F.col("opening").isNull() | F.startswith(first, F.lower("opening"))
    rows = responses.join(cases, "case_id")
    return rows.select("case_id", "id", ((F.size(missing) == 0) & ~bad & starts).alias("passed"), F.size(missing).alias("missing"))


def last_runs(records: DataFrame) -> DataFrame:
    """The last record of each run_id by created_at; of equal times the one with the largest other values."""
    return last_per_key(records, ["run_id"], ["created_at", *sorted(c for c in records.columns if c not in ("run_id", "created_at"))])
