"""Tasks to expert modules by shared terms, with feedback-adjusted scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import lexicon as L
from sievewright.functions import text as T


def module_table(spark: SparkSession, modules: Sequence[tuple] = L.MODULES) -> DataFrame:
    """Modules (module, domain, capabilities, keywords, cost) with their terms by kind."""
    rows = [(m[0], m[1], list(m[2]), list(m[3]), m[4]) for m in modules]
    table = spark.createDataFrame(rows, "module string, domain string, capabilities array<string>, keywords array<string>, cost int")
    return table.select("*", T.terms(F.col("domain")).alias("domain_terms"), T.terms_of(F.col("keywords")).alias("keyword_terms"), T.terms_of(F.col("capabilities")).alias("capability_terms"))


def score_modules(tasks: DataFrame, modules: DataFrame) -> DataFrame:
    """(task_id, module, cost, base_score, reasons) of every module that shares a term with a task (task_id, task).

    2 per domain term, 1.5 per keyword, 1 per capability term.  Instead of pairing all tasks with all modules, the
    modules' terms are an inverted index: each distinct term of a task is joined with it.  The index is as large as
    the catalogue of modules, not as the data.  Null and empty tasks match nothing.
    """
    kinds = (("domain_terms", 2.0), ("keyword_terms", 1.5), ("capability_terms", 1.0))
    index = None
    for column, weight in kinds:
        part = modules.select("module", "cost", F.explode(column).alias("term"), F.lit(column.removesuffix("_terms")).alias("kind"), F.lit(weight).alias("weight"))
        index = part if index is None else index.unionByName(part)
    said = tasks.select("task_id", F.explode(T.terms(F.col("task"))).alias("term"))
    hits = said.join(index, "term")
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("term"))))
    each = hits.groupBy("task_id", "module", "cost").agg(F.sum("weight").alias("base_score"), *[listed(k).alias(k) for k in ("domain", "keyword", "capability")])
    reason = lambda kind: F.when(F.size(kind) > 0, F.concat(F.lit(f"{kind} match: "), F.array_join(kind, ", ")))
    reasons = F.filter(F.array(reason("domain"), reason("keyword"), reason("capability")), lambda r: r.isNotNull())
    return each.select("task_id", "module", "cost", "base_score", reasons.alias("reasons"))


def route(tasks: DataFrame, modules: DataFrame, top_k: int = 3, minimum_score: float = 1.0, adjustments: DataFrame | None = None) -> DataFrame:
    """Scored modules (..., score, rank, selected) in order of score, then cost, then name.

    ``adjustments`` (module, adjustment) move scores of modules that are relevant at all; a module without one stays.
    The first ``top_k`` with ``minimum_score`` are selected; others come out as skipped.
    """
    scored = score_modules(tasks, modules)
    if adjustments is None:
        scored = scored.withColumn("adjustment", F.lit(0.0))
    else:
        scored = scored.join(adjustments.select("module", "adjustment"), "module", "left").withColumn("adjustment", F.coalesce("adjustment", F.lit(0.0)))
    return ranked(scored.withColumn("score", F.greatest(F.lit(0.0), F.col("base_score") + F.col("adjustment"))), top_k, minimum_score)


def ranked(scored: DataFrame, top_k: int = 3, minimum_score: float = 1.0) -> DataFrame:
    """Scored modules with rank and choice, as ``route`` gives them."""
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "cost", "module"))
    return scored.withColumn("rank", rank).withColumn("selected", (F.col("rank") <= top_k) & (F.col("score") >= minimum_score))


def route_confidence(routes: DataFrame) -> DataFrame:
    """(task_id, confidence): selected scores over all positive scores, 4 digits; tasks that match nothing are absent."""
    chosen = F.sum(F.when(F.col("selected"), F.col("score")).otherwise(0.0))
    return routes.groupBy("task_id").agg(T.rounded(F.coalesce(F.try_divide(chosen, F.sum("score")), F.lit(0.0)), 4).alias("confidence"))


def module_counts(routes: DataFrame) -> DataFrame:
    """Per selected module: times selected and mean score."""
    return routes.where("selected").groupBy("module").agg(F.count(F.lit(1)).alias("times_selected"), F.avg("score").alias("mean_score"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Per module of feedback (selected_modules, rating, success, confidence): times, outcomes, means to 4 digits.

    A record counts for each selected module; null lists count for none.  A null success is no outcome.
    """
    each = feedback.select(F.explode("selected_modules").alias("module"), "rating", "success", "confidence").groupBy("module").agg(
        F.count(F.lit(1)).alias("times_selected"), F.count_if(F.col("success")).alias("successes"), F.count_if(~F.col("success")).alias("failures"),
        F.avg("rating").alias("average_rating"), F.avg("confidence").alias("average_confidence"),
    )
    rate = F.try_divide(F.col("successes"), F.col("successes") + F.col("failures"))
    return each.withColumn("success_rate", F.round(rate, 4)).withColumn("average_rating", F.round("average_rating", 4)).withColumn("average_confidence", F.round("average_confidence", 4))


def adaptive_adjustments(stats: DataFrame, boost: float = 0.15, penalty: float = 0.15, minimum: int = 1, limit: float = 0.5) -> DataFrame:
    """(module, adjustment): signed share of successes and centred rating, each times its factor, within the limit, 4 digits."""
    outcomes = F.try_divide(F.col("successes") - F.col("failures"), F.col("successes") + F.col("failures"))
    rating = (F.col("average_rating") - 3.0) / 2.0
    part = lambda x: F.coalesce(F.when(x > 0, x * boost).otherwise(x * penalty), F.lit(0.0))
    value = F.when(F.col("times_selected") >= minimum, F.greatest(F.lit(-limit), F.least(part(outcomes) + part(rating), F.lit(limit)))).otherwise(0.0)
    return stats.select("module", F.round(value, 4).alias("adjustment"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """One row: records, mean confidence (4 digits), successes and failures."""
    return feedback.agg(F.count(F.lit(1)).alias("records"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("average_confidence"), F.count_if(F.col("success")).alias("successes"), F.count_if(~F.col("success")).alias("failures"))


def modules_for_workspace(modules: DataFrame, names: Sequence[str] = (), domains: Sequence[str] = (), fallback: str = "general-reasoning") -> DataFrame:
    """Modules by name if names are given, else by a shared domain term, else all; the fallback module always stays."""
    if names:
        keep = F.col("module").isin(*names)
    elif domains:
        keep = F.arrays_overlap("domain_terms", T.terms_of(T.words(domains)))
    else:
        keep = F.lit(True)
    return modules.where(keep | (F.col("module") == fallback))


def without_handler(modules: DataFrame, handlers: DataFrame) -> DataFrame:
    """Modules for which ``handlers`` (module) has none."""
    return modules.select("module").join(handlers.select("module"), "module", "left_anti")
