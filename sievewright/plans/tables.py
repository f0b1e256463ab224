"""Frames that the driver's queries start from; whole tables throughout."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import lexicon as L
from sievewright.functions import text as T
from sievewright.operators import review, routing

#: Modules of the traces' routing, as lookup without handlers for all of them.
HANDLED = ("code-assistant", "general-reasoning", "document-search")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("task_id"), F.col("text").alias("task"))


def document_routes(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    return routing.route(document_tasks(spark, folder), routing.module_table(spark), **options)


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Each trace once; deliveries of one trace are equal but for the time of ingestion."""
    return table(spark, folder, "inference_traces").dropDuplicates(["trace_id"])


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Each review once; its deliveries are equal but for the time of ingestion."""
    return table(spark, folder, "inference_reviews").dropDuplicates(["review_id"])


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews as feedback on the modules that their traces selected."""
    label = F.lower(F.trim("status"))
    rows = reviews(spark, folder).select(
        F.lower(F.trim("trace_id")).alias("trace_id"), "rating",
        F.when(label.isin("accepted", "corrected"), True).when(label.isin("rejected", "unsafe"), False).alias("success"), (F.coalesce("rating", F.lit(3)) / 5).alias("confidence"),
    )
    return rows.join(traces(spark, folder).select("trace_id", "selected_modules"), "trace_id").select("selected_modules", "rating", "success", "confidence")


def manifest_memory(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dataset_manifests").select(F.col("name").alias("record_id"), F.concat_ws(" ", "name", "description").alias("content"), "domains", F.col("capabilities").alias("keywords"), "source")


def trace_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return traces(spark, folder).select(F.col("trace_id").alias("task_id"), "task")


def mix_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the mix as samples, with reliability, licence and domains of their manifest; a source without one is unlicensed."""
    manifests = table(spark, folder, "dataset_manifests").select("source", F.get_json_object("metadata", "$.reliability").cast("double").alias("reliability"), "domains", "license")
    rows = table(spark, folder, "mix_rows").select("row_id", "source", "instruction", "input", "output")
    content = F.concat_ws(" ", F.nullif(T.squashed(F.col("instruction")), F.lit("")), F.nullif(T.squashed(F.col("input")), F.lit("")), F.nullif(T.squashed(F.col("output")), F.lit("")))
    joined = rows.join(manifests, "source", "left")
    blocked = T.has_any(F.lower(F.trim(T.text_or_empty(F.col("license")))), L.BLOCKED_LICENSES)
    return joined.withColumn("content", content).select(
        F.col("row_id").alias("id"), "content", "instruction", "output", F.lit("instruction").alias("sample_type"), "domains", F.array_distinct(T.content_terms(F.col("content"))).alias("keywords"),
        F.coalesce("reliability", F.lit(0.5)).alias("reliability"), (F.col("license").isNotNull() & ~blocked).alias("licensed"),
    )


def mix_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the mix as knowledge seeds: twelve keywords, the manifest's reliability as confidence."""
    rows = mix_samples(spark, folder)
    return rows.select("id", "content", "domains", T.top_keywords(F.col("content")).alias("keywords"), F.col("reliability").alias("confidence"), "reliability", F.lit("document").alias("source_type"))


def run_results(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of traces by adapter (run) and template with model (case)."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    rows = traces(spark, folder).select(
        F.col("adapter_name").alias("run_id"), F.concat_ws("/", "template_name", "model").alias("case_id"), F.least(n("selected_modules") / 3, F.lit(1.0)).alias("routing"),
        F.least(n("context_sources") / 4, F.lit(1.0)).alias("context"), F.when(F.col("error").isNull(), 1.0).otherwise(0.0).alias("growth"),
    )
    each = rows.groupBy("run_id", "case_id").agg(*[F.round(F.avg(m), 6).alias(m) for m in ("routing", "context", "growth")])
    return each.withColumn("overall", F.round(F.col("routing") * 0.5 + F.col("context") * 0.35 + F.col("growth") * 0.15, 9))


def trace_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Traces as benchmark cases: what they selected is expected, with the domains and five keywords of the task; the template is the workspace."""
    rows = traces(spark, folder).select(F.col("trace_id").alias("case_id"), "task", F.col("selected_modules").alias("expected_modules"), F.col("template_name").alias("workspace"))
    return rows.withColumn("expected_domains", T.domains_of(T.terms(F.col("task")))).withColumn("expected_keywords", T.top_keywords(F.col("task"), 5))


def mix_records(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the mix as JSON records (source, line_number, data)."""
    return table(spark, folder, "mix_rows").select("source", F.col("row_id").alias("line_number"), F.to_json(F.struct("instruction", "input", "output")).alias("data"))


def checked_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds of the mix with the status of their validation, a decision that follows from it alone, score, and the manifest's licence as metadata."""
    seeds = mix_seeds(spark, folder).persist(StorageLevel.MEMORY_AND_DISK)  # keywords are worked out once
    rows = table(spark, folder, "mix_rows").select(F.col("row_id").alias("id"), "source")
    licence = table(spark, folder, "dataset_manifests").select("source", F.to_json(F.struct("license")).alias("metadata"))
    decision = F.when(F.col("status") == "validated", "promote_candidate").when(F.col("status") == "rejected", "reject_broken").when(F.col("status") == "weak", "needs_review").otherwise("quarantine_weak")
    checked = review.validate_seeds(seeds).persist(StorageLevel.MEMORY_AND_DISK).select("id", "status", "score", decision.alias("decision"))
    return seeds.join(rows, "id").join(licence, "source", "left").join(checked, "id")
