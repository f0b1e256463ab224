"""Queries of the core operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import benchmark, chunking, growth, handlers, ingest, retrieval, review, routing, training
from sievewright.plans import tables as S
from sievewright.sources import jsonl

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def route_topk(spark: SparkSession, folder: str) -> DataFrame:
    return S.document_routes(spark, folder).where("selected").select(F.col("task_id").alias("doc_id"), "module", "score", "rank", F.array_join("reasons", "; ").alias("reasons"))


@query
def route_module_stats(spark: SparkSession, folder: str) -> DataFrame:
    return routing.module_counts(S.document_routes(spark, folder)).withColumn("mean_score", F.round("mean_score", 6))


@query
def route_confidence(spark: SparkSession, folder: str) -> DataFrame:
    routes = routing.route_confidence(S.document_routes(spark, folder))
    return routes.select(F.col("task_id").alias("doc_id"), F.round("confidence", 3).alias("confidence"))


@query
def feedback_module_stats(spark: SparkSession, folder: str) -> DataFrame:
    return routing.feedback_stats(S.feedback(spark, folder))


@query
def feedback_summary(spark: SparkSession, folder: str) -> DataFrame:
    return routing.feedback_summary(S.feedback(spark, folder))


@query
def adaptive_adjustment(spark: SparkSession, folder: str) -> DataFrame:
    return routing.adaptive_adjustments(routing.feedback_stats(S.feedback(spark, folder)))


@query
def missing_handlers(spark: SparkSession, folder: str) -> DataFrame:
    used = S.table(spark, folder, "inference_traces").select(F.explode("selected_modules").alias("module")).distinct()
    return routing.without_handler(used, spark.createDataFrame([(h,) for h in S.HANDLED], "module string"))


@query
def memory_search_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.search_memory(S.trace_tasks(spark, folder), S.manifest_memory(spark, folder), limit=3).select("task_id", "record_id", "score", "relevance", "rank")


@query
def context_build(spark: SparkSession, folder: str) -> DataFrame:
    tasks, memory = S.trace_tasks(spark, folder), S.manifest_memory(spark, folder)
    routes = routing.route(tasks, routing.module_table(spark))
    return retrieval.build_context(routes, retrieval.search_memory(tasks, memory, limit=3), memory).select("task_id", "position", "source", "relevance")


@query
def keywords_topk(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.keywords(S.table(spark, folder, "documents"))


@query
def domain_assign(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "documents").select("doc_id", F.array_join(T.domains_of(T.terms(F.col("text"))), ",").alias("domains"))


@query
def sample_type(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.table(spark, folder, "mix_rows")
    return rows.select("row_id", T.sample_type(F.concat_ws(" ", "instruction", "output"), "instruction").alias("sample_type"))


@query
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk(S.table(spark, folder, "documents"))


@query
def chunk_memory(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.memory_records(chunking.tagged(chunking.chunk(S.table(spark, folder, "documents"))))


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    said = F.array(F.struct(F.lit("human").alias("from"), F.col("task").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("response_text").alias("value")))
    return S.traces(spark, folder).select("trace_id", F.to_json(F.struct(said.alias("conversations"))).alias("data"))


@query
def conversation_samples(spark: SparkSession, folder: str) -> DataFrame:
    messages = ingest.parsed_messages(F.col("data"))
    return _conversations(spark, folder).select("trace_id", F.size(messages).alias("messages"), T.squashed(ingest.conversation_text(messages)).alias("content"))


@query
def first_turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pair = ingest.first_exchange(ingest.parsed_messages(F.col("data")))
    return _conversations(spark, folder).select("trace_id", pair.alias("p")).where("p is not null").select("trace_id", "p.instruction", "p.output")


@query
def jsonl_parse_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.table(spark, folder, "mix_rows").select(F.col("row_id").alias("line_number"), F.to_json(F.struct("instruction", "input", "output", "source")).alias("value"))
    return ingest.ingest_report(jsonl.json_objects(rows))


@query
def use_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.use_decisions(S.table(spark, folder, "dataset_manifests"))


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    return review.review(S.mix_samples(spark, folder))


@query
def review_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("id", "decision", F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


@query
def review_report(spark: SparkSession, folder: str) -> DataFrame:
    return review.review_report(_reviews(spark, folder))


@query
def review_reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    return review.reason_counts(_reviews(spark, folder))


@query
def accepted_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    return review.accepted_samples(S.mix_samples(spark, folder), _reviews(spark, folder)).select("id")


@query
def accepted_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return review.accepted_seeds(S.mix_samples(spark, folder), _reviews(spark, folder)).select("id", F.round("confidence", 6).alias("confidence"))


@query
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return review.exact_duplicates(rows).select("id", "first_id", "is_duplicate")


@query
def dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    return review.duplicate_groups(S.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))


@query
def length_refusal_filter(spark: SparkSession, folder: str) -> DataFrame:
    return training.usable_rows(S.table(spark, folder, "mix_rows")).select("row_id")


@query
def normalized_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.reviews(spark, folder).join(S.traces(spark, folder).select("trace_id", "task", "response_text"), "trace_id")
    return ingest.normalized_pairs(rows, "task", "response_text", final="corrected_response", score="rating", status="status", source="traces", minimum=3).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("output")).alias("chars"))


@query
def seed_validation(spark: SparkSession, folder: str) -> DataFrame:
    found = review.validate_seeds(S.mix_seeds(spark, folder))
    return found.select("id", "status", "score", F.array_join("warnings", "; ").alias("warnings"))


@query
def validation_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return review.validate_seeds(S.mix_seeds(spark, folder)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def near_dup_edges(spark: SparkSession, folder: str) -> DataFrame:
    return growth.duplicate_edges(S.mix_seeds(spark, folder)).select("i", "j", "rule", "score")


@query
def near_dup_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return growth.deduplicated(S.mix_seeds(spark, folder))


@query
def conflict_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return growth.conflicts(S.mix_seeds(spark, folder))


@query
def conflict_summary(spark: SparkSession, folder: str) -> DataFrame:
    return growth.conflict_counts(S.mix_seeds(spark, folder))


def _decisions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    seeds = S.mix_seeds(spark, folder).persist(StorageLevel.MEMORY_AND_DISK)  # keywords are worked out once
    kept = growth.deduplicated(seeds)
    conflicted = growth.conflict_counts(seeds)
    return seeds, growth.seed_decisions(review.validate_seeds(seeds), kept, conflicted)


@query
def seed_review_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _decisions(spark, folder)[1]


def _clusters(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    seeds = S.mix_seeds(spark, folder)
    return seeds, growth.cluster(seeds)


@query
def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder)[1]


@query
def cluster_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return growth.cluster_summary(*_clusters(spark, folder))


@query
def growth_plan_actions(spark: SparkSession, folder: str) -> DataFrame:
    return growth.cluster_actions(growth.cluster_summary(*_clusters(spark, folder)))


@query
def plan_memory_records(spark: SparkSession, folder: str) -> DataFrame:
    seeds, assigned = _clusters(spark, folder)
    summary = growth.cluster_summary(seeds, assigned)
    return growth.planned_memory(growth.cluster_actions(summary), summary, growth.cluster_keywords(seeds, assigned))


@query
def bench_report(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.run_report(S.run_results(spark, folder))


@query
def run_compare(spark: SparkSession, folder: str) -> DataFrame:
    results = S.run_results(spark, folder)
    return benchmark.compare_runs(results.where("run_id = 'static-local'"), results.where("run_id = 'lora-small'"), 0.02)


@query
def gate_decision(spark: SparkSession, folder: str) -> DataFrame:
    results = S.run_results(spark, folder)
    return benchmark.gate(benchmark.compare_runs(results.where("run_id = 'static-local'"), results.where("run_id = 'lora-small'"), 0.02), 0.0, 0.01)


@query
def best_config_per_case(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.best_per_case(S.run_results(spark, folder))


@query
def score_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.score_pivot(S.run_results(spark, folder), ["lora-small", "plugin-demo", "static-local"]).select("case_id", F.col("lora-small").alias("lora"), F.col("plugin-demo").alias("plugin"), F.col("static-local").alias("static"))


@query
def heuristic_eval(spark: SparkSession, folder: str) -> DataFrame:
    cases = spark.createDataFrame([("general_task", ["the"], ["cannot"], None), ("baseline_check", ["the", "a"], ["sorry"], "the"), ("training_example_review", [], ["null"], None)], "case_id string, required array<string>, forbidden array<string>, opening string")
    rows = S.traces(spark, folder).select(F.col("template_name").alias("case_id"), F.col("trace_id").alias("id"), F.col("response_text").alias("text"))
    return benchmark.check_responses(rows, cases)


@query
def trace_review_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    reviews = S.reviews(spark, folder).select("review_id", F.lower(F.trim("trace_id")).alias("trace_id"))
    return training.join_reviews(S.traces(spark, folder), reviews)


@query
def latest_reviews(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.reviews(spark, folder).select(F.lower(F.trim("trace_id")).alias("trace_id"), F.lower(F.trim("reviewer")).alias("reviewer"), T.utc_time(F.col("created_at")).alias("created_at"), "review_id", F.lower(F.trim("status")).alias("status"))
    return review.last_per_key(rows, ["trace_id", "reviewer"], ["created_at", "review_id"]).select("trace_id", "reviewer", "review_id", "status")


@query
def inference_review_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.reviews(spark, folder).select(F.lower(F.trim("status")).alias("status"), "rating")
    every = spark.createDataFrame([(s,) for s in ("accepted", "corrected", "needs_correction", "not_reviewed", "rejected", "unsafe")], "status string")
    counted = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 6).alias("mean_rating"))
    return every.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), "mean_rating")


@query
def review_flag_counts(spark: SparkSession, folder: str) -> DataFrame:
    return training.count_many(S.reviews(spark, folder), "quality_flags")


@query
def training_export(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.table(spark, folder, "training_examples").where("validation_status in ('validated', 'reviewed', 'synthetic_demo')")
    return training.native_json(rows, ["instruction", "input", "output", "source"])


@query
def manifest_domain_counts(spark: SparkSession, folder: str) -> DataFrame:
    return training.count_many(S.table(spark, folder, "training_examples"), "domains")


@query
def license_counts(spark: SparkSession, folder: str) -> DataFrame:
    return training.count_one(S.table(spark, folder, "training_examples"), "license")


@query
def provenance_summary(spark: SparkSession, folder: str) -> DataFrame:
    return training.provenance_summary(S.table(spark, folder, "training_examples"))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.table(spark, folder, "training_examples").select(F.col("example_id").alias("id"), F.get("domains", 0).alias("stratum"))
    return training.stratified_split(rows)


@query
def split_assign(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder)


@query
def stratified_split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).groupBy("stratum").pivot("split", list(training.SPLITS)).agg(F.count(F.lit(1))).na.fill(0)


@query
def mix_repeat_union(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.table(spark, folder, "mix_rows").select("row_id", "source")
    mixed = training.mixed_by_repeats({"corrections": (rows.where("source like 'data/corrections%'"), 8), "local": (rows.where("source like 'data/%' and source not like 'data/corrections%'"), 3), "other": (rows.where("coalesce(source, '') not like 'data/%'"), 1)})
    return mixed.select("row_id", "source_name", "copy")


@query
def trace_id_hash(spark: SparkSession, folder: str) -> DataFrame:
    return training.trace_ids(S.traces(spark, folder), ["task", "template_name", "response_text"]).select("trace_id", "stable_id")


@query
def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.traces(spark, folder)
    return rows.select("trace_id", training.rendered(rows, "Task: {task}\nRoute: {routing_summary}", ["task", "routing_summary"]).alias("prompt"))


@query
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.table(spark, folder, "events")
    each = rows.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 8).alias("mean_value"))
    return each.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


@query
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.table(spark, folder, "events")
    each = rows.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return each.select(F.col("w.start").alias("start"), "user_id", "n")


@query
def orchestrate(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of traces to modules, each selected module's handler applied, results put together."""
    tasks = S.trace_tasks(spark, folder)
    routes = routing.route(tasks, routing.module_table(spark))
    done = handlers.handled(routes, tasks, {"code-assistant": lambda t: F.concat(F.lit("code: "), T.shortened(t, 40)), "document-search": lambda t: F.concat(F.lit("search: "), F.array_join(T.top_keywords(t, 3), " "))}, lambda t: F.lit("reason"))
    return handlers.combined(done).select("task_id", F.array_join("modules", ",").alias("modules"), "text")


@query
def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.table(spark, folder, "training_examples")
    return training.manifest(rows, rows.select(F.lower(F.trim("split_name")).alias("split")))


@query
def memory_search_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Best documents for each manifest, by its name and description."""
    tasks = S.table(spark, folder, "dataset_manifests").select(F.col("name").alias("task_id"), F.concat_ws(" ", "name", "description").alias("task"))
    memory = S.table(spark, folder, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("content"), F.array().cast("array<string>").alias("domains"), F.array().cast("array<string>").alias("keywords"), "source")
    return retrieval.search_memory(tasks, memory, 5).select("task_id", "record_id", "score", "relevance", "rank")
