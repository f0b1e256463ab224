"""Training examples from seeds, feedback, benchmark results and reviewed traces, and the package made of them.

Examples have instruction, input, output, source, domains, capabilities, provenance (map), license, validation_status.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import lexicon as L
from sievewright.functions import text as T
from sievewright.operators import training

#: Statuses that examples are exported with, unless others are asked for.
EXPORTED = ("validated", "reviewed", "synthetic_demo")


def _map(**columns: Column) -> Column:
    """Map of strings; lists joined by a comma."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in sorted(columns)]), F.array(*[columns[k].cast("string") for k in sorted(columns)]))


def license_of(*metadata: Column, default: str = "unknown") -> Column:
    """The first license or license_name that is not empty, over JSON texts in order."""
    found = [F.nullif(F.get_json_object(m, f"$.{k}"), F.lit("")) for m in metadata for k in ("license", "license_name")]
    return F.coalesce(*found, F.lit(default))


def status_of_seed(status: Column) -> Column:
    return F.when(status.isin("validated", "promoted"), "validated").when(status == "rejected", "rejected").otherwise("raw")


def status_of_decision(decision: Column) -> Column:
    return F.when(decision == "promote_candidate", "validated").when(decision == "needs_review", "reviewed").when(decision == "reject_broken", "rejected").otherwise("raw")


def is_positive(success: Column, rating: Column) -> Column:
    """Success is true, and the rating 4 or more if there is one."""
    return F.coalesce(success & (rating.isNull() | (rating >= 4)), F.lit(False))


def exported(examples: DataFrame, statuses: Sequence[str] = EXPORTED) -> DataFrame:
    return examples.where(F.col("validation_status").isin(*statuses))


def from_seeds(seeds: DataFrame, statuses: Sequence[str] = EXPORTED) -> DataFrame:
    """Examples (and seed_id) of seeds (id, content, source, source_type, domains, reliability, confidence, status, metadata JSON)."""
    return exported(_of_seeds(seeds, status_of_seed(F.col("status"))), statuses)


def _of_seeds(seeds: DataFrame, status: Column, *more: Column) -> DataFrame:
    provenance = _map(origin=F.lit("knowledge_seed"), seed_id=F.col("id"), source_name=F.col("source"), source_type=F.col("source_type"), source_reliability=F.col("reliability"), seed_confidence=F.col("confidence"))
    return seeds.select(
        F.col("id").alias("seed_id"), F.lit(L.EXAMPLE_INSTRUCTIONS["knowledge_seed"]).alias("instruction"), F.lit("").alias("input"), F.col("content").alias("output"), "source", "domains", T.words(("knowledge_recall",)).alias("capabilities"),
        provenance.alias("provenance"), license_of(F.col("metadata")).alias("license"), status.alias("validation_status"), *more,
    )


def from_review_decisions(seeds: DataFrame, decisions: DataFrame, statuses: Sequence[str] = EXPORTED) -> DataFrame:
    """Examples of the seeds that decisions (id, decision, score) are about, with the status that follows and the review in metadata; inner join."""
    rows = seeds.join(decisions.select("id", "decision", "score"), "id")
    told = _map(review_decision=F.col("decision"), validation_score=F.col("score")).alias("metadata")
    return exported(_of_seeds(rows, status_of_decision(F.col("decision")), told), statuses)


def from_feedback(feedback: DataFrame, statuses: Sequence[str] = EXPORTED) -> DataFrame:
    """Examples of feedback (task, route_summary, rating, success, selected_modules, metadata JSON); only positive feedback is reviewed."""
    rows = feedback.select(
        F.lit(L.EXAMPLE_INSTRUCTIONS["feedback_record"]).alias("instruction"), F.col("task").alias("input"), F.col("route_summary").alias("output"), F.lit("feedback").alias("source"), F.array().cast("array<string>").alias("domains"),
        T.words(("routing", "feedback_analysis")).alias("capabilities"), _map(origin=F.lit("feedback_record"), selected_modules=F.array_join("selected_modules", ",")).alias("provenance"), license_of(F.col("metadata")).alias("license"),
        F.when(is_positive(F.col("success"), F.col("rating")), "reviewed").otherwise("raw").alias("validation_status"),
    )
    return exported(rows, statuses)


def from_results(cases: DataFrame, results: DataFrame, statuses: Sequence[str] = EXPORTED) -> DataFrame:
    """Examples of benchmark results (run_id, case_id, scores) with their cases; the output tells the scores."""
    rows = results.join(cases.select("case_id", "task", "expected_domains"), "case_id")
    told = F.concat(F.lit("overall="), F.col("overall").cast("string"), F.lit(", routing="), F.col("routing").cast("string"), F.lit(", context="), F.col("context").cast("string"))
    rows = rows.select(
        F.lit(L.EXAMPLE_INSTRUCTIONS["benchmark_result"]).alias("instruction"), F.col("task").alias("input"), told.alias("output"), F.lit("benchmark").alias("source"), F.col("expected_domains").alias("domains"),
        T.words(("routing", "benchmark_trace")).alias("capabilities"), _map(origin=F.lit("benchmark_result"), case_id=F.col("case_id"), config_name=F.col("run_id")).alias("provenance"), F.lit("synthetic-demo").alias("license"),
        F.lit("synthetic_demo").alias("validation_status"),
    )
    return exported(rows, statuses)


def reviewed_traces(traces: DataFrame, reviews: DataFrame) -> DataFrame:
    """(trace_id, review_id, created, reason, and an example's columns) of all pairs of a trace and its review, of traces without and reviews without.

    A corrected review gives its corrected response, an accepted one the trace's; other statuses, and those whose text is
    missing, give none.  Without an example its columns are null.
    """
    mine = [c for c in ("task", "template_name", "user_prompt", "response_text", "routing_summary", "context_sources", "selected_modules", "adapter_name", "model")]
    left = traces.select("trace_id", F.lit(True).alias("traced"), *mine)
    right = reviews.select(F.col("trace_id"), "review_id", "status", "corrected_response")
    both = left.join(right, "trace_id", "full_outer")
    text = F.when(F.col("status") == "corrected", F.nullif("corrected_response", F.lit(""))).when(F.col("status") == "accepted", F.nullif("response_text", F.lit("")))
    reason = (
        F.when(F.col("review_id").isNull(), "matching inference review was not found").when(F.col("traced").isNull(), "matching inference trace was not found")
        .when((F.col("status") == "corrected") & text.isNotNull(), "corrected review used corrected_response").when(F.col("status") == "corrected", "corrected review is missing corrected_response")
        .when((F.col("status") == "accepted") & text.isNotNull(), "accepted review used original trace response").when(F.col("status") == "accepted", "accepted trace is missing response_text")
        .otherwise(F.concat(F.lit("review status "), F.coalesce("status", F.lit("None")), F.lit(" is not an output source")))
    )
    created = F.col("traced").isNotNull() & F.col("review_id").isNotNull() & text.isNotNull()
    sources = F.when(F.size(F.coalesce("context_sources", F.array().cast("array<string>"))) > 0, F.array_join("context_sources", ", ")).otherwise("none")
    prompt = F.concat_ws("\n", T.text_or_empty(F.col("user_prompt")), F.lit(""), F.concat(F.lit("Prompt template: "), T.text_or_empty(F.col("template_name"))), F.concat(F.lit("Context sources: "), sources), F.concat(F.lit("Routing summary: "), F.nullif("routing_summary", F.lit(""))))
    provenance = _map(adapter_name=F.col("adapter_name"), context_sources=F.array_join("context_sources", ","), model=F.col("model"), origin=F.lit("reviewed_inference_trace"), prompt_template_name=F.col("template_name"), review_id=F.col("review_id"), selected_modules=F.array_join("selected_modules", ","), trace_id=F.col("trace_id"))
    only = lambda c: F.when(created, c)
    return both.select(
        "trace_id", "review_id", created.alias("created"), reason.alias("reason"), only(F.coalesce(F.nullif("task", F.lit("")), "user_prompt")).alias("instruction"), only(F.trim(prompt)).alias("input"), only(text).alias("output"),
        only(F.lit("reviewed_inference_trace")).alias("source"), only(provenance).alias("provenance"), only(F.lit("reviewed")).alias("validation_status"),
    )


def package(examples: DataFrame, statuses: Sequence[str] = EXPORTED, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Splits (id, stratum, split) of the examples (id, domains, validation_status, source, license, provenance) to be exported, and their manifest (part, value, n)."""
    kept = exported(examples, statuses)
    splits = training.stratified_split(kept.select("id", F.get("domains", 0).alias("stratum")), ratios=ratios, seed=seed)
    return splits, training.manifest(kept, splits)


def package_warnings(examples: DataFrame, splits: DataFrame, minimum: int = 1) -> DataFrame:
    """(warning) of a package: no examples, statuses that are not exported, too few rows, and splits below the minimum."""
    status = examples.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("validation_status") == s).alias(s) for s in ("raw", "rejected")])
    skipped = [F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s} examples will be skipped by export policy."))) for s in ("raw", "rejected")]
    told = F.array(F.when(F.col("n") == 0, F.lit("No examples were provided.")), *skipped)
    first = status.select(F.explode(F.filter(told, lambda w: w.isNotNull())).alias("warning"))
    counted = splits.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in training.SPLITS])
    small = [F.when((F.col("n") > 0) & (F.col(s) < minimum), F.lit(f"Split {s} has fewer examples than min_examples_per_split.")) for s in training.SPLITS]
    few = F.when(F.col("n").between(1, 2), F.lit("Dataset is too small for all train/validation/test splits to be populated."))
    return first.unionByName(counted.select(F.explode(F.filter(F.array(few, *small), lambda w: w.isNotNull())).alias("warning")))


def first_of(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """(value, place): distinct values of a column over frames in order, each at the first frame that has it."""
    rows = None
    for at, frame in enumerate(frames):
        part = frame.select(F.col(column).alias("value"), F.lit(at).alias("place"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no frame")
    return rows.groupBy("value").agg(F.min("place").alias("place"))
