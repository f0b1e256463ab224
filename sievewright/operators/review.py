"""Quality review of samples, exact duplicates, promotion of accepted samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import lexicon as L
from sievewright.functions import text as T


def content_hash(text: Column) -> Column:
    """SHA-256 of squashed lower-case text."""
    return F.sha2(F.lower(T.squashed(text)), 256)


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """(id, content_hash, first_id, is_duplicate) of rows (id, text) in order of id.

    The first row of each hash is found by a pre-aggregated minimum and joined back, so that copies of one text are
    never gathered in one task.  Null text counts as empty; empty texts are copies of each other.
    """
    hashed = rows.select("id", content_hash(F.col("text")).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min("id").alias("first_id"))
    return hashed.join(first, "content_hash").select("id", "content_hash", "first_id", (F.col("id") != F.col("first_id")).alias("is_duplicate"))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(first_id, copies) of texts that occur more than once."""
    return exact_duplicates(rows).groupBy("first_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def review(
    samples: DataFrame,
    markers: Sequence[str] = L.SUSPICIOUS_MARKERS,
    min_text: int = 40,
    min_instruction: int = 8,
    min_output: int = 12,
    expected_domains: Sequence[str] = (),
    threshold: float = 0.62,
    deduplicate: bool = True,
) -> DataFrame:
    """Decision, score and reasons for each sample (id, content, sample_type, domains, keywords, reliability, licensed).

    In this order: empty, unlicensed, repeated, then scored; a sample fails for hard reasons (too short, no or short
    answer), goes to a person below the threshold or with a suspicious marker, and is accepted otherwise.  Optional
    columns ``instruction`` and ``output`` stand for the blocks of the content.  Null content is empty, null lists are
    empty, null reliability counts 0, null licensed is false.  Of repeated samples the one with the smallest id counts.
    """
    text = T.squashed(F.col("content"))
    have = set(samples.columns)
    block = lambda name, *prefixes: T.squashed(F.col(name)) if name in have else F.coalesce(*[F.nullif(T.prefixed_block(F.col("content"), p), F.lit("")) for p in prefixes], F.lit(""))
    rows = samples.select(
        "id", "sample_type", text.alias("text"), content_hash(F.col("content")).alias("content_hash"), F.coalesce("licensed", F.lit(False)).alias("licensed"),
        F.coalesce("domains", F.array().cast("array<string>")).alias("domains"), F.size(F.coalesce("keywords", F.array().cast("array<string>"))).alias("n_keywords"),
        F.coalesce("reliability", F.lit(0.0)).alias("reliability"), block("instruction", "Instruction:").alias("instruction"), block("output", "Output:", "assistant:").alias("output"),
    )
    if deduplicate:
        first = rows.where("text <> '' and licensed").groupBy("content_hash").agg(F.min("id").alias("first_id"))
        rows = rows.join(first, "content_hash", "left")
    else:
        rows = rows.withColumn("first_id", F.col("id"))
    lowered = F.lower("text")
    found = F.filter(F.array(*[F.when(F.contains(lowered, F.lit(m)), F.lit(m)) for m in markers]), lambda m: m.isNotNull()) if markers else F.array().cast("array<string>")
    answers = F.col("sample_type").isin(*L.ANSWER_TYPES)
    rows = rows.withColumn("found", found).withColumn("repetitive", T.is_repetitive(F.col("text")))
    checks: list[tuple[Column, Column, float]] = [
        (F.length("text") < min_text, F.lit("content is too short"), 0.45),
        ((F.col("instruction") != "") & (F.length("instruction") < min_instruction), F.lit("instruction is too short"), 0.2),
        (answers & (F.col("output") == ""), F.lit("output or assistant answer is missing"), 0.55),
        (answers & (F.col("output") != "") & (F.length("output") < min_output), F.lit("output is too short"), 0.35),
    ]
    if expected_domains:
        checks.append((~F.arrays_overlap("domains", T.words(expected_domains)), F.lit("sample domains do not match expected domains"), 0.25))
    checks += [(F.col("repetitive"), F.lit("content has low information density"), 0.25), (F.size("found") > 0, F.concat(F.lit("suspicious marker detected: "), F.array_join("found", ", ")), 0.25)]
    penalty = sum((F.when(c, p).otherwise(0.0) for c, _, p in checks), F.lit(0.0))
    reasons = F.filter(F.array(*[F.when(c, r) for c, r, _ in checks]), lambda r: r.isNotNull())
    base = F.least(F.length("text") / 240, F.lit(1.0)) * 0.35 + F.when(F.size("domains") > 0, 1.0).otherwise(0.25) * 0.2 + F.least(F.col("n_keywords") / 5, F.lit(1.0)) * 0.2 + F.col("reliability") * 0.25
    rows = rows.withColumn("score", T.clamped(base - penalty)).withColumn("reasons", reasons)
    hard = checks[0][0] | checks[2][0] | checks[3][0]
    decision = (
        F.when(F.col("text") == "", "rejected_empty").when(~F.col("licensed"), "rejected_license").when(F.col("id") != F.col("first_id"), "rejected_duplicate")
        .when(hard, "rejected_too_short").when((F.col("score") < threshold) | (F.size("found") > 0), "needs_human_review").otherwise("accepted")
    )
    rows = rows.withColumn("decision", decision)
    early = F.create_map(*[F.lit(x) for x in ("rejected_empty", "content is empty", "rejected_license", "license is not allowed for review promotion", "rejected_duplicate", "duplicate normalized content")])
    quick = early[F.col("decision")]
    told = F.when(quick.isNotNull(), F.array(quick)).when(F.col("decision") == "accepted", F.array_append("reasons", F.lit("sample passed deterministic review checks"))).when(F.size("reasons") == 0, F.array(F.lit("quality score is below human review threshold"))).otherwise(F.col("reasons"))
    return rows.select("id", "decision", (F.col("decision") == "accepted").alias("accepted"), F.when(quick.isNotNull(), 0.0).otherwise(F.col("score")).alias("score"), told.alias("reasons"), "content_hash")


def review_report(reviews: DataFrame) -> DataFrame:
    """(decision, n, mean_score) of each decision that occurs."""
    return reviews.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 3).alias("mean_score"))


def reason_counts(reviews: DataFrame) -> DataFrame:
    """(reason, n) over all reviews."""
    return reviews.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def accepted_samples(samples: DataFrame, reviews: DataFrame) -> DataFrame:
    """Samples with an accepted review."""
    return samples.join(reviews.where("accepted").select("id"), "id", "left_semi")


def accepted_seeds(samples: DataFrame, reviews: DataFrame) -> DataFrame:
    """Accepted samples as seeds, with the smaller of reliability and review score as confidence; the last review of an id counts."""
    last = reviews.where("accepted").groupBy("id").agg(F.max_by("score", F.struct("score", "content_hash")).alias("__score"))
    return samples.join(last, "id").withColumn("confidence", F.least(F.coalesce("reliability", F.lit(0.0)), "__score")).drop("__score")


def validate_seeds(seeds: DataFrame, min_chars: int = 40, weak: float = 0.7, quarantine: float = 0.35) -> DataFrame:
    """(id, status, score, warnings) of seeds (id, content, domains, keywords, confidence, reliability, source_type).

    Score: reliability and confidence 0.35 each, length 0.15, domains and keywords 0.075 each, three digits.  Null lists
    are empty, null numbers 0, null source type is unknown.
    """
    none = F.array().cast("array<string>")
    rows = seeds.select(
        "id", T.squashed(F.col("content")).alias("text"), F.size(F.coalesce("domains", none)).alias("nd"), F.size(F.coalesce("keywords", none)).alias("nk"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("reliability", F.lit(0.0)).alias("reliability"), F.coalesce("source_type", F.lit("unknown")).alias("source_type"),
    )
    raw = F.col("reliability") * 0.35 + F.col("confidence") * 0.35 + F.least(F.length("text") / max(min_chars * 2, 1), F.lit(1.0)) * 0.15 + F.when(F.col("nd") > 0, 1.0).otherwise(0.0) * 0.075 + F.least(F.col("nk") / 4, F.lit(1.0)) * 0.075
    generic = T.is_generic(F.col("text"))
    rows = rows.withColumn("score", F.when(F.col("text") == "", 0.0).otherwise(T.rounded(T.clamped(raw), 3))).withColumn("generic", generic)
    warn = [
        (F.length("text") < min_chars, "content is short"), (F.col("reliability") < 0.5, "source reliability is low"), (F.col("confidence") < 0.4, "seed confidence is low"),
        (F.col("nd") == 0, "domains are missing"), (F.col("nk") == 0, "keywords are missing"), (F.col("source_type") == "unknown", "source type is unknown"), (F.col("generic"), "content looks generic"),
    ]
    warnings = F.filter(F.array(*[F.when(c, F.lit(w)) for c, w in warn]), lambda w: w.isNotNull())
    rows = rows.withColumn("warnings", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(warnings))
    status = (
        F.when((F.col("text") == "") | (F.col("reliability") <= 0.05), "rejected").when((F.col("confidence") < 0.25) | (F.col("score") < quarantine) | F.col("generic"), "quarantined")
        .when((F.col("score") < weak) | (F.size("warnings") > 0), "weak").otherwise("validated")
    )
    return rows.select("id", status.alias("status"), "score", "warnings")


def last_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by an order, as an upserted store would hold it; equal rows count once, nulls come first.

    Pre-aggregated, so that a key with very many rows is one row per task before the shuffle.
    """
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__last"))
    return last.select("__last.*")
