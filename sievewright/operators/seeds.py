"""Knowledge seeds from chunks, tool results, proposals and ingested samples.

Seeds have id, content, domains, keywords, confidence, reliability, source, source_type, origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import text as T

COLUMNS = ("id", "content", "domains", "keywords", "confidence", "reliability", "source", "source_type", "origin")


def _seeds(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*[columns[c].alias(c) for c in COLUMNS])


def from_chunks(chunks: DataFrame, reliability: float = 0.5, confidence: float | None = None) -> DataFrame:
    """Seeds of tagged chunks (chunk_id, content, domains, keywords, doc_id); the source's reliability is the confidence unless one is given."""
    sure = F.lit(reliability if confidence is None else confidence)
    return _seeds(
        chunks, id=F.concat(F.lit("seed:"), "chunk_id"), content=F.col("content"), domains=F.col("domains"), keywords=F.col("keywords"), confidence=sure, reliability=F.lit(reliability),
        source=F.concat(F.lit("document:"), F.col("doc_id").cast("string")), source_type=F.lit("document"), origin=F.lit("document_chunk"),
    )


def from_tool_results(results: DataFrame, reliability: float = 0.5, confidence: float | None = None) -> DataFrame:
    """Seeds of tool results (tool_name, output, details, domain); without a confidence the reliability counts, at most 0.75.

    Content is output and details.  Domains are the named one, else those of the words of name, output and details.  Null
    output and details are empty.
    """
    none = F.array().cast("array<string>")
    content = F.trim(F.array_join(F.concat(F.array(T.text_or_empty(F.col("output"))), F.coalesce("details", none)), " "))
    named = F.when(T.text_or_empty(F.col("domain")) != "", F.array("domain"))
    sure = F.lit(min(reliability, 0.75) if confidence is None else confidence)
    return _seeds(
        results, id=F.concat(F.lit("seed:tool:"), "tool_name"), content=content, domains=F.coalesce(named, T.domains_of(T.terms(F.concat_ws(" ", F.col("tool_name"), content)))), keywords=T.top_keywords(content),
        confidence=sure, reliability=F.lit(reliability), source=F.concat(F.lit("tool:"), "tool_name"), source_type=F.lit("tool"), origin=F.lit("tool_result"),
    )


def from_proposals(proposals: DataFrame, reliability: float = 0.45, strict: bool = True) -> DataFrame:
    """Seeds of proposals (source, task, proposal_type, content, confidence) of the type knowledge_seed.

    Another type is an error; with ``strict`` off it is left out.  Null confidence is the reliability.
    """
    if strict:
        right = F.col("proposal_type") == "knowledge_seed"
        proposals = proposals.withColumn("content", F.when(F.coalesce(right, F.lit(False)), F.col("content")).otherwise(F.raise_error(F.lit("only proposals of the type knowledge_seed become seeds")).cast("string")))
    else:
        proposals = proposals.where("proposal_type = 'knowledge_seed'")
    content = T.text_or_empty(F.col("content"))
    return _seeds(
        proposals, id=F.concat(F.lit("seed:donor:"), T.slug(F.col("source")), F.lit(":"), F.substring(T.slug(F.col("task")), 1, 48)), content=content, domains=T.domains_of(T.terms(content)), keywords=T.top_keywords(content),
        confidence=F.coalesce(F.col("confidence").cast("double"), F.lit(reliability)), reliability=F.lit(reliability), source=F.concat(F.lit("source:donor:"), T.slug(F.col("source"))), source_type=F.lit("donor_model"), origin=F.lit("donor_model_proposal"),
    )


def from_samples(samples: DataFrame) -> DataFrame:
    """Seeds of ingested samples (id, content, domains, keywords, reliability, source)."""
    return _seeds(
        samples, id=F.concat(F.lit("seed:"), "id"), content=F.col("content"), domains=F.col("domains"), keywords=F.col("keywords"), confidence=F.col("reliability"), reliability=F.col("reliability"), source=F.col("source"),
        source_type=F.lit("dataset"), origin=F.lit("dataset_sample"),
    )
