"""Keyword memory: search by shared terms, and context assembled from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text as T


def memory_index(memory: DataFrame) -> DataFrame:
    """Inverted index (term, role, record_id, weight) of memory (record_id, content, domains, keywords).

    Keyword terms weigh 1.5, content terms that are no keywords 0.5, domain terms 2; all keyword and content terms
    answer capabilities with 1.  Null columns have no terms.
    """
    listed = memory.select("record_id", T.terms(F.col("content")).alias("content"), T.terms_of(F.col("domains")).alias("domain"), T.terms_of(F.col("keywords")).alias("keyword"))
    entry = lambda column, role, weight: listed.select("record_id", F.explode(column).alias("term"), F.lit(role).alias("role"), F.lit(weight).alias("weight"))
    return (
        entry("keyword", "task", 1.5)
        .unionByName(entry(F.array_except("content", "keyword"), "task", 0.5))
        .unionByName(entry("domain", "domain", 2.0))
        .unionByName(entry(F.array_union("keyword", "content"), "capability", 1.0))
    )


def search_memory(tasks: DataFrame, memory: DataFrame, limit: int = 3, name: str = "memory") -> DataFrame:
    """Best records per task: (task_id, record_id, score, relevance, rank).

    ``tasks``: task_id, task, and optionally domains and capabilities (arrays).  Only pairs that share a term meet; the
    join is on the term, its partial sums are combined before the shuffle.  Relevance is the score over the best score
    of the task among all records, 4 digits; order is by score, then source, then record.  Null source counts as empty.
    """
    have = set(tasks.columns)
    none = F.array().cast("array<string>")
    roles = [("task", T.terms(F.col("task"))), ("domain", T.terms_of(F.col("domains")) if "domains" in have else none), ("capability", T.terms_of(F.col("capabilities")) if "capabilities" in have else none)]
    asked = None
    for role, listed in roles:
        part = tasks.select("task_id", F.explode(listed).alias("term"), F.lit(role).alias("role"))
        asked = part if asked is None else asked.unionByName(part)
    source = F.coalesce("source", F.lit("")) if "source" in memory.columns else F.lit("")
    hits = asked.join(memory_index(memory), ["term", "role"]).groupBy("task_id", "record_id").agg(F.sum("weight").alias("score"))
    hits = hits.join(memory.select("record_id", source.alias("source")), "record_id")
    order = Window.partitionBy("task_id").orderBy(F.desc("score"), "source", "record_id")
    # The limit comes first: it is applied before the shuffle, and the best score is among what it keeps.
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    ranked = ranked.withColumn("best", F.max("score").over(Window.partitionBy("task_id")))
    return ranked.select("task_id", "record_id", "source", "score", F.round(F.col("score") / F.col("best"), 4).alias("relevance"), "rank", F.lit(name).alias("memory"))


def build_context(routes: DataFrame, found: DataFrame, memory: DataFrame, memory_limit: int = 2, limit: int = 5) -> DataFrame:
    """Context of each routed task: (task_id, position, source, content, relevance).

    First one item per selected module (relevance: score over the task's best selected score), then memory items by
    relevance, source and content; repeats of (source, content) are left out; at most ``limit`` items.
    """
    chosen = routes.where("selected")
    best = F.max("score").over(Window.partitionBy("task_id"))
    own = chosen.select("task_id", F.lit(0).alias("part"), F.concat(F.lit("module:"), "module").alias("source"), F.concat(F.lit("route-scoped context of "), "module").alias("content"), F.round(F.when(best > 0, F.col("score") / best).otherwise(F.col("score")), 4).alias("relevance"), F.col("rank").alias("place"))
    held = found.join(memory.select("record_id", "content"), "record_id").join(chosen.select("task_id").distinct(), "task_id", "left_semi")
    held = held.select("task_id", F.lit(1).alias("part"), F.concat_ws(":", F.lit("memory"), "memory", "source", F.col("record_id").cast("string")).alias("source"), "content", "relevance")
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("relevance"), "source", "content"))).where(F.col("place") <= memory_limit)
    both = own.unionByName(held)
    first = F.row_number().over(Window.partitionBy("task_id", "source", "content").orderBy("part", "place"))
    once = both.withColumn("copy", first).where("copy = 1")
    position = F.row_number().over(Window.partitionBy("task_id").orderBy("part", "place"))
    return once.withColumn("position", position).where(F.col("position") <= limit).select("task_id", "position", "source", "content", "relevance")


def relevant_memories(routes: DataFrame, memories: DataFrame, modules: DataFrame) -> DataFrame:
    """(task_id, memory) of memories (memory, domains) that share a term with the domains and capabilities of a task's selected modules.

    A memory without domains is relevant to every routed task.  Both catalogues are small, so each module is matched with each
    memory once and routes are joined with the matches by module.
    """
    listed = memories.select("memory", T.terms_of(F.col("domains")).alias("own"), (F.size(F.coalesce("domains", F.array().cast("array<string>"))) == 0).alias("always"))
    terms = modules.select("module", F.explode(F.array_union(T.terms_of(F.array("domain")), T.terms_of(F.col("capabilities")))).alias("term"))
    matched = terms.join(listed.select("memory", F.explode("own").alias("term")), "term").select("module", "memory").distinct()
    chosen = routes.where("selected").select("task_id", "module")
    always = chosen.select("task_id").distinct().withColumn("one", F.lit(1)).join(F.broadcast(listed.where("always").select("memory", F.lit(1).alias("one"))), "one").select("task_id", "memory")
    return chosen.join(F.broadcast(matched), "module").select("task_id", "memory").unionByName(always).distinct()


def context_summary(context: DataFrame) -> DataFrame:
    """(task_id, stub, memory, confidence): context items by kind of source, and 0.55 plus 0.08 for each, 0.95 at most, four digits."""
    from_memory = F.startswith("source", F.lit("memory:"))
    each = context.groupBy("task_id").agg(F.count_if(~from_memory).alias("stub"), F.count_if(from_memory).alias("memory"))
    return each.withColumn("confidence", F.round(F.least(F.lit(0.95), F.lit(0.55) + F.lit(0.08) * (F.col("stub") + F.col("memory"))), 4))


def context_details(context: DataFrame, topic: str, limit: int = 2) -> DataFrame:
    """(task_id, details): a line for each of the most relevant context items, ties by source."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "source", "content"))), 1, limit)
    line = lambda s: F.concat(F.lit(f"Use {topic} context from "), s["source"], F.lit(": "), T.shortened(s["content"]))
    return context.groupBy("task_id").agg(F.transform(best, line).alias("details"))
