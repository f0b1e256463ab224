"""Near-duplicates, conflicts and clusters of knowledge seeds, and the plan that follows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import tiles
from sievewright.operators.lineage import checkpointed
from sievewright.operators.set_joins import canonical, overlap_pairs, within_bound


def normalized_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds (id, content, domains, keywords, reliability) with normalized text, tokens, keywords, domains and polarity; other columns are dropped."""
    kept = [c for c in ("id", "domains", "reliability") if c in seeds.columns]
    listed = seeds.select(*kept, T.normalized(F.col("content")).alias("norm"), T.normalized_list(F.col("keywords")).alias("kw"), T.normalized_list(F.col("domains")).alias("dom"))
    return listed.withColumn("tokens", F.array_distinct(F.filter(F.split("norm", " "), lambda t: t != ""))).withColumn("pol", T.polarity(F.col("norm")))


def _duplicate_links(seeds: DataFrame, keyword_threshold: float, text_threshold: float, short: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """ids (id); exact (i, j), with the first of each text; copies (id, rep, first), equal in text, keywords and domains to the earlier rep, and whether that is the first of its text; near (a, b, rule, score) between seeds that are no copies."""
    # Texts are compared by their digests; only short ones keep their words.
    digest = F.when(F.col("norm") != "", F.unhex(F.sha2("norm", 256)))
    rows = normalized_seeds(seeds).select("id", digest.alias("norm"), "kw", "dom", F.when(F.length("norm") <= short, F.col("tokens")).alias("tokens"), "pol").persist(StorageLevel.MEMORY_AND_DISK)
    repeated = rows.where("norm is not null").groupBy("norm").agg(F.min("id").alias("i"), F.count(F.lit(1)).alias("n")).where("n > 1").select("norm", "i")
    listed = F.unhex(F.sha2(F.to_json(F.struct(F.sort_array("kw").alias("k"), F.sort_array("dom").alias("d"))), 256))
    same = checkpointed(rows.join(within_bound(repeated), "norm").select("id", "i", listed.alias("listed")))
    exact = same.where("id <> i").select("i", F.col("id").alias("j"))
    classes = same.groupBy("i", "listed").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "listed", "rep")
    copies = checkpointed(same.join(within_bound(classes), ["i", "listed"]).where("id <> rep").select("id", "rep", (F.col("rep") == F.col("i")).alias("first")))
    reps = rows.join(within_bound(copies.select("id")), "id", "left_anti")
    pairs = lambda sets, threshold, rule, groups=None: overlap_pairs(sets, threshold, groups, carried=("pol", "norm")).withColumn("rule", F.lit(rule))
    near = pairs(reps.select("id", F.col("kw").alias("items"), "dom", "pol", "norm"), keyword_threshold, "keywords", "dom").unionByName(pairs(reps.where("tokens is not null").select("id", F.col("tokens").alias("items"), "pol", "norm"), text_threshold, "text"))
    opposite = (F.col("a_pol") != 0) & (F.col("b_pol") != 0) & (F.col("a_pol") != F.col("b_pol"))
    near = near.where(~opposite & (F.coalesce("a_norm", F.lit(b"")) != F.coalesce("b_norm", F.lit(b""))))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rule", F.round("shared", 3).alias("score"))
    near = near.groupBy("a", "b").agg(F.min_by(F.struct("rule", "score"), "rule").alias("x")).select("a", "b", "x.rule", "x.score")
    return rows.select("id"), exact, copies, near


def duplicate_edges(seeds: DataFrame, keyword_threshold: float = 0.8, text_threshold: float = 0.85, short: int = 140) -> DataFrame:
    """Edges (i, j, rule, score) between seeds of normalized equal text, or with overlapping keywords in a shared domain, or short and alike.

    ``rule`` is the first that holds: exact, keywords, text.  Seeds of opposite polarity only match exactly.  Of equal
    texts each is linked with the first only, which the greedy scan takes anyway.  Thresholds must be above 0.
    Copies are compared once and their edges expanded.
    """
    _, exact, copies, near = _duplicate_links(seeds, keyword_threshold, text_threshold, short)
    for c in ("a", "b"):
        # each as it is, and once for each copy of its end
        near = near.withColumn("rep", F.explode(F.array(F.lit(None), F.col(c)))).join(copies.select("rep", F.col("id").alias("copy")), "rep", "left").where("rep is null or copy is not null").withColumn(c, F.coalesce("copy", c)).drop("rep", "copy")
    near = near.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "rule", "score")
    return exact.select("i", "j", F.lit("exact").alias("rule"), F.lit(1.0).alias("score")).unionByName(near)


def deduplicated(seeds: DataFrame, keyword_threshold: float = 0.8, text_threshold: float = 0.85, short: int = 140) -> DataFrame:
    """(id, duplicate_of): canonical_seeds of duplicate_edges, without listing the edges of copies.

    Copies have the neighbours of the seed that they repeat, but for the first of their text, which all have: they stay
    or go as it does, and if it stays and is that first, repeat it.
    """
    ids, exact, copies, near = _duplicate_links(seeds, keyword_threshold, text_threshold, short)
    edges = checkpointed(exact.join(copies.select(F.col("id").alias("j")), "j", "left_anti").select("i", "j").unionByName(near.select(F.col("a").alias("i"), F.col("b").alias("j"))))
    found = checkpointed(canonical(edges, edges.select(F.col("j").alias("id")).distinct()).where("duplicate_of is not null"))
    more = copies.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("duplicate_of", F.when(F.col("first"), F.col("rep"))).alias("duplicate_of"))
    return ids.join(within_bound(found.unionByName(more)), "id", "left")


def canonical_seeds(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, duplicate_of) by a greedy scan in order of id."""
    return canonical(edges, seeds.select("id"))


def _opposed(seeds: DataFrame, keyword_threshold: float, text_threshold: float, counted: bool) -> DataFrame:
    if not (0 < keyword_threshold <= 1 and 0 < text_threshold <= 1):
        raise ValueError("thresholds must be in (0, 1]")
    rows = normalized_seeds(seeds).where("pol <> 0").select("id", "kw", "dom", "tokens", (F.col("pol") > 0).alias("left"), (F.coalesce("reliability", F.lit(0.0)) < 0.4).alias("weak"))
    return tiles.weighed(rows, keyword_threshold, text_threshold, 0.75, 0.65, counted)


def _severity() -> Column:
    return F.when(F.col("rank") == 1, "low").when(F.col("rank") == 2, "medium").otherwise("high")


def conflicts(seeds: DataFrame, keyword_threshold: float = 0.25, text_threshold: float = 0.25) -> DataFrame:
    """Pairs (left_id, right_id, severity, keyword_overlap, text_overlap) of seeds of opposite polarity that share a domain and overlap.

    Severity: low if the weaker source has a reliability below 0.4, high from 0.75 keyword or 0.65 text overlap on, else
    medium.  Only seeds with a polarity are weighed, positive against negative ones; thresholds must be above 0.
    """
    pairs = _opposed(seeds, keyword_threshold, text_threshold, False)
    return pairs.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), _severity().alias("severity"), "keyword_overlap", "text_overlap")


def conflict_counts(seeds: DataFrame, keyword_threshold: float = 0.25, text_threshold: float = 0.25) -> DataFrame:
    """conflict_summary of conflicts, counted without listing the pairs."""
    each = _opposed(seeds, keyword_threshold, text_threshold, True).groupBy("id").agg(F.sum("n").alias("conflicts"), F.max("rank").alias("rank"))
    return each.select("id", "conflicts", _severity().alias("severity"))


def conflict_summary(pairs: DataFrame) -> DataFrame:
    """(id, conflicts, severity) of both ends of conflicts; severity is the highest."""
    rank = F.create_map(*[x for i, s in enumerate(("none", "low", "medium", "high")) for x in (F.lit(s), F.lit(i))])
    both = pairs.select(F.col("left_id").alias("id"), "severity").unionByName(pairs.select(F.col("right_id").alias("id"), "severity"))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("conflicts"), F.max_by("severity", rank[F.col("severity")]).alias("severity"))


def seed_decisions(validations: DataFrame, duplicates: DataFrame, conflicted: DataFrame) -> DataFrame:
    """(id, decision): rejected before duplicate before conflict before weak before promoted."""
    rows = validations.join(duplicates.select("id", "duplicate_of"), "id", "left").join(conflicted.select("id", F.col("severity")), "id", "left")
    decision = (
        F.when(F.col("status") == "rejected", "reject_broken").when(F.col("duplicate_of").isNotNull(), "merge_duplicate")
        .when(F.col("severity").isin("medium", "high"), "quarantine_conflict").when(F.col("severity").isNotNull(), "needs_review")
        .when(F.col("status").isin("weak", "quarantined"), "quarantine_weak").otherwise("promote_candidate")
    )
    return rows.select("id", decision.alias("decision"), "score", "duplicate_of")


def cluster(seeds: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(id, domain, cluster_id, position, score) of seeds in order of id, clustered greedily within their primary domain.

    A seed joins the cluster with the largest keyword overlap if that reaches the threshold, the first of several, and
    else opens one; clusters grow by the keywords of their seeds.  The rule is sequential, so the seeds of a domain
    pass through one task in order; it streams them and keeps only the clusters' keywords, indexed by keyword.
    """
    rows = normalized_seeds(seeds).select(F.coalesce(F.get(T.normalized_list(F.col("domains")), 0), F.lit("general")).alias("domain"), "id", "kw")
    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domain, sizes, words, members = None, [], {}, []
        for batch in batches:
            out = []
            for d, i, kw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d != domain:
                    domain, sizes, words, members = d, [], {}, []
                own, hits = set(kw or ()), {}
                for w in own:
                    for c in words.get(w, ()):
                        hits[c] = hits.get(c, 0) + 1
                best, score = None, -1.0
                for c in sorted(hits):
                    s = hits[c] / min(len(own), sizes[c])
                    if s > score:
                        best, score = c, s
                if best is None and sizes and threshold <= 0:
                    best, score = 0, 0.0
                if best is None or score < threshold:
                    best, score = len(sizes), 1.0
                    sizes.append(0)
                    members.append(0)
                for w in own:
                    listed = words.setdefault(w, set())
                    if best not in listed:
                        listed.add(best)
                        sizes[best] += 1
                members[best] += 1
                out.append((i, d, best, members[best], score))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [batch.schema.field(1).type, pa.string(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "domain", "number", "position", "score"])

    kind = seeds.schema["id"].dataType.simpleString()
    placed = rows.repartition(parts, "domain").sortWithinPartitions("domain", "id").mapInArrow(run, f"id {kind}, domain string, number bigint, position int, score double")
    return placed.select("id", "domain", F.format_string("cluster:%s:%04d", T.slug(F.col("domain"), "general"), F.col("number") + 1).alias("cluster_id"), "position", "score")


def cluster_summary(seeds: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster_id, domain, seeds, confidence): mean quality, plus 0.05 per further seed up to 0.15, minus 0.05 for a single seed and 0.03 per weak one."""
    quality = T.rounded(T.clamped(F.coalesce("confidence", F.lit(0.0)) * 0.55 + F.coalesce("reliability", F.lit(0.0)) * 0.45), 3)
    rows = assigned.join(seeds.select("id", quality.alias("quality"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")), "id")
    each = rows.groupBy("cluster_id", "domain").agg(F.count(F.lit(1)).alias("seeds"), F.avg("quality").alias("q"), F.count_if(F.col("confidence") < 0.6).alias("weak"))
    value = F.col("q") + F.least((F.col("seeds") - 1) * 0.05, F.lit(0.15)) - F.when(F.col("seeds") == 1, 0.05).otherwise(0.0) - F.col("weak") * 0.03
    return each.select("cluster_id", "domain", "seeds", T.rounded(T.clamped(value), 3).alias("confidence"))


def cluster_keywords(seeds: DataFrame, assigned: DataFrame, limit: int = 12) -> DataFrame:
    """(cluster_id, rank, keyword, n): keywords of a cluster's seeds by count, then name."""
    rows = assigned.select("id", "cluster_id").join(normalized_seeds(seeds).select("id", "kw"), "id")
    each = rows.select("cluster_id", F.explode("kw").alias("keyword")).groupBy("cluster_id", "keyword").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "keyword"))
    return each.withColumn("rank", rank).where(F.col("rank") <= limit).select("cluster_id", "rank", "keyword", "n")


def cluster_actions(clusters: DataFrame, min_confidence: float = 0.6, min_seeds: int = 3) -> DataFrame:
    """(cluster_id, action, confidence): a cluster below the confidence is marked for review, another one gives one row per step it is ready for."""
    review = F.col("confidence") < min_confidence
    step = lambda when, name: F.when(when, F.lit(name))
    ready = F.array(step(~review, "create_candidate_cluster"), step(~review & (F.col("seeds") >= 2), "strengthen_cluster"), step(~review, "create_memory_record"), step(~review & (F.col("seeds") >= min_seeds), "suggest_expert_candidate"), step(review, "mark_cluster_needs_review"))
    rows = clusters.select("cluster_id", F.explode(F.filter(ready, lambda a: a.isNotNull())).alias("action"), "confidence")
    return rows.withColumn("confidence", F.when(F.col("action") == "mark_cluster_needs_review", F.greatest("confidence", F.lit(0.5))).otherwise(F.col("confidence")))


def planned_memory(actions: DataFrame, clusters: DataFrame, words: DataFrame) -> DataFrame:
    """Memory records (record_id, content, domains, keywords, source) of the clusters that the plan selects."""
    chosen = clusters.join(actions.where("action = 'create_memory_record'").select("cluster_id"), "cluster_id", "left_semi")
    listed = words.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda s: s["keyword"]).alias("keywords"))
    content = F.concat(F.col("cluster_id"), F.lit(": "), F.col("seeds").cast("string"), F.lit(" seeds about "), F.array_join("keywords", ", "))
    return chosen.join(listed, "cluster_id", "left").select(F.col("cluster_id").alias("record_id"), content.alias("content"), F.array("domain").alias("domains"), "keywords", F.lit("clusters").alias("source"))


def reviewed_clusters(seeds: DataFrame, decisions: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(id, assigned, domain, cluster_id, position, score, reason) of all seeds; those whose review (id, decision) promotes them are clustered.

    Left join: a seed without a decision is unassigned, as is one whose decision is another.
    """
    known = seeds.join(decisions.select("id", "decision"), "id", "left")
    placed = cluster(known.where("decision = 'promote_candidate'"), threshold)
    why = F.when(F.col("decision").isNull(), "missing review decision").when(F.col("decision") != "promote_candidate", F.concat(F.lit("review decision is "), "decision")).when(F.col("position") == 1, "created new cluster").otherwise("keyword overlap with cluster")
    rows = known.select("id", "decision").join(placed, "id", "left")
    return rows.select("id", F.col("cluster_id").isNotNull().alias("assigned"), "domain", "cluster_id", "position", "score", why.alias("reason"))


def growth_decisions(reviews: DataFrame, seeds: DataFrame, assigned: DataFrame, minimum: float = 0.6, promote_weak: bool = False, quarantine: bool = True) -> DataFrame:
    """(id, action, confidence, cluster_id) of reviewed seeds: reviews (id, decision, score) with their seeds (id, confidence) and places, if any.

    A seed that is unknown has confidence 0.  Confidence is the larger of the seed's and the review's score, three digits.
    """
    rows = reviews.select("id", "decision", "score").join(seeds.select("id", F.col("confidence").alias("own")), "id", "left").join(assigned.select("id", "cluster_id"), "id", "left")
    own = F.coalesce("own", F.lit(0.0))
    reviewed = F.coalesce(T.rounded(F.greatest(own, F.col("score")), 3), own)
    enough = own >= minimum
    action = (
        F.when(F.col("decision") == "reject_broken", "reject_seed").when(F.col("decision") == "merge_duplicate", "merge_duplicate").when(F.col("decision").isin("quarantine_conflict", "quarantine_weak"), "quarantine_seed")
        .when((F.col("decision") == "promote_candidate") & (enough | F.lit(promote_weak)), "promote_seed").when(F.col("decision") == "promote_candidate", "quarantine_seed")
        .when(F.col("decision") == "needs_review", "quarantine_seed" if quarantine else "no_action")
    )
    confidence = F.when(F.col("decision") != "promote_candidate", reviewed).when(enough, F.greatest(own, reviewed)).otherwise(F.greatest(own, F.lit(0.5)))
    return rows.select("id", action.alias("action"), confidence.alias("confidence"), "cluster_id").where("action is not null")


def domain_consistency(assigned: DataFrame, domains: DataFrame) -> DataFrame:
    """(cluster_id, consistency): share of a cluster's seeds whose own domain (id, own) is the cluster's, three digits."""
    rows = assigned.where("cluster_id is not null").select("id", "cluster_id", "domain").join(domains.select("id", "own"), "id", "left")
    same = F.count_if(F.col("own") == F.col("domain"))
    return rows.groupBy("cluster_id").agg(F.round(same / F.count(F.lit(1)), 3).alias("consistency"))


def action_summary(actions: DataFrame) -> DataFrame:
    """(summary): one row that tells how many decisions there are and how many of each action, by name."""
    counted = actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("action", "n")))
    pieces = F.array_join(F.transform(listed, lambda s: F.concat(s["action"], F.lit("="), s["n"].cast("string"))), ", ")
    text = F.concat(F.sum("n").cast("string"), F.lit(" growth decisions: "), pieces)
    return counted.agg(F.coalesce(text, F.lit("No growth decisions.")).alias("summary"))


def first_decisions(decisions: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` decisions of a plan by an order that is unique."""
    return decisions.orderBy(order).limit(limit)
