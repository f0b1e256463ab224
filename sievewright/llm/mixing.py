"""Mixing documents of several sources to target weights.

Tokens are totalled per cell of source, language and topic.  Iterative
proportional fitting rakes the cells' weights to the wanted source shares and to
given language and topic shares; the source marginal comes last and holds
exactly.  A cell's factor (its raked tokens over its own) is how often each of
its documents is used on average, never more than the source's ``max_repeats``.
Documents get the whole part of their factor, and one use more by systematic
sampling in order of language, topic and size, so that the tokens of each cell come
close to the plan; a few documents of a source, at most ``CORRECTIONS`` and two,
then change by one use to bring the source nearer still.

Language and topic shares are given, or derived: a power p between 0 and 1 asks for
the shares that the corpus has once its sources are raked, raised to p and scaled
to one, which lifts languages and topics with little text.

The total is the largest at which every source that has tokens can still have
its share: there the shares reached are as near to the targets as the caps
allow.  With a larger ``total_tokens`` sources at their cap fall short, and the
others keep their proportions to one another.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a bucket of documents of like size, which are ordered by different tasks.
SPREAD = 1024
#: Documents of a source that change by one use at the end.
CORRECTIONS = 8
#: Cells that the fitting holds on the driver: combinations of wanted sources, languages and topics.
MAX_CELLS = 100_000
#: Token counts up to which each is a size of its own when documents to change are looked for; beyond, 64 sizes an octave.
EXACT_SIZES = 2_048


def planned_sources(tokens: Mapping[str, float], share: Mapping[str, float], repeats: Mapping[str, int], total: float | None) -> dict[str, float]:
    """Tokens to take from each source that has any."""
    live = {s: share[s] for s in share if tokens.get(s, 0) > 0 and share[s] > 0 and repeats[s] > 0}
    if not live:
        return {}
    cap = {s: tokens[s] * repeats[s] for s in live}
    scale = sum(live.values())
    if total is None:
        total = min(cap[s] / (live[s] / scale) for s in live)
    plan: dict[str, float] = {}
    open_, left = dict(live), float(total)
    while open_:
        scale = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / scale > cap[s] * (1 + 1e-12)]
        if not full:
            plan |= {s: left * w / scale for s, w in open_.items()}
            break
        for s in full:
            plan[s] = float(cap[s])
            left -= cap[s]
            del open_[s]
    return plan


def rake(cells: Mapping[tuple[str, str, str], float], sources: Mapping[str, float], limits: Mapping[str, int], languages: Mapping[str, float] | None = None, topics: Mapping[str, float] | None = None, rounds: int = 200) -> dict[tuple[str, str, str], float]:
    """Factor of each cell by iterative proportional fitting, within 0 and the source's limit.

    ``languages`` and ``topics`` are wanted shares; one without a value keeps what the sources' plan gives it.
    """
    base = {c: float(t) for c, t in cells.items() if t > 0 and c[0] in sources}
    total = sum(sources.values())
    weight = dict(base)
    goals = []
    for axis, shares in ((1, languages), (2, topics), (0, {s: v / total for s, v in sources.items()} if total else {})):
        own: dict[str, list[tuple[str, str, str]]] = {}
        for c in weight:
            own.setdefault(c[axis], []).append(c)
        goals.append([(share * total, own[name]) for name, share in (shares or {}).items() if name in own])
    before = None
    for _ in range(rounds):
        for goal in goals:
            for wanted, own in goal:
                for _ in range(20):  # again, as cells at their limit leave the rest to the others
                    now = sum(weight[c] for c in own)
                    if not now or abs(wanted / now - 1) < 1e-9:
                        break
                    ratio, last = wanted / now, now
                    for c in own:
                        weight[c] = min(weight[c] * ratio, base[c] * limits[c[0]])
                    if abs(sum(weight[c] for c in own) - last) < 1e-12 * total:
                        break
        after = [sum(weight[c] for c in own) for goal in goals for _, own in goal]
        if before is not None and max((abs(x - y) for x, y in zip(before, after, strict=True)), default=0.0) < 1e-9 * total:
            break
        before = after
    return {c: weight[c] / base[c] for c in weight}


def tempered(cells: Mapping[tuple[str, str, str], float], sources: Mapping[str, float], axis: int, power: float) -> dict[str, float]:
    """Shares along an axis (1 languages, 2 topics) of the cells with their sources at plan, raised to a power and scaled to one."""
    own: dict[str, float] = {}
    for c, n in cells.items():
        own[c[0]] = own.get(c[0], 0.0) + n
    at: dict[str, float] = {}
    for c, n in cells.items():
        if c[0] in sources and own[c[0]]:
            at[c[axis]] = at.get(c[axis], 0.0) + n * sources[c[0]] / own[c[0]]
    raised = {k: v**power for k, v in at.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, languages: Mapping[str, float] | float | None = None, topics: Mapping[str, float] | float | None = None, seed: str = "mix") -> DataFrame:
    """(doc_id, source, lang, topic, tokens, uses) of the documents (doc_id, source, lang, topic, tokens) of the wanted sources; see ``mixed``."""
    return mixed(documents, targets, total_tokens, languages, topics, seed)[0]


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, languages: Mapping[str, float] | float | None = None, topics: Mapping[str, float] | float | None = None, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Uses (doc_id, source, lang, topic, tokens, uses) of documents, and the wanted shares (marginal, value, target_share).

    ``targets`` (source, target_share, max_repeats) has at most ``MAX_CELLS`` rows; a source may be named once.  Null share, null or negative
    repeats count as 0.  Documents of other sources and documents without tokens are used 0 times; null language and
    topic count as ``(none)``.  Of an empty table, or without targets, the result is empty or has no uses.
    """
    listed = targets.select("source", "target_share", "max_repeats").limit(MAX_CELLS + 1).collect()
    if len(listed) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} wanted sources")
    wanted = {r.source: (float(r.target_share or 0.0), max(0, int(r.max_repeats or 0))) for r in listed}
    limits = {s: m for s, (_, m) in wanted.items()}
    rows = documents.select("doc_id", "source", F.coalesce("lang", F.lit("(none)")).alias("lang"), F.coalesce("topic", F.lit("(none)")).alias("topic"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    rows = rows.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    found = rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} combinations of source, language and topic")
    cells = {(r.source, r.lang, r.topic): r.tokens for r in found}
    per_source: dict[str, float] = {}
    for (source, _, _), n in cells.items():
        per_source[source] = per_source.get(source, 0) + n
    plan = planned_sources(per_source, {s: w for s, (w, _) in wanted.items()}, limits, total_tokens)
    by_language = tempered(cells, plan, 1, languages) if isinstance(languages, int | float) else languages
    by_topic = tempered(cells, plan, 2, topics) if isinstance(topics, int | float) else topics
    factors = rake(cells, plan, limits, by_language, by_topic)
    spark = documents.sparkSession
    table = spark.createDataFrame([(*c, float(f)) for c, f in factors.items()], "source string, lang string, topic string, factor double")
    each = rows.join(F.broadcast(table), ["source", "lang", "topic"], "left").withColumn("factor", F.coalesce("factor", F.lit(0.0)) + F.when(F.col("factor") > 0, 1e-12).otherwise(0.0))
    # Systematic sampling: documents of a source in order of cell and size; one is used once more where the running sum of
    # fractions passes a whole number.  Sums of buckets come first, so that no task orders a whole source.
    each = each.withColumn("whole", F.floor("factor")).withColumn("part", F.when(F.col("tokens") > 0, F.col("factor") - F.floor("factor")).otherwise(0.0))
    each = each.withColumn("place", F.xxhash64(F.lit(seed), "doc_id"))
    size = F.floor(F.log2(F.greatest("tokens", F.lit(1))) * 32)
    each = each.withColumn("bucket", size * SPREAD + F.pmod("place", F.lit(SPREAD)))
    place = ["source", "lang", "topic", "bucket"]
    totals = each.groupBy(*place).agg(F.sum("part").alias("sum"))
    before = totals.select(*place, (F.sum("sum").over(Window.partitionBy("source").orderBy(*place[1:])) - F.col("sum")).alias("before"))
    local = Window.partitionBy(*place).orderBy("tokens", "place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = each.join(before, place).withColumn("end", F.col("before") + F.sum("part").over(local))
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(10_000)) / 10_000.0
    more = F.floor(F.col("end") + offset) - F.floor(F.col("end") - F.col("part") + offset)
    uses = F.when(F.col("tokens") > 0, F.col("whole") + F.when(F.col("part") > 1e-9, F.least(more, F.lit(1))).otherwise(0)).otherwise(0)
    chosen = run.select("doc_id", "source", "lang", "topic", "tokens", uses.cast("int").alias("uses")).persist(StorageLevel.MEMORY_AND_DISK)
    shares = [("source", s, w) for s, (w, _) in wanted.items()]
    for name, listed_shares in (("language", by_language), ("topic", by_topic)):
        shares += [(name, k, float(w)) for k, w in (listed_shares or {}).items()]
    return _corrected(chosen, {s: (n, limits[s]) for s, n in plan.items()}), spark.createDataFrame(shares, "marginal string, value string, target_share double")


def _steps(table: pa.Table) -> pa.Table:
    """Documents (of rows source, step, tokens, doc_id, lack of one source) whose uses change by a step: each the one that brings the source
    nearest to its goal, as long as one does, and at last the two that do so together."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "step", "tokens")), strict=True))
    lack, moved = table.column("lack")[0].as_py(), {}
    for _ in range(CORRECTIONS):
        best = min(((abs(lack - step * tokens), doc, step, tokens) for doc, step, tokens in rows if doc not in moved), default=None)
        if best is None or best[0] >= abs(lack):
            break
        moved[best[1]] = best[2]
        lack -= best[2] * best[3]
    free = [(step * tokens, doc, step) for doc, step, tokens in rows if doc not in moved]
    free.sort()
    change = np.array([f[0] for f in free], np.float64)
    if len(free) > 1 and lack:
        near = np.searchsorted(change, lack - change)
        pairs = [(abs(lack - free[i][0] - free[j][0]), i, j) for shift in (-1, 0) for i, j in enumerate((near + shift).tolist()) if 0 <= j < len(free) and free[i][1] != free[j][1]]
        best = min(pairs, default=None)
        if best is not None and best[0] < abs(lack):
            moved |= {free[best[1]][1]: free[best[1]][2], free[best[2]][1]: free[best[2]][2]}
    return pa.table({"doc_id": pa.array(list(moved), table.schema.field("doc_id").type), "step": pa.array(list(moved.values()), pa.int32())})


def _corrected(chosen: DataFrame, goals: Mapping[str, tuple[float, int]]) -> DataFrame:
    """Uses after at most ``CORRECTIONS`` and two documents of each source changed by one use.

    Looked for among the smallest and largest document of each size, of those that may be used more and of those that may be used
    less; sizes of a source are at most EXACT_SIZES and 64 for each octave beyond, so that a source's are few for one task.
    """
    spark = chosen.sparkSession
    goal = spark.createDataFrame([(s, float(n), m) for s, (n, m) in goals.items()], "source string, goal double, most int")
    used = chosen.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("used"))
    lack = goal.join(used, "source").select("source", "most", (F.col("goal") - F.col("used")).alias("lack"))
    size = F.when(F.col("tokens") < EXACT_SIZES, F.col("tokens")).otherwise(EXACT_SIZES + F.floor(F.log2("tokens") * 64))
    able = F.filter(F.array(F.when(F.col("uses") < F.col("most"), 1), F.when(F.col("uses") > 0, -1)), lambda x: x.isNotNull())
    each = chosen.where("tokens > 0").join(F.broadcast(lack), "source").select("source", "lack", F.explode(able).alias("step"), size.alias("size"), F.struct("tokens", "doc_id").alias("d"))
    ends = each.groupBy("source", "lack", "step", "size").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    near = ends.select("source", "lack", "step", F.explode(F.array_distinct(F.array("low", "high"))).alias("d")).select("source", "lack", "step", "d.tokens", "d.doc_id")
    moved = near.groupBy("source").applyInArrow(_steps, f"doc_id {kind}, step int")
    return chosen.join(F.broadcast(moved), "doc_id", "left").select("doc_id", "source", "lang", "topic", "tokens", (F.col("uses") + F.coalesce("step", F.lit(0))).cast("int").alias("uses"))


def marginals(uses: DataFrame, wanted: DataFrame) -> DataFrame:
    """(marginal, value, target_share, share, documents, tokens, uses, tokens_used): wanted and reached share of all tokens used.

    Values that nothing was wanted of have no target share.
    """
    value = F.explode(F.array(*[F.struct(F.lit(m).alias("marginal"), F.col(c).alias("value")) for m, c in (("source", "source"), ("language", "lang"), ("topic", "topic"))])).alias("m")
    each = uses.select("tokens", "uses", value).groupBy("m.marginal", "m.value").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens_used")
    )
    joined = wanted.join(each, ["marginal", "value"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.coalesce(F.try_divide("tokens_used", F.sum("tokens_used").over(Window.partitionBy("marginal"))), F.lit(0.0))
    return joined.select("marginal", "value", "target_share", share.alias("share"), *[zero(c) for c in ("documents", "tokens", "uses", "tokens_used")])


def mix_report(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """Per wanted source: target and reached share of all tokens used, documents, tokens there and used, and the mean number of uses."""
    each = uses.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens_used"), F.max("uses").alias("most_uses")
    )
    total = Window.partitionBy(F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = targets.select("source", "target_share", "max_repeats").join(each, "source", "left").select("source", "target_share", "max_repeats", *[zero(c) for c in ("documents", "tokens", "uses", "tokens_used", "most_uses")])
    return joined.withColumn("share", F.coalesce(F.try_divide("tokens_used", F.sum("tokens_used").over(total)), F.lit(0.0)))
