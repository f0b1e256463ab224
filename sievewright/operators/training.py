"""Training examples: joins that build them, order, splits, summaries, mixing by repetition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import lexicon as L
from sievewright.functions import text as T

SPLITS = ("train", "validation", "test")


def join_reviews(traces: DataFrame, reviews: DataFrame) -> DataFrame:
    """(trace_id, review_id, state) by full outer join: matched, no_review or no_trace.

    ``traces``: trace_id once; ``reviews``: review_id once, trace_id.  Null trace ids match nothing.
    """
    left = traces.select("trace_id", F.lit(True).alias("traced"))
    both = left.join(reviews.select("trace_id", "review_id"), "trace_id", "full_outer")
    state = F.when(F.col("traced").isNull(), "no_trace").when(F.col("review_id").isNull(), "no_review").otherwise("matched")
    return both.select("trace_id", "review_id", state.alias("state"))


def split_counts(total: Column, ratios: Sequence[float] = (0.8, 0.1, 0.1), minimum: int = 1) -> Column:
    """Rows per split of a stratum of ``total`` rows, as an array in order of the splits.

    Largest remainder: each split has the whole part of its share, and the places left go to the largest fractions, of
    equal ones to the first.  A single row is the first split's.  Where each split that has a ratio could have a row, an
    empty one then takes a row of the fullest split, the first of several, that has more than ``minimum``.
    """
    n, share = len(ratios), [F.lit(r / sum(ratios)) * total for r in ratios]
    fraction = [x - F.floor(x) for x in share]
    rank = [sum((F.when((fraction[j] > fraction[i]) if j > i else (fraction[j] >= fraction[i]), 1).otherwise(0) for j in range(n) if j != i), F.lit(0)) for i in range(n)]
    spare = total - sum((F.floor(x) for x in share), F.lit(0))
    counts = F.array(*[(F.floor(x) + F.when(r < spare, 1).otherwise(0)).cast("int") for x, r in zip(share, rank, strict=True)])
    wanted = [i for i, r in enumerate(ratios) if r > 0]
    if minimum > 0:
        def given(held: Column, to: Column) -> Column:
            fullest = F.array_position(held, F.array_max(held)) - 1
            able = (F.get(held, to) == 0) & (F.array_max(held) > minimum)
            moved = F.transform(held, lambda c, i: c + F.when(i == to, 1).otherwise(0) - F.when(i == fullest, 1).otherwise(0))
            return F.when(able, moved).otherwise(held)

        filled = F.aggregate(F.array(*map(F.lit, wanted)), counts, given)
        counts = F.when(total >= len(wanted), filled).otherwise(counts)
    first = F.array(F.lit(1), *[F.lit(0)] * (n - 1))
    return F.when(total <= 0, F.array(*[F.lit(0)] * n)).when(total == 1, first).otherwise(counts)


def shuffle_key(key: Column, seed: int) -> Column:
    """Order that depends on key and seed only, the same in every engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def stratified_split(examples: DataFrame, stratum: Column | None = None, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 7) -> DataFrame:
    """(id, stratum, split): each stratum is ordered by a hash and cut by ``split_counts``; null strata are ``unknown``.

    Places are counted within hash ranges whose sizes are summed up first, so that a large stratum is ordered by many
    tasks.  Ids must be unique.
    """
    rows = examples.select("id", F.coalesce(stratum if stratum is not None else F.col("stratum"), F.lit("unknown")).alias("stratum"))
    rows = rows.withColumn("key", shuffle_key(F.col("id"), seed)).withColumn("part", F.substring("key", 1, 2))
    sizes = rows.groupBy("stratum", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("stratum", "part", (F.sum("n").over(Window.partitionBy("stratum").orderBy("part")) - F.col("n")).alias("before"))
    total = sizes.groupBy("stratum").agg(F.sum("n").alias("total")).withColumn("counts", split_counts(F.col("total"), ratios))
    place = F.row_number().over(Window.partitionBy("stratum", "part").orderBy("key", "id"))
    placed = rows.withColumn("place", place).join(before, ["stratum", "part"]).join(total.select("stratum", "counts"), "stratum").withColumn("place", F.col("place") + F.col("before"))
    split = F.when(F.col("place") <= F.col("counts")[0], SPLITS[0]).when(F.col("place") <= F.col("counts")[0] + F.col("counts")[1], SPLITS[1]).otherwise(SPLITS[2])
    return placed.select("id", "stratum", split.alias("split"))


def seeded_permutation(n: int, seed: int) -> list[int]:
    """Places of 0..n-1 after a Mersenne-Twister shuffle, for small tables that must keep an older order."""
    order = list(range(n))
    Random(seed).shuffle(order)
    return order


def count_many(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) over all strings of an array column, without empty ones."""
    return rows.select(F.explode(column).alias("value")).where(F.col("value") != "").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def count_one(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of a string column; null and empty count as ``unknown``."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def provenance_summary(rows: DataFrame) -> DataFrame:
    """(origin, n, with_trace, with_review) by the origin in a provenance map; without one ``unknown``."""
    has = lambda k: F.coalesce(F.map_contains_key("provenance", F.lit(k)), F.lit(False))
    origin = F.coalesce(F.col("provenance")["origin"], F.lit("unknown"))
    return rows.groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(has("trace_id")).alias("with_trace"), F.count_if(has("review_id")).alias("with_review"))


def mixed_by_repeats(sources: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """UNION ALL of frames of one schema, each row as often as its source says, with source_name and copy (from 1)."""
    out = None
    for name, (frame, times) in sources.items():
        part = frame.withColumn("source_name", F.lit(name)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))) if times > 0 else frame.limit(0).withColumn("source_name", F.lit(name)).withColumn("copy", F.lit(1))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source")
    return out


def usable_rows(rows: DataFrame, max_chars: int = 5000, markers: Sequence[str] = L.REFUSAL_MARKERS) -> DataFrame:
    """Rows with instruction and output, none of their fields longer than ``max_chars``, without a refusal phrase."""
    long = F.lit(False)
    for c in ("instruction", "input", "output"):
        long = long | (F.length(T.text_or_empty(F.col(c))) > max_chars)
    said = F.lower(F.concat_ws("\n", T.text_or_empty(F.col("instruction")), T.text_or_empty(F.col("output"))))
    filled = (F.trim(T.text_or_empty(F.col("instruction"))) != "") & (F.trim(T.text_or_empty(F.col("output"))) != "")
    return rows.where(filled & ~long & ~T.has_any(said, markers))


def native_json(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(value): one JSON object per row with keys in alphabetical order; nulls are kept."""
    return rows.select(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("value"))


def trace_ids(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a stable trace id: 16 hex digits of the SHA-256 of the columns joined by line ends; null counts as empty."""
    joined = F.concat_ws("\n", *[T.text_or_empty(F.col(c)) for c in columns])
    return rows.withColumn("stable_id", F.concat(F.lit("trace:"), F.substring(F.sha2(joined, 256), 1, 16)))


def rendered(rows: DataFrame, template: str, fields: Sequence[str]) -> Column:
    """Template with {field} replaced by columns; null counts as empty.  Unknown fields are an error."""
    import string

    named = {f for _, f, _, _ in string.Formatter().parse(template) if f is not None}
    if unknown := named - set(fields):
        raise ValueError(f"template names unknown fields: {sorted(unknown)}")
    out = F.lit(template)
    for f in sorted(named):
        out = F.replace(out, F.lit("{" + f + "}"), T.text_or_empty(F.col(f).cast("string")))
    return out


def ordered(rows: DataFrame) -> DataFrame:
    """Examples in order of source, status, instruction and output."""
    return rows.orderBy("source", "validation_status", "instruction", "output")


def unique_ids(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Rows with ``unique_id``: the base, and from its second row on with the lowest of -2, -3 and so on that is no row's base.

    Only bases that end in a number are looked up as taken.
    """
    taken = rows.select(F.regexp_extract(base, r"^(.*)-([1-9][0-9]*)$", 1).alias("stem"), F.regexp_extract(base, r"^(.*)-([1-9][0-9]*)$", 2).alias("n")).where("stem <> ''")
    taken = taken.distinct().groupBy("stem").agg(F.array_sort(F.collect_set(F.col("n").cast("bigint"))).alias("__taken"))
    place = F.row_number().over(Window.partitionBy(base).orderBy(order))
    placed = rows.withColumn("__place", place.cast("bigint")).join(taken.withColumnRenamed("stem", base), base, "left")
    # The k-th free number: each taken one up to it moves it on by one.
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<bigint>")), F.col("__place"), lambda k, t: F.when((t >= 2) & (t <= k), k + 1).otherwise(k))
    return placed.withColumn("unique_id", F.when(F.col("__place") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), free.cast("string")))).drop("__place", "__taken").select(*rows.columns, "unique_id")


def manifest(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """(part, value, n): a manifest in long form: splits, statuses, sources, licences, domains and origins."""
    one = lambda column, part: count_one(rows, column).select(F.lit(part).alias("part"), "value", "n")
    out = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit("split").alias("part"), F.col("split").alias("value"), "n")
    out = out.unionByName(one("validation_status", "status")).unionByName(one("source", "source")).unionByName(one("license", "license"))
    out = out.unionByName(count_many(rows, "domains").select(F.lit("domain").alias("part"), "value", "n"))
    return out.unionByName(provenance_summary(rows).select(F.lit("origin").alias("part"), F.col("origin").alias("value"), "n"))
