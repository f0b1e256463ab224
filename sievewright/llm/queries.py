"""Queries of the training-data problems over the tables of a scale folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import abuse, consensus, cross_split, mixing, near_duplicates, pair_defects
from sievewright.llm.encode import encode
from sievewright.llm.token_budget import label, language, token_totals

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(*columns: str) -> Column:
    """Columns joined by line ends; null counts as empty."""
    return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def _mix_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mix_rows").select(F.col("row_id").alias("id"), lines("instruction", "output").alias("text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates.near_duplicate_pairs(_mix_texts(spark, folder), 0.7)
    return found.select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_mix_texts(spark, folder), 0.7).withColumnRenamed("id", "row_id")


def _example_texts(spark: SparkSession, folder: str) -> DataFrame:
    split = F.lower(F.trim("split_name"))
    return table(spark, folder, "training_examples").select(
        F.col("example_id").alias("id"), (split == "train").alias("train"), lines("instruction", "input", "output").alias("text"), split.alias("split"), "source"
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = cross_split.cross_split_pairs(_example_texts(spark, folder), 0.7)
    return found.select(F.least("a", "b").alias("example_id_a"), F.greatest("a", "b").alias("example_id_b"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = _example_texts(spark, folder)
    return cross_split.leakage_report(rows.where("not train").select("id", "split", "source"), cross_split.cross_split_pairs(rows, 0.7))


def _consensus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return consensus.truth_discovery(consensus.clean_reviews(table(spark, folder, "inference_reviews")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "inference_traces").select(F.lower(F.trim("trace_id")).alias("item")).distinct()
    items, _ = _consensus(spark, folder)
    return items.where("annotators >= 3").join(known, "item", "left_semi").select(F.col("item").alias("trace_id"), F.col("label").alias("status"))


def p2_agreement(spark: SparkSession, folder: str) -> DataFrame:
    items, _ = _consensus(spark, folder)
    return items.select(F.col("item").alias("trace_id"), F.col("label").alias("status"), "annotators", *[F.round(c, 6).alias(c) for c in ("agreement", "support", "rating")])


def p2_reviewers(spark: SparkSession, folder: str) -> DataFrame:
    _, contributors = _consensus(spark, folder)
    return consensus.annotator_reliability(contributors).withColumnRenamed("annotator", "reviewer")


def p3_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and tokens of outputs: mix rows by source and language, training examples by source, language and each domain."""
    mix = table(spark, folder, "mix_rows").select(
        F.lit("mix_rows").alias("table_name"), label(F.col("source")).alias("source"), language(F.col("lang")).alias("lang"), F.lit("(all)").alias("domain"), F.col("output").alias("text")
    )
    domains = F.array_distinct(F.transform(F.filter("domains", lambda d: F.trim(d) != ""), lambda d: F.lower(F.trim(d))))
    listed = F.when(F.size(F.coalesce(domains, F.array().cast("array<string>"))) > 0, domains).otherwise(F.array(F.lit("(none)")))
    examples = table(spark, folder, "training_examples").select(
        F.lit("training_examples").alias("table_name"), label(F.col("source")).alias("source"), language(F.get_json_object("metadata", "$.dataset_language")).alias("lang"), F.explode(listed).alias("domain"), F.col("output").alias("text")
    )
    return token_totals(mix.unionByName(examples), ["table_name", "source", "lang", "domain"])


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    mix = table(spark, folder, "mix_rows").select(F.lit("mix_rows").alias("table_name"), F.col("row_id").cast("string").alias("row_key"), F.col("instruction").alias("question"), F.col("output").alias("answer"))
    traces = table(spark, folder, "inference_traces").select(F.lit("inference_traces").alias("table_name"), F.col("trace_id").alias("row_key"), F.col("task").alias("question"), F.col("response_text").alias("answer"))
    return mix.unionByName(traces)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.pair_defects(_pairs(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"))


#: Power to which the shares of languages and topics are raised.
TEMPER = 0.8


def _uses(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents")
    about = documents.select("doc_id", "source", language(F.col("lang")).alias("lang"), F.coalesce(F.get_json_object("metadata", "$.workspace"), F.lit("(none)")).alias("topic"), "text")
    counted = encode(about.withColumn("row", F.struct("doc_id", "source", "lang", "topic")), "row").select("row.*", F.size("ids").cast("bigint").alias("tokens"))
    return mixing.mixed(counted, table(spark, folder, "mix_targets"), languages=TEMPER, topics=TEMPER)


def p7_uses(spark: SparkSession, folder: str) -> DataFrame:
    return _uses(spark, folder)[0].select("doc_id", "source", "tokens", "uses")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.marginals(*_uses(spark, folder))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).where(F.col("score") >= abuse.CASE).select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder)


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return abuse.abuse_rates(_scores(spark, folder).join(documents, "doc_id"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_found, p2_agreement, p2_reviewers, p3_budget, p4_found, p4_report,
        p5_found, p6_ids, p7_uses, p7_shares, p8_found, p8_scores, p8_rates,
    )
}

#: Overlap of all pairs of texts t (id, side, text), by the words that they share; texts without words if they are equal.
_OVERLAP = r"""
    w AS (SELECT id, side, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS word FROM t), n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
    shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND CONDITION GROUP BY ALL),
    pairs AS (SELECT a, b, c / (x.n + y.n - c) AS overlap FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c * 10 >= 7 * (x.n + y.n - c)
        UNION ALL SELECT a.id, b.id, 1.0 FROM t a JOIN t b ON a.text = b.text AND CONDITION WHERE a.id NOT IN (SELECT id FROM n))"""
_MIX = "t AS (SELECT row_id AS id, 0 AS side, coalesce(instruction, '') || chr(10) || coalesce(output, '') AS text FROM mix_rows)"
_EXAMPLES = "t AS (SELECT example_id AS id, lower(trim(split_name)) = 'train' AS side, lower(trim(split_name)) AS split, source, coalesce(instruction, '') || chr(10) || coalesce(input, '') || chr(10) || coalesce(output, '') AS text FROM training_examples)"
_ACROSS = _OVERLAP.replace("CONDITION", "NOT a.side AND b.side")

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_MIX}, {_OVERLAP.replace('CONDITION', 'a.id < b.id')} SELECT a AS row_id_a, b AS row_id_b FROM pairs",
    "p1_groups": f"""WITH RECURSIVE {_MIX}, {_OVERLAP.replace('CONDITION', 'a.id < b.id')}, known AS MATERIALIZED (SELECT a, b FROM pairs), sets AS (SELECT id, string_agg(word, ' ' ORDER BY word) AS s FROM w GROUP BY id),
        rep AS MATERIALIZED (SELECT t.id, min(t.id) OVER (PARTITION BY coalesce(s, '! ' || text)) AS rep, count(*) OVER (PARTITION BY coalesce(s, '! ' || text)) AS copies FROM t LEFT JOIN sets USING (id)),
        both_ AS MATERIALIZED (SELECT a, b FROM known UNION ALL SELECT b, a FROM known), reach(id, r) AS (SELECT a, a FROM both_ UNION SELECT reach.id, both_.b FROM reach JOIN both_ ON both_.a = reach.r),
        grp AS (SELECT id, min(r) AS g FROM reach GROUP BY id), linked AS (SELECT x.rep AS rep, count(DISTINCT y.rep) AS n FROM both_ JOIN rep x ON x.id = both_.a JOIN rep y ON y.id = both_.b WHERE x.rep <> y.rep GROUP BY x.rep)
        SELECT rep.id AS row_id, coalesce(g, rep.id) AS group_id, coalesce(n, 0) AS links, copies FROM rep LEFT JOIN grp ON grp.id = rep.id LEFT JOIN linked ON linked.rep = rep.rep""",
    "p4_found": f"WITH {_EXAMPLES}, {_ACROSS} SELECT least(a, b) AS example_id_a, greatest(a, b) AS example_id_b FROM pairs",
    "p4_report": f"""WITH {_EXAMPLES}, {_ACROSS}, best AS (SELECT a AS id, max(overlap) AS best FROM pairs GROUP BY a)
        SELECT split, coalesce(source, '(none)') AS source, count(*) AS rows, count(*) FILTER (best = 1) AS same, count(*) FILTER (best < 1) AS almost, count(best) AS leaked, round(count(best) / count(*), 4) AS share FROM t LEFT JOIN best USING (id) WHERE NOT side GROUP BY ALL""",
}
