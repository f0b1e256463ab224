"""Queries of ingestion, seeds, growth plans, benchmark runs and training examples over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import lexicon as L
from sievewright.functions import text as T
from sievewright.operators import benchmark, chunking, examples, growth, ingest, retrieval, review, routing, seeds, training
from sievewright.plans import core_sql as Q
from sievewright.plans import tables as S
from sievewright.sources import jsonl

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def registered(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return registered


def slug(text: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g')"
    return f"CASE WHEN {bare} = '' THEN 'unknown' ELSE {bare} END"


def domains(terms: str) -> str:
    """Labels of the domains of a list of terms, joined by commas."""
    return f"coalesce(nullif(array_to_string(flatten(list_filter([{Q._DOMAINS.replace('list_has_any(t,', f'list_has_any({terms},')}], lambda x: x IS NOT NULL)), ','), ''), '{L.FALLBACK_DOMAIN}')"


def joined(column: str) -> F.Column:
    return F.array_join(F.coalesce(column, F.array().cast("array<string>")), ",")


_USES = f"""(SELECT name, source, use, coalesce(list_contains(allowed_uses, use), false) AND NOT (use = 'training_export_candidate' AND {Q.has_any("lower(trim(coalesce(license, '')))", L.BLOCKED_LICENSES)}) AS allowed
    FROM dataset_manifests, (SELECT unnest({Q.array(L.MANIFEST_USES)}) AS use))"""
_OK = f"instruction IS NOT NULL AND output IS NOT NULL AND {Q.squashed('instruction')} <> '' AND {Q.squashed('output')} <> ''"


@query(f"""SELECT name, 'dataset:' || {slug('name')} AS source_id, CASE WHEN format = 'sharegpt' THEN 'conversation_dataset' WHEN format = 'alpaca' THEN 'instruction_dataset' WHEN coalesce(list_contains(domains, 'code'), false) THEN 'code_dataset' ELSE 'unknown' END AS source_type,
    CASE WHEN format IN ('alpaca', 'sharegpt', 'jsonl', 'text') THEN format ELSE 'unknown' END AS format, license, coalesce(json_extract_string(metadata, '$.language'), 'unknown') AS language,
    coalesce(try_cast(json_extract_string(metadata, '$.reliability') AS DOUBLE), 0.5) AS reliability FROM dataset_manifests""")  # fmt: skip
def manifest_sources(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.sources(S.table(spark, folder, "dataset_manifests")).drop("metadata")


@query("""SELECT x.row_id, 'jsonl_dataset_record' AS origin, x.row_id::VARCHAR AS line, m.name AS manifest, json_extract_string(m.metadata, '$.language') AS language, m.requires_review::VARCHAR AS requires_review
    FROM mix_rows x LEFT JOIN dataset_manifests m ON x.source = m.source""")  # fmt: skip
def record_provenance(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.with_provenance(S.mix_records(spark, folder), S.table(spark, folder, "dataset_manifests"))
    m = F.col("metadata")
    return rows.select(F.col("line_number").alias("row_id"), m["origin"].alias("origin"), m["line_number"].alias("line"), m["manifest_name"].alias("manifest"), m["language"].alias("language"), m["manifest_requires_review"].alias("requires_review"))


_INGESTED = f"""(SELECT x.source, row_id AS line_number, coalesce(g.any, false) AND {_OK} AS accepted, CASE WHEN NOT coalesce(g.any, false) THEN 'line ' || row_id || ': manifest policy rejected record' WHEN NOT ({_OK}) THEN 'line ' || row_id || ': unsupported or incomplete record' END AS reason
    FROM mix_rows x LEFT JOIN (SELECT source, bool_or(allowed) AS any FROM {_USES} GROUP BY source) g ON x.source = g.source)"""


@query(f"SELECT * FROM {_INGESTED}")
def ingest_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.ingested(S.mix_records(spark, folder), S.table(spark, folder, "dataset_manifests"))


@query(f"""SELECT 'dataset:' || {slug('m.name')} || ':instruction-' || CASE WHEN row_id < 10000 THEN lpad(row_id::VARCHAR, 4, '0') ELSE row_id::VARCHAR END AS id, x.source, coalesce(try_cast(json_extract_string(m.metadata, '$.reliability') AS DOUBLE), 0.5) AS reliability,
    {domains('x.t')} AS domains FROM (SELECT *, {Q.terms("concat_ws(' ', " + ', '.join(f"nullif({Q.squashed(c)}, '')" for c in ('instruction', 'input', 'output')) + ')')} AS t FROM mix_rows) x JOIN dataset_manifests m ON x.source = m.source
    WHERE {_OK} AND m.name IN (SELECT name FROM {_USES} WHERE use = 'knowledge_seed_candidate' AND allowed)""")  # fmt: skip
def ingest_seed_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = ingest.seed_candidates(S.mix_records(spark, folder), S.table(spark, folder, "dataset_manifests"))
    return found.select("id", "source", "reliability", joined("domains").alias("domains"))


#: Windows of 500 characters with a lap of 50, by the recurrence of their beginnings.
_CHUNKS = f"""RECURSIVE plain AS (SELECT doc_id, {Q.squashed('text')} AS t FROM documents),
    cut(doc_id, n, b, e) AS (
        SELECT doc_id, 0, 0, CASE WHEN length(t) <= 500 THEN length(t) WHEN contains(left(t, 500), ' ') THEN 501 - strpos(reverse(left(t, 500)), ' ') ELSE 500 END FROM plain WHERE t <> ''
        UNION ALL SELECT doc_id, n + 1, s, CASE WHEN s + 500 >= length(t) THEN length(t) WHEN contains(substr(t, s + 1, 500), ' ') THEN s + 501 - strpos(reverse(substr(t, s + 1, 500)), ' ') ELSE s + 500 END
        FROM (SELECT c.doc_id, c.n, t, CASE WHEN e - 50 > b THEN e - 50 ELSE e END AS s, e FROM cut c JOIN plain USING (doc_id) WHERE e < length(t))),
    chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS chunk_index, content FROM (SELECT doc_id, n, {Q.trimmed('substr(t, b + 1, e - b)')} AS content FROM cut JOIN plain USING (doc_id)) WHERE content <> ''),
    named AS (SELECT *, doc_id || ':chunk-' || lpad(chunk_index::VARCHAR, 4, '0') AS chunk_id FROM chunks)"""
ORACLES["chunk_documents"] = f"WITH {_CHUNKS} SELECT * FROM named"
_TAGGED = f"""(SELECT n.chunk_id, doc_id, content, coalesce(kw, []) AS keywords, string_split({domains('t')}, ',') AS domains FROM (SELECT *, {Q.terms('content')} AS t FROM named) n LEFT JOIN {Q.top_keywords('named', 'chunk_id', 'content')} k ON n.chunk_id = k.chunk_id)"""
ORACLES["chunk_memory"] = f"WITH {_CHUNKS} SELECT chunk_id AS record_id, content, domains, keywords, 'document:' || doc_id AS source FROM {_TAGGED}"


@query(f"WITH {_CHUNKS} SELECT 'seed:' || chunk_id AS id, content, array_to_string(domains, ',') AS domains, array_to_string(keywords, ',') AS keywords, 0.5::DOUBLE AS confidence, 'document:' || doc_id AS source FROM {_TAGGED}")
def chunk_seeds(spark: SparkSession, folder: str) -> DataFrame:
    found = seeds.from_chunks(chunking.tagged(chunking.chunk(S.table(spark, folder, "documents"))))
    return found.select("id", "content", joined("domains").alias("domains"), joined("keywords").alias("keywords"), "confidence", "source")


_TOOL = f"""(SELECT trace_id, trim(coalesce(response_text, '') || CASE WHEN len(coalesce(context_sources, [])) > 0 THEN ' ' || array_to_string(context_sources, ' ') ELSE '' END, ' ') AS content FROM {Q._TRACES})"""


@query(f"SELECT 'seed:tool:' || trace_id AS id, content, {domains('t')} AS domains, 0.75::DOUBLE AS confidence FROM (SELECT *, {Q.terms("trace_id || ' ' || content")} AS t FROM {_TOOL})")
def tool_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Responses with their context sources as tool results."""
    rows = S.traces(spark, folder).select(F.col("trace_id").alias("tool_name"), F.col("response_text").alias("output"), F.col("context_sources").alias("details"), F.lit(None).cast("string").alias("domain"))
    return seeds.from_tool_results(rows, 0.8).select("id", "content", joined("domains").alias("domains"), "confidence")


@query(f"""SELECT 'seed:donor:' || {slug('model')} || ':' || substr({slug('task')}, 1, 48) AS id, coalesce(response_text, '') AS content, {domains(Q.terms('response_text'))} AS domains, 0.45::DOUBLE AS confidence FROM {Q._TRACES} WHERE adapter_name = 'lora-small'""")
def proposal_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Responses of one adapter as proposals of seeds, those of others as proposals of another type, which are left out."""
    kind = F.when(F.col("adapter_name") == "lora-small", "knowledge_seed").otherwise("answer")
    rows = S.traces(spark, folder).select(F.col("model").alias("source"), "task", kind.alias("proposal_type"), F.col("response_text").alias("content"), F.lit(None).cast("double").alias("confidence"))
    return seeds.from_proposals(rows, strict=False).select("id", "content", joined("domains").alias("domains"), "confidence")


_CHECKED = f"""{Q._VALID}, checked AS (SELECT v.id, v.status, v.score, x.source, m.license, s.confidence, s.domains, CASE v.status WHEN 'validated' THEN 'promote_candidate' WHEN 'rejected' THEN 'reject_broken' WHEN 'weak' THEN 'needs_review' ELSE 'quarantine_weak' END AS decision
    FROM valid v JOIN mix_rows x ON x.row_id = v.id LEFT JOIN dataset_manifests m ON x.source = m.source JOIN seed s ON s.id = v.id)"""
_DECIDED = f"""{_CHECKED}, decided AS (SELECT id, CASE decision WHEN 'reject_broken' THEN 'reject_seed' WHEN 'promote_candidate' THEN CASE WHEN confidence >= 0.6 THEN 'promote_seed' ELSE 'quarantine_seed' END ELSE 'quarantine_seed' END AS action,
    round(CASE WHEN decision <> 'promote_candidate' OR confidence >= 0.6 THEN greatest(confidence, score) ELSE greatest(confidence, 0.5) END, 3) AS confidence, 'cluster:' || coalesce(domains[1], 'general') AS cluster_id FROM checked)"""


@query(f"WITH {_CHECKED} SELECT id AS seed_id, coalesce(nullif(license, ''), 'unknown') AS license, 'validated' AS validation_status, array_to_string(domains, ',') AS domains FROM checked WHERE status = 'validated'")
def seed_examples(spark: SparkSession, folder: str) -> DataFrame:
    return examples.from_seeds(S.checked_seeds(spark, folder)).select("seed_id", "license", "validation_status", joined("domains").alias("domains"))


@query(f"WITH {_CHECKED} SELECT id AS seed_id, CASE decision WHEN 'promote_candidate' THEN 'validated' ELSE 'reviewed' END AS validation_status, decision AS review_decision FROM checked WHERE decision IN ('promote_candidate', 'needs_review')")
def decision_examples(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.checked_seeds(spark, folder)
    made = examples.from_review_decisions(rows.drop("decision", "score"), rows.select("id", "decision", "score"))
    return made.select("seed_id", "validation_status", F.col("metadata")["review_decision"].alias("review_decision"))


@query(f"""SELECT t.task AS input, t.routing_summary AS output, 'unknown' AS license, 'reviewed' AS validation_status FROM {Q._REVIEWS} r JOIN {Q._TRACES} t ON lower(trim(r.trace_id)) = t.trace_id
    WHERE lower(trim(r.status)) IN ('accepted', 'corrected') AND (rating IS NULL OR rating >= 4)""")  # fmt: skip
def feedback_examples(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.reviews(spark, folder).select(F.lower(F.trim("trace_id")).alias("trace_id"), "rating", F.lower(F.trim("status")).isin("accepted", "corrected").alias("success"))
    rows = rows.join(S.traces(spark, folder).select("trace_id", "task", F.col("routing_summary").alias("route_summary"), "selected_modules"), "trace_id").withColumn("metadata", F.lit("{}"))
    return examples.from_feedback(rows).select("input", "output", "license", "validation_status")


@query(f"SELECT case_id AS input, run_id AS config_name, 'overall=' || overall || ', routing=' || routing || ', context=' || context AS output, 'synthetic-demo' AS license FROM {Q._RESULTS}")
def result_examples(spark: SparkSession, folder: str) -> DataFrame:
    results = S.run_results(spark, folder)
    cases = results.select("case_id").distinct().select("case_id", F.col("case_id").alias("task"), F.array().cast("array<string>").alias("expected_domains"))
    return examples.from_results(cases, results).select("input", F.col("provenance")["config_name"].alias("config_name"), "output", "license")


_PROMPT = """trim(concat_ws(chr(10), coalesce(user_prompt, ''), '', 'Prompt template: ' || coalesce(template_name, ''), 'Context sources: ' || CASE WHEN len(coalesce(context_sources, [])) > 0 THEN array_to_string(context_sources, ', ') ELSE 'none' END, 'Routing summary: ' || nullif(routing_summary, '')), ' ')"""


@query(f"""SELECT trace_id, review_id, created, reason, CASE WHEN created THEN coalesce(nullif(task, ''), user_prompt) END AS instruction, CASE WHEN created THEN {_PROMPT} END AS input, CASE WHEN created THEN said END AS output FROM (
    SELECT *, traced AND review_id IS NOT NULL AND said IS NOT NULL AS created, CASE WHEN review_id IS NULL THEN 'matching inference review was not found' WHEN NOT traced THEN 'matching inference trace was not found' WHEN status = 'corrected' AND said IS NOT NULL THEN 'corrected review used corrected_response'
        WHEN status = 'corrected' THEN 'corrected review is missing corrected_response' WHEN status = 'accepted' AND said IS NOT NULL THEN 'accepted review used original trace response' WHEN status = 'accepted' THEN 'accepted trace is missing response_text'
        ELSE 'review status ' || coalesce(status, 'None') || ' is not an output source' END AS reason
    FROM (SELECT coalesce(t.trace_id, r.trace_id) AS trace_id, r.review_id, t.trace_id IS NOT NULL AS traced, r.status, task, user_prompt, template_name, context_sources, routing_summary,
        CASE WHEN r.status = 'corrected' THEN nullif(r.corrected_response, '') WHEN r.status = 'accepted' THEN nullif(t.response_text, '') END AS said
        FROM {Q._TRACES} t FULL JOIN (SELECT review_id, lower(trim(trace_id)) AS trace_id, lower(trim(status)) AS status, corrected_response FROM {Q._REVIEWS}) r ON t.trace_id = r.trace_id))""")  # fmt: skip
def reviewed_trace_examples(spark: SparkSession, folder: str) -> DataFrame:
    reviews = S.reviews(spark, folder).select("review_id", F.lower(F.trim("trace_id")).alias("trace_id"), F.lower(F.trim("status")).alias("status"), "corrected_response")
    return examples.reviewed_traces(S.traces(spark, folder), reviews).select("trace_id", "review_id", "created", "reason", "instruction", "input", "output")


def _splits(rows: str) -> str:
    """CTE split (id, stratum, split) of a subquery (id, stratum)."""
    return f"""placed AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7:' || id), id) AS place, count(*) OVER (PARTITION BY stratum) AS n FROM (SELECT id, coalesce(stratum, 'unknown') AS stratum FROM {rows})),
    share AS (SELECT DISTINCT stratum, n, [0.8::DOUBLE * n, 0.1::DOUBLE * n, 0.1::DOUBLE * n] AS s FROM placed), part AS (SELECT *, list_transform(s, lambda x: x - floor(x)) AS f, n - list_sum(list_transform(s, lambda x: floor(x))) AS spare FROM share),
    whole AS (SELECT stratum, n, floor(s[1]) + CASE WHEN (f[2] > f[1])::INT + (f[3] > f[1])::INT < spare THEN 1 ELSE 0 END AS a, floor(s[2]) + CASE WHEN (f[1] >= f[2])::INT + (f[3] > f[2])::INT < spare THEN 1 ELSE 0 END AS b,
        floor(s[3]) + CASE WHEN (f[1] >= f[3])::INT + (f[2] >= f[3])::INT < spare THEN 1 ELSE 0 END AS c FROM part),
    given AS (SELECT stratum, n, CASE WHEN n = 1 THEN 1 ELSE a - CASE WHEN n >= 3 AND b = 0 AND a > 1 THEN 1 ELSE 0 END END AS a, CASE WHEN n = 1 THEN 0 WHEN n >= 3 AND b = 0 AND a > 1 THEN 1 ELSE b END AS b, CASE WHEN n = 1 THEN 0 ELSE c END AS c FROM whole),
    counts AS (SELECT stratum, a - CASE WHEN n >= 3 AND c = 0 AND a > 1 THEN 1 ELSE 0 END AS a, b FROM given),
    split AS (SELECT id, p.stratum, CASE WHEN place <= a THEN 'train' WHEN place <= a + b THEN 'validation' ELSE 'test' END AS split FROM placed p JOIN counts USING (stratum))"""


_EXAMPLES = "(SELECT example_id AS id, domains[1] AS stratum FROM training_examples)"
ORACLES["split_assign"] = f"WITH {_splits(_EXAMPLES)} SELECT * FROM split"
ORACLES["stratified_split_counts"] = f"WITH {_splits(_EXAMPLES)} SELECT stratum, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM split GROUP BY stratum"
_EXPORTED = "(SELECT * FROM training_examples WHERE validation_status IN ('validated', 'reviewed', 'synthetic_demo'))"
_PACKAGE = f"{_splits(f'(SELECT example_id AS id, domains[1] AS stratum FROM {_EXPORTED})')}, kept AS {_EXPORTED}"


def _package(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return examples.package(S.table(spark, folder, "training_examples").withColumnRenamed("example_id", "id"))


@query(f"""WITH {_PACKAGE} SELECT 'split' AS part, split AS value, count(*) AS n FROM split GROUP BY 2 UNION ALL SELECT 'status', validation_status, count(*) FROM kept GROUP BY 2 UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'unknown'), count(*) FROM kept GROUP BY 2
    UNION ALL SELECT 'license', coalesce(nullif(license, ''), 'unknown'), count(*) FROM kept GROUP BY 2 UNION ALL SELECT 'domain', value, count(*) FROM (SELECT unnest(domains) AS value FROM kept) WHERE value <> '' GROUP BY 2
    UNION ALL SELECT 'origin', coalesce(provenance['origin'], 'unknown'), count(*) FROM kept GROUP BY 2""")  # fmt: skip
def package_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _package(spark, folder)[1]


@query(f"WITH {_PACKAGE} SELECT * FROM split")
def package_splits(spark: SparkSession, folder: str) -> DataFrame:
    return _package(spark, folder)[0]


@query(f"""WITH {_PACKAGE}, c AS (SELECT validation_status AS s, count(*) AS n FROM training_examples WHERE validation_status IN ('raw', 'rejected') GROUP BY 1)
    SELECT n || ' ' || s || ' examples will be skipped by export policy.' AS warning FROM c UNION ALL
    SELECT 'Split ' || name || ' has fewer examples than min_examples_per_split.' FROM (SELECT unnest(['train', 'validation', 'test']) AS name) WHERE (SELECT count(*) FROM split) > 0 AND (SELECT count(*) FROM split WHERE split = name) < 200""")  # fmt: skip
def package_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return examples.package_warnings(S.table(spark, folder, "training_examples"), _package(spark, folder)[0], 200)


def _growth_decisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.checked_seeds(spark, folder)
    placed = rows.select("id", F.concat(F.lit("cluster:"), F.coalesce(F.get("domains", 0), F.lit("general"))).alias("cluster_id"))
    return growth.growth_decisions(rows, rows.select("id", "confidence"), placed)


@query(f"WITH {_DECIDED} SELECT * FROM decided")
def growth_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _growth_decisions(spark, folder).withColumn("confidence", F.round("confidence", 3))


@query(f"WITH {_DECIDED} SELECT sum(n)::BIGINT || ' growth decisions: ' || string_agg(action || '=' || n, ', ' ORDER BY action) AS summary FROM (SELECT action, count(*) AS n FROM decided GROUP BY action)")
def growth_action_summary(spark: SparkSession, folder: str) -> DataFrame:
    return growth.action_summary(_growth_decisions(spark, folder))


@query(f"WITH {_DECIDED} SELECT id, action FROM decided ORDER BY id LIMIT 50")
def growth_plan_first(spark: SparkSession, folder: str) -> DataFrame:
    """A plan with its limit of decisions."""
    return growth.first_decisions(_growth_decisions(spark, folder), "id", 50).select("id", "action")


@query(f"""SELECT cluster_id, round(count(*) FILTER (own = domain) / count(*), 3) AS consistency FROM (SELECT x.source AS cluster_id, m.domains[1] AS domain, string_split({domains('t')}, ',')[1] AS own
    FROM (SELECT source, {Q.terms("concat_ws(' ', instruction, output)")} AS t FROM mix_rows WHERE source IS NOT NULL) x LEFT JOIN dataset_manifests m ON x.source = m.source) GROUP BY cluster_id""")  # fmt: skip
def domain_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as clusters: how often the domain of a row's words is the first of its manifest."""
    first = S.table(spark, folder, "dataset_manifests").select("source", F.get("domains", 0).alias("domain"))
    rows = S.table(spark, folder, "mix_rows").select(F.col("row_id").alias("id"), "source", F.get(T.domains_of(T.terms(F.concat_ws(" ", "instruction", "output"))), 0).alias("own"))
    return growth.domain_consistency(rows.join(first, "source", "left").select("id", F.col("source").alias("cluster_id"), "domain"), rows.select("id", "own"))


_MODULE_TERMS = ", ".join(f"({Q.quoted(m[0])}, {Q.quoted(t)})" for m in L.MODULES for t in dict.fromkeys(__import__("re").findall("[a-z0-9]+", " ".join([m[1], *m[2]]).lower())))


@query(f"""WITH {Q._routes(Q._TRACE_TASKS)}, own AS (SELECT name AS memory, unnest(flatten(list_transform(coalesce(domains, []), lambda d: {Q.terms('d')}))) AS term FROM dataset_manifests), chosen AS (SELECT task_id, module FROM r WHERE selected)
    SELECT DISTINCT task_id, memory FROM chosen JOIN (VALUES {_MODULE_TERMS}) AS mt(module, term) USING (module) JOIN own USING (term) UNION
    SELECT task_id, name FROM chosen, dataset_manifests WHERE len(coalesce(domains, [])) = 0""")  # fmt: skip
def relevant_memories(spark: SparkSession, folder: str) -> DataFrame:
    modules = routing.module_table(spark)
    return retrieval.relevant_memories(routing.route(S.trace_tasks(spark, folder), modules), S.table(spark, folder, "dataset_manifests").select(F.col("name").alias("memory"), "domains"), modules)


def _context(spark: SparkSession, folder: str) -> DataFrame:
    tasks, memory = S.trace_tasks(spark, folder), S.manifest_memory(spark, folder)
    return retrieval.build_context(routing.route(tasks, routing.module_table(spark)), retrieval.search_memory(tasks, memory, limit=3), memory)


_CONTEXT = f"""{Q._routes(Q._TRACE_TASKS)}, {Q._SEARCH},
    own AS (SELECT task_id, 0 AS part, rank AS place, 'module:' || module AS source, 'route-scoped context of ' || module AS content, round(CASE WHEN max(score) OVER (PARTITION BY task_id) > 0 THEN score / max(score) OVER (PARTITION BY task_id) ELSE score END, 4) AS relevance FROM r WHERE selected),
    held AS (SELECT t.task_id, 1 AS part, row_number() OVER (PARTITION BY t.task_id ORDER BY relevance DESC, 'memory:memory:' || t.source || ':' || record_id) AS place, 'memory:memory:' || t.source || ':' || record_id AS source, content, relevance FROM top t JOIN mem USING (record_id) WHERE t.task_id IN (SELECT task_id FROM own)),
    both_ AS (SELECT * FROM own UNION ALL SELECT * FROM held WHERE place <= 2), ctx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY part, place) AS position FROM both_) WHERE position <= 5)"""


@query(f"WITH {_CONTEXT} SELECT task_id, count(*) FILTER (NOT starts_with(source, 'memory:')) AS stub, count(*) FILTER (starts_with(source, 'memory:')) AS memory, round(least(0.95, 0.55 + 0.08 * count(*)), 4)::DOUBLE AS confidence FROM ctx GROUP BY task_id")
def context_summary(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.context_summary(_context(spark, folder))


def _short(text: str, limit: int = 120) -> str:
    plain = Q.squashed(text)
    return f"CASE WHEN length({plain}) <= {limit} THEN {plain} ELSE regexp_replace(left({plain}, {limit - 3}), ' +$', '') || '...' END"


@query(f"WITH {_CONTEXT} SELECT task_id, string_agg('Use traces context from ' || source || ': ' || {_short('content')}, chr(10) ORDER BY relevance DESC, source, content) AS details FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY relevance DESC, source, content) AS rn FROM ctx) WHERE rn <= 2 GROUP BY task_id")
def context_details(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.context_details(_context(spark, folder), "traces").select("task_id", F.array_join("details", "\n").alias("details"))


def _coverage(expected: str, observed: str) -> str:
    return f"CASE WHEN len(coalesce({expected}, [])) = 0 THEN 1.0 ELSE round(len(list_filter({expected}, lambda e: list_contains({observed}, lower(e)))) / len({expected}), 3) END"


_LABELS = "(VALUES " + ", ".join(f"({Q.quoted(m)}, {Q.quoted(d)})" for m, d in L.MODULE_LABELS.items()) + ") AS lab(module, label)"
_CASES = f"""cs AS (SELECT trace_id AS case_id, task, selected_modules AS em, string_split({domains(Q.terms('task'))}, ',') AS ed, coalesce(k.kw[1:5], []) AS ek FROM {Q._TRACES} t LEFT JOIN {Q.top_keywords(Q._TRACES, 'trace_id', 'task')} k USING (trace_id))"""


def _scored(context: str, extra: str = "[]", growth: str = "0.0") -> str:
    """CTE bench (case_id, routing, context, growth, overall) from a CTE of context items."""
    return f"""plan AS (SELECT list(DISTINCT w) AS pt FROM (SELECT unnest({Q.terms('description')}) AS w FROM dataset_manifests)), sel AS (SELECT task_id AS case_id, list(DISTINCT lower(module)) AS mods, list(DISTINCT lower(coalesce(label, module))) AS doms FROM r LEFT JOIN {_LABELS} USING (module) WHERE selected GROUP BY task_id),
    txt AS (SELECT task_id AS case_id, string_agg(content, ' ' ORDER BY position) AS body FROM {context} GROUP BY task_id),
    sc AS (SELECT cs.case_id, round({_coverage('ed', 'coalesce(doms, [])')} * 0.45 + {_coverage('em', 'coalesce(mods, [])')} * 0.55, 3) AS routing, {_coverage('ek', f"list_concat({Q.terms("concat_ws(' ', task, body)")}, {extra})")} AS context, {growth} AS growth FROM cs CROSS JOIN plan LEFT JOIN sel USING (case_id) LEFT JOIN txt USING (case_id)),
    bench AS (SELECT case_id, routing::DOUBLE AS routing, context::DOUBLE AS context, growth::DOUBLE AS growth, round(routing * 0.5 + context * 0.35 + growth * 0.15, 3)::DOUBLE AS overall FROM sc)"""


_PLAN_TERMS = "pt"
_GROWTH = f"round({_coverage('ed', _PLAN_TERMS)} * 0.4 + {_coverage('ek', _PLAN_TERMS)} * 0.6, 3)"


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "dataset_manifests").select(F.col("description").alias("text"))


def _near(frame: DataFrame) -> DataFrame:
    """Overall to two digits: its third one may differ by how halves are rounded."""
    return frame.withColumn("overall", F.round("overall", 2))


@query(f"WITH {_CASES}, {_CONTEXT}, {_scored('ctx')} SELECT case_id, routing, context, growth FROM bench")
def bench_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Traces as cases, with manifests as memory."""
    return benchmark.run_cases(S.trace_cases(spark, folder), routing.module_table(spark), S.manifest_memory(spark, folder)).select("case_id", "routing", "context", "growth")


@query(f"WITH {_CASES}, {_CONTEXT}, {_scored('ctx', _PLAN_TERMS, _GROWTH)} SELECT case_id, routing, context, growth FROM bench")
def bench_growth_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the manifests' descriptions as growth plan."""
    return benchmark.run_cases(S.trace_cases(spark, folder), routing.module_table(spark), S.manifest_memory(spark, folder), _plan(spark, folder)).select("case_id", "routing", "context", "growth")


@query(f"""SELECT * FROM (WITH {_CASES}, {_CONTEXT}, {_scored('(SELECT * FROM ctx WHERE part = 0)')} SELECT 'routing' AS run_id, count(*) AS cases, round(avg(routing), 2) AS routing, round(avg(context), 2) AS context, round(avg(growth), 2) AS growth FROM bench) UNION ALL
    SELECT * FROM (WITH {_CASES}, {_CONTEXT}, {_scored('ctx')} SELECT 'memory', count(*), round(avg(routing), 2), round(avg(context), 2), round(avg(growth), 2) FROM bench) UNION ALL
    SELECT * FROM (WITH {_CASES}, {_CONTEXT}, {_scored('ctx', _PLAN_TERMS, _GROWTH)} SELECT 'growth', count(*), round(avg(routing), 2), round(avg(context), 2), round(avg(growth), 2) FROM bench)""")  # fmt: skip
def bench_configs(spark: SparkSession, folder: str) -> DataFrame:
    """Mean scores of three configurations."""
    memory = S.manifest_memory(spark, folder)
    runs = benchmark.run_configs(S.trace_cases(spark, folder), routing.module_table(spark), {"routing": (None, None), "memory": (memory, None), "growth": (memory, _plan(spark, folder))})
    return runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(m), 2).alias(m) for m in ("routing", "context", "growth")])


_LAST = ", ".join(f"({Q.quoted(w)}, {Q.quoted(m)})" for w, m in (("baseline_check", "code-assistant"), ("baseline_check", "general-reasoning"), ("general_task", "document-search")))


@query(f"""WITH said AS (SELECT DISTINCT task_id, unnest({Q.terms('task')}) AS term FROM {Q._TRACE_TASKS}), scored AS (SELECT task_id, module, cost, sum(weight)::DOUBLE AS score FROM said JOIN {Q._module_index()} USING (term) GROUP BY ALL),
    open_ AS (SELECT s.* FROM scored s JOIN {Q._TRACES} t ON s.task_id = t.trace_id WHERE t.template_name IS NULL OR t.template_name NOT IN ('baseline_check', 'general_task') OR (t.template_name, module) IN (VALUES {_LAST})),
    r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, cost, module) <= 3 AND score >= 1.0 AS selected FROM open_), {_CASES}, ctx AS (SELECT task_id, 1 AS position, '' AS content FROM r WHERE false), {_scored('ctx')} SELECT case_id, routing FROM bench""")  # fmt: skip
def bench_workspace_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Routing scores where two workspaces allow some modules only."""
    allowed = spark.createDataFrame([("baseline_check", "code-assistant"), ("baseline_check", "general-reasoning"), ("general_task", "document-search")], "workspace string, module string")
    return benchmark.run_cases(S.trace_cases(spark, folder), routing.module_table(spark), allowed=allowed).select("case_id", "routing")


@query(f"""SELECT run_id, created_at, trace_id FROM (SELECT adapter_name AS run_id, created_at, trace_id, row_number() OVER (PARTITION BY adapter_name ORDER BY created_at DESC, trace_id DESC) AS rn FROM {Q._TRACES}) WHERE rn = 1""")
def last_runs(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.last_runs(S.traces(spark, folder).select(F.col("adapter_name").alias("run_id"), "created_at", "trace_id"))


@query("""SELECT example_id, CASE WHEN json_type(metadata, '$.dataset_language') = 'VARCHAR' THEN json_extract_string(metadata, '$.dataset_language') ELSE 'unknown' END AS language FROM training_examples""")
def typed_fields(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.table(spark, folder, "training_examples")
    return rows.select("example_id", jsonl.optional_text(F.col("metadata"), "dataset_language", "unknown").alias("language"))


@query("SELECT row_id, instruction, output, true AS same FROM mix_rows")
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written as records and read back."""
    rows = S.table(spark, folder, "mix_rows").select("row_id", "instruction", "output")
    back = jsonl.records_of(jsonl.native(rows), "row_id bigint, instruction string, output string")
    both = back.join(rows.select("row_id", F.col("instruction").alias("i"), F.col("output").alias("o")), "row_id")
    return both.select("row_id", "instruction", "output", (F.col("instruction").eqNullSafe(F.col("i")) & F.col("output").eqNullSafe(F.col("o"))).alias("same"))


@query("SELECT row_id, CASE WHEN rn = 1 THEN base ELSE base || '-' || rn END AS unique_id FROM (SELECT row_id, coalesce(source, 'none') AS base, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY row_id) AS rn FROM mix_rows)")
def unique_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.table(spark, folder, "mix_rows").select("row_id", F.coalesce("source", F.lit("none")).alias("base"))
    return training.unique_ids(rows, "base", "row_id").select("row_id", "unique_id")


@query(f"""SELECT row_id FROM (SELECT row_id, sha256('7:' || row_id) AS k FROM mix_rows WHERE {Q.trimmed("coalesce(instruction, '')")} <> '' AND {Q.trimmed("coalesce(output, '')")} <> '' AND length(instruction) <= 5000 AND length(coalesce(input, '')) <= 5000 AND length(output) <= 5000
    AND NOT {Q.has_any("lower(instruction || chr(10) || output)", L.REFUSAL_MARKERS)}) ORDER BY substr(k, 1, 4) < '2666', k LIMIT 100""")  # fmt: skip
def stream_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of a stream: rows normalized, filtered, put in hash order and limited."""
    rows = S.table(spark, folder, "mix_rows")
    return ingest.scanned(rows, lambda f: f.select("row_id", "instruction", "input", "output"), 100, key="row_id").select("row_id")


@query(f"SELECT doc_id, {slug('source')} AS slug, {_short('text', 40)} AS short FROM documents")
def text_labels(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "documents").select("doc_id", T.slug(F.col("source")).alias("slug"), T.shortened(F.col("text"), 40).alias("short"))


@query("SELECT value, min(place)::INTEGER AS place FROM (SELECT source AS value, 0 AS place FROM dataset_manifests UNION ALL SELECT source, 1 FROM mix_rows UNION ALL SELECT source, 2 FROM training_examples) GROUP BY value")
def sources_by_table(spark: SparkSession, folder: str) -> DataFrame:
    return examples.first_of([S.table(spark, folder, t) for t in ("dataset_manifests", "mix_rows", "training_examples")], "source")


ORACLES["orchestrate"] = f"""WITH {Q._routes(Q._TRACE_TASKS)}, kw AS {Q.top_keywords(Q._TRACE_TASKS, 'task_id', 'task')}
    SELECT task_id, string_agg(module, ',' ORDER BY rank, module) AS modules, string_agg(CASE module WHEN 'code-assistant' THEN 'code: ' || {_short('task', 40)} WHEN 'document-search' THEN 'search: ' || array_to_string(coalesce(kw, [])[1:3], ' ') ELSE 'reason' END, chr(10) ORDER BY rank, module) AS text
    FROM r JOIN {Q._TRACE_TASKS} t USING (task_id) LEFT JOIN kw USING (task_id) WHERE selected GROUP BY task_id"""


_CANONICAL = f"""e AS MATERIALIZED ({Q.ORACLES['near_dup_edges']}), js AS MATERIALIZED (SELECT row_number() OVER (ORDER BY j) AS n, * FROM (SELECT j, list(DISTINCT i ORDER BY i) AS firsts FROM e GROUP BY j)),
    scan(n, j, of, gone) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] UNION ALL
        SELECT n, j, of, CASE WHEN of IS NULL THEN gone ELSE list_append(gone, j) END FROM (SELECT js.n, js.j, gone, list_filter(firsts, lambda i: NOT list_contains(gone, i))[1] AS of FROM scan JOIN js ON js.n = scan.n + 1)),
    canon AS (SELECT row_id AS id, of AS duplicate_of FROM mix_rows LEFT JOIN (SELECT j, of FROM scan WHERE of IS NOT NULL) ON j = row_id)"""
ORACLES["near_dup_canonical"] = f"WITH RECURSIVE {_CANONICAL} SELECT * FROM canon"
ORACLES["seed_review_decisions"] = f"""WITH RECURSIVE {_CANONICAL}, val AS ({Q.ORACLES['seed_validation']}), conf AS ({Q.ORACLES['conflict_summary']})
    SELECT v.id, CASE WHEN status = 'rejected' THEN 'reject_broken' WHEN duplicate_of IS NOT NULL THEN 'merge_duplicate' WHEN severity IN ('medium', 'high') THEN 'quarantine_conflict' WHEN severity IS NOT NULL THEN 'needs_review' WHEN status IN ('weak', 'quarantined') THEN 'quarantine_weak' ELSE 'promote_candidate' END AS decision, score, duplicate_of
    FROM val v LEFT JOIN canon USING (id) LEFT JOIN conf USING (id)"""


def _clustered(chosen: str = "true") -> str:
    """CTE placed (id, domain, number, position, score, kw) of the seeds n that a condition chooses, by the sequential rule."""
    return f"""{Q._NORMAL}, seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS n FROM (SELECT id, kw, coalesce(list_filter(list_transform(domains, lambda d: {Q.normalized('d')}), lambda d: d <> '')[1], 'general') AS domain FROM nt WHERE {chosen})),
    grown(domain, n, id, held, members, best, score) AS (SELECT DISTINCT domain, 0::BIGINT, NULL::BIGINT, []::VARCHAR[][], []::INTEGER[], 0::BIGINT, 0.0::DOUBLE FROM seq UNION ALL
        SELECT domain, n, id, CASE WHEN best <= len(held) THEN list_transform(held, lambda x, i: CASE WHEN i = best THEN list_distinct(list_concat(x, kw)) ELSE x END) ELSE list_append(held, kw) END,
            CASE WHEN best <= len(held) THEN list_transform(members, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END) ELSE list_append(members, 1) END, best, CASE WHEN best <= len(held) THEN top ELSE 1.0 END
        FROM (SELECT *, CASE WHEN top >= 0.35 THEN list_position(sc, top) ELSE len(held) + 1 END AS best FROM (SELECT *, coalesce(list_max(sc), 0.0) AS top FROM (
            SELECT g.domain, s.n, s.id, s.kw, held, members, list_transform(held, lambda x: CASE WHEN least(len(x), len(s.kw)) > 0 THEN len(list_intersect(x, s.kw)) / least(len(x), len(s.kw)) ELSE 0.0 END) AS sc
            FROM grown g JOIN seq s ON s.domain = g.domain AND s.n = g.n + 1)))),
    placed AS (SELECT id, domain, 'cluster:' || {slug('domain').replace("'unknown'", "'general'")} || ':' || lpad(best::VARCHAR, 4, '0') AS cluster_id, members[best] AS position, score FROM grown WHERE id IS NOT NULL)"""


_SUMMARY = """qual AS (SELECT p.*, round(confidence * 0.55 + reliability * 0.45, 3) AS q, confidence FROM placed p JOIN seed USING (id)),
    raw AS (SELECT cluster_id, domain, count(*) AS seeds, greatest(0.0::DOUBLE, least(1.0::DOUBLE, avg(q) + least((count(*) - 1) * 0.05::DOUBLE, 0.15::DOUBLE) - CASE WHEN count(*) = 1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END - count(*) FILTER (confidence < 0.6) * 0.03::DOUBLE)) AS v FROM qual GROUP BY ALL),
    two AS (SELECT *, v * 1000.0::DOUBLE AS p, 134217729.0::DOUBLE * v - (134217729.0::DOUBLE * v - v) AS hi FROM raw), err AS (SELECT *, (hi * 1000.0::DOUBLE - p) + (v - hi) * 1000.0::DOUBLE AS err, floor(p) AS fl FROM two),
    summed AS (SELECT cluster_id, domain, seeds, CASE WHEN p - fl < 0.5 THEN fl WHEN p - fl > 0.5 THEN fl + 1 WHEN err < 0 THEN fl WHEN err > 0 THEN fl + 1 WHEN fl % 2 = 0 THEN fl ELSE fl + 1 END / 1000.0::DOUBLE AS confidence FROM err)"""
_ACTIONS = """acted AS (SELECT cluster_id, unnest(list_filter(CASE WHEN confidence < 0.6 THEN ['mark_cluster_needs_review'] ELSE ['create_candidate_cluster', CASE WHEN seeds >= 2 THEN 'strengthen_cluster' END, 'create_memory_record', CASE WHEN seeds >= 3 THEN 'suggest_expert_candidate' END] END, lambda a: a IS NOT NULL)) AS action,
    CASE WHEN confidence < 0.6 THEN greatest(confidence, 0.5) ELSE confidence END AS confidence FROM summed)"""
_WORDS = "words AS (SELECT cluster_id, list(k ORDER BY n DESC, k)[1:12] AS keywords FROM (SELECT cluster_id, k, count(*) AS n FROM (SELECT cluster_id, unnest(kw) AS k FROM placed JOIN seq USING (id)) GROUP BY ALL) GROUP BY cluster_id)"
ORACLES["clusters"] = f"WITH RECURSIVE {_clustered()} SELECT * FROM placed"
ORACLES["cluster_confidence"] = f"WITH RECURSIVE {_clustered()}, {_SUMMARY} SELECT * FROM summed"
ORACLES["growth_plan_actions"] = f"WITH RECURSIVE {_clustered()}, {_SUMMARY}, {_ACTIONS} SELECT * FROM acted"
ORACLES["plan_memory_records"] = f"""WITH RECURSIVE {_clustered()}, {_SUMMARY}, {_ACTIONS}, {_WORDS}
    SELECT cluster_id AS record_id, cluster_id || ': ' || seeds || ' seeds about ' || array_to_string(keywords, ', ') AS content, [domain] AS domains, keywords, 'clusters' AS source FROM summed LEFT JOIN words USING (cluster_id) WHERE cluster_id IN (SELECT cluster_id FROM acted WHERE action = 'create_memory_record')"""


@query(f"""WITH RECURSIVE {_clustered("id % 3 = 0")} SELECT x.row_id AS id, p.id IS NOT NULL AS assigned, p.cluster_id, CASE WHEN row_id % 3 = 1 THEN 'missing review decision' WHEN row_id % 3 = 2 THEN 'review decision is needs_review' WHEN position = 1 THEN 'created new cluster' ELSE 'keyword overlap with cluster' END AS reason
    FROM mix_rows x LEFT JOIN placed p ON p.id = x.row_id""")  # fmt: skip
def reviewed_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """All seeds with made-up decisions: of three rows one is promoted, one has no decision and one is to be reviewed."""
    every = S.mix_seeds(spark, folder)
    kind = F.pmod("id", F.lit(3))
    decisions = every.where(kind != 1).select("id", F.when(kind == 0, "promote_candidate").otherwise("needs_review").alias("decision"))
    return growth.reviewed_clusters(every, decisions).select("id", "assigned", "cluster_id", "reason")
