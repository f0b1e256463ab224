"""SQL of the core queries for DuckDB, written from the definitions, not from the plans."""

from __future__ import annotations

import re

from sievewright.functions import lexicon as L
from sievewright.plans.tables import HANDLED

_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:  # noqa: ANN001
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def array(values) -> str:  # noqa: ANN001
    return "[" + ", ".join(quoted(v) for v in values) + "]::VARCHAR[]"


def trimmed(text: str) -> str:
    """Without outer blanks, and only those."""
    return f"regexp_replace({text}, '^ +| +$', '', 'g')"


def terms(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')"


def squashed(text: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({text}, ''), '{_SPACES}', ' ', 'g'), '^ | $', '', 'g')"


def normalized(text: str) -> str:
    return squashed(f"translate(lower(coalesce({text}, '')), '{_PUNCTUATION}', '{' ' * 32}')")


def content_terms(text: str) -> str:
    return f"list_filter({terms(text)}, lambda t: length(t) > 2 AND t NOT IN {listed(L.STOP_WORDS)})"


def has_any(text: str, parts) -> str:  # noqa: ANN001
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in parts) + ")"


def top_keywords(rows: str, key: str, text: str) -> str:
    """Subquery (key, kw): twelve keywords per row, by count, then name."""
    return f"""(SELECT {key}, list(t ORDER BY n DESC, t)[1:12] AS kw FROM (SELECT {key}, t, count(*) AS n FROM (SELECT {key}, unnest({content_terms(text)}) AS t FROM {rows}) GROUP BY ALL) GROUP BY {key})"""


def _module_index() -> str:
    rows = []
    for name, domain, capabilities, keywords, cost in L.MODULES:
        for words, weight in (([domain], 2.0), (keywords, 1.5), (capabilities, 1.0)):
            for t in dict.fromkeys(t for w in words for t in re.findall("[a-z0-9]+", w.lower())):
                rows.append(f"({quoted(name)}, {cost}, {quoted(t)}, {weight})")
    return "(VALUES " + ", ".join(rows) + ") AS idx(module, cost, term, weight)"


def _routes(tasks: str) -> str:
    """CTE r (task_id, module, score, rank, selected) from a subquery (task_id, task)."""
    return f"""said AS (SELECT DISTINCT task_id, unnest({terms('task')}) AS term FROM {tasks}),
    scored AS (SELECT task_id, module, cost, sum(weight)::DOUBLE AS score FROM said JOIN {_module_index()} USING (term) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, cost, module) AS rank FROM scored),
    r AS (SELECT *, rank <= 3 AND score >= 1.0 AS selected FROM ranked)"""


_DOC_TASKS = "(SELECT doc_id AS task_id, text AS task FROM documents)"
_TRACES = "(SELECT * FROM inference_traces QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY ingested_at) = 1)"
_REVIEWS = "(SELECT * FROM inference_reviews QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY ingested_at) = 1)"
_TRACE_TASKS = f"(SELECT trace_id AS task_id, task FROM {_TRACES})"
_FEEDBACK = f"""(SELECT t.selected_modules, r.rating, CASE WHEN lower(trim(status)) IN ('accepted', 'corrected') THEN true WHEN lower(trim(status)) IN ('rejected', 'unsafe') THEN false END AS success,
    coalesce(r.rating, 3) / 5 AS confidence FROM {_REVIEWS} r JOIN {_TRACES} t ON lower(trim(r.trace_id)) = t.trace_id)"""
_STATS = f"""(SELECT module, count(*) AS times_selected, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, round(avg(rating), 4) AS average_rating,
    round(avg(confidence), 4) AS average_confidence, round(count(*) FILTER (success) / nullif(count(*) FILTER (success) + count(*) FILTER (NOT success), 0), 4) AS success_rate
    FROM (SELECT unnest(selected_modules) AS module, rating, success, confidence FROM {_FEEDBACK}) GROUP BY module)"""

_REASONS = """(SELECT task_id, module, concat_ws('; ', nullif(concat('domain match: ', string_agg(term, ', ' ORDER BY term) FILTER (weight = 2.0)), 'domain match: '),
    nullif(concat('keyword match: ', string_agg(term, ', ' ORDER BY term) FILTER (weight = 1.5)), 'keyword match: '), nullif(concat('capability match: ', string_agg(term, ', ' ORDER BY term) FILTER (weight = 1.0)), 'capability match: ')) AS reasons
    FROM said JOIN """ + _module_index() + """ USING (term) GROUP BY ALL)"""

_MEMORY = "(SELECT name AS record_id, concat_ws(' ', name, description) AS content, domains, capabilities AS keywords, source FROM dataset_manifests)"
_SEARCH = f"""mem AS {_MEMORY},
    kw AS (SELECT DISTINCT record_id, unnest(flatten(list_transform(keywords, lambda k: {terms('k')}))) AS term FROM mem),
    ct AS (SELECT DISTINCT record_id, unnest({terms('content')}) AS term FROM mem),
    entries AS (SELECT record_id, term, 1.5 AS weight FROM kw UNION ALL SELECT record_id, term, 0.5 FROM (SELECT * FROM ct EXCEPT SELECT * FROM kw)),
    asked AS (SELECT DISTINCT task_id, unnest({terms('task')}) AS term FROM {_TRACE_TASKS}),
    hit AS (SELECT task_id, record_id, sum(weight)::DOUBLE AS score FROM asked JOIN entries USING (term) GROUP BY ALL),
    found AS (SELECT task_id, record_id, source, score, round(score / max(score) OVER (PARTITION BY task_id), 4) AS relevance, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, source, record_id) AS rank FROM hit JOIN mem USING (record_id)),
    top AS (SELECT * FROM found WHERE rank <= 3)"""

_SAMPLE = f"""(SELECT row_id AS id, concat_ws(' ', nullif({squashed('instruction')}, ''), nullif({squashed('input')}, ''), nullif({squashed('output')}, '')) AS content, {squashed('instruction')} AS instruction, {squashed('output')} AS output,
    m.domains, coalesce(CAST(json_extract_string(m.metadata, '$.reliability') AS DOUBLE), 0.5) AS reliability, m.license IS NOT NULL AND NOT {has_any("lower(trim(coalesce(m.license, '')))", L.BLOCKED_LICENSES)} AS licensed
    FROM mix_rows x LEFT JOIN dataset_manifests m ON x.source = m.source)"""
_STRIP = r"""^[.,:;!?()\[\]{}"]+|[.,:;!?()\[\]{}"]+$"""
_REVIEW = f"""s AS (SELECT *, {squashed('content')} AS t FROM {_SAMPLE}),
    w AS (SELECT *, sha256(lower(t)) AS h, len(list_distinct({content_terms('content')})) AS nk, list_filter(list_transform(string_split(t, ' '), lambda x: lower(regexp_replace(x, '{_STRIP}', '', 'g'))), lambda x: x <> '') AS toks,
        list_filter({array(L.SUSPICIOUS_MARKERS)}, lambda m: contains(lower(t), m)) AS found FROM s),
    f AS (SELECT w.*, min(CASE WHEN t <> '' AND licensed THEN id END) OVER (PARTITION BY h) AS first_id FROM w),
    c AS (SELECT *, length(t) < 40 AS c1, instruction <> '' AND length(instruction) < 8 AS c2, output = '' AS c3, output <> '' AND length(output) < 12 AS c4, len(toks) < 5 OR len(list_distinct(toks)) < 0.35 * len(toks) AS c5, len(found) > 0 AS c6 FROM f),
    q AS (SELECT *, greatest(0.0, least(least(length(t) / 240, 1.0) * 0.35 + CASE WHEN len(coalesce(domains, [])) > 0 THEN 1.0 ELSE 0.25 END * 0.2 + least(nk / 5, 1.0) * 0.2 + reliability * 0.25
        - (CASE WHEN c1 THEN 0.45 ELSE 0.0 END + CASE WHEN c2 THEN 0.2 ELSE 0.0 END + CASE WHEN c3 THEN 0.55 ELSE 0.0 END + CASE WHEN c4 THEN 0.35 ELSE 0.0 END + CASE WHEN c5 THEN 0.25 ELSE 0.0 END + CASE WHEN c6 THEN 0.25 ELSE 0.0 END), 1.0)) AS raw,
        list_filter([CASE WHEN c1 THEN 'content is too short' END, CASE WHEN c2 THEN 'instruction is too short' END, CASE WHEN c3 THEN 'output or assistant answer is missing' END, CASE WHEN c4 THEN 'output is too short' END,
        CASE WHEN c5 THEN 'content has low information density' END, CASE WHEN c6 THEN 'suspicious marker detected: ' || array_to_string(found, ', ') END], lambda x: x IS NOT NULL) AS told FROM c),
    d AS (SELECT *, CASE WHEN t = '' THEN 'rejected_empty' WHEN NOT licensed THEN 'rejected_license' WHEN id <> first_id THEN 'rejected_duplicate' WHEN c1 OR c3 OR c4 THEN 'rejected_too_short' WHEN raw < 0.62 OR c6 THEN 'needs_human_review' ELSE 'accepted' END AS decision FROM q),
    review AS (SELECT id, decision, CASE WHEN decision IN ('rejected_empty', 'rejected_license', 'rejected_duplicate') THEN 0.0 ELSE raw END AS score, reliability,
        CASE decision WHEN 'rejected_empty' THEN ['content is empty'] WHEN 'rejected_license' THEN ['license is not allowed for review promotion'] WHEN 'rejected_duplicate' THEN ['duplicate normalized content']
        WHEN 'accepted' THEN list_append(told, 'sample passed deterministic review checks') ELSE CASE WHEN len(told) = 0 THEN ['quality score is below human review threshold'] ELSE told END END AS reasons FROM d)"""

_SEEDS = f"""s AS (SELECT * FROM {_SAMPLE}), k AS {top_keywords('s', 'id', 'content')}, seed AS (SELECT s.id, content, coalesce(domains, []) AS domains, coalesce(kw, []) AS kw, reliability AS confidence, reliability FROM s LEFT JOIN k USING (id))"""
_POLARITY = f"CASE WHEN {has_any('norm', [n for _, n in L.OPPOSITES] + list(L.NEGATION_MARKERS))} THEN -1 WHEN {has_any('norm', [p for p, _ in L.OPPOSITES])} THEN 1 ELSE 0 END"
_NORMAL = f"""{_SEEDS}, n AS (SELECT *, {normalized('content')} AS norm, list_distinct(list_filter(list_transform(domains, lambda d: {normalized('d')}), lambda d: d <> '')) AS dom FROM seed),
    nt AS (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS toks, {_POLARITY} AS pol FROM n)"""
_VALID = f"""{_SEEDS}, v AS (SELECT *, {squashed('content')} AS t, lower({squashed('content')}) AS low FROM seed),
    v2 AS (SELECT *, list_filter(string_split({squashed("translate(low, '.,', '  ')")}, ' '), lambda x: x <> '') AS toks FROM v),
    cnt AS (SELECT id, max(n) AS most FROM (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(toks) AS x FROM v2) GROUP BY ALL) GROUP BY id),
    v3 AS (SELECT v2.*, low IN {listed(L.GENERIC_CONTENT)} OR len(toks) < 5 OR most > 0.55 * len(toks) AS generic,
        CASE WHEN t = '' THEN 0.0 ELSE greatest(0.0, least(reliability * 0.35::DOUBLE + confidence * 0.35::DOUBLE + least(length(t) / 80, 1.0::DOUBLE) * 0.15::DOUBLE + CASE WHEN len(domains) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.075::DOUBLE + least(len(kw) / 4, 1.0::DOUBLE) * 0.075::DOUBLE, 1.0)) END AS raw FROM v2 LEFT JOIN cnt USING (id)),
    r1 AS (SELECT *, raw * 1000.0::DOUBLE AS p, 134217729.0::DOUBLE * raw - (134217729.0::DOUBLE * raw - raw) AS hi FROM v3),
    r2 AS (SELECT *, (hi * 1000.0::DOUBLE - p) + (raw - hi) * 1000.0::DOUBLE AS err, floor(p) AS fl FROM r1),
    r3 AS (SELECT *, CASE WHEN p - fl < 0.5 THEN fl WHEN p - fl > 0.5 THEN fl + 1 WHEN err < 0 THEN fl WHEN err > 0 THEN fl + 1 WHEN fl % 2 = 0 THEN fl ELSE fl + 1 END / 1000.0::DOUBLE AS score FROM r2),
    v4 AS (SELECT *, CASE WHEN t = '' THEN [] ELSE list_filter([CASE WHEN length(t) < 40 THEN 'content is short' END, CASE WHEN reliability < 0.5 THEN 'source reliability is low' END, CASE WHEN confidence < 0.4 THEN 'seed confidence is low' END,
        CASE WHEN len(domains) = 0 THEN 'domains are missing' END, CASE WHEN len(kw) = 0 THEN 'keywords are missing' END, CASE WHEN generic THEN 'content looks generic' END], lambda x: x IS NOT NULL) END AS warn FROM r3),
    valid AS (SELECT id, score, array_to_string(warn, '; ') AS warnings, CASE WHEN t = '' OR reliability <= 0.05 THEN 'rejected' WHEN confidence < 0.25 OR score < 0.35 OR generic THEN 'quarantined' WHEN score < 0.7 OR len(warn) > 0 THEN 'weak' ELSE 'validated' END AS status FROM v4)"""

_SHARED = "len(list_intersect(a.{0}, b.{0})) / least(len(a.{0}), len(b.{0}))"
_CONFLICT = f"""{_NORMAL}, p AS (SELECT a.id AS left_id, b.id AS right_id, CASE WHEN least(len(a.nkw), len(b.nkw)) > 0 THEN {_SHARED.format('nkw')} ELSE 0.0 END AS k, CASE WHEN least(len(a.toks), len(b.toks)) > 0 THEN {_SHARED.format('toks')} ELSE 0.0 END AS x, least(a.reliability, b.reliability) AS rel
    FROM (SELECT *, kw AS nkw FROM nt WHERE pol <> 0) a JOIN (SELECT *, kw AS nkw FROM nt WHERE pol <> 0) b ON a.id < b.id AND a.pol <> b.pol AND list_has_any(a.dom, b.dom)),
    conf AS (SELECT left_id, right_id, CASE WHEN rel < 0.4 THEN 'low' WHEN k >= 0.75 OR x >= 0.65 THEN 'high' ELSE 'medium' END AS severity, round(k, 3) AS keyword_overlap, round(x, 3) AS text_overlap FROM p WHERE k >= 0.25 OR x >= 0.25)"""
_RESULTS = f"""(SELECT *, round(routing * 0.5 + context * 0.35 + growth * 0.15, 9) AS overall FROM (SELECT adapter_name AS run_id, concat_ws('/', template_name, model) AS case_id,
    round(avg(least(coalesce(len(selected_modules), 0) / 3, 1.0)), 6) AS routing, round(avg(least(coalesce(len(context_sources), 0) / 4, 1.0)), 6) AS context, round(avg(CASE WHEN error IS NULL THEN 1.0 ELSE 0.0 END), 6) AS growth FROM {_TRACES} GROUP BY ALL))"""
_DELTAS = f"""b AS (SELECT * FROM {_RESULTS} WHERE run_id = 'static-local'), c AS (SELECT * FROM {_RESULTS} WHERE run_id = 'lora-small'),
    delta AS (SELECT coalesce(b.case_id, c.case_id) AS case_id, {', '.join(f'round(round(coalesce(c.{m}, 0) - coalesce(b.{m}, 0), 9), 3) AS {m}_delta' for m in ('overall', 'routing', 'context', 'growth'))},
    b.case_id IS NULL AS only_c, c.case_id IS NULL AS only_b FROM b FULL JOIN c ON b.case_id = c.case_id),
    cmp AS (SELECT case_id, overall_delta, routing_delta, context_delta, growth_delta, CASE WHEN only_c THEN 'improved' WHEN only_b THEN 'regressed' WHEN overall_delta >= 0.02 THEN 'improved' WHEN overall_delta <= -0.02 THEN 'regressed' ELSE 'unchanged' END AS status FROM delta)"""
_DOMAINS = ", ".join(f"CASE WHEN list_has_any(t, {array(words)}) THEN {array(L.DOMAIN_LABELS.get(d, (d,)))} END" for d, words in L.DOMAIN_WORDS.items())
_CUES = " ".join(f"WHEN {has_any('low', cues)} THEN {quoted(name)}" for name, cues in L.SAMPLE_CUES)
_HASHED = f"(SELECT doc_id AS id, sha256(lower({squashed('text')})) AS h FROM documents)"

ORACLES: dict[str, str] = {
    "route_topk": f"WITH {_routes(_DOC_TASKS)} SELECT task_id AS doc_id, module, score, rank::INTEGER AS rank, reasons FROM r JOIN {_REASONS} USING (task_id, module) WHERE selected",
    "route_module_stats": f"WITH {_routes(_DOC_TASKS)} SELECT module, count(*) AS times_selected, round(avg(score), 6) AS mean_score FROM r WHERE selected GROUP BY module",
    "route_confidence": f"WITH {_routes(_DOC_TASKS)} SELECT task_id AS doc_id, round(round(coalesce(sum(CASE WHEN selected THEN score ELSE 0.0 END) / nullif(sum(score), 0), 0.0), 4), 3) AS confidence FROM r GROUP BY task_id",
    "feedback_module_stats": f"SELECT * FROM {_STATS}",
    "feedback_summary": f"SELECT count(*) AS records, round(coalesce(avg(confidence), 0.0), 4) AS average_confidence, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures FROM {_FEEDBACK}",
    "adaptive_adjustment": f"""SELECT module, round(greatest(-0.5, least(coalesce(0.15 * (successes - failures) / nullif(successes + failures, 0), 0.0) + coalesce(0.15 * (average_rating - 3.0) / 2.0, 0.0), 0.5)), 4) AS adjustment FROM {_STATS}""",
    "missing_handlers": f"SELECT DISTINCT module FROM (SELECT unnest(selected_modules) AS module FROM inference_traces) WHERE module NOT IN {listed(HANDLED)}",
    "memory_search_topk": f"WITH {_SEARCH} SELECT task_id, record_id, score, relevance, rank::INTEGER AS rank FROM top",
    "context_build": f"""WITH {_routes(_TRACE_TASKS)}, {_SEARCH},
        own AS (SELECT task_id, 0 AS part, rank AS place, 'module:' || module AS source, round(CASE WHEN max(score) OVER (PARTITION BY task_id) > 0 THEN score / max(score) OVER (PARTITION BY task_id) ELSE score END, 4) AS relevance FROM r WHERE selected),
        held AS (SELECT t.task_id, 1 AS part, row_number() OVER (PARTITION BY t.task_id ORDER BY relevance DESC, 'memory:memory:' || t.source || ':' || record_id) AS place, 'memory:memory:' || t.source || ':' || record_id AS source, relevance FROM top t WHERE t.task_id IN (SELECT task_id FROM own)),
        both_ AS (SELECT * FROM own UNION ALL SELECT * FROM held WHERE place <= 2)
        SELECT task_id, position::INTEGER AS position, source, relevance FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY part, place) AS position FROM both_) WHERE position <= 5""",
    "keywords_topk": f"""SELECT doc_id, rank::INTEGER AS rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({content_terms('text')}) AS term FROM documents) GROUP BY ALL)) WHERE rank <= 12""",
    "domain_assign": f"""SELECT doc_id, coalesce(nullif(array_to_string(flatten(list_filter([{_DOMAINS}], lambda x: x IS NOT NULL)), ','), ''), '{L.FALLBACK_DOMAIN}') AS domains FROM (SELECT doc_id, {terms('text')} AS t FROM documents)""",
    "sample_type": f"""SELECT row_id, CASE {_CUES} WHEN contains(t, '?') THEN 'factual_qa' ELSE 'instruction' END AS sample_type FROM (SELECT row_id, concat_ws(' ', instruction, output) AS t, lower(concat_ws(' ', instruction, output)) AS low FROM mix_rows)""",
    "conversation_samples": f"""SELECT trace_id, (q <> '')::INTEGER + (a <> '')::INTEGER AS messages, {squashed("concat_ws(chr(10), CASE WHEN q <> '' THEN 'user: ' || q END, CASE WHEN a <> '' THEN 'assistant: ' || a END)")} AS content FROM (SELECT trace_id, {squashed('task')} AS q, {squashed('response_text')} AS a FROM {_TRACES})""",
    "first_turn_pairs": f"""SELECT * FROM (SELECT trace_id, {squashed('task')} AS instruction, {squashed('response_text')} AS output FROM {_TRACES}) WHERE instruction <> '' AND output <> ''""",
    "jsonl_parse_report": f"""SELECT shape, count(*) AS records, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM (SELECT CASE WHEN instruction IS NOT NULL AND output IS NOT NULL THEN 'alpaca' ELSE 'other' END AS shape,
        {squashed('instruction')} <> '' AND {squashed('output')} <> '' AND instruction IS NOT NULL AND output IS NOT NULL AS ok FROM mix_rows) GROUP BY shape""",
    "use_decisions": f"""SELECT name, use, coalesce(list_contains(allowed_uses, use), false) AND NOT (use = 'training_export_candidate' AND {has_any("lower(trim(coalesce(license, '')))", L.BLOCKED_LICENSES)}) AS allowed FROM dataset_manifests, (SELECT unnest({array(L.MANIFEST_USES)}) AS use)""",
    "review_decisions": f"WITH {_REVIEW} SELECT id, decision, round(score, 6) AS score, array_to_string(reasons, '; ') AS reasons FROM review",
    "review_report": f"WITH {_REVIEW} SELECT decision, count(*) AS n, round(avg(score), 3) AS mean_score FROM review GROUP BY decision",
    "review_reason_counts": f"WITH {_REVIEW} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM review) GROUP BY reason",
    "accepted_semi_join": f"WITH {_REVIEW} SELECT id FROM review WHERE decision = 'accepted'",
    "accepted_seeds": f"WITH {_REVIEW} SELECT id, round(least(reliability, score), 6) AS confidence FROM review WHERE decision = 'accepted'",
    "exact_dedup": f"SELECT id, min(id) OVER (PARTITION BY h) AS first_id, id <> min(id) OVER (PARTITION BY h) AS is_duplicate FROM {_HASHED}",
    "dup_groups": f"SELECT min(id) AS first_id, count(*) AS copies FROM {_HASHED} GROUP BY h HAVING count(*) > 1",
    "length_refusal_filter": f"""SELECT row_id FROM mix_rows WHERE {trimmed("coalesce(instruction, '')")} <> '' AND {trimmed("coalesce(output, '')")} <> '' AND length(instruction) <= 5000 AND length(coalesce(input, '')) <= 5000 AND length(output) <= 5000
        AND NOT {has_any("lower(instruction || chr(10) || output)", L.REFUSAL_MARKERS)}""",
    "normalized_pairs": f"""SELECT 'traces' AS source, count(*) AS n, sum(length({trimmed('response_text')}) + CASE WHEN {trimmed("coalesce(corrected_response, '')")} <> '' THEN 16 + length({trimmed('corrected_response')}) ELSE 0 END)::BIGINT AS chars FROM {_REVIEWS} r JOIN {_TRACES} t USING (trace_id)
        WHERE {trimmed("coalesce(task, '')")} <> '' AND {trimmed("coalesce(response_text, '')")} <> '' AND (rating IS NULL OR rating >= 3) AND NOT (contains(lower(coalesce(status, '')), 'fail') AND NOT contains(lower(coalesce(status, '')), 'pass')) HAVING count(*) > 0""",
    "seed_validation": f"WITH {_VALID} SELECT id, status, score, warnings FROM valid",
    "validation_status_counts": f"WITH {_VALID} SELECT status, count(*) AS n FROM valid GROUP BY status",
    "near_dup_edges": f"""WITH {_NORMAL}, first AS (SELECT norm, min(id) AS i, count(*) AS c FROM nt WHERE norm <> '' GROUP BY norm), pairs AS (SELECT a.id AS i, b.id AS j,
        CASE WHEN least(len(a.kw), len(b.kw)) > 0 THEN {_SHARED.format('kw')} ELSE 0.0 END AS k, list_has_any(a.dom, b.dom) AS d, CASE WHEN length(a.norm) <= 140 AND length(b.norm) <= 140 AND least(len(a.toks), len(b.toks)) > 0 THEN {_SHARED.format('toks')} ELSE 0.0 END AS x
        FROM nt a JOIN nt b ON a.id < b.id AND a.norm <> b.norm AND NOT (a.pol <> 0 AND b.pol <> 0 AND a.pol <> b.pol))
        SELECT i, id AS j, 'exact' AS rule, 1.0 AS score FROM nt JOIN first USING (norm) WHERE id <> i UNION ALL
        SELECT i, j, CASE WHEN d AND k >= 0.8 THEN 'keywords' ELSE 'text' END, round(CASE WHEN d AND k >= 0.8 THEN k ELSE x END, 3) FROM pairs WHERE (d AND k >= 0.8) OR x >= 0.85""",
    "conflict_pairs": f"WITH {_CONFLICT} SELECT * FROM conf",
    "conflict_summary": f"""WITH {_CONFLICT} SELECT id, count(*) AS conflicts, ['low', 'medium', 'high'][max(list_position(['low', 'medium', 'high'], severity))] AS severity FROM (SELECT left_id AS id, severity FROM conf UNION ALL SELECT right_id, severity FROM conf) GROUP BY id""",
    "bench_report": f"SELECT run_id, count(*) AS cases, round(avg(overall), 3) AS overall, round(avg(routing), 3) AS routing, round(avg(context), 3) AS context, round(avg(growth), 3) AS growth FROM {_RESULTS} GROUP BY run_id",
    "run_compare": f"WITH {_DELTAS} SELECT * FROM cmp",
    "gate_decision": f"""WITH {_DELTAS}, long AS (SELECT 'overall' AS m, overall_delta AS d FROM cmp UNION ALL SELECT 'routing', routing_delta FROM cmp UNION ALL SELECT 'context', context_delta FROM cmp UNION ALL SELECT 'growth', growth_delta FROM cmp)
        SELECT 'metric:' || m AS label, round(avg(d), 3) AS delta FROM long GROUP BY m HAVING round(avg(d), 3) <= -0.0 UNION ALL SELECT 'case:' || case_id, overall_delta FROM cmp WHERE overall_delta <= -0.01""",
    "best_config_per_case": f"SELECT case_id, run_id, overall FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY overall DESC, run_id) AS rn FROM {_RESULTS}) WHERE rn = 1",
    "score_pivot": f"SELECT case_id, max(overall) FILTER (run_id = 'lora-small') AS lora, max(overall) FILTER (run_id = 'plugin-demo') AS plugin, max(overall) FILTER (run_id = 'static-local') AS static FROM {_RESULTS} GROUP BY case_id",
    "heuristic_eval": f"""SELECT c.case_id, trace_id AS id, len(list_filter(required, lambda r: NOT contains(low, r))) = 0 AND len(list_filter(forbidden, lambda r: contains(low, r))) = 0 AND (opening IS NULL OR starts_with(trim(string_split(trim(low), chr(10))[1]), opening)) AS passed, len(list_filter(required, lambda r: NOT contains(low, r)))::INTEGER AS missing
        FROM (SELECT *, lower(coalesce(response_text, '')) AS low FROM {_TRACES}) t JOIN (VALUES ('general_task', ['the']::VARCHAR[], ['cannot']::VARCHAR[], NULL), ('baseline_check', ['the', 'a'], ['sorry'], 'the'), ('training_example_review', [], ['null'], NULL)) AS c(case_id, required, forbidden, opening) ON t.template_name = c.case_id""",
    "trace_review_full_outer": f"""SELECT coalesce(t.trace_id, r.trace_id) AS trace_id, r.review_id, CASE WHEN t.trace_id IS NULL THEN 'no_trace' WHEN r.review_id IS NULL THEN 'no_review' ELSE 'matched' END AS state FROM {_TRACES} t
        FULL JOIN (SELECT DISTINCT review_id, lower(trim(trace_id)) AS trace_id FROM inference_reviews) r ON t.trace_id = r.trace_id""",
    "latest_reviews": f"""SELECT trace_id, reviewer, review_id, status FROM (SELECT lower(trim(trace_id)) AS trace_id, lower(trim(reviewer)) AS reviewer, review_id, lower(trim(status)) AS status, row_number() OVER (PARTITION BY lower(trim(trace_id)), lower(trim(reviewer)) ORDER BY try_cast(trim(created_at) AS TIMESTAMP) DESC NULLS LAST, review_id DESC) AS rn FROM {_REVIEWS}) WHERE rn = 1""",
    "inference_review_summary": f"""SELECT s.status, coalesce(n, 0) AS n, mean_rating FROM (VALUES ('accepted'), ('corrected'), ('needs_correction'), ('not_reviewed'), ('rejected'), ('unsafe')) AS s(status) LEFT JOIN (SELECT lower(trim(status)) AS status, count(*) AS n, round(avg(rating), 6) AS mean_rating FROM {_REVIEWS} GROUP BY 1) c ON s.status = c.status""",
    "review_flag_counts": f"SELECT value, count(*) AS n FROM (SELECT unnest(quality_flags) AS value FROM {_REVIEWS}) WHERE value <> '' GROUP BY value",
    "training_export": "SELECT to_json(struct_pack(input := input, instruction := instruction, output := output, source := source))::VARCHAR AS value FROM training_examples WHERE validation_status IN ('validated', 'reviewed', 'synthetic_demo')",
    "manifest_domain_counts": "SELECT value, count(*) AS n FROM (SELECT unnest(domains) AS value FROM training_examples) WHERE value <> '' GROUP BY value",
    "license_counts": "SELECT coalesce(nullif(license, ''), 'unknown') AS value, count(*) AS n FROM training_examples GROUP BY 1",
    "provenance_summary": "SELECT coalesce(provenance['origin'], 'unknown') AS origin, count(*) AS n, count(*) FILTER (provenance['trace_id'] IS NOT NULL) AS with_trace, count(*) FILTER (provenance['review_id'] IS NOT NULL) AS with_review FROM training_examples GROUP BY 1",
    "mix_repeat_union": """SELECT row_id, source_name, copy::INTEGER AS copy FROM (SELECT row_id, CASE WHEN source LIKE 'data/corrections%' THEN 'corrections' WHEN source LIKE 'data/%' THEN 'local' ELSE 'other' END AS source_name,
        unnest(range(1, CASE WHEN source LIKE 'data/corrections%' THEN 9 WHEN source LIKE 'data/%' THEN 4 ELSE 2 END)) AS copy FROM mix_rows)""",
    "trace_id_hash": f"SELECT trace_id, 'trace:' || left(sha256(coalesce(task, '') || chr(10) || coalesce(template_name, '') || chr(10) || coalesce(response_text, '')), 16) AS stable_id FROM {_TRACES}",
    "prompt_render": f"SELECT trace_id, 'Task: ' || coalesce(task, '') || chr(10) || 'Route: ' || coalesce(routing_summary, '') AS prompt FROM {_TRACES}",
    "event_windows": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(avg(value), 8) AS mean_value FROM events GROUP BY ALL",
    "event_sessions": """SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "export_manifest": """WITH t AS (SELECT * FROM training_examples)
        SELECT 'split' AS part, lower(trim(split_name)) AS value, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'status', coalesce(nullif(validation_status, ''), 'unknown'), count(*) FROM t GROUP BY 2
        UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'unknown'), count(*) FROM t GROUP BY 2 UNION ALL SELECT 'license', coalesce(nullif(license, ''), 'unknown'), count(*) FROM t GROUP BY 2
        UNION ALL SELECT 'domain', value, count(*) FROM (SELECT unnest(domains) AS value FROM t) WHERE value <> '' GROUP BY 2 UNION ALL SELECT 'origin', coalesce(provenance['origin'], 'unknown'), count(*) FROM t GROUP BY 2""",
    "memory_search_documents": f"""WITH tasks AS (SELECT name AS task_id, concat_ws(' ', name, description) AS task FROM dataset_manifests), asked AS (SELECT DISTINCT task_id, unnest({terms('task')}) AS term FROM tasks),
        held AS (SELECT DISTINCT doc_id, unnest({terms('text')}) AS term FROM documents), hit AS (SELECT task_id, doc_id AS record_id, count(*) * 0.5::DOUBLE AS score FROM asked JOIN held USING (term) GROUP BY ALL),
        r AS (SELECT task_id, record_id, score, round(score / max(score) OVER (PARTITION BY task_id), 4) AS relevance, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, coalesce(source, ''), record_id) AS rank FROM hit JOIN documents ON record_id = doc_id)
        SELECT task_id, record_id, score, relevance, rank::INTEGER AS rank FROM r WHERE rank <= 5""",
}
