"""Reference SQL (DuckDB) for the registered queries."""

from __future__ import annotations

from vigilog import fixed_values as fixed
from vigilog.operators import scoring, training
from vigilog.plans import queries
from vigilog.plans.sql_parts import (
    AUTH_LINES, CHOSEN, CORRECTIONS, DOC_LINES, MEANS, PAGE_LINES, SIMS, SPACE, TURN_PAIRS,
    asset, category, common_subsequences, contains_case, first_match, gsub, hashed_vectors, normalize,
    offset_table, preprocess, q, rule_case, search_field, span_table, split_words, squeeze, tag_table, token_table,
    vocabulary_table,
)

ORACLES: dict[str, str] = {}


def oracle(name: str, *ctes_and_select: str) -> None:
    *ctes, select = ctes_and_select
    ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + select


# ---------------------------------------------------------------- searches

CATEGORIZED = f"categorized AS (SELECT *, {category('line')} AS event_category FROM auth_lines)"
SIZE = queries.ENCODER_SIZE

oracle("failed_login_alert", AUTH_LINES, CATEGORIZED, f"""
  SELECT start AS window_start, start + INTERVAL 7 DAY AS window_end, src_ip, user_name AS user, count(*) AS failures
  FROM (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, {search_field('src_ip')} AS src_ip,
      {search_field('user')} AS user_name FROM categorized WHERE event_category = 'authentication_failure')
  WHERE src_ip IS NOT NULL AND user_name IS NOT NULL GROUP BY start, src_ip, user_name HAVING count(*) > 5""")
SLIDING = f"""slots AS (
  SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, src_ip, user_name, ts
  FROM (SELECT ts, {search_field('src_ip')} AS src_ip, {search_field('user')} AS user_name FROM categorized WHERE event_category = 'authentication_failure')
  WHERE src_ip IS NOT NULL AND user_name IS NOT NULL)"""
oracle("failed_login_alert_hourly", AUTH_LINES, CATEGORIZED, SLIDING, """
  SELECT start AS window_start, start + INTERVAL 1 HOUR AS window_end, src_ip, user_name AS user, count(*) AS failures
  FROM slots GROUP BY start, src_ip, user_name HAVING count(*) > 1""")
oracle("stream_alert_state", AUTH_LINES, CATEGORIZED, SLIDING, """
  SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(start + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
    src_ip, user_name AS user, count(*) AS failures
  FROM slots WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM slots) GROUP BY start, src_ip, user_name""")
oracle("security_summary", AUTH_LINES, CATEGORIZED, "SELECT event_category, count(*) AS events FROM categorized GROUP BY 1")
oracle("hourly_activity", AUTH_LINES, CATEGORIZED,
       "SELECT date_trunc('hour', ts) AS hour, event_category, count(*) AS events FROM categorized GROUP BY ALL")
ORACLES["hourly_totals"] = ORACLES["hourly_activity"]
oracle("activity_by_hour", AUTH_LINES, "SELECT date_trunc('hour', ts) AS hour, count(*) AS events FROM auth_lines GROUP BY ALL")
oracle("top_users", AUTH_LINES, f"""
  SELECT user, count(*) AS events FROM (SELECT {search_field('user')} AS user FROM auth_lines) WHERE user IS NOT NULL
  GROUP BY user ORDER BY events DESC, user LIMIT 10""")
oracle("failed_sources", AUTH_LINES, CATEGORIZED, f"""
  SELECT src_ip, count(*) AS events FROM (
    SELECT {search_field('src_ip')} AS src_ip FROM categorized WHERE event_category = 'authentication_failure')
  WHERE src_ip IS NOT NULL GROUP BY src_ip ORDER BY events DESC, src_ip LIMIT 20""")
oracle("count_by_action", AUTH_LINES, f"""
  SELECT action, count(*) AS events FROM (SELECT {search_field('action')} AS action FROM auth_lines)
  WHERE action IS NOT NULL GROUP BY action""")
for name, wanted in (("failed_logins", "authentication_failure"), ("successful_logins", "authentication_success")):
    oracle(name, AUTH_LINES, CATEGORIZED, f"SELECT line_id, line, event_category FROM categorized WHERE event_category = '{wanted}'")
TRANSFORMED = ", ".join(f"{first_match('line', p, 1)} AS {n}" for n, p in fixed.TRANSFORM_FIELDS.items())
oracle("calculated_fields", AUTH_LINES, CATEGORIZED, f"""
  SELECT line_id, {search_field('user')} AS user, {search_field('src_ip')} AS src_ip, {search_field('action')} AS action,
    {TRANSFORMED}, {rule_case('line', fixed.LOG_LEVELS, 'DEBUG')} AS log_level, event_category,
    'security_monitoring' AS app_name FROM categorized""")

# ---------------------------------------------------------------- normalising, fields and labels

oracle("normalize_text", AUTH_LINES, f"SELECT line_id, {normalize('line')} AS normalized_log FROM auth_lines")
oracle("normalize_documents", f"SELECT doc_id, {normalize('text')} AS normalized_log FROM documents")
oracle("preprocess_text", AUTH_LINES, f"SELECT line_id, {preprocess('line')} AS normalized_log FROM auth_lines")
FIELDS = ", ".join(f"{first_match('line', p, 0)} AS {n}" for n, p in fixed.LINE_FIELDS.items())
oracle("log_fields", AUTH_LINES, f"SELECT line_id, {FIELDS} FROM auth_lines")
for name, key, column, rows in (("document_log_fields", "doc_id", "text", "documents"), ("page_log_fields", "page_id", "html", "pages")):
    oracle(name, f"SELECT {key}, {', '.join(f'{first_match(column, p, 0)} AS {n}' for n, p in fixed.LINE_FIELDS.items())} FROM {rows}")
oracle("page_rule_labels", f"""
  SELECT line_id, {rule_case('line', fixed.SSH_RULES, 'Other')} AS ssh_label, {rule_case('line', fixed.LINUX_RULES, 'Other')} AS linux_label
  FROM (SELECT page_id AS line_id, html AS line FROM pages UNION ALL SELECT -doc_id - 1, text FROM documents)""")
oracle("search_filter", """
  SELECT doc_id, source, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview
  FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e|copyright')""")
oracle("rule_labels", AUTH_LINES, f"""
  SELECT line_id, text, {rule_case('text', fixed.SSH_RULES, 'Other')} AS ssh_label,
    {rule_case('text', fixed.LINUX_RULES, 'Other')} AS linux_label
  FROM (SELECT line_id, event_type || ' ' || line || ' ' || user_id AS text FROM auth_lines)""")
oracle("row_text", """
  SELECT event_id, user_id || ' ' || event_type || ' ' ||
    coalesce(CASE WHEN event_type <> 'view' THEN value::VARCHAR END, 'nan') AS text FROM events""")
oracle("asset_type", AUTH_LINES, f"SELECT line_id, {asset('line')} AS asset FROM auth_lines")
FORMAT = contains_case("line", fixed.LOG_FORMATS, "generic")
oracle("format_sniff", AUTH_LINES, f"""
  SELECT source, {FORMAT} AS suspected_format FROM (SELECT source, arg_min(line, line_id) AS line FROM auth_lines GROUP BY source)""")
TIMED = " OR ".join(f"count(*) FILTER (WHERE rank <= 10 AND regexp_matches(line, {q(p)})) > 0.5 * least(count(*), 10)" for p in fixed.FORMAT_TIMESTAMPS)
for name, lines, cte in (("format_report", "auth_lines", AUTH_LINES), ("document_format_report", "doc_lines", DOC_LINES)):
    oracle(name, cte, f"""
  SELECT source, count(*) AS total_lines, round(avg(length(line)), 6) AS avg_line_length, ({TIMED}) AS has_timestamps,
    count(*) FILTER (WHERE rank <= 10 AND regexp_matches(line, {q(fixed.FORMAT_ADDRESS)})) > 0 AS has_ip_addresses,
    max(CASE WHEN rank = 1 THEN {FORMAT} END) AS suspected_format, count(*) > 0 AS valid
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_id) AS rank FROM {lines}) GROUP BY source""")
oracle("line_stats", DOC_LINES, """
  SELECT source, count(*) AS total_lines, round(avg(length(line)), 6) AS avg_length, min(length(line))::BIGINT AS min_length,
    max(length(line))::BIGINT AS max_length, sum(length(line))::BIGINT AS total_characters FROM doc_lines GROUP BY source""")
oracle("line_times", """
  SELECT event_id, strftime(CASE WHEN event_id % 6 = 1 THEN ts ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S.%f') AS time
  FROM events""")

# ---------------------------------------------------------------- entities, timeline, patterns


def entity_table(lines: str) -> str:
    parts = []
    for kind, pattern, group in fixed.ENTITY_PATTERNS:
        found = f"regexp_extract_all(line, {q(pattern)}, {group})"
        if kind == "Host":
            found = f"list_filter({found}, lambda h: contains(h, '.') AND NOT regexp_matches(h, {q('^' + fixed.ENTITY_PATTERNS[0][1])}))"
        if kind == "File":
            trimmed = gsub("f", f"^{SPACE}+|{SPACE}+$", "")
            found = f"list_filter(list_transform({found}, lambda f: {trimmed}), lambda f: length(f) > 3)"
        parts.append(f"SELECT line_id, '{kind}' AS type, unnest({found}) AS entity, generate_subscripts({found}, 1) - 1 AS ord FROM {lines}")
    return f"entities AS ({' UNION ALL '.join(parts)})"


oracle("entities", AUTH_LINES, entity_table("auth_lines"), "SELECT line_id, type, ord::INTEGER AS ord, entity FROM entities")
oracle("document_entities", DOC_LINES, entity_table("doc_lines"), """
  SELECT line_id.doc_id AS doc_id, line_id.pos::INTEGER AS pos, type, ord::INTEGER AS ord, entity FROM entities""")
oracle("entity_unique", AUTH_LINES, entity_table("auth_lines"), "SELECT type, count(DISTINCT entity) AS unique_entities FROM entities GROUP BY type")
oracle("entity_top10", AUTH_LINES, entity_table("auth_lines"), """
  SELECT * FROM (
    SELECT type, entity, count(*) AS events,
      row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, min({'l': line_id, 'o': ord}))::INTEGER AS rank
    FROM entities GROUP BY type, entity) WHERE rank <= 10""")
ORACLES["entity_top10_two_pass"] = ORACLES["entity_top10"]
ORACLES["top_users_two_pass"] = ORACLES["top_users"]
ORACLES["failed_sources_two_pass"] = ORACLES["failed_sources"]
oracle("entity_sketch_counts", AUTH_LINES, entity_table("auth_lines"), """
  SELECT type, count(DISTINCT date_trunc('hour', ts)) AS hours, count(DISTINCT entity) AS exact, true AS near
  FROM entities JOIN auth_lines USING (line_id) GROUP BY type""")
HOURS = f"hours AS (SELECT unnest(regexp_extract_all(line, {q(fixed.CLOCK_HOUR)}, 1))::INTEGER AS hour FROM auth_lines)"
oracle("events_by_hour", AUTH_LINES, HOURS, """
  SELECT d.hour::INTEGER AS hour, count(h.hour) AS events FROM range(24) AS d(hour) LEFT JOIN hours h ON h.hour = d.hour GROUP BY d.hour""")
oracle("peak_hour", AUTH_LINES, HOURS, "SELECT hour, count(*) AS events FROM hours GROUP BY hour ORDER BY events DESC, hour LIMIT 1")


def escaped(pattern: str) -> str:
    return pattern.replace("{", r"\{").replace("}", r"\}")


HITS = {}
for kind, patterns in fixed.EVENT_PATTERNS.items():
    flags = ", ".join(f"CASE WHEN regexp_matches(line, {q(escaped(p))}) THEN '{i}' END" for i, p in enumerate(patterns))
    HITS[kind] = f"array_to_string(list_filter([{flags}], lambda x: x IS NOT NULL), '|')"
oracle("event_patterns", AUTH_LINES, f"""
  SELECT *, CASE WHEN authentication_failure_hits <> '' THEN 'authentication_failure'
    WHEN authentication_success_hits <> '' THEN 'authentication_success' ELSE 'none' END AS label
  FROM (SELECT line_id, {', '.join(f'{v} AS {k}_hits' for k, v in HITS.items())} FROM auth_lines)""")
oracle("security_patterns", AUTH_LINES, " UNION ALL ".join(
    f"""SELECT {q(name)} AS name, {q(pattern)} AS pattern, {confidence}::DOUBLE AS confidence, {q(','.join(names))} AS fields,
  count(*) AS lines, min(line_id) AS first_line_id FROM auth_lines WHERE regexp_matches(line, {q('(?i)' + pattern)})"""
    for name, pattern, confidence, names in fixed.SECURITY_PATTERNS))


def attack_table(lines: str) -> str:
    parts = [
        f"SELECT line_id, {q(kind)} AS category, {q(pattern)} AS pattern, regexp_extract_all(line, {q('(?i)' + pattern)}) AS found FROM {lines}"
        for kind, patterns in fixed.ATTACK_PATTERNS.items() for pattern in patterns
    ]
    return f"""attacks AS (
  SELECT line_id, category, pattern, array_to_string(found, '|') AS matches,
    round(least(1.0::DOUBLE, len(found) * 0.3::DOUBLE + 0.4::DOUBLE), 6) AS confidence
  FROM ({' UNION ALL '.join(parts)}) WHERE len(found) > 0 AND least(1.0::DOUBLE, len(found) * 0.3::DOUBLE + 0.4::DOUBLE) >= 0.7::DOUBLE)"""


oracle("attack_hits", AUTH_LINES, attack_table("auth_lines"), "SELECT * FROM attacks")
oracle("page_attack_hits", PAGE_LINES, attack_table("page_lines"), "SELECT * FROM attacks")
ORACLES["attack_pattern_table"] = ORACLES["attack_hits"]
oracle("document_pattern_table", """
  words AS (SELECT regexp_extract_all(lower(text), '[a-z]{5,}') AS w FROM benchmark)""", """
  pairs AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || '\\s+' || w[i + 1])) AS pattern FROM words)""", """
  firsts AS MATERIALIZED (SELECT pattern, split_part(pattern, chr(92), 1) AS first FROM pairs)""", """
  texts AS MATERIALIZED (SELECT doc_id, text, lower(text) AS lowered FROM documents)""", """
  SELECT doc_id AS line_id, pattern, len(regexp_extract_all(text, '(?i)' || pattern))::INTEGER AS matches
  FROM texts, firsts WHERE contains(lowered, first) AND regexp_matches(text, '(?i)' || pattern)""")
PREFIXED = ", ".join(f"CASE WHEN {k}_hits <> '' THEN '{k}:' || replace({k}_hits, '|', '|{k}:') END" for k in sorted(HITS))
oracle("dictionary_table_labels", AUTH_LINES, f"""
  found AS (SELECT line_id, {', '.join(f'{v} AS {k}_hits' for k, v in HITS.items())} FROM auth_lines)""", f"""
  SELECT line_id, CASE WHEN authentication_failure_hits <> '' THEN 'authentication_failure'
    WHEN authentication_success_hits <> '' THEN 'authentication_success' ELSE 'none' END AS label, concat_ws('|', {PREFIXED}) AS hits FROM found""")
oracle("attack_counts", AUTH_LINES, attack_table("auth_lines"), """
  SELECT category, count(*) AS hits FROM attacks GROUP BY category UNION ALL SELECT 'Total', count(*) FROM attacks""")
oracle("attack_bins", PAGE_LINES, attack_table("page_lines"), """
  limits AS (SELECT min(confidence) AS a, max(confidence) AS b FROM attacks),
  opened AS (SELECT a = b AS flat, CASE WHEN a < b THEN a WHEN a = 0 THEN -0.001 ELSE a - abs(a) * 0.001 END AS low,
    CASE WHEN a < b THEN b WHEN b = 0 THEN 0.001 ELSE b + abs(b) * 0.001 END AS high FROM limits),
  edges AS (SELECT i::INTEGER AS bin, low + (high - low) / 5 * (i - 1) AS lower,
      CASE WHEN i = 5 THEN high ELSE low + (high - low) / 5 * i END AS upper, low, high, flat FROM opened, range(1, 6) AS r(i))""", """
  SELECT bin, round(CASE WHEN bin = 1 AND NOT flat THEN low - (high - low) * 0.001 ELSE lower END, 6) AS lower, round(upper, 6) AS upper,
    (SELECT count(*) FROM attacks WHERE (confidence > e.lower OR e.bin = 1) AND (confidence <= e.upper OR e.bin = 5)) AS events
  FROM edges e""")

# ---------------------------------------------------------------- vectors and scores

oracle("prototype_mean", MEANS, """
  SELECT label, (generate_subscripts(vec, 1) - 1)::INTEGER AS pos, round(unnest(vec), 6) AS value FROM means""")
oracle("own_prototype_cosine", MEANS, """
  SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], vec), 6) AS cosine FROM embeddings JOIN means USING (label)""")
oracle("prototype_scores", SIMS, "SELECT vec_id, label, category, score FROM scores")
oracle("softmax_scores", SIMS, """
  SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY category) - 1)::INTEGER AS pos,
    round(exp(3 * sim) / sum(exp(3 * sim)) OVER (PARTITION BY vec_id), 6) AS probability FROM sims""")
oracle("nearest_example", """bank AS (SELECT label, vec_id AS idx, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 20 <> 0)""", """
  SELECT vec_id, round(max(sim), 6) AS max_similarity_score, arg_min(idx, (-sim, idx)) AS most_similar_positive_idx, arg_min(label, (-sim, idx)) AS label
  FROM (SELECT e.vec_id, b.idx, b.label, round(list_cosine_similarity(e.embedding::DOUBLE[], b.vec), 12) AS sim FROM embeddings e, bank b WHERE e.vec_id % 20 = 0)
  GROUP BY vec_id""")


def nearest_lines(bank: str, targets: str) -> tuple[str, ...]:
    """CTEs ending in ``matched``: the nearest example of every target line."""
    return (
        AUTH_LINES,
        f"""bank AS ({bank}), targets AS (SELECT line_id, {normalize('line')} AS norm FROM auth_lines WHERE {targets}),
  texts AS (SELECT DISTINCT norm FROM targets),
  bank_texts AS (SELECT idx, example, {normalize('example')} AS norm FROM bank),
  every AS (SELECT norm FROM texts UNION SELECT norm FROM bank_texts)""",
        hashed_vectors("v", "every", "norm", SIZE),
        """lengths AS (SELECT norm, sqrt(sum(n * n)) AS size FROM v GROUP BY norm),
  dots AS (SELECT a.norm, c.idx, sum(a.n * w.n) AS dot FROM texts t JOIN v a ON a.norm = t.norm JOIN v w ON w.slot = a.slot
    JOIN bank_texts c ON c.norm = w.norm GROUP BY ALL),
  sims AS (SELECT t.norm, b.idx, b.example, round(coalesce(d.dot / (lt.size * lb.size), 0), 12) AS sim
    FROM texts t CROSS JOIN bank_texts b LEFT JOIN lengths lt ON lt.norm = t.norm LEFT JOIN lengths lb ON lb.norm = b.norm
    LEFT JOIN dots d ON d.norm = t.norm AND d.idx = b.idx),
  best AS (SELECT norm, round(max(sim), 6) AS score, arg_min(idx, (-sim, idx)) AS idx, arg_min(example, (-sim, idx)) AS example
    FROM sims GROUP BY norm),
  matched AS (SELECT line_id, b.norm, score, b.idx, example FROM targets JOIN best b USING (norm))""",
    )


FIRST_LINES = nearest_lines("SELECT min(line_id) AS idx, arg_min(line, line_id) AS example FROM auth_lines GROUP BY event_type", "true")
KNOWN_LINES = nearest_lines(f"""SELECT min(line_id) AS idx, arg_min(line, line_id) AS example FROM (
  SELECT line_id, line, {normalize('line')} AS norm FROM auth_lines WHERE line_id % 20 <> 0) GROUP BY norm""", "line_id % 20 = 0")
MATCHED = f"""SELECT line_id, norm AS normalized_log, score AS max_similarity_score, idx AS most_similar_positive_idx,
    example AS most_similar_positive_example, {category('example')} AS prediction FROM matched"""
oracle("nearest_line_example", *FIRST_LINES, MATCHED)
oracle("nearest_known_line", *KNOWN_LINES, MATCHED)
ORACLES["nearest_example_index"] = ORACLES["nearest_example"]
ORACLES["nearest_known_line_index"] = ORACLES["nearest_known_line"]
LINE_SCORES = f"scores AS (SELECT line_id, {category('example')} AS prediction, score FROM matched)"

PHRASES = ", ".join(
    f"({i}, {q(c)}, {q(fixed.SCORING_OPTIONS['category_labels'][c])}, {q(p)})"
    for i, (c, ps) in enumerate(scoring.prototype_phrases().items()) for p in ps
)
oracle(
    "analyze_logs", AUTH_LINES,
    f"""phrases AS (SELECT ord, category, label, {preprocess('phrase')} AS phrase
    FROM (VALUES {PHRASES}) AS p(ord, category, label, phrase)),
  texts AS (SELECT DISTINCT {preprocess('line')} AS norm FROM auth_lines)""",
    hashed_vectors("pv", "phrases", "phrase", SIZE),
    hashed_vectors("v", "texts", "norm", SIZE),
    """protos AS (SELECT ord, category, label, slot, sum(n) / 7 AS w FROM phrases JOIN pv USING (phrase) GROUP BY ALL),
  psize AS (SELECT ord, category, label, sqrt(sum(w * w)) AS size FROM protos GROUP BY ALL),
  vsize AS (SELECT norm, sqrt(sum(n * n)) AS size FROM v GROUP BY norm),
  dots AS (SELECT v.norm, p.ord, sum(v.n * p.w) AS dot FROM v JOIN protos p USING (slot) GROUP BY ALL),
  sims AS (SELECT t.norm, p.ord, p.category, p.label, round(coalesce(d.dot / (p.size * s.size), 0), 12) AS sim
    FROM texts t CROSS JOIN psize p LEFT JOIN vsize s ON s.norm = t.norm LEFT JOIN dots d ON d.norm = t.norm AND d.ord = p.ord),
  wide AS (SELECT norm, max(sim) AS best, arg_min(category, (-round(sim, 12), ord)) AS category, arg_min(label, (-round(sim, 12), ord)) AS label,
      max(sim) FILTER (WHERE ord < 2) AS inside, max(sim) FILTER (WHERE ord = 2) AS outside,
      sum(exp(3 * sim)) AS total, max(exp(3 * sim)) AS top,
      arg_min(label, (-round(sim, 12), CASE label WHEN 'Non-login event' THEN 0 WHEN 'Failed login' THEN 1 ELSE 2 END)) AS model_label
    FROM sims GROUP BY norm),
  judged AS (SELECT *, CASE WHEN best < 0.3 THEN 'Ambiguous event' ELSE label END AS semantic, top / total AS model_score,
      inside > outside AND inside > 0.15 AS login FROM wide),
  final AS (SELECT norm, login, best, model_score, category,
      CASE WHEN best > 0.6 OR (best > 0.4 AND semantic = model_label) THEN semantic WHEN model_score > 0.8 THEN model_label
        ELSE 'Ambiguous event' END AS prediction,
      CASE WHEN best > 0.6 THEN best WHEN best > 0.4 AND semantic = model_label THEN greatest(best, model_score)
        WHEN model_score > 0.8 THEN model_score ELSE greatest(best, model_score) END AS score,
      CASE WHEN best > 0.6 THEN printf('Semantic similarity: %.3f to %s (high confidence)', best, category)
        WHEN best > 0.4 AND semantic = model_label THEN printf('Agreement: semantic %.3f, model %.3f', best, model_score)
        WHEN model_score > 0.8 THEN printf('Model confidence: %.3f', model_score)
        ELSE printf('Low confidence: %.3f/%.3f', best, model_score) END AS explanation FROM judged)""",
    f"""SELECT line_id, l.norm AS normalized_log, CASE WHEN login THEN prediction ELSE 'Non-login event' END AS prediction,
    round(CASE WHEN login THEN score ELSE 0 END, 6) AS max_similarity_score,
    CASE WHEN login THEN explanation ELSE 'Semantically not login-related' END AS explanation
  FROM (SELECT line_id, {preprocess('line')} AS norm FROM auth_lines) l JOIN final USING (norm)""")

CHANGED = ORACLES["analyze_logs"]
for before, after in (("best > 0.6", "best > 0.5"), ("inside > 0.15", "inside > 0.35")):
    CHANGED = CHANGED.replace(before, after)
ORACLES["analyze_logs_options"] = CHANGED

oracle("score_metrics", *FIRST_LINES, LINE_SCORES, """
  SELECT count(*) AS total_lines, count(*) FILTER (WHERE score >= 0.6) AS above_threshold, round(avg(score), 6) AS mean_score,
    max(score) AS max_score FROM scores""")
oracle("score_summary", *FIRST_LINES, LINE_SCORES, """
  SELECT count(*) AS total_lines, round(avg(score), 6) AS mean_score, max(score) AS max_score, min(score) AS min_score,
    round(stddev_samp(score), 6) AS std_score, count(*) FILTER (WHERE score >= 0.8) AS high,
    count(*) FILTER (WHERE score >= 0.6 AND score < 0.8) AS medium, count(*) FILTER (WHERE score < 0.6) AS low FROM scores""")
oracle("analysis_summary", *FIRST_LINES, LINE_SCORES, """
  SELECT 'has_results' AS status, (SELECT count(*) FROM events) AS total_log_lines, count(*) AS analysis_entries,
    round(avg(score), 6) AS mean_confidence, max(score) AS max_confidence, min(score) AS min_confidence FROM scores""")
oracle("score_histogram", *FIRST_LINES, LINE_SCORES, """
  limits AS (SELECT min(score) AS a, max(score) AS b FROM scores),
  binned AS (SELECT least(floor((score - a) / (b - a) * 50), 49)::INTEGER AS bin, count(*) AS events FROM scores, limits GROUP BY 1)""", """
  SELECT i::INTEGER AS bin, round(a + (b - a) / 50 * i, 6) AS lower, round(a + (b - a) / 50 * (i + 1), 6) AS upper,
    coalesce(events, 0) AS events FROM limits, range(50) AS r(i) LEFT JOIN binned ON bin = i""")
oracle("score_bands", *FIRST_LINES, LINE_SCORES, """
  SELECT line_id, score, CASE WHEN score >= 0.8 THEN 'High' WHEN score >= 0.6 THEN 'Medium' ELSE 'Low' END AS band FROM scores""")
oracle("scores_above_threshold", *FIRST_LINES, LINE_SCORES, "SELECT line_id, prediction, score FROM scores WHERE score >= 0.6")
oracle("top_scores", *FIRST_LINES, LINE_SCORES, "SELECT line_id, prediction, score FROM scores ORDER BY score DESC, line_id LIMIT 20")

# ---------------------------------------------------------------- text pairs

oracle("token_breakdown", TURN_PAIRS, f"""
  words AS (SELECT conv_id, turn, second, {split_words('first')} AS w, list_distinct({split_words(normalize('first'))}) AS a,
    list_distinct({split_words(normalize('second'))}) AS b FROM turn_pairs),
  parts AS (SELECT conv_id, turn, list_sort(list_intersect(a, b)) AS common, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS mine,
    list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS theirs,
    list_filter(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), lambda x: contains(second, x)) AS phrases FROM words)""", """
  SELECT conv_id, turn, array_to_string(common, '|') AS common_tokens, array_to_string(mine, '|') AS unique_to_log,
    array_to_string(theirs, '|') AS unique_to_example, array_to_string(list_concat(common, phrases), '|') AS important_phrases FROM parts""")
oracle("bigrams", AUTH_LINES, f"words AS (SELECT line_id, {split_words('line')} AS w FROM auth_lines)", """
  SELECT line_id, (i - 1)::INTEGER AS pos, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT line_id, w, unnest(range(1, len(w))) AS i FROM words)""")
oracle("highlight", AUTH_LINES, f"""
  SELECT line_id, regexp_replace(line, '(user' || user_id || '|failed|login|user)', {q(queries.MARKS[0] + chr(92) + '1' + queries.MARKS[1])}, 'g') AS highlighted
  FROM auth_lines""")
WORD = q(r"[\p{L}\p{N}_]{2,}")
oracle("tfidf_pair", TURN_PAIRS, f"""
  terms AS (SELECT conv_id, turn, 1 AS side, unnest(regexp_extract_all(lower(first), {WORD})) AS term FROM turn_pairs UNION ALL
    SELECT conv_id, turn, 2, unnest(regexp_extract_all(lower(second), {WORD})) FROM turn_pairs),
  counts AS (SELECT conv_id, turn, term, count(*) FILTER (WHERE side = 1) AS a, count(*) FILTER (WHERE side = 2) AS b FROM terms GROUP BY ALL),
  weights AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS w FROM counts),
  sums AS (SELECT conv_id, turn, sum(a * w * b * w) AS dot, sum(a * w * a * w) AS aa, sum(b * w * b * w) AS bb FROM weights GROUP BY ALL)""", """
  SELECT conv_id, turn, coalesce(round(CASE WHEN aa > 0 AND bb > 0 THEN dot / sqrt(aa * bb) END, 6), 0) AS lexical
  FROM turn_pairs LEFT JOIN sums USING (conv_id, turn)""")

RATIO = "CASE WHEN length(first) + length(second) = 0 THEN 1.0 ELSE 2.0 * coalesce(lcs, 0) / (length(first) + length(second)) END"
LCS = common_subsequences("common", "turn_pairs")
ORACLES["string_ratio"] = f"""WITH RECURSIVE {TURN_PAIRS}, {LCS}
  SELECT conv_id, turn, round({RATIO}, 6) AS ratio FROM turn_pairs LEFT JOIN common USING (first, second)"""
# Only pairs whose lengths allow half of their characters to be common are stepped through.
LIKE_LONG = TURN_PAIRS.replace("b.turn = a.turn + 1)", "b.turn = a.turn + 1 WHERE 4 * least(length(a.text), length(b.text)) >= length(a.text) + length(b.text))")
ORACLES["similar_turns"] = f"""WITH RECURSIVE {LIKE_LONG}, {LCS}
  SELECT conv_id, turn, round(r, 6) AS ratio FROM (SELECT conv_id, turn, {RATIO} AS r FROM turn_pairs LEFT JOIN common USING (first, second)) WHERE r >= 0.5"""
LEXICAL = ORACLES["tfidf_pair"].removeprefix(f"WITH {TURN_PAIRS}, ").replace(
    "coalesce(round(CASE WHEN aa > 0 AND bb > 0 THEN dot / sqrt(aa * bb) END, 6), 0)", "coalesce(CASE WHEN aa > 0 AND bb > 0 THEN dot / sqrt(aa * bb) END, 0)")
ORACLES["enhanced_similarity"] = f"""WITH RECURSIVE {TURN_PAIRS}, {LCS},
  lexical AS (WITH {LEXICAL}),
  squeezed AS (SELECT DISTINCT t, {squeeze('t')} AS norm FROM (SELECT first AS t FROM turn_pairs UNION ALL SELECT second FROM turn_pairs)),
  {hashed_vectors("v", "(SELECT DISTINCT norm FROM squeezed)", "norm", SIZE)},
  sizes AS (SELECT norm, sqrt(sum(n * n)) AS size FROM v GROUP BY norm),
  dots AS (SELECT conv_id, turn, sum(x.n * y.n) AS dot FROM turn_pairs JOIN squeezed a ON a.t = first JOIN squeezed b ON b.t = second
    JOIN v x ON x.norm = a.norm JOIN v y ON y.norm = b.norm AND y.slot = x.slot GROUP BY ALL),
  semantic AS (SELECT conv_id, turn, coalesce(dot / (x.size * y.size), 0) AS semantic FROM turn_pairs JOIN squeezed a ON a.t = first
    JOIN squeezed b ON b.t = second LEFT JOIN sizes x ON x.norm = a.norm LEFT JOIN sizes y ON y.norm = b.norm LEFT JOIN dots USING (conv_id, turn)),
  every AS (SELECT conv_id, turn, semantic, lexical, {RATIO} AS string FROM turn_pairs LEFT JOIN common USING (first, second)
    JOIN semantic USING (conv_id, turn) JOIN lexical USING (conv_id, turn))
  SELECT conv_id, turn, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, round(string, 6) AS string,
    round(semantic * 0.5::DOUBLE + lexical * 0.3::DOUBLE + string * 0.2::DOUBLE, 6) AS combined FROM every"""

# ---------------------------------------------------------------- corrections

oracle("correction_records", CORRECTIONS, "SELECT doc_id, record_id, timestamp, used_for_training FROM corrections")


def display(source: str) -> str:
    return f"""
  SELECT record_id, CASE WHEN length(log_text) > 100 THEN substr(log_text, 1, 100) || '...' ELSE log_text END AS log_preview,
    printf('%s (%.3f)', original_label, original_confidence) AS original_prediction,
    printf('%s (%.3f)', coalesce(corrected_label, 'Unknown'), 1.0::DOUBLE) AS user_correction, timestamp, used_for_training FROM {source}"""


oracle("correction_display", CORRECTIONS, display("corrections"))
STATS = """
  SELECT count(*) AS total, count(*) FILTER (WHERE {used}) AS used, count(*) FILTER (WHERE NOT ({used})) AS unused,
    round(count(*) FILTER (WHERE {used}) / greatest(count(*), 1) * 100, 6) AS usage_rate FROM corrections"""
oracle("correction_stats", CORRECTIONS, STATS.format(used="used_for_training"))
oracle("correction_types", CORRECTIONS, "SELECT coalesce(corrected_label, 'Unknown') AS label, count(*) AS corrections FROM corrections GROUP BY 1")
oracle("unused_corrections", CORRECTIONS, "SELECT doc_id, record_id, log_text FROM corrections WHERE NOT used_for_training")
oracle("used_corrections", CORRECTIONS, "SELECT doc_id, record_id FROM corrections WHERE used_for_training")
oracle("filtered_counts", CORRECTIONS, """
  SELECT count(*) FILTER (WHERE NOT used_for_training AND regexp_matches(log_text, '(?i)licen[cs]e|@')) AS shown, count(*) AS total FROM corrections""")
PICKED = "(record_id, log_text) IN (SELECT (record_id, log_text) FROM chosen)"
oracle("mark_used", CORRECTIONS, CHOSEN, f"""
  SELECT doc_id, record_id, used_for_training OR {PICKED} AS used_for_training, CASE WHEN {PICKED} THEN '2025-07-01 00:00:00' END AS training_timestamp,
    CASE WHEN {PICKED} THEN '20250701_000000' END AS dataset_generation_session FROM corrections""")
oracle("selected_corrections", CORRECTIONS, CHOSEN, f"SELECT doc_id, record_id FROM corrections WHERE {PICKED}")
oracle("remaining_corrections", CORRECTIONS, CHOSEN, f"SELECT doc_id, record_id FROM corrections WHERE NOT {PICKED}")

# ---------------------------------------------------------------- training sets

oracle("training_rows", CORRECTIONS, f"""
  SELECT record_id AS "ID", {asset('log_text')} AS "Asset", log_text AS "Log", class_id AS "Label", 'user_correction' AS "Source" FROM corrections""")
BOOST = fixed.CORRECTION_BOOST
oracle("boosted_training_set", CORRECTIONS, f"""
  SELECT record_id AS "ID", {asset('log_text')} AS "Asset", class_id AS "Label", 'user_correction' AS "Source"
  FROM corrections, range({BOOST}) WHERE NOT used_for_training""")


def quota_tables(total: str) -> str:
    return f"""boosts AS (SELECT {total} AS total, {', '.join(f'count(*) FILTER (WHERE class_id = {c}) * {BOOST} AS b{c}' for c in (1, 2, 0))}
    FROM corrections WHERE NOT used_for_training),
  thirds AS (SELECT *, greatest(1, total // 3 - b1) AS q1, greatest(1, total // 3 - b2) AS q2 FROM boosts),
  shares AS (SELECT *, greatest(1, total - q1 - q2 - b1 - b2 - b0) AS q0 FROM thirds),
  quotas AS (SELECT 1 AS "Label", b1 AS boosted, q1 AS quota FROM shares UNION ALL SELECT 2, b2, q2 FROM shares UNION ALL SELECT 0, b0, q0 FROM shares)"""


EVENT_QUOTAS = quota_tables("(SELECT count(*) FROM events)")
SEED = training.SHUFFLE_SEED
oracle("class_quota", CORRECTIONS, EVENT_QUOTAS, 'SELECT "Label"::INTEGER AS "Label", boosted::BIGINT AS boosted, quota::BIGINT AS quota FROM quotas')
oracle("quota_sample", CORRECTIONS, quota_tables("(SELECT count(*) FROM documents)"), AUTH_LINES, CATEGORIZED, f"""
  placed AS (SELECT line_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || line_id), line_id) AS place FROM (
    SELECT line_id, CASE event_category WHEN 'authentication_success' THEN 1 WHEN 'authentication_failure' THEN 2 ELSE 0 END AS label FROM categorized))""", """
  SELECT line_id, p.label::INTEGER AS "Label" FROM placed p JOIN quotas u ON p.label = u."Label" WHERE place <= quota""")
POOL = f"""pool AS (SELECT line_id, line, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || line_id), line_id) AS place FROM (
    SELECT line_id, line, CASE event_category WHEN 'authentication_success' THEN 1 WHEN 'authentication_failure' THEN 2 ELSE 0 END AS label FROM categorized))"""
ENHANCED = ", ".join([CORRECTIONS, EVENT_QUOTAS, AUTH_LINES, CATEGORIZED, POOL, f"""
  enhanced AS (SELECT line_id::VARCHAR AS "ID", {asset('line')} AS "Asset", line AS "Log", p.label AS "Label", 'labelled_line' AS "Source"
    FROM pool p JOIN quotas u ON p.label = u."Label" WHERE place <= quota UNION ALL
    SELECT record_id, {asset('log_text')}, log_text, class_id, 'user_correction' FROM corrections, range({BOOST}) WHERE NOT used_for_training)"""])
oracle("enhanced_dataset", ENHANCED, "SELECT * FROM enhanced")
NAMES = fixed.CLASS_NAMES_BY_ID
oracle("dataset_metadata", ENHANCED, f"""
  SELECT '2025-07-01 00:00:00' AS generation_timestamp, count(*) AS total_logs, count(*) FILTER (WHERE "Source" = 'labelled_line') AS filler_logs,
    count(*) FILTER (WHERE "Source" = 'user_correction') AS correction_logs,
    {', '.join(f'count(*) FILTER (WHERE "Label" = {c}) AS {n}' for c, n in NAMES.items())},
    {', '.join(f'''count(*) FILTER (WHERE "Label" = {c} AND "Source" = 'user_correction') AS corrections_{n}''' for c, n in NAMES.items())},
    count(*) FILTER (WHERE "Source" = 'user_correction') // {BOOST} AS corrections_used, {BOOST} AS correction_boost_factor FROM enhanced""")
oracle("saved_dataset", ENHANCED, """
  SELECT place, "ID", "Asset", md5("Log") AS log_md5, "Label"::INTEGER AS "Label", "Source" FROM enhanced, (VALUES ('by_class'), ('combined')) AS p(place)""")
LABELLED = """labelled AS (SELECT *, CASE event_category WHEN 'authentication_success' THEN 'Success_login'
    WHEN 'authentication_failure' THEN 'Failed_login' ELSE 'Other' END AS label FROM categorized)"""
oracle("label_counts", AUTH_LINES, CATEGORIZED, LABELLED, "SELECT label, count(*) AS rows FROM labelled GROUP BY label")
oracle("asset_counts", AUTH_LINES, f"""SELECT {asset('line')} AS "Asset", count(*) AS rows FROM auth_lines GROUP BY 1 ORDER BY rows DESC, 1 LIMIT 10""")
oracle("distinct_counts", "SELECT DISTINCT count(*) AS rows FROM events GROUP BY user_id")
oracle("labelled_samples", AUTH_LINES, CATEGORIZED, """
  SELECT source, line_id, line AS text, CASE event_category WHEN 'authentication_failure' THEN 'Failed_login' ELSE 'Other' END AS label
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_id) AS rank FROM categorized) WHERE rank <= 100""")
oracle("union_labelled", AUTH_LINES, CATEGORIZED, LABELLED, DOC_LINES, f"""
  SELECT line AS text, label, NULL::VARCHAR AS asset FROM labelled UNION ALL SELECT line, NULL, {asset('line')} FROM doc_lines""")
oracle("first_lines", AUTH_LINES, "SELECT line_id, line FROM auth_lines ORDER BY line_id LIMIT 1000")
oracle("line_preview", AUTH_LINES, """
  SELECT row_number() OVER (ORDER BY line_id) || ': ' || line AS preview FROM (SELECT line_id, line FROM auth_lines ORDER BY line_id LIMIT 5)""")
oracle("line_numbers", AUTH_LINES, """
  SELECT source, line_id, row_number() OVER (PARTITION BY source ORDER BY line_id) AS line_number FROM auth_lines""")
oracle("shuffled_rows", AUTH_LINES, f"""
  SELECT line_id, row_number() OVER (ORDER BY md5('{SEED}:' || line_id), line_id) AS position FROM auth_lines""")
oracle("ordered_split", AUTH_LINES, """
  SELECT line_id, CASE WHEN row_number() OVER (ORDER BY line_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'validation' END AS part FROM auth_lines""")

# ---------------------------------------------------------------- tokens

oracle("token_rows", AUTH_LINES, token_table("tokens", "auth_lines"), "SELECT line_id, pos::INTEGER AS pos, token FROM tokens")
oracle("token_offsets", AUTH_LINES, offset_table("spans", "auth_lines"), """
  SELECT line_id, pos::INTEGER AS pos, start_at::INTEGER AS start_at, end_at::INTEGER AS end_at, token FROM spans""")
for name, lines, cte in (("document_vocabulary", "doc_lines", DOC_LINES), ("line_vocabulary", "auth_lines", AUTH_LINES)):
    oracle(name, cte, token_table("tokens", lines), vocabulary_table("vocabulary", "tokens"), "SELECT word, idx, occurrences FROM vocabulary")
TAGS = tag_table("tags", "auth_lines")
oracle("bio_tags", AUTH_LINES, TAGS, "SELECT line_id, pos::INTEGER AS pos, token, tag FROM tags")
oracle("bio_spans", AUTH_LINES, TAGS, span_table("found", "tags"), "SELECT line_id, ord::INTEGER AS ord, type, value FROM found")
oracle("last_entities", AUTH_LINES, tag_table("tags", "auth_lines"), span_table("found", "tags"), """
  SELECT line_id, type, arg_max(value, ord) AS value FROM found GROUP BY line_id, type""")
oracle("span_tokens", AUTH_LINES, offset_table("spans", "auth_lines"), """
  SELECT line_id, string_agg(token, ' ' ORDER BY pos) AS inside FROM spans JOIN (SELECT line_id, strpos(line, ':') - 3 AS place FROM auth_lines) USING (line_id)
  WHERE start_at >= place AND end_at <= place + 8 GROUP BY line_id""")
oracle("tag_index", AUTH_LINES, TAGS, "SELECT tag, row_number() OVER (ORDER BY tag) AS idx FROM (SELECT DISTINCT tag FROM tags)")
oracle("decoded_tags", AUTH_LINES, TAGS, "SELECT tag, tag AS decoded, count(*) AS tokens FROM tags GROUP BY tag")
oracle("encoded_batches", AUTH_LINES, token_table("tokens", "auth_lines"), vocabulary_table("vocabulary", "tokens"), """
  encoded AS (SELECT line_id, string_agg(idx::VARCHAR, ' ' ORDER BY pos) AS ids, count(*) AS length FROM tokens JOIN vocabulary ON word = lower(token) GROUP BY line_id),
  batched AS (SELECT *, (row_number() OVER (ORDER BY line_id) - 1) // 16 AS batch FROM encoded),
  sized AS (SELECT *, max(length) OVER (PARTITION BY batch) AS longest FROM batched)""", """
  SELECT line_id, batch::BIGINT AS batch, length::INTEGER AS length, ids || repeat(' 0', (longest - length)::BIGINT) AS ids FROM sized""")

# ---------------------------------------------------------------- files and streams

oracle("text_round_trip", AUTH_LINES, "SELECT line, 0::BIGINT AS odd FROM auth_lines")
oracle("broken_cells_csv", "SELECT doc_id AS line_id, md5(source || ' ' || text) AS text FROM documents")
oracle("example_bank_file", AUTH_LINES, f"""
  SELECT line_id AS "ID", {asset('line')} AS "Asset", line AS "Log", {normalize('line')} AS normalized_log FROM auth_lines""")
ORACLES["pattern_file_labels"] = ORACLES["event_patterns"]
oracle("pattern_table", """
  SELECT lang AS category, (generate_subscripts(sources, 1) - 1)::INTEGER AS ord, unnest(sources) AS pattern
  FROM (SELECT lang, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY lang)""")
oracle("first_lines_file", AUTH_LINES, """
  SELECT row_number() OVER (ORDER BY line_id) AS line_number, line FROM (SELECT line_id, line FROM auth_lines ORDER BY line_id LIMIT 1000)""")
oracle("file_admission", AUTH_LINES, f"""
  SELECT DISTINCT source, extension, reason FROM auth_lines, (VALUES ('txt', NULL), ('orc',
    {q('Unsupported file type: orc. Supported types: ' + ', '.join(fixed.ALLOWED_EXTENSIONS))})) AS k(extension, reason)""")
oracle("csv_round_trip", DOC_LINES, f"""
  SELECT line FROM doc_lines WHERE line NOT IN ({', '.join(q(c) for c in fixed.MISSING_CELLS)})""")
oracle("structured_csv_text", AUTH_LINES, "SELECT line_id, event_type || ' ' || line AS text FROM auth_lines")
oracle("json_round_trip", CORRECTIONS, display("corrections WHERE NOT used_for_training").replace("SELECT record_id,", "SELECT record_id, md5(log_text) AS full_log_text,"))
oracle("feedback_append", CORRECTIONS, """
  SELECT substr(md5(log_text || timestamp), 1, 12) AS record_id, md5(log_text) AS text_md5, false AS used_for_training,
    sum(CASE WHEN corrected_label IS NULL THEN 1 ELSE 2 END)::BIGINT AS rows FROM corrections GROUP BY ALL""")
oracle("snapshot_stats", CORRECTIONS, CHOSEN, STATS.format(used=f"used_for_training OR {PICKED}"))
oracle("tagged_file_counts", AUTH_LINES, TAGS, "SELECT tag, count(*) AS tokens FROM tags GROUP BY tag")


def windows(bucket: str, width: str, keys: str, having: str = "true", where: str = "true", measure: str = "events") -> str:
    return f"""
  SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(start + INTERVAL {width}, '%Y-%m-%d %H:%M:%S') AS window_end, {keys}, count(*) AS {measure}
  FROM (SELECT {bucket} AS start, * FROM categorized WHERE {where}) GROUP BY start, {keys} HAVING {having}"""


FOUND = f"""found AS (SELECT *, {search_field('src_ip')} AS src_ip, {search_field('user')} AS user FROM categorized)"""
oracle("stream_alert", AUTH_LINES, CATEGORIZED, FOUND, windows(
    "time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01')", "7 DAY", "src_ip, user", "count(*) > 5",
    "event_category = 'authentication_failure' AND src_ip IS NOT NULL AND user IS NOT NULL", "failures").replace("FROM categorized", "FROM found"))
oracle("stream_hourly", AUTH_LINES, CATEGORIZED, windows("date_trunc('hour', ts)", "1 HOUR", "event_category"))
oracle("stream_daily_summary", AUTH_LINES, CATEGORIZED, windows(
    "time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01 09:00:00')", "1 DAY", "event_category"))
oracle("stream_classified", AUTH_LINES, CATEGORIZED, f"""
  SELECT line_id, event_category, CASE WHEN {HITS['authentication_failure']} <> '' THEN 'authentication_failure'
      WHEN {HITS['authentication_success']} <> '' THEN 'authentication_success' ELSE 'none' END AS label,
    {search_field('user')} AS user, {search_field('src_ip')} AS src_ip, {search_field('action')} AS action FROM categorized""")
oracle("stream_feedback", AUTH_LINES, CATEGORIZED, """
  SELECT DISTINCT substr(md5(line), 1, 12) AS record_id, line AS log_text, event_category AS label FROM categorized""")
