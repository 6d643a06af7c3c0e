"""Building blocks of the reference SQL (DuckDB dialect).

Patterns and word lists come from the fixed values; everything else is
written out independently of the Spark expressions.
"""

from __future__ import annotations

from vigilog import fixed_values as fixed

SPACE = f"[{fixed.WHITESPACE_CLASS}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def gsub(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(replacement)}, 'g')"


def strip(expr: str) -> str:
    return gsub(expr, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(expr: str) -> str:
    return strip(gsub(expr, f"{SPACE}+", " "))


def split_words(expr: str) -> str:
    return f"list_filter(string_split({squeeze(expr)}, ' '), lambda w: w <> '')"


def normalize(expr: str) -> str:
    for pattern in fixed.TIMESTAMP_REMOVALS + fixed.ADDRESS_REMOVALS:
        expr = gsub(expr, pattern, "")
    expr = gsub(expr, fixed.BRACKETS_AND_QUOTES, " ")
    # No look-behind here: every second boundary needs another pass.
    for _ in range(2):
        expr = gsub(expr, "([A-Za-z])([A-Z])", r"\1 \2")
    return squeeze(f"lower({expr})")


def preprocess(expr: str) -> str:
    expr = gsub(f"lower({expr})", r"\d+", "")
    expr = gsub(expr, fixed.BRACKETS_AND_QUOTES, " ")
    expr = f"translate({expr}, {q(fixed.ASCII_PUNCTUATION)}, '')"
    for pattern, replacement in fixed.SCORING_OPTIONS["term_normalizations"].items():
        expr = gsub(expr, pattern, replacement)
    return squeeze(expr)


def first_match(expr: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({expr}, {q(pattern)}, {group}), '')"


def case(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


def rule_case(expr: str, rules, default: str) -> str:
    return case([(f"regexp_matches({expr}, {q(p)})", q(v)) for p, v in rules], q(default))


def contains_case(expr: str, rules, default: str) -> str:
    found = [(" OR ".join(f"contains(lower({expr}), {q(w)})" for w in ws), q(v)) for v, ws in rules]
    return case(found, q(default))


def category(expr: str) -> str:
    return rule_case(expr, fixed.EVENT_CATEGORIES, fixed.DEFAULT_EVENT_CATEGORY)


def asset(expr: str) -> str:
    return contains_case(expr, fixed.ASSET_TYPES, fixed.DEFAULT_ASSET_TYPE)


def search_field(name: str, expr: str = "line") -> str:
    return first_match(expr, fixed.SEARCH_FIELDS[name], 1)


# ---------------------------------------------------------------- derived tables

AUTH_LINES = """auth_lines AS (
  SELECT event_id AS line_id, ts, user_id, event_type, 'host-' || (event_id % 7) AS source,
    strftime(ts, '%Y-%m-%d %H:%M:%S') || ' host-' || (event_id % 7) || ' ' || CASE
      WHEN event_type = 'error' AND event_id % 3 = 0
        THEN 'sshd[' || pid || ']: ERROR authentication failed; failed login for user=' || uname || ' from ' || ip
      WHEN event_type = 'error'
        THEN 'sshd[' || pid || ']: Failed password login for user=' || uname || ' from ' || ip || ' port 22 ssh2'
      WHEN event_type = 'signup'
        THEN 'sshd[' || pid || ']: Successful login INFO for user=' || uname || ' from ' || ip || ' port 22 ssh2'
      WHEN event_type = 'purchase'
        THEN 'postgres[' || pid || ']: LOG:  connection authorized: user=' || uname || ' database=prod session_id=s' || event_id
      WHEN event_type = 'click'
        THEN 'apache2[' || pid || ']: ' || ip || ' GET /index.html'
          || CASE WHEN event_id % 11 = 0 THEN ' union select' ELSE '' END
          || CASE WHEN event_id % 13 = 0 THEN ' <script>' ELSE '' END
      ELSE 'kernel: WARN eth0 state change on web-prod-01' END AS line
  FROM (SELECT *, 'user' || user_id AS uname, 1000 + event_id % 60000 AS pid,
          '10.0.' || (user_id % 4) || '.' || (1 + user_id % 250) AS ip FROM events))"""

DOC_LINES = f"""doc_lines AS (
  SELECT {{'doc_id': doc_id, 'pos': pos - 1}} AS line_id, source, {strip('raw')} AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
          generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE {strip('raw')} <> '')"""

PAGE_LINES = "page_lines AS (SELECT page_id AS line_id, html AS line FROM pages)"

TURN_PAIRS = """turn_pairs AS (
  SELECT a.conv_id, a.turn, a.text AS first, b.text AS second
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

CORRECTIONS = """raw_corrections AS (
  SELECT doc_id, text AS log_text,
    CASE WHEN quality = 1 THEN 'Successful login' ELSE 'Failed login' END AS original_label,
    (n_chars % 1000) / 1000.0::DOUBLE AS original_confidence,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'Failed login' WHEN toxic = 1 THEN 'failed_login'
      WHEN quality = 1 THEN 'successful_login' ELSE 'other_login' END AS corrected_label,
    '2025-06-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' 12:' || lpad((doc_id % 60)::VARCHAR, 2, '0')
      || ':00.000000' AS timestamp,
    CASE WHEN doc_id % 5 <> 0 THEN substr(md5(doc_id::VARCHAR), 1, 12) END AS stored_id,
    CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 = 0 END AS stored_used
  FROM labels JOIN documents USING (doc_id)),
corrections AS (
  SELECT *, coalesce(stored_id, substr(md5(log_text || timestamp), 1, 12)) AS record_id,
    coalesce(stored_used, false) AS used_for_training,
    CASE lower(replace(coalesce(corrected_label, ''), ' ', '_'))
      WHEN 'successful_login' THEN 1 WHEN 'failed_login' THEN 2 ELSE 0 END AS class_id
  FROM raw_corrections)"""

CHOSEN = """chosen AS (
  SELECT DISTINCT record_id, log_text FROM corrections
  WHERE NOT used_for_training AND lower(replace(corrected_label, ' ', '_')) = 'failed_login')"""


# ---------------------------------------------------------------- tokens and tags

TOKEN = rf"[{fixed.WORD_CLASS}]+|[^{fixed.WORD_CLASS}{fixed.WHITESPACE_CLASS}]"


def token_table(name: str, lines: str) -> str:
    """CTE ``name(line_id, pos, token)``."""
    found = f"regexp_extract_all(line, {q(TOKEN)})"
    return f"""{name} AS (SELECT line_id, unnest({found}) AS token, generate_subscripts({found}, 1) - 1 AS pos FROM {lines})"""


def offset_table(name: str, lines: str) -> str:
    """CTE ``name(line_id, pos, start_at, end_at, token)`` from runs of tokens and blanks."""
    runs = f"regexp_extract_all(line, {q(TOKEN + '|' + SPACE + '+')})"
    return f"""{name}_runs AS (SELECT line_id, unnest({runs}) AS run, generate_subscripts({runs}, 1) AS k FROM {lines}),
{name}_ends AS (SELECT *, sum(length(run)) OVER (PARTITION BY line_id ORDER BY k) AS end_at FROM {name}_runs),
{name} AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY k) - 1 AS pos,
  end_at - length(run) AS start_at, end_at, run AS token FROM {name}_ends WHERE NOT regexp_full_match(run, {q(SPACE + '+')}))"""


# The text before the capture group inside a match of each tag pattern.
TAG_LEADS = {"USERNAME": r"(?i)^(?:user\s+|for\s+)", "PORT": r"(?i)^port\s+", "DURATION": r"(?i)^\(duration:\s+", "STATUS": "^"}


def tag_table(name: str, lines: str) -> str:
    """CTEs ending in ``name(line_id, pos, token, tag)``."""
    spans = []
    for order, (tag, pattern) in enumerate(fixed.TAG_PATTERNS):
        whole = q("(?i)" + pattern)
        group = 1 if tag in TAG_LEADS else 0
        lead = f"length(regexp_extract(match, {q(TAG_LEADS[tag])}))" if group else "0"
        spans.append(f"""SELECT line_id, {order} AS ord, {q(tag)} AS tag, place + {lead} AS s, place + {lead} + length(part) AS e FROM (
  SELECT line_id, matches[k] AS match, parts[k] AS part,
    list_sum([length(x) for x in gaps[1:k]]) + coalesce(list_sum([length(x) for x in matches[1:k-1]]), 0) AS place
  FROM (SELECT line_id, regexp_extract_all(line, {whole}) AS matches, regexp_extract_all(line, {whole}, {group}) AS parts,
      string_split_regex(line, {whole}) AS gaps, unnest(range(1, len(regexp_extract_all(line, {whole})) + 1)) AS k
    FROM {lines}))""")
    return f"""{offset_table(name + '_tokens', lines)},
{name}_spans AS ({' UNION ALL '.join(spans)}),
{name}_hits AS (
  SELECT t.line_id, t.pos, s.ord, s.tag,
    CASE WHEN t.pos = min(t.pos) OVER (PARTITION BY t.line_id, s.ord, s.s) THEN 'B-' ELSE 'I-' END || s.tag AS full_tag
  FROM {name}_tokens t JOIN {name}_spans s ON t.line_id = s.line_id AND t.start_at >= s.s AND t.end_at <= s.e),
{name}_last AS (SELECT line_id, pos, arg_max(full_tag, ord) AS tag FROM {name}_hits GROUP BY ALL),
{name} AS (SELECT t.line_id, t.pos, t.token, coalesce(l.tag, 'O') AS tag
  FROM {name}_tokens t LEFT JOIN {name}_last l ON t.line_id = l.line_id AND t.pos = l.pos)"""


def span_table(name: str, tags: str) -> str:
    """CTEs ending in ``name(line_id, ord, type, value)``."""
    return f"""{name}_starts AS (SELECT *, count(*) FILTER (WHERE tag LIKE 'B-%') OVER (PARTITION BY line_id ORDER BY pos) AS island FROM {tags}),
{name}_typed AS (SELECT *, first_value(substr(tag, 3)) OVER (PARTITION BY line_id, island ORDER BY pos) AS kind FROM {name}_starts WHERE island > 0),
{name}_runs AS (SELECT *, count(*) FILTER (WHERE tag NOT LIKE 'B-%' AND tag <> 'I-' || kind) OVER (PARTITION BY line_id, island ORDER BY pos) AS broken FROM {name}_typed),
{name} AS (SELECT line_id, island - 1 AS ord, kind AS type, string_agg(token, ' ' ORDER BY pos) AS value FROM {name}_runs WHERE broken = 0 GROUP BY line_id, island, kind)"""


def vocabulary_table(name: str, tokens: str) -> str:
    return f"""{name} AS (SELECT word, row_number() OVER (ORDER BY occurrences DESC, seen) + 1 AS idx, occurrences FROM (
  SELECT lower(token) AS word, count(*) AS occurrences, min({{'l': line_id, 'p': pos}}) AS seen FROM {tokens} GROUP BY 1))"""


# ---------------------------------------------------------------- vectors

MEANS = """means AS (
  SELECT label, list(value ORDER BY pos) AS vec FROM (
    SELECT label, pos, avg(v) AS value FROM (
      SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label)"""

SIMS = MEANS + """,
sims AS (
  SELECT e.vec_id, e.label, m.label AS category, list_cosine_similarity(e.embedding::DOUBLE[], m.vec) AS sim
  FROM embeddings e CROSS JOIN means m),
scores AS (
  SELECT vec_id, any_value(label) AS label, arg_max(category, sim) AS category, round(max(sim), 6) AS score
  FROM sims GROUP BY vec_id)"""


def hashed_vectors(name: str, texts: str, column: str, size: int) -> str:
    """CTE ``name(column, slot, n)``: how often the words of a text fall into each slot."""
    return f"""{name} AS (SELECT {column}, slot, count(*)::DOUBLE AS n FROM (
  SELECT {column}, ('0x' || substr(md5(word), 1, 8))::BIGINT % {size} AS slot
  FROM (SELECT {column}, unnest(string_split({column}, ' ')) AS word FROM {texts}) WHERE word <> '') GROUP BY ALL)"""


def common_subsequences(name: str, pairs: str) -> str:
    """CTEs ending in ``name(first, second, lcs)``: one recursion step per character of the first text.

    The next row of the table is the running maximum of the last one and of its left neighbours plus one where the
    characters are equal. Only the last row is kept.
    """
    return f"""{name}_texts AS MATERIALIZED (SELECT row_number() OVER () AS k, first, second
  FROM (SELECT DISTINCT first, second FROM {pairs} WHERE length(first) > 0 AND length(second) > 0)),
{name}_cells AS MATERIALIZED (SELECT k, unnest(range(1, length(second) + 1)) AS j, unnest(string_split(second, '')) AS ch FROM {name}_texts),
{name}_rows(i, k, j, v) USING KEY (k, j) AS (
  SELECT 0, k, j, 0 FROM {name}_cells
  UNION
  SELECT i, k, j, max(best) OVER (PARTITION BY k ORDER BY j) AS v FROM (
    SELECT r.i + 1 AS i, r.k, r.j, greatest(r.v, CASE WHEN c.ch = t.first[r.i + 1]
        THEN coalesce(lag(r.v) OVER (PARTITION BY r.k ORDER BY r.j), 0) + 1 ELSE 0 END) AS best
    FROM {name}_rows r JOIN {name}_cells c ON c.k = r.k AND c.j = r.j JOIN {name}_texts t ON t.k = r.k WHERE r.i < length(t.first))),
{name} AS (SELECT first, second, max(v) AS lcs FROM {name}_rows JOIN {name}_texts USING (k) GROUP BY first, second)"""
