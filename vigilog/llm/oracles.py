"""DuckDB SQL for those training-data queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _spans(kind: str, rank: int, pattern: str, least: int) -> str:
    """Places of a pattern's matches: marks around them, then the lengths of the pieces between."""
    return f"""
      SELECT doc_id, '{kind}' AS kind, {rank} AS rank, upto - width AS s, upto AS e FROM (
        SELECT doc_id, cut, n, n - (cut > 0)::int AS width,
               sum(n - (cut > 0)::int) OVER (PARTITION BY doc_id ORDER BY place) AS upto
        FROM (SELECT doc_id, place, length(piece) AS n, instr(piece, chr(2)) AS cut FROM (
          SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS place FROM (
            SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)),
              '{pattern}', chr(1) || '\\1' || chr(2) || '\\2' || chr(1), 'g'), chr(1)) AS pieces FROM documents))))
      WHERE cut > 0 AND n - cut >= {least}"""


_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = "((?:" + _NAMES + """)["'']?\\x20*[:=]\\x20*["'']?)([A-Za-z0-9+/_.=-]+)"""

ORACLES["op7_blob_ledger"] = f"""
WITH found AS ({_spans("assign", 0, _ASSIGN, 6)}
  UNION ALL {_spans("access", 1, "()(AKIA[A-Z0-9]+)", 20)}
  UNION ALL {_spans("hex", 2, "()([0-9a-f]+)", 24)}),
 digest AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' ORDER BY s, rank) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN digest USING (doc_id)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::int >> {shift}) & 31), 1)"
    for i in range(8) for shift in (15, 10, 5, 0)
)

ORACLES["op9_warc_chunks"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
 k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""


def _shingle_sets(table: str, key: str, words: int) -> str:
    """Distinct shingles of ``words`` lower-cased words; a shorter text is one shingle."""
    return f"""
      SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {words} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END) AS g
      FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})"""


ORACLES["op3_containment"] = f"""
WITH d AS ({_shingle_sets("documents", "doc_id", 5)}), i AS ({_shingle_sets("benchmark", "item_id", 5)}),
 n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, item_shingles, count(*) AS shared
FROM d JOIN i USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING 100 * count(*) >= 80 * item_shingles
"""

ORACLES["op2_hamming_join"] = f"""
WITH RECURSIVE s AS MATERIALIZED ({_shingle_sets("documents", "doc_id", 2)}),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
 reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a),
 final AS (SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
           FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id))
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM final
"""

ORACLES["op6_suffix_trees"] = """
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 r AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS run
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w WHERE len(w) >= 50)),
 m AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY run) AS least FROM r) WHERE least < doc_id),
 g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM m),
 x AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(len(gone), 0)::bigint AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w
         ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id)
"""

# crc32 bit by bit, over the digits of the id.
_CRC = """xor(list_reduce(range(0, 8 * strlen(doc_id::varchar)), lambda c, i: xor(
  xor(c, CASE WHEN i % 8 = 0 THEN ord(substr(doc_id::varchar, i // 8 + 1, 1)) ELSE 0 END) >> 1,
  3988292384 * (xor(c, CASE WHEN i % 8 = 0 THEN ord(substr(doc_id::varchar, i // 8 + 1, 1)) ELSE 0 END) & 1)), 4294967295::bigint), 4294967295)"""

ORACLES["op11_periodic_runs"] = f"""
WITH t AS (SELECT doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
 p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
 d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN w
        ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
 k AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
 e AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
 s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
 r AS MATERIALIZED (SELECT doc_id, q, min(i) AS b, count(*) + q AS size FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
 f AS MATERIALIZED (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.b <= r.b AND o.b + o.size >= r.b + r.size)),
 g AS (SELECT DISTINCT doc_id, unnest(range(b + q, b + size)) AS i FROM f),
 c AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM k ANTI JOIN g USING (doc_id, i) GROUP BY k.doc_id),
 l AS (SELECT doc_id, count(*) AS n_runs, string_agg(b || ',' || size || ',' || q || chr(10), '' ORDER BY b, q) AS runs FROM f GROUP BY doc_id),
 m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size / q DESC, b, q) = 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, m.b::bigint AS start, m.size::bigint AS length, m.q::bigint AS period,
       (1000 * m.size // m.q)::bigint AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES["op12_hard_negatives"] = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
       QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::int AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""

_CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN ", "[/TURN]"]
# A backslash is put behind every backslash and behind the first character of every control string.
_ADDED = " + ".join(["length(text) - length(replace(text, chr(92), ''))", *[f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in _CONTROL]])

ORACLES["op13_chat_events"] = f"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + {_ADDED} + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 18 ELSE 6 END)::bigint AS formatted_chars
FROM t GROUP BY conv_id
"""
