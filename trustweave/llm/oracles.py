"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from trustweave.llm import quality

_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

# -- secrets ---------------------------------------------------------------------

_ASSIGN = """(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\\x20*[:=]\\x20*["']?"""
#: Kind, pattern (what precedes the secret in the first group), and what the whole match must fulfil.
_SECRETS = [
    ("assign", f"(){_ASSIGN}[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(x, $${_ASSIGN}$$, '')) >= 6"),
    ("access", "()AKIA[A-Z0-9]+", "length(x) >= 20"),
    ("hex", "()[0-9a-f]+", "length(x) >= 24"),
    ("private_key", "()-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", "true"),
    ("github", "(^|[^A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("slack", "(^|[^A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("jwt", "(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "true"),
]


def _found(place: int, kind: str, pattern: str, valid: str) -> str:
    return f"""
  SELECT doc_id, '{kind}' AS kind, {place} AS place, s, x FROM (
    SELECT doc_id, length(g[i]) + list_sum(list_transform(b[1:i], lambda z: length(z)))
             + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS s,
           m[i][length(g[i]) + 1:] AS x
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, $${pattern}$$, 0) AS m, regexp_extract_all(t, $${pattern}$$, 1) AS g,
             string_split_regex(t, $${pattern.replace('()', '', 1)}$$) AS b FROM texts)))
  WHERE {valid}"""


SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({' UNION ALL '.join(_found(i, *rule) for i, rule in enumerate(_SECRETS))}),
lines AS (SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(x) AS BIGINT) AS line FROM hits)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(line, ',' ORDER BY s, place) FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
  coalesce(string_agg(line, ',' ORDER BY s, place), '') AS spans
FROM documents LEFT JOIN lines USING (doc_id) GROUP BY doc_id"""

# -- near duplicates ------------------------------------------------------------------

NEAR_DUP = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM split),
sizes AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN sets USING (doc_id) GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ways.b, root FROM reach JOIN ways ON ways.a = node)
SELECT node AS doc_id, any_value(n) AS n_shingles, min(root) AS component_id, node = min(root) AS kept
FROM reach JOIN sizes ON doc_id = node GROUP BY node"""

# -- quality rules -----------------------------------------------------------------------

_SIGNALS = [(s, over, under, margin) for s, (over, under, margin) in quality.SIGNALS.items()]
_BASE = f"(n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"
_Q = lambda share: f"min(CASE WHEN 100 * upto >= {share} * total THEN low END)"

QUALITY = f"""
WITH split AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM split LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)),
signals AS (
  {' UNION ALL '.join(f"SELECT lang, source, '{s}' AS signal, {margin} AS margin, {over} * 1000 // n_words AS v FROM counts WHERE NOT {_BASE}" for s, over, under, margin in _SIGNALS)}),
low AS (SELECT *, CASE WHEN v < 64 THEN v ELSE (v >> (length(to_base(v, 2)) - 6)) << (length(to_base(v, 2)) - 6) END AS low FROM signals),
levels AS (
  SELECT 0 AS level, lang AS l, source AS s, signal, margin, low, count(*) AS n FROM low GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, signal, margin, low, count(*) FROM low GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, signal, margin, low, count(*) FROM low GROUP BY ALL),
sums AS (SELECT *, sum(n) OVER (PARTITION BY level, l, s, signal ORDER BY low) AS upto, sum(n) OVER (PARTITION BY level, l, s, signal) AS total FROM levels),
fences AS (
  SELECT level, l, s, signal, max(total) AS total,
    greatest({_Q(75)} + {quality.SPREAD} * ({_Q(75)} - {_Q(25)}), {_Q(50)} + any_value(margin)) AS fence
  FROM sums GROUP BY level, l, s, signal),
used AS (
  SELECT o.l AS lang, o.s AS source, o.signal,
    CASE WHEN o.total >= {quality.MIN_GROUP} THEN o.fence WHEN u.total >= {quality.MIN_GROUP} THEN u.fence ELSE e.fence END AS fence
  FROM fences o JOIN fences u ON u.level = 1 AND u.l IS NOT DISTINCT FROM o.l AND u.signal = o.signal
  JOIN fences e ON e.level = 2 AND e.signal = o.signal WHERE o.level = 0),
beyond AS (
  SELECT doc_id, min(CASE signal {' '.join(f"WHEN '{s}' THEN {i}" for i, (s, *_) in enumerate(_SIGNALS))} END) AS first
  FROM counts c JOIN used u ON u.lang IS NOT DISTINCT FROM c.lang AND u.source IS NOT DISTINCT FROM c.source
  WHERE n_words > 0 AND CASE signal {' '.join(f"WHEN '{s}' THEN {over} * 1000 // n_words" for s, over, *_ in _SIGNALS)} END > fence
  GROUP BY doc_id),
judged AS (
  SELECT c.*, {_BASE} AS base_failed,
    CASE WHEN n_words < {quality.MIN_WORDS} THEN 'short' WHEN {_BASE} THEN 'repetitive'
      ELSE CASE first {' '.join(f"WHEN {i} THEN '{s}'" for i, (s, *_) in enumerate(_SIGNALS))} END END AS reason
  FROM counts c LEFT JOIN beyond USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason IS NULL AS kept, reason FROM judged"""


NEAR_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT node, b FROM reach JOIN links ON other = a),
component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON vec_id = node LEFT JOIN counted ON a = vec_id"""
