"""SQL for the operators that SQL can express, written apart from their plans."""

from __future__ import annotations

from quadrille.llm.licenses import PHRASES, TEXTS

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
grams AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
          FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
widths AS (SELECT DISTINCT m FROM grams),
windows AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM d, widths, unnest(range(1, len(w) - m + 2)) t(i)),
hits AS (SELECT doc_id, i, m, item FROM windows JOIN grams USING (m, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

_TEXTS = ", ".join([*(f"('{t}', '{x}', true)" for t, x in PHRASES.items()), *(f"('{t}', '{x}', false)" for t, x in TEXTS.items())])

LICENSES = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
texts(template, label, base) AS (VALUES {_TEXTS}),
templates AS (SELECT template, label, base, len(w) - 1 AS pairs, i - 1 AS position, w[i] || ' ' || w[i + 1] AS pair
              FROM (SELECT *, string_split(template, ' ') AS w FROM texts), unnest(range(1, len(w))) t(i)),
votes AS (SELECT doc_id, template, label, base, pairs, i - 1 - position AS diagonal, i - 1 AS place
          FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS pair FROM d, unnest(range(1, len(w))) t(i)) JOIN templates USING (pair)),
lines AS (SELECT doc_id, template, label, base, pairs, diagonal, count(*) AS votes, min(place) AS low, max(place) AS high FROM votes GROUP BY ALL),
wholes AS (SELECT * FROM lines WHERE votes = pairs),
runs AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run
         FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 3 THEN 1 ELSE 0 END AS gap
               FROM lines WHERE NOT base AND pairs >= 6)),
long AS (SELECT *, max(high) OVER w - min(low) OVER w > 2 * pairs AS cut, diagonal - min(diagonal) OVER w AS away, greatest(pairs // 2, 2) AS half
         FROM runs WINDOW w AS (PARTITION BY doc_id, template, run)),
pieces AS (SELECT *, 0 AS way, 0 AS piece FROM long WHERE NOT cut UNION ALL SELECT *, 1, away // half FROM long WHERE cut
           UNION ALL SELECT *, 2, (away + half // 2) // half FROM long WHERE cut),
merged AS (SELECT doc_id, label, least(1.0::DOUBLE, sum(votes) / pairs) AS share FROM pieces GROUP BY doc_id, template, label, pairs, run, way, piece
           HAVING sum(votes) >= ceil(pairs * 0.7) AND max(high) - min(low) <= 2 * pairs),
found AS (SELECT doc_id, label, 1.0::DOUBLE AS share FROM wholes UNION ALL SELECT doc_id, label, share FROM merged),
labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY doc_id),
base AS (SELECT doc_id, count(*) AS n, min(diagonal) AS low, max(diagonal) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
         FROM wholes WHERE base GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.low AS first_word, b.high AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(l.score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN base b USING (doc_id) LEFT JOIN labelled l USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Kinds, patterns, the group that counts and its least length; the first three are the base.
_SECRETS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)


def _rule(k: int) -> str:
    kind, pattern, group, least = _SECRETS[k]
    pattern = _quoted(pattern)
    return f"""SELECT doc_id, {k} AS kind, '{kind}' AS name, unnest(regexp_split_to_array(text, {pattern})) AS gap,
       unnest(regexp_extract_all(text, {pattern}, 0)) AS whole, unnest(regexp_extract_all(text, {pattern}, {group})) AS part,
       unnest(range(len(regexp_split_to_array(text, {pattern})))) AS i, {least} AS least FROM documents"""


SECRETS = f"""
WITH cut AS ({" UNION ALL ".join(map(_rule, range(len(_SECRETS))))}),
placed AS (SELECT *, sum(length(gap) + coalesce(length(whole), 0)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM cut),
spans AS (SELECT doc_id, kind, stop - length(whole) AS start, name || ':' || CAST(stop - length(whole) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span
          FROM placed WHERE whole IS NOT NULL AND length(part) >= least),
digests AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
            string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN digests USING (doc_id)
"""

_UNIT = "CAST(embedding AS DOUBLE[])"

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, {_UNIT} AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM roots LEFT JOIN counts USING (vec_id)
"""
