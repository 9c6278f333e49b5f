"""Comparison SQL of the queries that SQL can express, written for DuckDB."""

from __future__ import annotations

from sheaf.llm.common import A_TO_Z, LOWER

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{A_TO_Z}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

WU_MANBER = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (
    SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc_words CROSS JOIN (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, item, i, n FROM doc_windows JOIN item_windows USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

_ESCAPED = r"regexp_replace(replace({0}, '\', '\\'), '([<\[])(/?)(s>|INST\])', '\1\\\2\3', 'g')"

PREFIX_TARGETS = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, sum(20 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + "))"

MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (
    SELECT doc_id, lang, {_LEAF.format('n_chars')} AS leaf,
      CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN {_LEAF.format('(n_chars + 1)')} ELSE {_LEAF.format('n_chars')} END AS bent FROM documents)),
tree AS (
  SELECT lang, 0 AS level, pos, n, leaf AS node FROM leaves UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (SELECT lang, node, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, node FROM subroots UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT l.lang, l.pos, t.level, l.pos >> t.level AS slot, s.node AS other FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.pos = l.pos >> t.level AND t.n > 1
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.pos = xor(t.pos, 1::BIGINT)
  UNION ALL
  SELECT l.lang, l.pos, r.height + t.level, r.pos >> t.level, s.node FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
    JOIN top t ON t.pos = r.pos >> t.level AND t.n > 1 LEFT JOIN top s ON s.level = t.level AND s.pos = xor(t.pos, 1::BIGINT)),
folded AS (
  SELECT lang, pos, 0 AS level, bent AS node FROM leaves UNION ALL
  SELECT f.lang, f.pos, f.level + 1, sha256(CASE WHEN other IS NULL THEN f.node WHEN slot % 2 = 1 THEN other || f.node ELSE f.node || other END)
  FROM folded f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos AND s.level = f.level),
ends AS (SELECT lang, pos, max_by(node, level) AS folded_root FROM folded GROUP BY lang, pos),
proofs AS (SELECT lang, pos, string_agg(other, '' ORDER BY level) AS path FROM steps GROUP BY lang, pos)
SELECT l.doc_id, l.leaf, r.node AS subroot, t.node AS root, sha256(coalesce(p.path, '')) AS proof_sha256, e.folded_root, e.folded_root = t.node AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN top t ON t.n = 1
JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.pos = l.pos LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""
