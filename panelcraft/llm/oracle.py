"""DuckDB twins of the training-data queries that SQL can express whole.

The other operators hash, train or tokenize; their tests compare them with brute force.
"""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p(i) WHERE len(w) > 0),
found AS (
  SELECT spots.r, spots.i, spots.k, wins.item
  FROM (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS words
        FROM docs, (SELECT DISTINCT k FROM wins) lengths, unnest(range(1, len(w) - k + 2)) p(i)) spots
  JOIN wins USING (k, words)),
hit AS (SELECT r, count(DISTINCT spot) AS n_hit FROM found, unnest(range(i, i + k)) p(spot) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""

SAID = r"\### Assistant: </turn> ok"
MARKED = "(2 * length({0}) - length(translate({0}, '\\<#:', '')))"
CHAT = f"""WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{SAID}'), (-7, 1, 'assistant', '{SAID}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('### : </turn>') + 1 + {MARKED.format('role')} + {MARKED.format('text')})::BIGINT AS formatted_chars
FROM said GROUP BY conv_id"""

COLLOCATIONS = f"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang, {LOWER} AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^ \\t]+') AS w FROM docs, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) u(p)),
grams AS (
  SELECT lang, w[i : i + k - 1] AS g, count(*) AS f
  FROM pieces, unnest([1, 2, 3]) s(k), unnest(range(1, len(w) - k + 2)) v(i) GROUP BY lang, g),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE len(g) = 1 GROUP BY lang),
cand AS (SELECT lang, g, f AS a FROM grams WHERE len(g) > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cand c, unnest(range(1, len(c.g))) s(k)
  JOIN grams x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN grams y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
covered AS (
  SELECT DISTINCT c.lang, c.g FROM cand t, unnest([1, 2]) s(i), cand c
  WHERE len(t.g) = 3 AND c.lang = t.lang AND c.g = t.g[i : i + 1] AND 100 * t.a >= 50 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
  array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM lowest ANTI JOIN covered USING (lang, g) JOIN sizes USING (lang) QUALIFY rank <= 2000"""

HARD_NEGATIVES = """WITH whole AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = o.label AS same, o.vec_id, list_dot_product(a.v, o.v)::BIGINT AS score
  FROM whole a JOIN whole o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

ORACLE = {"op11_hard_negatives": HARD_NEGATIVES, "op3_decontaminate": DECONTAMINATE, "op9_chat_tree": CHAT, "op12_collocations": COLLOCATIONS}
