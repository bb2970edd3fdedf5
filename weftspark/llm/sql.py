"""DuckDB SQL of the queries that SQL can express."""

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(vec_id, root) USING KEY (vec_id) AS (
  SELECT vec_id, vec_id AS root FROM v
  UNION
  SELECT l.w, min(r.root) FROM reach r JOIN links l ON l.u = r.vec_id
  JOIN recurring.reach o ON o.vec_id = l.w WHERE r.root < o.root GROUP BY l.w
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.root::BIGINT AS component_id, v.vec_id = r.root AS kept
FROM v JOIN reach r USING (vec_id) LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) n ON n.u = v.vec_id
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, b, sha256(h) AS s, min(page_id) OVER (PARTITION BY sha256(h)) AS f FROM p)
SELECT page_id, b::BIGINT AS payload_bytes, s AS payload_digest,
  CASE WHEN b >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 100 AND page_id > f THEN f END AS refers_to
FROM d
"""

OP4 = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
s AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM starts),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM s) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM r),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.k) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[OUT\]|</s>|<s>|\[ROLE\]|\[TEXT\]|\[/ROLE\]', 'x' || '\0', 'g'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + length(role) END AS n,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  (3 + sum(n))::BIGINT AS formatted_chars,
  bool_and(CASE WHEN p IS NULL THEN role IN ('system', 'user') WHEN p = 'system' THEN role = 'user' WHEN p = 'user' THEN role = 'assistant' WHEN p = 'assistant' THEN role = 'user' ELSE false END)
    AND last(role ORDER BY turn, role, text) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""

_LEDGER = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) AS three, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS k FROM win) WHERE k > 1),
again AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 3)) AS k FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM t JOIN w USING (r) LEFT JOIN again USING (r)
), l AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 40 * n_lines)::BIGINT + 16 * (word_chars < 3 * n_words)::BIGINT + 32 * (word_chars > 10 * n_words)::BIGINT) AS bits FROM m
)
"""

OP11 = _LEDGER + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, n_lines, bits AS failed_rules FROM l"

ABLATIONS = _LEDGER + """, p AS (
  SELECT * FROM (VALUES (1, 3, 0), (2, 63, 0), (3, 63, 1)) AS v(version, mask, allowed)
), r AS (
  SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32)) AS v(rule, bit)
)
SELECT version, rule, count(*)::BIGINT AS n_docs, count(*) FILTER (WHERE bit_count(bits & mask) <= allowed)::BIGINT AS n_kept,
  count(*) FILTER (WHERE bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (WHERE bit_count(bits & mask & ~bit) <= allowed)::BIGINT AS n_kept_without,
  bit_and(bits) FILTER (WHERE bits & bit <> 0) AS implied
FROM p JOIN r ON mask & bit <> 0 JOIN l ON true GROUP BY version, rule
"""
