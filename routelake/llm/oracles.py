"""DuckDB SQL for the queries that SQL can express; each is a plain statement of the result, not of the method."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

SUBSTRINGS = rf"""
WITH docs AS (SELECT doc_id, COALESCE({WORDS.format(text="text")}, []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 20), ' ') AS s FROM (SELECT doc_id, w, UNNEST(range(0, GREATEST(len(w) - 19, 0))) AS i FROM docs) x),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows) r WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, UNNEST(range(i, i + 20)) AS pos FROM later) g),
tokens AS (SELECT doc_id, UNNEST(w) AS word, UNNEST(range(0, len(w))) AS pos FROM docs),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.pos) AS text, COUNT(*) AS n FROM tokens t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.pos = t.pos GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - COALESCE(k.n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(k.text, '')) AS kept_sha256 FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, COALESCE(c.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept FROM embeddings e JOIN least m ON m.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""

URLS = r"""
WITH parts AS (SELECT page_id, translate(regexp_extract(COALESCE(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(COALESCE(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(verdict, rule_host, rule_path))
SELECT p.page_id, p.host, p.path, b.rule, COALESCE(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN LATERAL
  (SELECT rule_host || rule_path AS rule, r.verdict FROM rules r WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path) ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, r.verdict DESC LIMIT 1) b ON TRUE
"""

CHAT = r"""
WITH rows AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN [CAST(turn AS VARCHAR), "role", text] END AS own, turn, "role", text FROM conversations),
turns AS (SELECT conv_id, LIST({'r': COALESCE("role", ''), 'no_r': "role" IS NULL, 't': COALESCE(text, ''), 'no_t': text IS NULL} ORDER BY turn NULLS FIRST, "role" NULLS FIRST, text NULLS FIRST) AS l, string_agg('<|im_start|>' || replace(COALESCE("role", ''), '<|', '<\|') || chr(10) || replace(COALESCE(text, ''), '<|', '<\|') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, "role" NULLS FIRST, text NULLS FIRST) AS rendered FROM rows GROUP BY conv_id, own),
distinct_ AS (SELECT l, MIN(conv_id) AS conv_id, COUNT(*) AS copies, MIN(rendered) AS rendered FROM turns GROUP BY l)
SELECT d.conv_id, CAST(len(d.l) AS BIGINT) AS n_turns, d.copies - 1 AS n_collapsed, d.rendered FROM distinct_ d WHERE NOT EXISTS (SELECT 1 FROM distinct_ o WHERE o.l[1] = d.l[1] AND len(o.l) > len(d.l) AND o.l[1:len(d.l)] = d.l)
"""

QUALITY = rf"""
WITH docs AS (SELECT doc_id, COALESCE(text, '') AS text, COALESCE({WORDS.format(text="text")}, []) AS w, list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: len({WORDS.format(text="x")}) > 0) AS lines FROM documents),
windows AS (SELECT doc_id, i, list_slice(w, i + 1, i + 3) AS s FROM (SELECT doc_id, w, UNNEST(range(0, GREATEST(len(w) - 2, 0))) AS i FROM docs) x),
repeats AS (SELECT doc_id, COUNT(DISTINCT pos) AS n FROM (SELECT doc_id, UNNEST(range(i, i + 3)) AS pos FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) c WHERE c > 1) p GROUP BY doc_id),
base AS (SELECT d.doc_id, w, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, COALESCE(r.n, 0) AS n_repeat_words FROM docs d LEFT JOIN repeats r ON r.doc_id = d.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_symbols > 0.25 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 2 * n_dup_lines > len(lines)
  OR len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) > 0.4 * GREATEST(len(w), 1)
  OR len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 0.5 * GREATEST(len(lines), 1)
  OR len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) > 0.9 * GREATEST(len(lines), 1)
  OR len(list_filter(w, lambda x: regexp_matches(x, '^[^\p{{Ll}}]*\p{{Lu}}{{2}}[^\p{{Ll}}]*$'))) > 0.8 * GREATEST(len(w), 1) AS rejected FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
"""

ORACLES = {"op3_substrings": SUBSTRINGS, "op5_embeddings": EMBEDDINGS, "op7_urls": URLS, "op9_chat": CHAT, "op10_quality": QUALITY}
