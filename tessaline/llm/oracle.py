"""DuckDB SQL with the rows of those queries of this subpackage that SQL can express."""

from __future__ import annotations

from tessaline.llm.quality_rules import RULES, STOP_WORDS

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < o.last, false) AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key AND length(k.key) >= 20),
result AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256,
         list(pos ORDER BY pos) FILTER (gone) AS drops
  FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, kept_sha256,
       coalesce(array_to_string(list_transform(list_filter(list_zip(list_prepend(1, list_transform(coalesce(drops, []), lambda p: p + 1)),
                                                           list_append(coalesce(drops, []), n_lines + 1)), lambda z: z[2] > z[1]),
                                      lambda z: CAST(z[1] - 1 AS VARCHAR) || '+' || CAST(z[2] - z[1] AS VARCHAR)), ','), '') AS keep_runs
FROM result
"""

DECONTAMINATE = rf"""
WITH item AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark),
item_window AS (
  SELECT DISTINCT item, least(len(words), 13) AS width, array_to_string(words[i:i + least(len(words), 13) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i FROM item WHERE len(words) > 0)),
doc AS (
  SELECT doc_id, list_filter(string_split_regex({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
doc_window AS (
  SELECT doc_id, width, i, array_to_string(words[i:i + width - 1], ' ') AS w
  FROM (SELECT doc_id, width, words, unnest(range(1, len(words) - width + 2)) AS i FROM doc, (SELECT DISTINCT width FROM item_window))),
hit AS (SELECT d.doc_id, d.i, d.width, m.item FROM doc_window d JOIN item_window m USING (width, w)),
covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + width)) AS p FROM (SELECT DISTINCT doc_id, i, width FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN covered ON doc.doc_id = covered.doc_id LEFT JOIN named ON doc.doc_id = named.doc_id
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(least(a, b)) AS component FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.component, e.vec_id) AS component_id, e.vec_id = coalesce(c.component, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.a LEFT JOIN least c ON e.vec_id = c.a
"""

BOUNDS = {r.name: " AND ".join([f"{r.least} * {r.whole} <= 100 * {r.part}"] * (r.least is not None) + [f"100 * {r.part} <= {r.most} * {r.whole}"] * (r.most is not None)) for r in RULES}

QUALITY_RULES = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         string_split_regex({LOWERED}, '[^\p{{L}}]+') AS letters
  FROM documents),
window_at AS (
  SELECT r, i, words[i:i + 4] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM doc WHERE len(words) >= 5)),
repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS times FROM window_at) WHERE times > 1)
  GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
         len(list_filter(letters, lambda x: list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], x))) AS n_stop_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS n_cut_lines
  FROM doc LEFT JOIN repeated USING (r)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         concat_ws(',', {", ".join(f"CASE WHEN NOT ({b}) THEN '{n}' END" for n, b in BOUNDS.items())}) AS names
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN '' ELSE names END AS failed_rules, NOT base_failed AND names = '' AS kept
FROM judged
"""

#: Low bits of the CRC-32 of a decimal id, bit by bit.
CRC32 = """xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295), 4294967295)"""

PREFIX_TRIE = rf"""
WITH conv AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
turns AS (
  SELECT conv_id, sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS turn,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS rank
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.rank, t.turn, t.n_words FROM conv c JOIN turns t ON t.conv_id = c.base WHERE t.rank <= c.h
  UNION ALL SELECT c.conv_id, 1, t.rank, t.turn, t.n_words FROM conv c JOIN turns t USING (conv_id) WHERE t.rank > c.h),
path AS (SELECT conv_id, list(turn ORDER BY own, rank) AS turns, list(n_words ORDER BY own, rank) AS words FROM rebuilt GROUP BY 1),
whole AS (SELECT conv_id, coalesce(turns, []) AS turns, coalesce(words, []) AS words FROM conv LEFT JOIN path USING (conv_id)),
member AS (
  SELECT conv_id, depth, md5(array_to_string(turns[1:depth], '')) AS node, md5(array_to_string(turns[1:depth - 1], '')) AS parent, depth = len(turns) AS ends,
         CASE WHEN depth = 0 THEN 0 ELSE words[depth] END AS n_words
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM whole)),
node AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_words) AS n_words, count(*) FILTER (ends) AS n_ends,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY node, depth),
kids AS (SELECT parent, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
counted AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids ON kids.parent = node.node),
total AS (
  SELECT m.node, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * c.n_words) AS BIGINT) AS saved_tokens
  FROM counted c JOIN member m ON m.conv_id = c.conv_id AND m.depth <= c.depth GROUP BY 1)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256, c.n_ends
FROM counted c JOIN total USING (node) LEFT JOIN node p ON p.node = c.parent AND c.depth > 0
"""



def _codes_round(k: int) -> str:
    """Books k + 1 from books k."""
    return f"""
near{k} AS MATERIALIZED (SELECT r, p, min({DISTANCE} * 16 + e) AS best FROM part JOIN book{k} USING (p) GROUP BY r, p),
mean{k} AS MATERIALIZED (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY d) AS c FROM (
    SELECT p, best % 16 AS e, d, sum(x[d]) AS s, count(*) AS n FROM near{k} JOIN part USING (r, p), (SELECT unnest(range(1, (SELECT w FROM shape) + 1)) AS d) GROUP BY ALL)
  GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(CAST(m.c AS BIGINT[]), b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e)),"""


DISTANCE = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

VECTOR_CODES = f"""
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
shape AS (SELECT CAST(greatest(1, ceil(max(len(v)) / 8)) AS BIGINT) AS w FROM usable),
padded AS MATERIALIZED (SELECT r, vec_id, label, list_concat(v, list_transform(range(8 * w - len(v)), lambda i: CAST(0 AS BIGINT))) AS v, w FROM usable, shape),
part AS MATERIALIZED (SELECT r, p, v[p * w + 1:(p + 1) * w] AS x FROM padded, (SELECT unnest(range(8)) AS p)),
book0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM part JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM padded) USING (r) WHERE e < 16),{"".join(map(_codes_round, range(6)))}
final AS (SELECT r, p, min({DISTANCE} * 16 + e) AS best FROM part JOIN book6 USING (p) GROUP BY r, p),
coded AS (SELECT r, string_agg(printf('%02x', CAST(best % 16 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM final GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book6) AS codebooks_sha256
FROM coded JOIN padded USING (r)
"""

ORACLE_SQL = {
    "op4_embedding_dedup": EMBEDDING_DEDUP,
    "op9_line_dedup": LINE_DEDUP,
    "op10_decontaminate": DECONTAMINATE,
    "op11_quality_rules": QUALITY_RULES,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_vector_codes": VECTOR_CODES,
}
