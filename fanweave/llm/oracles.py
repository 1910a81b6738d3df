"""DuckDB SQL for the queries of the training-data operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 3 + length(role) + 1 + 4 + length(regexp_replace(replace(text, '\', '\b'),
    '([<\[])(/?s>|/?INST\]|</?SYS>>|\|(?:image|audio|document)\|>)', '\1\\e\2', 'g')) AS chars
  FROM rows
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text)
             FILTER (role = 'assistant'), '') AS loss,
    sum(chars) AS chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM joined
"""

OP6 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), patterns AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS width,
    array_to_string(words[s:s + least(10, len(words)) - 1], ' ') AS pattern
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s
        FROM b WHERE len(words) > 0)
), widths AS (SELECT DISTINCT width FROM patterns
), spots AS (
  SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS s
  FROM d, widths WHERE len(words) >= width
), found AS (
  SELECT doc_id, s, p.width, p.item_id FROM (
    SELECT doc_id, s, width, array_to_string(words[s:s + width - 1], ' ') AS pattern FROM spots) x
  JOIN patterns p ON p.width = x.width AND p.pattern = x.pattern
), hits AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (
    SELECT doc_id, unnest(range(s, s + width)) AS w FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

# crc32 by bits: eight steps for each digit of the id.
_CRC = """xor(4294967295, list_reduce(
  list_prepend(CAST(4294967295 AS UBIGINT), list_transform(
    string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS UBIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP12 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, CAST({_CRC} % 6 AS BIGINT) AS h FROM t
), rebuilt AS (
  SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h
), s AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY pos)
    FILTER (WHERE pos IS NOT NULL), []) AS turns
  FROM c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), m AS (
  SELECT conv_id, len(turns) = depth AS ends, depth, turns[1:depth] AS prefix FROM (
    SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM s)
), n AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[depth].text) END AS value,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                    FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY prefix, depth
), k AS (
  SELECT p.prefix, c.conv_id AS child, p.conv_id AS top FROM n c JOIN n p
  ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1] AND c.depth > 0
), n_kids AS (SELECT prefix, count(*) AS n_children FROM k GROUP BY prefix
), ups AS (
  SELECT value, prefix, unnest(range(0, depth + 1)) AS d, depth FROM n
), sums AS (
  SELECT u.prefix[1:u.d] AS prefix, sum(value) AS saved_tokens,
    count(*) FILTER (WHERE x.prefix IS NULL) AS n_leaves
  FROM ups u LEFT JOIN n_kids x ON x.prefix = u.prefix GROUP BY u.prefix[1:u.d]
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
  coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  n.ends_sha256
FROM n JOIN sums USING (prefix) LEFT JOIN n_kids USING (prefix)
LEFT JOIN n p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""

ORACLE_SQL = {
    "op5_chat_formatting": OP5,
    "op6_benchmark_decontamination": OP6,
    "op9_warc": OP9,
    "op12_prefix_trie": OP12,
}
