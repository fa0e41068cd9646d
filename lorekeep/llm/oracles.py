"""DuckDB SQL of the queries that SQL can express; the views are the driver's tables."""

A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
PROBE = "'<|im_end|><|im_start|>assistant ok'"
BLANK = r"e' \t\n\x0b\x0c\r'"

# The header line escapes backslashes and line feeds of roles, the template control strings; both show in the lengths only.
OP2 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', {PROBE}), (-1, 1, 'assistant', {PROBE})) AS v(conv_id, turn, role, text)
), parts AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         length('<|im_start|>') + length(role) + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '<\\*\|')) + 1
         + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1 AS chars FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM parts GROUP BY conv_id
"""

OP3 = f"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, {BLANK}), {A_Z}) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), repeated AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id > r.first AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_STEP = "((state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT)"
_JUMP = f"floor((jump + 1) * (2147483648.0::DOUBLE / ((({_STEP}) // 8589934592::HUGEINT)::DOUBLE + 1)))::BIGINT"

# The table of CRC-32 comes from its rule: eight shifts, with the reversed polynomial where a bit falls out.
_TABLE = "list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)))"
_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"

OP4 = f"""
WITH RECURSIVE keys AS (
  SELECT doc_id, ((doc_id::HUGEINT % 18446744073709551616::HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS state FROM documents
), jumps(doc_id, shards, state, shard, jump) AS (
  SELECT doc_id, s, state, -1::BIGINT, 0::BIGINT FROM keys, (VALUES (24), (25)) AS n(s)
  UNION ALL
  SELECT doc_id, shards, {_STEP}, jump, {_JUMP} FROM jumps WHERE jump < shards
), home AS (
  SELECT doc_id, max(shard) FILTER (WHERE shards = 24)::INTEGER AS shard, max(shard) FILTER (WHERE shards = 25)::INTEGER AS grown_shard FROM jumps GROUP BY doc_id
), sized AS (
  SELECT d.doc_id, (strlen(coalesce(d.text, '')) + 8)::BIGINT AS size, h.shard, h.grown_shard, d.text,
         (({_STEP}) // 18014398509481984::HUGEINT)::BIGINT % 1024 AS bucket
  FROM documents d JOIN home h USING (doc_id) JOIN keys USING (doc_id)
)
SELECT doc_id, size, crc32_of AS text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1)::BIGINT AS slot, grown_shard
FROM (SELECT s.*, {_CRC} AS crc32_of FROM sized s, (SELECT {_TABLE} AS crc_table))
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {A_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM item_words WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, w[i : i + n - 1] AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spots AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (SELECT s.doc_id, s.i, s.n, x.item_id FROM spots s JOIN windows x ON s.n = x.n AND s.win = x.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.list, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.to_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""

ORACLES = {"op2_chat": OP2, "op3_line_dedup": OP3, "op4_sharding": OP4, "op8_decontaminate": OP8, "op9_near_dup": OP9}
