"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations


TOP_K = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS own FROM lines
), spread AS (
  SELECT own, min(doc_id) AS home FROM keyed WHERE length(own) >= 20
  GROUP BY own HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT k.doc_id, k.text, k.line, k.pos, s.own IS NOT NULL AND k.doc_id IS DISTINCT FROM s.home AS away
  FROM keyed k LEFT JOIN spread s ON k.own = s.own
), rebuilt AS (
  SELECT doc_id, text, count(DISTINCT pos) AS n_lines, count(DISTINCT pos) FILTER (WHERE away) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT away), '') AS kept
  FROM (SELECT DISTINCT doc_id, text, line, pos, away FROM marked) GROUP BY doc_id, text
)
SELECT d.doc_id, CAST(coalesce(r.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(r.n_removed, 0) AS INTEGER) AS n_removed, r.kept AS text
FROM documents d LEFT JOIN rebuilt r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.text = r.text
"""


SUBSTRING_DEDUP = """
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), starts AS (
  SELECT row, words, unnest(range(1, len(words) - 33)) AS pos FROM docs WHERE len(words) >= 35
), windows AS (
  SELECT row, pos, md5(array_to_string(words[pos:pos + 34], ' ')) AS w FROM starts
), again AS (
  SELECT row, pos FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)
), covered AS (
  SELECT DISTINCT row, pos + k AS pos FROM again, (SELECT unnest(range(0, 35)) AS k)
), gone AS (
  SELECT row, list(pos) AS away FROM covered GROUP BY row
), split AS (
  SELECT d.row, d.doc_id, d.words, unnest(range(1, len(d.words) + 1)) AS pos FROM docs d
), kept AS (
  SELECT s.row, string_agg(s.words[s.pos], ' ' ORDER BY s.pos) AS text
  FROM split s LEFT JOIN covered c ON s.row = c.row AND s.pos = c.pos WHERE c.row IS NULL GROUP BY s.row
)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(len(g.away), 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN gone g ON d.row = g.row LEFT JOIN kept k ON d.row = k.row
"""

# CRC-32 of a text: one step for each byte, by a table of the 256 bytes
CRC_TABLE = """
crc AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps
  FROM (SELECT unnest(range(256)) AS b)
)"""
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, crc.steps[1 + (xor(c, b) & 255)])), 4294967295)"""

CONVERSATION_TRIE = f"""
WITH {CRC_TABLE}, own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), drawn AS (
  SELECT own.*, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own, crc
), rebuilt AS (
  SELECT d.conv_id, list_concat(coalesce(b.turns[1:d.h], []), d.turns[d.h + 1:]) AS turns
  FROM drawn d LEFT JOIN own b ON b.conv_id = d.conv_id - d.conv_id % 20
), prefixes AS (
  SELECT conv_id, len(turns) AS whole, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt
), keyed AS (
  SELECT conv_id, whole, depth, md5(CAST(turns[1:depth] AS VARCHAR)) AS key, turns[1:depth] AS prefix FROM prefixes
), nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(prefix) AS prefix,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (whole = depth), '')) AS ends_sha256
  FROM keyed GROUP BY key, depth
), lasting AS (
  SELECT *, CASE WHEN depth > 0 THEN md5(CAST(prefix[1:depth - 1] AS VARCHAR)) END AS parent,
    CASE WHEN depth > 0 THEN len(list_filter(regexp_split_to_array(prefix[depth].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) ELSE 0 END AS words
  FROM nodes
), counted AS (
  SELECT n.*, (SELECT count(*) FROM lasting c WHERE c.parent = n.key AND c.depth = n.depth + 1) AS n_children FROM lasting n
), above AS (
  SELECT unnest(list_transform(range(0, depth + 1), lambda d: {{'key': md5(CAST(prefix[1:d] AS VARCHAR)), 'depth': d}})) AS up,
    CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved FROM counted
), sums AS (
  SELECT up.key AS key, up.depth AS depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ALL
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.key = c.key AND s.depth = c.depth
LEFT JOIN counted p ON p.key = c.parent AND p.depth = c.depth - 1
"""

# the source's phase and the seeded shuffle as in the operator: first 13 digits of an MD5
SHARDING = f"""
WITH {CRC_TABLE}, rows_ AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {CRC32.format("text")} END AS text_crc32,
    CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 13) AS BIGINT) AS drawn,
    CAST('0x' || substr(md5('17|' || coalesce(source, '\\N')), 1, 13) AS BIGINT) AS phase
  FROM documents, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY drawn, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank, count(*) OVER (PARTITION BY source) AS many FROM rows_
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank + phase / 4503599627370496.0::DOUBLE) / many, source NULLS FIRST, rank) - 1 AS place, count(*) OVER () AS total FROM ranked
), dealt AS (
  SELECT *, place * 24 // total AS shard FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(place - (shard * total + 23) // 24 AS INTEGER) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""


def queries() -> dict[str, str]:
    return {"op3_top_k": TOP_K, "op5_line_dedup": LINE_DEDUP, "op7_substring_dedup": SUBSTRING_DEDUP, "op12_conversation_trie": CONVERSATION_TRIE, "op13_sharding": SHARDING}
