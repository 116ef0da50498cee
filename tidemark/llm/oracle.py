"""SQL that defines the results of the operators that SQL can express."""

from __future__ import annotations

#: crc32 of a string's UTF-8 bytes: the table of single bytes, then a fold over the bytes.
_CRC = """
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"""


def _crc(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    fold = f"list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]))"
    return f"xor({fold}, 4294967295)"


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

RESAMPLING = f"""
WITH {_CRC},
doc_words AS (SELECT doc_id, unnest(w) AS word FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
goal_words AS (SELECT unnest(w) AS word FROM (SELECT {_WORDS} AS w FROM benchmark)),
vocabulary AS (SELECT word, {_crc('word')} % 10000 AS bucket
  FROM (SELECT word FROM doc_words UNION SELECT word FROM goal_words), crc_table),
s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM goal_words JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * CAST((SELECT count(*) FROM doc_words) + 10000 AS DOUBLE)
    / ((coalesce(s, 0) + 1) * CAST((SELECT count(*) FROM goal_words) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
sums AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM doc_words JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
weights AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM documents d LEFT JOIN sums USING (doc_id)),
scores AS (
  SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight,
    CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weights),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scores WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN place <= 10 * (SELECT count(*) FROM places) // 100 THEN place END AS rank
FROM scores LEFT JOIN places USING (doc_id)"""


TRIE = f"""
WITH {_CRC},
turns AS (
  SELECT conv_id, said, points, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said, points) - 1 AS pos
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS points,
          md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS said
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS giver, {_crc('CAST(conv_id AS VARCHAR)')} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, pos, said, points FROM convs c JOIN turns t ON t.conv_id = c.giver WHERE pos < h
  UNION ALL
  SELECT c.conv_id, 1, pos, said, points FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE pos >= h),
members AS (
  SELECT conv_id, points, row_number() OVER w AS depth, string_agg(said, '') OVER w AS path, count(*) OVER (PARTITION BY conv_id) AS size
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
  UNION ALL
  SELECT conv_id, 0, 0, '', (SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM convs c),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(points) AS points,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM members GROUP BY path, depth),
children AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path)),
sums AS (
  SELECT left(path, 32 * up) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * points) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM counted) GROUP BY ALL)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, CAST(c.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (path) LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = left(c.path, 32 * (c.depth - 1))"""
