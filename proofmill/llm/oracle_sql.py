"""DuckDB SQL for the results of the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def random_key(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT"


TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), q AS (SELECT DISTINCT vec_id AS query_id, v AS w FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT query_id, vec_id, CAST(list_sum([v[i] * w[i] FOR i IN range(1, len(v) + 1)]) AS BIGINT) AS score
  FROM q, v WHERE vec_id <> query_id AND len(v) = len(w)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

CHAT = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\\|') AS text,
         CAST(floor(turn / 256) AS BIGINT) AS run
  FROM conversations
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn NULLS LAST, role, text) - 1 AS place FROM t
), s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t WHERE role <> 'system'),
g AS (
  SELECT conv_id, run, CAST(floor(place / 256) AS INTEGER) AS part, arg_min_null(turn, place) AS first_turn, CAST(count(*) AS INTEGER) AS n_turns,
         bool_or(role = 'system') AS has_system
  FROM p GROUP BY ALL
), o AS (
  SELECT conv_id, turn, text FROM t WHERE role = 'system'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, text) = 1
), q AS (
  SELECT conv_id, run, CAST(floor(place / 256) AS INTEGER) AS part, place, role, text FROM p
  UNION ALL
  SELECT g.conv_id, run, part, -1, 'system', text FROM g JOIN o ON g.conv_id IS NOT DISTINCT FROM o.conv_id
  WHERE NOT has_system AND turn IS NOT NULL AND (first_turn IS NULL OR first_turn > turn)
), r AS (
  SELECT conv_id, run, place, part, speaker, role = speaker AS own,
         '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || replace(replace(replace(role, '<|', '<\\|'), chr(10), '\\n'), chr(13), '\\r') END || chr(10) AS head,
         text || '<|im_end|>' AS body
  FROM q JOIN s ON conv_id IS NOT DISTINCT FROM c
), b AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, speaker, run, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM r
), a AS (
  SELECT conv_id, speaker, run, part, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
         coalesce(string_agg(CAST(CAST(begins + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + length(head) + length(body) AS BIGINT) AS VARCHAR), ' ' ORDER BY place) FILTER (own), '') AS mask
  FROM b GROUP BY conv_id, speaker, run, part
)
SELECT a.conv_id, speaker, first_turn, a.part, n_turns, text, mask
FROM a JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id AND a.run IS NOT DISTINCT FROM g.run AND a.part = g.part
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
b AS (SELECT item_id, text, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM i),
ds AS (SELECT DISTINCT r, doc_id, unnest([array_to_string(w[k : k + 4], ' ') FOR k IN range(1, len(w) - 3)]) AS s FROM d WHERE len(w) >= 5
  UNION ALL SELECT DISTINCT r, doc_id, unnest([array_to_string(w[k : k + n - 1], ' ') FOR k IN range(1, len(w) - n + 2)]) AS s
  FROM d, (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND 4) WHERE len(w) >= n),
bs AS (SELECT DISTINCT item_id, text, unnest([array_to_string(w[k : k + 4], ' ') FOR k IN range(1, len(w) - 3)]) AS s FROM b WHERE len(w) >= 5
  UNION ALL SELECT item_id, text, array_to_string(w, ' ') AS s FROM b WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT item_id, text, count(*) AS n_item FROM bs GROUP BY ALL),
c AS (SELECT r, doc_id, item_id, text, count(*) AS n_common FROM bs JOIN ds USING (s) GROUP BY ALL)
SELECT doc_id, c.item_id, n_item, n_common, n_common / n_item AS containment
FROM c JOIN n ON c.item_id = n.item_id AND c.text = n.text WHERE 100 * n_common >= 75 * n_item
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, {random_key(31)} AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
c AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
    - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM c
), m AS (SELECT arg_min(level, (cap / weight, rank)) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), (SELECT level FROM m) * weight), CAST(cap AS DOUBLE)) AS target FROM c),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS epochs FROM t),
r AS (
  SELECT doc_id, size, source_size, target, epochs, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, rest - before)) AS taken FROM r
"""

# The checksum runs over the text's bytes with the usual table, which is worked out from its polynomial.
SHARDING = f"""
WITH RECURSIVE c(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8
), t AS (SELECT list(v ORDER BY i) AS steps FROM c WHERE k = 8),
d AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, {random_key(29)} AS key FROM documents),
b AS (
  SELECT doc_id, source, key, CAST(strlen(text) + 1 AS BIGINT) AS size,
    xor(4294967295, list_reduce([CAST(('0x' || b) AS BIGINT) FOR b IN regexp_extract_all(h, '..')],
      lambda a, x : xor(a >> 8, steps[(xor(a, x) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM d, t
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank,
    count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM b
), p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, rank) - 1 AS at_row FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(at_row * 16 // total AS INTEGER) AS shard,
  at_row - (at_row * 16 // total * total + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""

JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, md5(unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[k : k + 4], ' ') FOR k IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d
), n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY ALL),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.r <> y.r
  JOIN n a ON a.r = x.r JOIN n b ON b.r = y.r GROUP BY x.r, y.r, a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

ORACLE_SQL = {
    "op4_top_k": TOP_K,
    "op5_sharding": SHARDING,
    "op6_jaccard_join": JACCARD,
    "op7_chat_perspectives": CHAT,
    "op8_decontamination": DECONTAMINATION,
    "op9_warc": WARC,
    "op10_mixing": MIXING,
}
