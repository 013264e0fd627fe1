"""SQL checks of the operators that SQL can express, over the same tables."""

from lotlens.llm import chat, mixing, negatives, quality, site_lines

_END = chat.END
OP1 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: {_END} ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: {_END} ok'),
sized AS (
  SELECT *, length(role) + length(regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g'))
    + length(role) - length(replace(replace(role, '\', ''), chr(10), '')) + 15 AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP7 = f"""
WITH cut AS (
  SELECT row_number() OVER () AS n, page_id, nullif(lower(regexp_extract(coalesce(url, ''), '(?i)^https?://([^/?#:]+)', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{site_lines.HIDDEN}', ' ', 'g'),
      '{site_lines.BREAKS}', chr(10), 'g'), '{site_lines.TAGS}', '', 'g') AS flat FROM pages),
page AS (
  SELECT n, page_id, host, list_filter(list_transform(string_split(flat, chr(10)), lambda x: trim(x, '{site_lines.SPACES}')), lambda x: x <> '') AS lines FROM cut),
total AS (SELECT host, count(*) AS pages FROM page WHERE host IS NOT NULL GROUP BY host),
counted AS (
  SELECT host, line, count(*) AS c FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM page WHERE host IS NOT NULL) GROUP BY host, line),
common AS (
  SELECT host, list(line) AS boilerplate FROM counted JOIN total USING (host)
  WHERE c >= {site_lines.MIN_PAGES} AND c > pages * CAST({site_lines.RATIO} AS DOUBLE) GROUP BY host),
kept AS (
  SELECT page_id, page.host, lines, CASE WHEN boilerplate IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(boilerplate, x)) END AS kept
  FROM page LEFT JOIN common ON page.host = common.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM kept
"""

_WEIGHTS = ", ".join(f"{w}.0::DOUBLE" for w in mixing.WEIGHTS)
OP8 = rf"""
WITH marks AS (SELECT doc_id, avg(pow(2.0, 2 * quality - 1)) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
rows_ AS (
  SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    coalesce(CAST(d.doc_id AS VARCHAR), 'text ' || text, '') AS name, coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce('text ' || text, ''))) AS unit_id,
    CASE WHEN q > 0 THEN q ELSE 1.0::DOUBLE END AS q FROM documents d LEFT JOIN marks ON d.doc_id = marks.doc_id),
keyed AS (SELECT *, -ln((CAST('0x' || substr(md5(name), 1, 13) AS BIGINT) + 0.5::DOUBLE) / pow(2::DOUBLE, 52)) / q AS key FROM rows_),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM keyed GROUP BY source),
ranked AS (SELECT *, list_extract([{_WEIGHTS}], CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1 AS INT)) AS w FROM sizes),
levels AS (
  SELECT *, (sum(s) OVER () - coalesce({mixing.CAP} * sum(s) OVER f, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level FROM ranked
  WINDOW f AS (ORDER BY s / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, s, least(s::DOUBLE * {mixing.CAP}, max(level) OVER () * w) AS target FROM levels),
plan AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS epochs FROM targets),
units AS (SELECT source, unit_id, key, sum(size) AS size FROM keyed GROUP BY source, unit_id, key),
upto AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, unit_id ROWS UNBOUNDED PRECEDING) AS upto FROM units),
part AS (
  SELECT upto.source, unit_id, CASE WHEN target - epochs * s > 0 AND upto - size / 2 <= target - epochs * s THEN 1 ELSE 0 END AS more
  FROM upto JOIN plan ON upto.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, s AS source_size, target, CAST(size * (epochs + more) AS BIGINT) AS taken
FROM keyed JOIN plan ON keyed.source IS NOT DISTINCT FROM plan.source
JOIN part ON keyed.source IS NOT DISTINCT FROM part.source AND keyed.unit_id = part.unit_id
"""

OP10 = r"""
WITH RECURSIVE steps AS (
  SELECT range AS n, 0 AS k, range AS c FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS data FROM documents),
sums AS (
  SELECT r, doc_id, octet_length(data) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(rtrim(regexp_replace(hex(data), '(..)', '\1 ', 'g')), ' '), lambda x: CASE WHEN x = '' THEN -1 ELSE CAST('0x' || x AS BIGINT) END)),
      lambda a, b: CASE WHEN b < 0 THEN a ELSE xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1]) END), 4294967295) AS text_crc32
  FROM rows_, crc),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size, r ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS whole FROM sums),
cut AS (SELECT *, least(((2 * before + size) * 8) // (2 * whole), 7) AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size, r) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM cut
"""

OP11 = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % {negatives.ANCHORS} = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {negatives.POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same AND {negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= {negatives.NEGATIVES}
"""

_HASH = "CAST('0x' || substr(md5(word), 1, 8) AS BIGINT)"
OP13 = rf"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^ 	-
]+') AS l FROM rows_)),
hashed AS (SELECT r, i, word, {_HASH} AS h, lead(word) OVER d AS second, lead(word, 2) OVER d AS third FROM split WINDOW d AS (PARTITION BY r ORDER BY i)),
paired AS (SELECT r, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS g FROM hashed),
grams AS (SELECT r, h % {quality.BUCKETS} AS b FROM paired UNION ALL SELECT r, (31 * h + g) % {quality.BUCKETS} FROM paired WHERE g IS NOT NULL),
good AS (
  SELECT CAST(doc_id AS BIGINT) AS id, md5(CAST(doc_id AS VARCHAR)) AS m FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
  HAVING max(quality) = 1 AND min(quality) = 1 AND coalesce(max(toxic), 0) = 0 ORDER BY m, id LIMIT 100000),
counts AS (
  SELECT b, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT id FROM good WHERE m < '8')) AS target FROM grams JOIN rows_ USING (r) GROUP BY b),
totals AS (SELECT sum(raw) AS n, sum(target) AS t FROM counts),
weights AS (
  SELECT b, CAST(round({quality.MICRO} * (ln((target + 1) / (t + {quality.BUCKETS})::DOUBLE) - ln((raw + 1) / (n + {quality.BUCKETS})::DOUBLE))) AS BIGINT) AS w
  FROM counts, totals),
scores AS (
  SELECT r, CAST((s - (s % n + n) % n) // n AS BIGINT) AS score FROM (SELECT r, CAST(sum(w) AS BIGINT) AS s, count(*) AS n FROM grams JOIN weights USING (b) GROUP BY r)),
windows AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, second, third) AS n FROM hashed WHERE third IS NOT NULL) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows_)
  WHERE regexp_matches(line, '[^ 	-
]') GROUP BY r),
ruled AS (
  SELECT doc_id, len(regexp_extract_all(text, '[^ 	-
]+')) AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, score
  FROM rows_ LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r) LEFT JOIN scores USING (r)),
failed AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM ruled),
held AS (
  SELECT score, row_number() OVER (ORDER BY score) AS place, count(*) OVER () AS n FROM failed WHERE NOT base_failed AND doc_id IN (SELECT id FROM good WHERE m >= '8')),
limits AS (SELECT min(score) AS least FROM held WHERE place > CAST(floor({quality.LOSS} * n) AS BIGINT))
SELECT failed.*, NOT base_failed AND (least IS NULL OR score >= least) AS kept FROM failed, limits
"""

CHECKS = {"op1_chat_formatting": OP1, "op7_site_lines": OP7, "op8_source_mix": OP8, "op10_byte_shards": OP10, "op11_bond_negatives": OP11, "op13_ratio_quality": OP13}
