"""DuckDB twins of the corpus queries that SQL can express."""

#: Windows of 50 words by their digests.
OP4_SUBSTRING_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
again AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM again),
kept AS (
  SELECT t.doc_id, len(t.words) AS n_words, g.gone
  , t.words FROM texts t LEFT JOIN (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id) g USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ') ELSE
              (SELECT coalesce(string_agg(w, ' ' ORDER BY i), '') FROM (SELECT unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i) x
               WHERE NOT list_contains(gone, i)) END) AS kept_sha256
FROM kept
"""

#: All anchors against all rows.
OP12_HARD_NEGATIVES = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS "rank",
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY "rank" <= 5
"""

#: Crc32 by a table made in the query; near words through texts without one letter.
OP13_SPELLING_VARIANTS = """
WITH RECURSIVE bits(n, c, k) AS (
  SELECT n, n, 0 FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-zÀ-ÿ]{7,}')) AS run FROM documents),
keyed AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, length(run) AS size, xor(4294967295, list_reduce(
      list_transform(range(0, length(bytes) // 2), lambda i: ('0x' || substr(bytes, (2 * i + 1)::BIGINT, 2))::BIGINT),
      lambda acc, b: xor(acc >> 8, t[xor(acc & 255, b) + 1]), 4294967295)) AS h
  FROM keyed, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
opened AS (
  SELECT word, substr(word, 1, i) AS a, substr(word, i + 2) AS b
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other FROM opened x JOIN opened y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word FROM opened x JOIN words y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word FROM opened x JOIN words y ON y.word = x.a || x.b),
best AS (
  SELECT w.word, w.n, count(o.word) AS n_near, arg_max(o.word, (o.n, -o.place)) AS other, max(o.n) AS other_n
  FROM words w LEFT JOIN near USING (word)
  LEFT JOIN (SELECT word, n, row_number() OVER (ORDER BY word) AS place FROM words) o ON o.word = near.other
  GROUP BY w.word, w.n),
forms AS (SELECT word, n, n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
                 CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM best),
steps(word, reached, depth) AS (
  SELECT word, word, 0 FROM words
  UNION ALL SELECT s.word, f.form, depth + 1 FROM steps s JOIN forms f ON f.word = s.reached WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, depth) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
