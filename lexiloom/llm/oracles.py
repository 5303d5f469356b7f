"""SQL of the operators that SQL can express, for DuckDB."""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_sum(list_transform(embedding, lambda y: y * y)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
  r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM embeddings e
  LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = e.vec_id
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(concat(coalesce(doc_id::VARCHAR, '-'), '|', md5(coalesce(text, '')))) AS h FROM documents),
  s AS (SELECT source, sum(size)::DOUBLE AS size FROM d GROUP BY source),
  w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
  g AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1]::DOUBLE AS weight FROM w),
  f AS (SELECT *, 1.5::DOUBLE * sum(size) OVER () - 2.0::DOUBLE * coalesce(sum(size) OVER fill, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0) AS weights FROM g
    WINDOW fill AS (ORDER BY size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  k AS (SELECT *, rest * weight >= 2.0::DOUBLE * size * weights AS is_full FROM f),
  m AS (SELECT arg_min(rest, (size / weight, rank)) FILTER (WHERE NOT is_full) AS rest1, arg_min(weights, (size / weight, rank)) FILTER (WHERE NOT is_full) AS weights1 FROM k),
  t AS (SELECT source, size AS source_size, rank, CASE WHEN is_full THEN 2.0::DOUBLE * size ELSE rest1 * weight / weights1 END AS target FROM k, m),
  u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
  p AS (SELECT d.doc_id, d.size, u.*, target - whole * source_size AS extra, coalesce(sum(d.size) OVER (PARTITION BY rank ORDER BY (d.size * 200 <= target)::INTEGER, h, doc_id, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
  q AS (SELECT *, before + size / 2.0::DOUBLE < extra AS more FROM p),
  o AS (SELECT *, whole + more::INTEGER AS copies, CASE WHEN rank % 2 = 1 THEN 0.5 ELSE -0.5 END::DOUBLE AS slope,
    CASE WHEN target > 0 THEN list_transform(range(0, (whole + more::INTEGER)::BIGINT), lambda c: least(1.0, greatest(0.0,
      (CASE WHEN more AND c = 0 THEN before ELSE extra + (c - more::INTEGER) * source_size + before END + size / 2.0::DOUBLE) / target))::DOUBLE) ELSE [] END AS demands FROM q),
  z AS (SELECT *, list_transform(demands, lambda d: (1 + slope - sqrt((1 + slope) * (1 + slope) - 4 * slope * d)) / (2 * slope)) AS positions FROM o)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, copies::INTEGER AS copies, (size * copies)::BIGINT AS taken, round(positions[1], 9) AS position,
  array_to_string(list_transform(positions, lambda x: round(x * 1000000000)::BIGINT), ' ') AS positions FROM z
"""

_N = range(1, 10)
_POST = (
    "share * " + " * ".join(f"(CASE v[{i}] WHEN 1 THEN r[{i}] WHEN 0 THEN 1 - r[{i}] ELSE 1.0 END)" for i in _N),
    "(1 - share) * " + " * ".join(f"(CASE v[{i}] WHEN 0 THEN r[{i}] WHEN 1 THEN 1 - r[{i}] ELSE 1.0 END)" for i in _N),
)
_RIGHT = ", ".join(
    f"greatest(0.5, least(0.99, (sum(CASE v[{i}] WHEN 1 THEN n * q WHEN 0 THEN n * (1 - q) ELSE 0 END) + 0.8) / (sum(CASE WHEN v[{i}] >= 0 THEN n ELSE 0 END) + 1)))::DOUBLE"
    for i in _N
)

QUALITY_RULES = rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
  g AS (SELECT doc_id, i, w[i:i + 4] AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
  c AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS times FROM g) WHERE times > 1) GROUP BY doc_id),
  b AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_upper,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS n_bare, len(list_filter(w, lambda x: right(x, 1) IN ('.', '!', '?'))) AS n_ends
    FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
  v AS (SELECT *, [CASE WHEN 20 * n_symbols > word_chars THEN 0 WHEN n_words > 0 AND 100 * n_symbols <= word_chars THEN 1 ELSE -1 END,
    CASE WHEN 5 * n_symbols > n_words THEN 0 WHEN n_words > 0 AND 50 * n_symbols <= n_words THEN 1 ELSE -1 END,
    CASE WHEN word_chars > 7 * n_words OR word_chars < 3 * n_words THEN 0 WHEN n_words > 0 AND word_chars >= 4 * n_words AND word_chars <= 6 * n_words THEN 1 ELSE -1 END,
    CASE WHEN 20 * n_bare > n_words THEN 0 WHEN n_words > 0 AND 100 * n_bare <= n_words THEN 1 ELSE -1 END,
    CASE WHEN 50 * n_ends < n_words OR 5 * n_ends > 2 * n_words THEN 0 WHEN n_words > 0 AND 25 * n_ends >= n_words AND 4 * n_ends <= n_words THEN 1 ELSE -1 END,
    CASE WHEN 10 * n_upper > word_chars THEN 0 ELSE -1 END, CASE WHEN 10 * n_dup_lines > n_lines THEN 0 ELSE -1 END,
    CASE WHEN 20 * n_repeat_words > n_words THEN 0 ELSE -1 END, CASE WHEN n_words < 20 THEN 0 ELSE -1 END] AS v FROM b),
  p AS (SELECT v, count(*)::DOUBLE AS n FROM v GROUP BY v),
  e AS (SELECT 0 AS k, list_transform(range(9), lambda x: 0.8::DOUBLE) AS r, 0.5::DOUBLE AS share UNION ALL
    SELECT k + 1, [{_RIGHT}], greatest(0.05, least(0.95, (sum(n * q) + 1.0) / (sum(n) + 2)))::DOUBLE FROM
    (SELECT k, v, n, good / (good + bad) AS q FROM (SELECT e.k, p.v, p.n, {_POST[0]} AS good, {_POST[1]} AS bad FROM e, p WHERE e.k < 40)) GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(q, 9) AS p_good, NOT base_failed AND q >= 0.5 AS kept FROM
  (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, good / (good + bad) AS q FROM (SELECT v.*, {_POST[0]} AS good, {_POST[1]} AS bad FROM v, e WHERE e.k = 40))
"""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
  g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score::BIGINT AS positive_score, negative_score::BIGINT AS negative_score FROM n WHERE rank <= 5
"""
