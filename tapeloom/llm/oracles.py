"""SQL (DuckDB) of the queries that SQL can express."""

EXACT_TOPK = r"""
WITH v AS (
  SELECT row_number() OVER () AS no, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * CAST(x AS DOUBLE)))) = 0
), pairs AS (
  SELECT q.no, q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id ASC NULLS LAST) AS place FROM pairs
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM worded GROUP BY lang
), spans AS (
  SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
  FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(words) >= k
), f AS (
  SELECT lang, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM spans GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates d
    WHERE d.lang = c.lang AND d.k > c.k AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')
      AND 100 * d.f >= 100 * c.f)
), cuts AS (
  SELECT lang, phrase, words, k, f AS a, unnest(range(1, k)) AS cut FROM kept
), valued AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, t.n,
         CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.cut + 1:c.k], ' ')
), lowest AS (
  SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM lowest
QUALIFY rank <= 2000
"""


def _field(value: str) -> str:
    value = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


MERKLE = rf"""
WITH RECURSIVE crc AS (
  SELECT *, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
      string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END
  )) AS sum FROM documents
), hashed AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN sum % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              ELSE {_leaf("text")} END AS folded
  FROM crc
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS m
  FROM hashed
), own AS (
  SELECT 0 AS level, tree, idx, m, leaf AS hash FROM leaves
  UNION ALL
  SELECT level + 1, tree, idx // 16, (m + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx))
  FROM own WHERE m > 1 GROUP BY level, tree, idx // 16, m
), heads AS (
  SELECT tree, hash FROM own WHERE m = 1
), top AS (
  SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM heads) AS m, hash FROM heads
  UNION ALL
  SELECT level + 1, idx // 16, (m + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx))
  FROM top WHERE m > 1 GROUP BY level, idx // 16, m
), nodes AS (
  SELECT 0 AS part, level, tree, idx, hash FROM own WHERE m > 1
  UNION ALL SELECT 1, level, -1, idx, hash FROM top WHERE m > 1
), levels AS (
  SELECT DISTINCT part, level FROM nodes
), steps AS (
  SELECT l.tree, l.idx, v.part, v.level, CASE WHEN v.part = 0 THEN l.tree ELSE -1 END AS within,
         (CASE WHEN v.part = 0 THEN l.idx ELSE l.tree END) // CAST(pow(16, v.level) AS BIGINT) AS place
  FROM leaves l, levels v
), beside AS (
  SELECT s.tree, s.idx, s.part, s.level,
         coalesce(string_agg(n.hash, '' ORDER BY n.idx) FILTER (n.idx < s.place), '') AS before,
         coalesce(string_agg(n.hash, '' ORDER BY n.idx) FILTER (n.idx > s.place), '') AS after
  FROM steps s JOIN nodes n ON n.part = s.part AND n.level = s.level AND n.tree = s.within
   AND n.idx // 16 = s.place // 16
  GROUP BY s.tree, s.idx, s.part, s.level
), path AS (
  SELECT *, row_number() OVER (PARTITION BY tree, idx ORDER BY part, level) AS step FROM beside
), folds AS (
  SELECT tree, idx, 0 AS step, folded AS node FROM leaves
  UNION ALL
  SELECT f.tree, f.idx, p.step, sha256(p.before || f.node || p.after)
  FROM folds f JOIN path p ON p.tree = f.tree AND p.idx = f.idx AND p.step = f.step + 1
), done AS (
  SELECT tree, idx, arg_max(node, step) AS folded_root FROM folds GROUP BY tree, idx
), proof AS (
  SELECT tree, idx, string_agg(before || after, '' ORDER BY step) AS text FROM path GROUP BY tree, idx
)
SELECT l.doc_id, l.leaf, h.hash AS subroot, t.hash AS root, sha256(coalesce(p.text, '')) AS proof_sha256,
       d.folded_root, d.folded_root = t.hash AS verified
FROM leaves l JOIN heads h ON h.tree = l.tree JOIN done d ON d.tree = l.tree AND d.idx = l.idx
LEFT JOIN proof p ON p.tree = l.tree AND p.idx = l.idx
JOIN top t ON t.m = 1
"""

ORACLES = {
    "op11_exact_topk": EXACT_TOPK,
    "op12_collocations": COLLOCATIONS,
    "op13_merkle_manifest": MERKLE,
}
