"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

#: Earlier copies of every run of 50 words, then the words that such runs cover.
ORACLES["op8_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS place FROM split WHERE len(words) >= 50
), runs AS (
  SELECT doc_id, place, array_to_string(words[place:place + 49], ' ') AS run FROM places
), repeated AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, min(doc_id) OVER (PARTITION BY run) AS first_doc FROM runs
  ) WHERE first_doc < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(place, place + 50)) AS place FROM repeated
), listed AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS place FROM split
), kept AS (
  SELECT l.doc_id, string_agg(l.words[l.place], ' ' ORDER BY l.place) AS text, count(*) AS n
  FROM listed l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id
)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""

#: Links by brute force; components as the smallest vector that links reach.
ORACLES["op7_embedding_near_dedup"] = r"""
WITH RECURSIVE valid AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
   AND list_dot_product(a.v, b.v) >= 0.95 * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM valid
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), numbers AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS component FROM reached GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, e.vec_id) AS component_id,
       e.vec_id = coalesce(component, e.vec_id) AS kept
FROM embeddings e LEFT JOIN numbers ON e.vec_id = numbers.a LEFT JOIN least ON e.vec_id = least.a
"""

#: Numbers of each text, failures by host, rates shrunken to the beta of their mean and variance.
ORACLES["op4_host_rules"] = r"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS place, words FROM split WHERE len(words) >= 5
), runs AS (
  SELECT doc_id, unnest(list(place)) AS place FROM places
  GROUP BY doc_id, array_to_string(words[place:place + 4], ' ') HAVING count(*) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT word) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(place, place + 5)) AS word FROM runs) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
), duplicated AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM lines GROUP BY doc_id
), numbers AS (
  SELECT s.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM split s LEFT JOIN duplicated USING (doc_id) LEFT JOIN repeated USING (doc_id)
), failed AS (
  SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2,
         100 * n_symbols > 50 * n_words AS f3, 100 * n_dup_lines > 30 * n_lines AS f4 FROM numbers
), counted AS (
  SELECT source, unnest([1, 2, 3, 4]) AS rule, count(*) AS n,
         unnest([count_if(f1), count_if(f2), count_if(f3), count_if(f4)]) AS k
  FROM failed WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v, avg(n) AS size FROM counted GROUP BY rule
), priors AS (
  SELECT rule, m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE size END AS s FROM moments
), hosts AS (
  SELECT source, max((k + m * s) / (n + s)) AS rate FROM counted JOIN priors USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 OR f2) AS base_failed,
       NOT (f1 OR f2) AND coalesce(rate, 0) <= 0.5 AS kept
FROM failed LEFT JOIN hosts USING (source)
"""

#: Similar pairs of shingle sets by brute force; classes as the smallest document that links reach.
ORACLES["op9_minhash_near_dedup"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, array_to_string(words[place:place + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS place FROM split WHERE len(words) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON c.a = x.doc_id JOIN sizes y ON c.b = y.doc_id
  WHERE c.n >= 0.8 * (x.n + y.n - c.n)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM split
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS class_id FROM reached GROUP BY a)
SELECT s.doc_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, s.doc_id = class_id AS kept
FROM split s JOIN least ON s.doc_id = least.a LEFT JOIN sizes z ON s.doc_id = z.doc_id
"""


def _clustering(k: int, rounds: int, scale: int, dim: int) -> str:
    """Lloyd's rounds, one after the other."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
assigned{r} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT k.row, k.vec_id, k.v, m.c,
           CAST(list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM kept k, means{r} m
  ) GROUP BY row
)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT best.c AS c, i, sum(v[i]) AS s, CAST(count(*) AS HUGEINT) AS n
  FROM assigned{r}, (SELECT unnest(range(1, {dim} + 1)) AS i) GROUP BY best.c, i
), moved{r} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM sums{r} GROUP BY c
), means{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(w.v, m.v) AS v FROM means{r} m LEFT JOIN moved{r} w USING (c)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), means0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
    SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}
  )
), {",".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM assigned{rounds} a JOIN means{rounds} m ON a.best.c = m.c
"""


ORACLES["op11_centroid_clusters"] = _clustering(k=16, rounds=3, scale=64, dim=64)

#: All inner products, the ten highest of each query.
ORACLES["op12_exact_top_k"] = r"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def _phrases(least: int, longest: int, within: int, scale: int, first: int) -> str:
    """Frequent runs of words, counted one by one, and the frequencies of what their cuts leave."""
    runs = " UNION ALL ".join(
        f"SELECT lang, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: ws[i:i + {k - 1}])) AS p FROM pieces WHERE len(ws) >= {k}"
        for k in range(1, longest + 1)
    )
    return f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)
), totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM ({runs}) GROUP BY lang, p HAVING count(*) >= {least}),
found AS (SELECT lang, p, f AS a FROM counts WHERE len(p) > 1),
parts AS (
  SELECT lang, p[i:i + size - 1] AS p, max(a) AS cover
  FROM (SELECT lang, p, a, size, unnest(range(1, len(p) - size + 2)) AS i
        FROM (SELECT lang, p, a, unnest(range(2, len(p))) AS size FROM found WHERE len(p) > 2))
  GROUP BY 1, 2
), kept AS (
  SELECT f.lang, f.p, f.a FROM found f LEFT JOIN parts USING (lang, p)
  WHERE cover IS NULL OR 100 * CAST(cover AS HUGEINT) < {within} * CAST(a AS HUGEINT)
), cuts AS (
  SELECT k.lang, k.p, k.a, min({{'score': CAST(({scale} * CAST(a AS HUGEINT)) // (x.f + y.f) AS BIGINT), 'k': k, 'l': x.f, 'r': y.f}}) AS cut
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM kept) k
  JOIN counts x ON x.lang = k.lang AND x.p = k.p[1:k.k] JOIN counts y ON y.lang = k.lang AND y.p = k.p[k.k + 1:]
  GROUP BY k.lang, k.p, k.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, array_to_string(p, ' ')) AS rank,
         array_to_string(p, ' ') AS phrase, a, cut.l AS l, cut.r AS r, cut.score AS score
  FROM cuts
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {first}
"""


ORACLES["op13_collocations"] = _phrases(least=30, longest=4, within=80, scale=2_000_000, first=2000)
