"""What SQL can say of the operators, for DuckDB: by brute force, with nothing of the operators' own code."""

from __future__ import annotations

SPACES = r"\x20\x09-\x0D"


def _components(nodes: str, links: str) -> str:
    """Common table expressions: reach (id, r), every node with each node that links lead to, from nodes (id) and links (a, b) drawn
    both ways."""
    return f"reach AS (SELECT id, id AS r FROM {nodes} UNION SELECT l.b, reach.r FROM reach JOIN {links} l ON l.a = reach.id)"


#: Nearest by inner product: every query against every vector.
ANN = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(list_inner_product(q.e, c.e)) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e) GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 20"""

#: Sets of three words, all pairs that share a shingle, components by reachability.
JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACES}]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), t AS (
  SELECT doc_id AS id, len(s) AS n, md5(unnest(s)) AS t FROM s
), near AS (
  SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.t = b.t AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), nodes AS (SELECT doc_id AS id FROM documents), {_components("nodes", "near")},
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class_id FROM s WHERE len(s) > 0)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, comp.component_id, coalesce(cls.class_id, s.doc_id) AS class_id
FROM s JOIN comp ON comp.id = s.doc_id LEFT JOIN cls ON cls.doc_id = s.doc_id"""

#: Every pair of vectors.
NEARDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0
), u AS (
  SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v
), near AS (
  SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) >= 0.95
), nodes AS (SELECT vec_id AS id FROM embeddings), {_components("nodes", "near")},
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.component_id, comp.component_id = e.vec_id AS kept
FROM embeddings e JOIN comp ON comp.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""

#: Every run of up to five lines with words that has at least five words (longer ones are unions of these: a line has a word).
LINES = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents WHERE text IS NOT NULL
), m AS (
  SELECT doc_id, number, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(line, '[^{SPACES}]+')) AS words FROM l
), o AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number) AS at FROM m WHERE words > 0
), r AS (
  SELECT a.doc_id, a.number AS start, k.k AS k, string_agg(b.line, chr(10) ORDER BY b.at) AS run, list(b.number ORDER BY b.at) AS numbers, sum(b.words) AS words, count(*) AS n
  FROM o a, (SELECT unnest(range(1, 6)) AS k) k JOIN o b ON b.doc_id = a.doc_id AND b.at >= a.at AND b.at < a.at + k.k
  GROUP BY a.doc_id, a.number, k.k
), p AS (
  SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY doc_id, start) AS copy FROM r WHERE n = k AND words >= 5
), gone AS (
  SELECT doc_id, list_sort(list(DISTINCT number)) AS removed FROM (SELECT doc_id, unnest(numbers) AS number FROM p WHERE copy > 1) GROUP BY doc_id
), left_ AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.number) AS text FROM l JOIN gone g ON g.doc_id = l.doc_id WHERE NOT list_contains(g.removed, l.number) GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(len(g.removed), 0)::INTEGER AS n_removed, CASE WHEN g.removed IS NULL THEN []::INTEGER[] ELSE g.removed::INTEGER[] END AS removed_lines,
       CASE WHEN g.removed IS NULL THEN d.text ELSE coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id LEFT JOIN left_ t ON t.doc_id = d.doc_id"""

#: Base32 by groups of five hexadecimal digits, which are four letters.
WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS best,
    array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * g + 1, 5))::BIGINT >> (15 - 5 * k)) & 31)::INTEGER + 1, 1)), '')), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM b"""

SQL = {"op2_ann_hilbert": ANN, "op3_ngram_jaccard": JACCARD, "op5_embedding_neardup": NEARDUP, "op7_line_dedup": LINES, "op8_warc": WARC}
