"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillstream.llm.align import op12_token_alignment
from quillstream.llm.avi import op6_avi_clips
from quillstream.llm.decontam import op13_decontamination
from quillstream.llm.embedding import op2_embedding_dedup
from quillstream.llm.jaccard import op7_ngram_jaccard
from quillstream.llm.language import op9_language
from quillstream.llm.licenses import op5_license_scan
from quillstream.llm.lm import op3_lm_score
from quillstream.llm.mixing import op10_mixing
from quillstream.llm.packing import op4_length_buckets
from quillstream.llm.quality import op8_quality
from quillstream.llm.sessions import op11_late_sessions
from quillstream.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_length_buckets": op4_length_buckets,
    "op5_license_scan": op5_license_scan,
    "op6_avi_clips": op6_avi_clips,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_mixing": op10_mixing,
    "op11_late_sessions": op11_late_sessions,
    "op12_token_alignment": op12_token_alignment,
    "op13_decontamination": op13_decontamination,
}
# Components of links by the smallest id that is reachable: each node walks to smaller ones.
_REACH = "e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(node, root) AS (SELECT id, id FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b), c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)"
_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), v AS (SELECT doc_id AS id FROM documents), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, root AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.node = doc_id"""
_COSINE = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), u AS (SELECT id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda t: t IS NULL OR NOT isfinite(t))) = 0 AND len(list_filter(x, lambda t: t <> 0)) > 0),
l AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.id < q.id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.95), {_REACH}, k AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, id = root AS kept FROM v LEFT JOIN k ON k.a = id JOIN c ON c.node = id"""
# crc32 of decimal digits, a bit at a time; then sessions of each batch's events so far, without regard to those of the batch before.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({0}) + 1), lambda i: ascii({0}[i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_SESSIONS = f"""WITH t AS (SELECT conv_id, turn, conv_id::VARCHAR AS a, conv_id::VARCHAR || ':' || turn::VARCHAR AS b FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), c AS (SELECT conv_id, turn, {_CRC.format("a")} AS c, {_CRC.format("b")} AS h FROM t),
d AS (SELECT 2 * floor(conv_id / 8)::BIGINT + c % 2 AS u, (c // 2) % 7200 + 300 * turn + h % 600 AS s, h, h // 600 AS g FROM c), e AS (SELECT u, s, h, floor(s / 1800)::BIGINT + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS b FROM d),
f AS (SELECT x.u, y.b AS batch, x.s, x.h, x.b FROM e x JOIN (SELECT DISTINCT u, b FROM e) y ON x.u = y.u AND x.b <= y.b), l AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY u, batch ORDER BY s) <= 240 THEN 0 ELSE 1 END AS cut FROM f),
n AS (SELECT *, sum(cut) OVER (PARTITION BY u, batch ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM l), v AS (SELECT u, batch, k, min(s) AS a, max(s) AS z, count(*) AS n, count(*) FILTER (b = batch) AS fresh, sum(h) AS h FROM n GROUP BY 1, 2, 3 HAVING count(*) FILTER (b = batch) > 0),
r AS (SELECT v.u, v.batch, v.a, min(w.batch) AS rb, arg_min(w.a, w.batch) AS ra FROM v JOIN v w ON v.u = w.u AND w.batch > v.batch AND w.a <= v.a AND w.z >= v.z GROUP BY 1, 2, 3), m AS (SELECT u, rb, ra, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT v.u::BIGINT AS "user", v.batch::BIGINT AS batch, v.a::BIGINT AS start_s, v.z::BIGINT AS end_s, v.n::BIGINT AS n_events, fresh::BIGINT AS n_new, coalesce(m.n, 0)::BIGINT AS n_retracted, v.h::BIGINT AS h_sum, r.rb::BIGINT AS retracted_batch, r.ra::BIGINT AS retracted_start_s
FROM v LEFT JOIN r ON r.u = v.u AND r.batch = v.batch AND r.a = v.a LEFT JOIN m ON m.u = v.u AND m.rb = v.batch AND m.ra = v.a"""
_ITEM_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LEAKS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents), i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark), k AS (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS g FROM k, unnest(range(1, len(w) - n + 2)) AS t(j)), z AS (SELECT DISTINCT n FROM g), p AS (SELECT r, n, j, array_to_string(w[j:j + n - 1], ' ') AS g FROM d, z, unnest(range(1, len(w) - n + 2)) AS t(j)),
m AS (SELECT r, n, j, g FROM p SEMI JOIN g USING (n, g)), h AS (SELECT r, count(DISTINCT j + x) AS n_hit FROM m, unnest(range(n)) AS t(x) GROUP BY 1), s AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m JOIN g USING (n, g) WHERE item_id IS NOT NULL GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)"""
ORACLES: dict[str, str] = {"op13_decontamination": _LEAKS, "op11_late_sessions": _SESSIONS, "op2_embedding_dedup": _COSINE, "op7_ngram_jaccard": _JOIN}
