"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_trees, near_vectors, ngram_join, packing, quality_rules, sentence_pieces, token_files, toxicity, warc_packages
from .language_id import op1_language_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_near_vectors": near_vectors.op2_near_vectors,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_warc_packages": warc_packages.op5_warc_packages,
    "op6_token_files": token_files.op6_token_files,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_sentence_pieces": sentence_pieces.op8_sentence_pieces,
    "op9_chat_trees": chat_trees.op9_chat_trees,
    "op10_packing": packing.op10_packing,
}

#: Brute force in SQL: every pair of documents that share a shingle, and what is reachable.
NGRAM_JOIN_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM d),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id)::BIGINT AS component_id FROM d LEFT JOIN n USING (doc_id)
"""

#: Every pair of vectors of a label.
NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1), k AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, v.vec_id = component_id AS kept FROM v LEFT JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""

#: Digests from the pages themselves, in base32 by groups of five hexadecimal digits.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), h AS (SELECT page_id, octet_length(body)::BIGINT AS n, sha1(body) AS h FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS first_id FROM h)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END::BIGINT AS refers_to FROM f
"""

CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length(role) + length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_near_vectors": NEAR_VECTORS_SQL,
    "op3_ngram_join": NGRAM_JOIN_SQL,
    "op5_warc_packages": WARC_SQL,
    "op9_chat_trees": CHAT_SQL,
    "op4_quality_rules": quality_rules.ORACLE,
}
