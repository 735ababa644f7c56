"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from .licences import BASE, COVER, NEAR, NOTICES

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WHITE = r"[^\x20\x09-\x0D]+"

OP2 = f"""
WITH b AS (SELECT item_id, regexp_extract_all({LOWER}, '{PLAIN}') AS w FROM benchmark WHERE item_id IS NOT NULL),
 bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(13, len(w)) - 1) AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
 d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{PLAIN}') AS w FROM documents),
 sizes AS (SELECT DISTINCT len(win) AS m FROM bw),
 dw AS (SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
 hit AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (win)),
 words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WHITE}') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4) UNION SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 3),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 link AS (SELECT x, y FROM common JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
 both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
 reach AS (SELECT x AS doc_id, x AS m FROM both_ways UNION SELECT e.y, r.m FROM reach r JOIN both_ways e ON e.x = r.doc_id),
 comp AS (SELECT doc_id, min(m) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.m, d.doc_id) AS component_id, coalesce(comp.m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WHITE}') AS w FROM documents),
 win AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
 late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM late),
 word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
 kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _op6() -> str:
    texts = [*BASE, *NOTICES]
    pairs = [(k, t, a, b) for k, x in enumerate(texts) for t, (a, b) in enumerate(zip(x.split(), x.split()[1:], strict=False))]
    values = ", ".join(f"({k}, {t}, '{a}', '{b}')" for k, t, a, b in pairs)
    names = ", ".join(f"({k}, '{v}', {str(k >= len(BASE)).lower()}, {len(x.split()) - 1})" for k, (x, v) in enumerate([*BASE.items(), *NOTICES.items()]))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{PLAIN}') AS w FROM documents),
 pr AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS p, unnest(w[:len(w) - 1]) AS w1, unnest(w[2:]) AS w2 FROM d),
 t AS (SELECT * FROM (VALUES {values}) x(tid, t, w1, w2)), nm AS (SELECT * FROM (VALUES {names}) x(tid, label, own, pairs)),
 v AS (SELECT doc_id, tid, p - t AS diagonal, bit_or(1::BIGINT << t) AS places FROM pr JOIN t USING (w1, w2) GROUP BY ALL),
 g AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER k > CASE WHEN own THEN {NEAR} ELSE 0 END)::INT, 1) AS fresh FROM v JOIN nm USING (tid) WINDOW k AS (PARTITION BY doc_id, tid ORDER BY diagonal)),
 h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, tid ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM g),
 s AS (SELECT doc_id, label, own, bit_count(bit_or(places)) / pairs AS share, min(diagonal) AS start FROM h GROUP BY doc_id, tid, label, own, pairs, span),
 f AS (SELECT doc_id, count(*) FILTER (WHERE NOT own) AS n_base, min(start) FILTER (WHERE NOT own) AS first_word, max(start) FILTER (WHERE NOT own) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE NOT own) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
  FROM s WHERE share >= CASE WHEN own THEN {COVER} ELSE 1.0 END GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
 coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score FROM d LEFT JOIN f USING (doc_id)"""


OP6 = _op6()

OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""

OP9 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
 w AS (SELECT doc_id, i, md5(array_slice(b, i, i + 399)) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400)),
 dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM w) WHERE c > 1),
 gap AS (SELECT doc_id, i, lag(i) OVER k AS before FROM dup WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
 run AS (SELECT doc_id, i, sum((before IS NULL OR i - before > 400)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM gap),
 span AS (SELECT doc_id, r, min(i) AS lo, max(i) + 400 AS hi FROM run GROUP BY doc_id, r),
 edge AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS begin FROM (SELECT doc_id, lo, hi FROM span UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) + 2 FROM d)),
 rest AS (SELECT doc_id, unhex(coalesce(string_agg(CASE WHEN lo > begin THEN hex(array_slice(b, begin, lo - 1)) ELSE '' END, '' ORDER BY lo), '')) AS t FROM edge JOIN d USING (doc_id) GROUP BY doc_id),
 n AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(rest.t) AS kept_sha256
FROM d JOIN rest USING (doc_id) LEFT JOIN n USING (doc_id)"""

ORACLES = {
    "op2_benchmark_decontamination": OP2,
    "op3_minhash_near_dedup": OP3,
    "op5_substring_dedup": OP5,
    "op6_licence_scan": OP6,
    "op7_exact_top_k": OP7,
    "op9_suffix_array_dedup": OP9,
}
