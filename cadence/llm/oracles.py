"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .mixing import GOLDEN, MODULUS

#: White space of a word's edges, as RE2 writes it.
_GAP = r"\x20\x09-\x0D"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_GAP}]+') AS w FROM documents),
win AS (SELECT r, k, array_to_string(list_slice(w, k, k + 7), chr(31)) AS key FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, key) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + 8)) AS p FROM twice) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_GAP}]')) AS l FROM d),
m AS (SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[{_GAP}]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN ln USING (r) LEFT JOIN rep USING (r)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 n_symbols > greatest(n_words, 1) * 0.2 OR n_dup_lines > greatest(n_words, 1) * 0.1 OR n_repeat_words > greatest(n_words, 1) * 0.2 OR word_chars < 2 * greatest(n_words, 1) OR word_chars > 20 * greatest(n_words, 1) AS house_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed OR house_failed AS BIGINT)) AS f FROM j GROUP BY 1),
p AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v, avg(1 / n) AS r FROM h),
s AS (SELECT m, greatest(least(m * (1 - m) / greatest(v - m * (1 - m) * r, 1e-6) - 1, 1e6), 2.0) AS c FROM p),
t AS (SELECT source, (f + m * c) / (n + c) <= 0.5 AS trusted FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (trusted OR NOT house_failed) AS kept FROM j JOIN t ON j.source IS NOT DISTINCT FROM t.source
"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{_GAP}]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT * FROM d),
l AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM e),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM e GROUP BY 1),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 3 * z AS most FROM s),
x AS (SELECT *, sum(z) OVER () - coalesce(sum(most) OVER o, 0) AS room, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, room / rest * weight >= most AS is_full FROM x),
t AS (SELECT source, z, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE (SELECT arg_min(room / rest, most / weight) FROM y WHERE NOT is_full) * weight END AS target, CAST(ceil(z / greatest(32, ceil(z / 4194304))) AS BIGINT) AS nb FROM y),
u AS (SELECT *, CASE WHEN z > 0 THEN target * nb / z ELSE 0 END AS draws FROM t),
v AS (SELECT *, coalesce(sum(draws) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / greatest(sum(draws) OVER (), 1e-300), 0) AS lo,
 CASE WHEN row_number() OVER (ORDER BY source NULLS LAST) = count(*) OVER () THEN 1 ELSE sum(draws) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) / greatest(sum(draws) OVER (), 1e-300) END AS hi FROM u),
i AS (SELECT i, ((i % {MODULUS}) * {GOLDEN}) % {MODULUS} / {float(MODULUS)} AS p FROM (SELECT unnest(range(CAST((SELECT coalesce(round(sum(draws)), 0) FROM u) AS BIGINT))) AS i)),
r AS (SELECT v.source, nb, z, row_number() OVER (PARTITION BY v.source ORDER BY i) - 1 AS k FROM i JOIN v ON p >= lo AND p < hi WHERE nb > 0),
b AS (SELECT source, k % nb AS block, count(*) AS times, (k % nb) * any_value(z) // any_value(nb) AS c0, (k % nb + 1) * any_value(z) // any_value(nb) AS c1 FROM r WHERE k < 3 * nb GROUP BY source, k % nb),
g AS (SELECT l.source, l.doc_id, l.a, CAST(sum(times * greatest(least(c1, l.a + size) - greatest(c0, l.a), 0)) AS BIGINT) AS taken FROM l JOIN b ON l.source IS NOT DISTINCT FROM b.source AND c0 < l.a + size AND c1 > l.a WHERE size > 0 GROUP BY 1, 2, 3)
SELECT l.doc_id, l.size, t.z AS source_size, t.target, coalesce(g.taken, 0) AS taken FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON l.source IS NOT DISTINCT FROM g.source AND l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.a = g.a AND l.size > 0
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_GAP}]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda p: array_to_string(list_slice(w, p, p + 4), chr(31))) WHEN len(w) > 0 THEN [array_to_string(w, chr(31))] ELSE [] END) AS s FROM d),
c AS (SELECT doc_id, s, count(*) AS c FROM k GROUP BY 1, 2), n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS low FROM c a JOIN c b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE low / (x.n + y.n - low) >= 0.8),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY 1)
SELECT d.doc_id, least(d.doc_id, coalesce(m.low, d.doc_id)) AS class_id, CASE WHEN len(w) > 0 THEN count(*) OVER (PARTITION BY text) ELSE 1 END AS n_copies, d.doc_id <= coalesce(m.low, d.doc_id) AS kept FROM d LEFT JOIN m USING (doc_id)
"""

PASSAGES = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_GAP}]+') AS w FROM documents),
k AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), chr(31))) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY key) AS low FROM k) WHERE low < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM f),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY 1),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(z.n, 0) AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1), m AS (SELECT a AS vec_id, min(b) AS low FROM r GROUP BY 1)
SELECT x.vec_id, coalesce(n.n, 0) AS n_links, least(x.vec_id, coalesce(m.low, x.vec_id)) AS component_id, x.vec_id <= coalesce(m.low, x.vec_id) AS kept FROM embeddings x LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10), v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total, any_value(coalesce(v.v, 0)) AS v FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN v ON v.lang = g.lang GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (total + 2 * s.v) AS BIGINT) AS p FROM s JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
l AS (SELECT lang, sum(total) AS total, any_value(v) AS v FROM s GROUP BY 1),
q AS (SELECT p.lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS BIGINT) AS q FROM p JOIN l ON l.lang = p.lang GROUP BY 1, 2),
w AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(w.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
UNION ALL SELECT p.lang, source, 'term', p.term, (p - q) * (p - q) // (p + q) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
"""

ORACLES = {"op1_near_duplicates": NEAR_DUPLICATES, "op5_passages": PASSAGES, "op6_quality": QUALITY, "op9_mixing": MIXING, "op10_embedding_caps": EMBEDDINGS, "op13_source_divergence": DIVERGENCE}
