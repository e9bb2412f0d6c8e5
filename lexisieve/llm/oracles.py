"""SQL equivalents, with every list and limit written out again."""

_DIVERGENCE = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
grams AS (SELECT doc_id, i, words[i:i + 4] AS g FROM (
  SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c >= 2),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, i + unnest(range(0, 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
lists AS (SELECT * FROM (VALUES
  ('en', ['the','of','and','to','in','is','that','for','it','with','as','on']),
  ('de', ['der','die','und','in','den','von','zu','das','mit','sich','des','ist']),
  ('fr', ['de','la','le','et','les','des','en','un','du','une','que','est']),
  ('es', ['de','la','que','el','en','y','los','se','del','las','un','por'])) AS v(lang, list)),
m AS (SELECT w.doc_id, w.lang, len(words)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    [length(t) - length(regexp_replace(t, '\p{Ll}+', '', 'g')), length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')),
     length(t) - length(regexp_replace(t, '\p{Nd}+', '', 'g')),
     length(t) - length(regexp_replace(t, '[.,;:''"()?-]+', '', 'g')),
     length(t) - length(regexp_replace(t, '[!#*$%&|<>]+', '', 'g')),
     length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))] AS c, length(t) AS n_chars,
    list_transform(list, lambda x: len(list_filter(words, lambda y: y = x))) AS h
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lists ON lists.lang = w.lang),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    list_append(c, n_chars - list_sum(c)) AS classes, list_append(h, n_words - list_sum(h)) AS common FROM m),
long AS (SELECT doc_id, lang, n_words, base_failed, 'classes' AS kind, unnest(range(1, 8)) AS k, unnest(classes) AS x FROM b
  UNION ALL SELECT doc_id, lang, n_words, base_failed, 'common', unnest(range(1, 14)), unnest(common) FROM b WHERE common IS NOT NULL),
supported AS (SELECT lang FROM b WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= 2000),
ref AS (SELECT lang, kind, k, sum(x) AS y FROM long SEMI JOIN supported USING (lang) WHERE NOT base_failed GROUP BY ALL),
shares AS (SELECT doc_id, kind, x / sum(x) OVER (PARTITION BY doc_id, kind) AS p, y / sum(y) OVER (PARTITION BY doc_id, kind) AS q
  FROM long JOIN ref USING (lang, kind, k)),
dist AS (SELECT doc_id, kind, sqrt(greatest(sum(
    CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js
  FROM shares GROUP BY doc_id, kind),
j AS (SELECT b.*, CASE WHEN word_chars >= 150 THEN dc.js END AS cd, CASE WHEN n_words >= 80 THEN dw.js END AS wd FROM b
  LEFT JOIN dist dc ON dc.doc_id = b.doc_id AND dc.kind = 'classes' LEFT JOIN dist dw ON dw.doc_id = b.doc_id AND dw.kind = 'common')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd, 0) <= 0.25 AND coalesce(wd, 0) <= 0.24 AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS common_distance FROM j
"""



def _equal_average() -> str:
    """Four rounds of assignment and means, then the last assignment, by comparing with every entry."""
    def assigned(k: int) -> str:
        return f"""a{k} AS (SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS near FROM (
  SELECT vec_id, x.p, e, x, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d
  FROM x JOIN c{k} ON x.p = c{k}.p) GROUP BY vec_id, p)"""

    steps = [assigned(0)]
    for k in range(1, 5):
        steps.append(f"""m{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
  SELECT p, e, i, floor(sum(y) / count(*)) AS m FROM (
    SELECT p, near.e AS e, unnest(range(1, 17)) AS i, unnest(x) AS y FROM a{k - 1}) GROUP BY p, e, i) GROUP BY p, e),
c{k} AS (SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM c{k - 1} o LEFT JOIN m{k} m ON o.p = m.p AND o.e = m.e)""")
        steps.append(assigned(k))
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS (SELECT vec_id, p, v[16 * p + 1:16 * p + 16] AS x FROM (SELECT vec_id, v, unnest(range(0, 4)) AS p FROM k)),
c0 AS (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM x) WHERE e < 256),
{(","  + chr(10)).join(steps)},
hash AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (
  SELECT p, e, unnest(range(1, 17)) AS i, unnest(c) AS y FROM c4)),
coded AS (SELECT vec_id, string_agg(printf('%02x', near.e::BIGINT), '' ORDER BY p) AS code, sum(near.d)::BIGINT AS error
  FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN k USING (vec_id), hash
"""


ORACLES = {"op4_divergence": _DIVERGENCE, "op13_equal_average": _equal_average()}
