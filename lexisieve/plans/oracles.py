"""SQL that computes the registered queries independently, on the same tables."""

from __future__ import annotations

from lexisieve.functions.tokens import SPECIALS, TWO_LETTER_ATOMS, TWO_LETTER_ATOMS_EXTENDED
from lexisieve.operators.rules import RULES

ORACLES: dict[str, str] = {}

# --- fragments of SQL -------------------------------------------------------

WORDS = r"list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '')"


def atom_regex(atoms=TWO_LETTER_ATOMS) -> str:
    return "(" + "|".join([*atoms, "%[0-9][0-9]", "."]) + ")"


def atoms_of(text: str, atoms=TWO_LETTER_ATOMS) -> str:
    return f"regexp_extract_all({text}, '{atom_regex(atoms)}', 1)"


def grams(words: str = "words", q: int = 3) -> str:
    joined = " || ' ' || ".join(f"{words}[i + {k}]" for k in range(q))
    return f"list_distinct(list_transform(range(1, len({words}) - {q - 2}), lambda i: {joined}))"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def seeded(seed: int, *cols: str) -> str:
    return "md5('" + str(seed) + "'" + "".join(f" || ':' || {c}::VARCHAR" for c in cols) + ")"


def md5_int(text: str) -> str:
    return f"('0x' || substr({text}, 1, 7))::BIGINT"


PLAIN = [*(chr(c) for c in range(32, 127)), "Cl", "Br", "Na", "Si", "Li", "Se"]
VOCAB_MAP = "MAP {" + ", ".join("'" + t.replace("'", "''") + f"': {i + 3}" for i, t in enumerate(PLAIN)) + "}"
KNOWN_TOKENS = sql_list(PLAIN)

DOC_WORDS = f"w AS (SELECT doc_id, lang, n_chars, {WORDS} AS words FROM documents)"
DOC_GRAMS = f"{DOC_WORDS}, s AS (SELECT doc_id, {grams()} AS g FROM w)"
DOC_ELEMENTS = f"{DOC_GRAMS}, e AS (SELECT doc_id, unnest(g) AS gram, len(g) AS n FROM s)"
PAIRS = f"""{DOC_ELEMENTS},
shared AS (SELECT a.doc_id AS l, b.doc_id AS r, any_value(a.n) AS ln, any_value(b.n) AS rn, count(*) AS c
  FROM e a JOIN e b ON a.gram = b.gram WHERE a.doc_id NOT IN (SELECT doc_id FROM labels) AND b.doc_id IN (SELECT doc_id FROM labels) GROUP BY 1, 2),
tc AS (SELECT l, r, ln, rn, c, c::DOUBLE / (ln + rn - c) AS tanimoto FROM shared)"""
SETS = f"""{PAIRS},
keyed AS (SELECT doc_id, (doc_id IN (SELECT doc_id FROM labels))::INT AS side, list_sort(g) AS g FROM s WHERE len(g) > 0),
reps AS (SELECT side, g, min(doc_id) AS rep, count(*) AS copies FROM keyed GROUP BY side, g),
set_pairs AS (SELECT l AS left_rep, r AS right_rep, a.copies AS left_copies, b.copies AS right_copies, tanimoto
  FROM tc JOIN reps a ON a.rep = l AND a.side = 0 JOIN reps b ON b.rep = r AND b.side = 1)"""


def contained(doc_g: str, bench_g: str) -> str:
    """CTEs ``hit(doc_id, item_id)`` from words of both tables."""
    return f"""{DOC_WORDS}, s AS (SELECT doc_id, {doc_g} AS g FROM w),
bw AS (SELECT item_id, {WORDS} AS words FROM benchmark), b AS (SELECT item_id, {bench_g} AS g FROM bw),
se AS (SELECT doc_id, unnest(g) AS gram FROM s), be AS (SELECT item_id, unnest(g) AS gram, len(g) AS n FROM b),
hit AS (SELECT doc_id, item_id FROM se JOIN be USING (gram) GROUP BY 1, 2 HAVING count(*) = any_value(n))"""


COARSE = f"(SELECT {grams('h')} FROM (SELECT list_transform(words, lambda x: substr(x, 1, 2)) AS h))"

# --- sources and sinks ------------------------------------------------------

ORACLES["scan_project"] = r"""
SELECT doc_id AS ID, text AS SMILES FROM documents"""
ORACLES["resume_curate"] = """
SELECT min(p_partkey::VARCHAR)::BIGINT AS ID, 'CC' || repeat('C', p_size % 9) AS SMILES, true AS same_path FROM part GROUP BY p_size % 9"""
ORACLES["tsv_roundtrip"] = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"
ORACLES["merge_files"] = """
SELECT s_suppkey, s_name, s_nationkey::DOUBLE AS s_nationkey, s_acctbal FROM supplier
UNION ALL SELECT c_custkey, c_name, NULL, NULL FROM customer"""
ORACLES["sdf_scan"] = """
SELECT doc_id AS id, lang, rtrim(text, ' ') AS body, '0  0' AS counts
FROM documents"""
ORACLES["file_identity"] = " UNION ALL ".join(
    f"SELECT '{t}' AS file_name, 'parquet' AS file_format, count(*) AS n FROM {t}"
    for t in ("documents", "part", "orders", "lineitem"))
ORACLES["save_result"] = """
SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, 5::BIGINT AS n_columns FROM documents GROUP BY lang"""
ORACLES["split_chunks"] = """
SELECT idx // 7000 AS numfile, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key
FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS idx FROM lineitem) GROUP BY 1"""

CASCADE = f"""{PAIRS},
f AS (SELECT doc_id, n_chars, len(words) AS n_words, round_even(n_chars / len(words), 3) AS per_word,
  (SELECT {grams()}) AS fine, {COARSE} AS coarse FROM w),
hits AS (
  SELECT doc_id, 1 AS stage FROM f WHERE NOT coalesce(200 <= n_chars AND n_chars <= 6000 AND 30 <= n_words AND per_word < 6.5, false)
  UNION ALL SELECT l, 2 FROM tc WHERE c = ln AND c = rn
  UNION ALL SELECT l, 3 FROM tc WHERE c * 100 > 85 * (ln + rn - c)
  UNION ALL SELECT doc_id, 4 FROM hit_fine UNION ALL SELECT doc_id, 5 FROM hit_coarse),
tagged AS (SELECT doc_id, any_value(n_words) AS n_words,
  coalesce(['property', 'hard', 'soft', 'atom', 'graph'][min(stage)], 'kept') AS dropped_at
  FROM f LEFT JOIN hits USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id)"""
_fine = contained(grams(), grams())
_extra = f"""bw AS (SELECT item_id, {WORDS} AS words FROM benchmark),
bf AS (SELECT item_id, unnest(g) AS gram, len(g) AS n FROM (SELECT item_id, {grams()} AS g FROM bw)),
bc AS (SELECT item_id, unnest(g) AS gram, len(g) AS n FROM (SELECT item_id, {COARSE} AS g FROM bw)),
ce AS (SELECT doc_id, unnest(g) AS gram FROM (SELECT doc_id, {COARSE} AS g FROM w)),
hit_fine AS (SELECT doc_id, item_id FROM e JOIN bf USING (gram) GROUP BY 1, 2 HAVING count(*) = any_value(bf.n)),
hit_coarse AS (SELECT doc_id, item_id FROM ce JOIN bc USING (gram) GROUP BY 1, 2 HAVING count(*) = any_value(bc.n)),
f AS ("""
CASCADE = CASCADE.replace("f AS (", _extra, 1)
ORACLES["screen_cascade"] = f"WITH {CASCADE} SELECT doc_id, dropped_at FROM tagged"
ORACLES["filter_funnel"] = f"""WITH {CASCADE},
stages AS (SELECT unnest(['property', 'hard', 'soft', 'atom', 'graph']) AS stage, unnest([1, 2, 3, 4, 5]) AS no),
pos AS (SELECT doc_id, coalesce(no, 6) AS no FROM tagged LEFT JOIN stages ON stage = dropped_at)
SELECT stage, (SELECT count(*) FROM pos WHERE pos.no = stages.no) AS n_dropped,
  (SELECT count(*) FROM pos WHERE pos.no > stages.no) AS n_remaining FROM stages"""
ORACLES["stage_snapshots"] = f"""WITH {CASCADE}
SELECT dropped_at, count(*) AS n, sum(n_words)::BIGINT AS n_words FROM tagged GROUP BY 1"""

# --- cleaning ---------------------------------------------------------------

ORACLES["rule_filter"] = """
SELECT * FROM (SELECT p_partkey, p_size, round_even(p_retailprice * 1.00037, 3) AS price FROM part WHERE NOT contains(p_name, 'ring'))
WHERE (p_size < 5 OR (20 <= p_size AND p_size <= 40 AND NOT p_size = 30)) AND 900.333 <= price AND price <= 960.5"""


def _rule(rule: str) -> str:
    return "(" + rule.replace("&", " AND ").replace("==", "=") + ")"


ORACLES["rule_profile_matrix"] = f"""
WITH d AS (SELECT p_partkey, round_even(p_retailprice - 500, 3) AS MW, round_even(p_size / 10.0::DOUBLE, 3) AS logP,
  p_partkey % 7 AS HBD, p_partkey % 13 AS HBA, round_even(p_size * 4.0::DOUBLE, 3) AS TPSA, p_partkey % 12 AS NRB,
  p_partkey % 3 <> 0 AS MCF, p_size % 9 AS rings FROM part)
SELECT p_partkey, {", ".join(f"{_rule(r)} AS {n}" for n, r in RULES.items())},
  ({" + ".join(f"{_rule(r)}::INT" for r in RULES.values())})::INT AS n_passed FROM d"""
ORACLES["drop_invalid"] = """
SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL"""

VALIDITY = f"""
n AS (SELECT doc_id AS ID, text AS SMILES FROM documents),
t AS (SELECT ID, SMILES, {atoms_of('SMILES')} AS tokens FROM n),
u AS (SELECT ID, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM t),
d AS (SELECT ID, i, tok,
  sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY ID ORDER BY i) AS p,
  sum(CASE tok WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER (PARTITION BY ID ORDER BY i) AS q FROM u),
x AS (SELECT ID, min(p) AS pmin, arg_max(p, i) AS pend, min(q) AS qmin, arg_max(q, i) AS qend,
  bool_or(NOT list_contains({KNOWN_TOKENS}, tok) AND NOT regexp_full_match(tok, '%[0-9][0-9]|[1-9]'))
    AS strange FROM d GROUP BY ID),
r AS (SELECT ID, lab, count(*) AS c FROM (SELECT ID, unnest(regexp_extract_all(
  regexp_replace(SMILES, '\\[[^\\]]*\\]', '*', 'g'), '(%[0-9][0-9]|[1-9])', 1)) AS lab FROM n) GROUP BY 1, 2),
odd AS (SELECT DISTINCT ID FROM r WHERE c % 2 = 1),
v AS (SELECT n.ID, n.SMILES, CASE WHEN length(SMILES) = 0 THEN 'empty' WHEN strange THEN 'unknown token'
  WHEN pmin < 0 OR pend <> 0 THEN 'parenthesis' WHEN qmin < 0 OR qend <> 0 THEN 'bracket'
  WHEN odd.ID IS NOT NULL THEN 'open ring' END AS invalid_reason
  FROM n LEFT JOIN x USING (ID) LEFT JOIN odd ON odd.ID = n.ID)""".replace("\\\\", "\\")
ORACLES["validity"] = f"WITH {VALIDITY} SELECT ID, invalid_reason IS NULL AS valid, invalid_reason FROM v"


def _longest(text: str, sep: str) -> str:
    """First part of the greatest length."""
    parts = f"string_split({text}, {sep})"
    return (f"list_filter({parts}, lambda p: length(p) = list_max(list_transform({parts}, lambda z: length(z))))[1]")


def _normal(text: str, sep: str) -> str:
    stripped = f"regexp_replace({text}, '\\[[0-9]+', '[', 'g')"
    return (f"CASE WHEN length({stripped}) - length(replace(replace({stripped}, 'C', ''), 'c', '')) >= 2 "
            f"THEN {_longest(stripped, sep)} END")


ORACLES["normalize_fragment"] = f"""
SELECT * FROM (SELECT doc_id, {_normal('text', 'chr(10)')} AS fragment FROM documents) WHERE fragment IS NOT NULL"""
ORACLES["tokenize"] = f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS tokens_md5
FROM (SELECT doc_id, {atoms_of('text')} AS t FROM documents)"""
ORACLES["token_filter"] = f"""
SELECT ID, (len(list_filter(list_distinct(t), lambda x: NOT list_contains({KNOWN_TOKENS}, x))) = 0)::INT AS pass
FROM (SELECT doc_id AS ID, {atoms_of('text')} AS t FROM documents)"""
ORACLES["token_filter_failed"] = f"""
SELECT doc_id AS ID, md5(text) AS text_md5 FROM documents
WHERE len(list_filter(list_distinct({atoms_of('text')}), lambda x: NOT list_contains({KNOWN_TOKENS}, x))) > 0"""
ORACLES["token_filter_count"] = f"SELECT count(*) AS n_fail FROM ({ORACLES['token_filter_failed']})"
ORACLES["label_remap"] = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 2 END::INT AS label
FROM (SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem)"""
ORACLES["penalized_score"] = """
SELECT p_partkey, round(CASE WHEN p_size > 2 AND p_partkey % 5 <> 0
  THEN p_retailprice / 100 - p_size / 10.0::DOUBLE - p_partkey % 3 ELSE -5 END, 6)::DOUBLE AS score FROM part"""

CURATED = f"""{VALIDITY},
one AS (SELECT min(ID) AS ID, SMILES FROM v WHERE invalid_reason IS NULL GROUP BY SMILES),
norm AS (SELECT ID, {_normal('SMILES', "'.'")} AS SMILES FROM one),
ok AS (SELECT ID, SMILES FROM norm WHERE SMILES IS NOT NULL
  AND len(list_filter({atoms_of('SMILES')}, lambda y: NOT list_contains({KNOWN_TOKENS}, y))) = 0)"""
ORACLES["curate"] = f"""WITH {CURATED},
again AS (SELECT min(ID) AS ID, SMILES FROM ok GROUP BY SMILES)
SELECT ID, SMILES, 1.1::DOUBLE AS plogP, lpad((row_number() OVER (ORDER BY ID) - 1)::VARCHAR,
  length((SELECT count(*) FROM again)::VARCHAR)::INT, '0') AS row_id FROM again"""

# --- functions --------------------------------------------------------------

PASSING = f"""n AS (SELECT doc_id AS ID, text AS SMILES FROM documents),
t AS (SELECT ID, SMILES, {atoms_of('SMILES')} AS tokens FROM n),
m AS (SELECT ID, SMILES, tokens, list_transform(tokens, lambda x: {VOCAB_MAP}[x]) AS ids FROM t
  WHERE len(list_filter(list_distinct(tokens), lambda x: NOT list_contains({KNOWN_TOKENS}, x))) = 0)"""
ORACLES["encode_pad"] = f"""WITH {PASSING}
SELECT ID, array_to_string(list_resize(list_concat([1], ids)[1:99], 100, 2), ',') AS ids,
  least(len(tokens) + 1, 99) AS length FROM m"""
ORACLES["decode_roundtrip"] = f"""WITH {PASSING}
SELECT ID, array_to_string(tokens, '') AS decoded, array_to_string(tokens, '') = SMILES AS whole FROM m"""
ORACLES["encode_unk"] = f"""
WITH t AS (SELECT doc_id, lang, {atoms_of('text', TWO_LETTER_ATOMS_EXTENDED)} AS tokens FROM documents),
seen AS (SELECT DISTINCT unnest(tokens) AS token FROM t WHERE lang = 'en'),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM seen), k AS (SELECT count(*) AS k FROM seen),
u AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM t),
ids AS (SELECT doc_id, list(coalesce(id, k + 3) ORDER BY i) AS e, count(*) FILTER (id IS NULL) AS n_unk
  FROM u CROSS JOIN k LEFT JOIN vocab USING (token) GROUP BY doc_id)
SELECT doc_id, len(coalesce(e, [])) + 2 AS n_ids,
  md5(array_to_string(list_concat([k], coalesce(e, []), [k + 1]), ',')) AS ids_md5, coalesce(n_unk, 0) AS n_unk
FROM documents CROSS JOIN k LEFT JOIN ids USING (doc_id)"""
ORACLES["collate_batches"] = f"""
WITH w AS (SELECT doc_id, list_transform({WORDS}, lambda x: length(x)) AS ids FROM documents),
o AS (SELECT doc_id, ids, row_number() OVER (ORDER BY {seeded(5, 'doc_id')}, doc_id) - 1 AS i FROM w),
b AS (SELECT doc_id, ids, i // 32 AS batch, len(ids) AS length FROM o WHERE i < (SELECT count(*) FROM w) // 32 * 32),
m AS (SELECT *, max(length) OVER (PARTITION BY batch) AS padded,
  row_number() OVER (PARTITION BY batch ORDER BY length DESC, doc_id) AS position FROM b)
SELECT batch, doc_id, position, length, padded, md5(array_to_string(list_resize(ids, padded, 0), ',')) AS ids_md5 FROM m"""


def _bits(q: int, n_bits: int) -> str:
    return (f"{DOC_WORDS}, b AS (SELECT doc_id, list_sort(list_distinct(list_transform({grams(q=q)}, "
            f"lambda g: {md5_int('md5(g)')} % {n_bits}))) AS bits FROM w)")


ORACLES["fingerprint"] = f"""WITH {_bits(3, 2048)}
SELECT doc_id, len(bits) AS n_on, md5(array_to_string(bits, ',')) AS bits_md5 FROM b"""
ORACLES["fp_vector"] = f'WITH {_bits(1, 512)} SELECT doc_id, len(bits)::DOUBLE AS "on" FROM b'
ORACLES["add_index"] = """
SELECT doc_id, n_chars, 'doc_' || lpad((row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1)::VARCHAR,
  length((SELECT count(*) FROM documents)::VARCHAR)::INT, '0') AS ID FROM documents"""
_CARBON = sql_list(["C", "c"])
_HETERO = sql_list(["N", "n", "O", "o", "S", "s", "P", "p", "F", "I", "B", "K", *TWO_LETTER_ATOMS])
ORACLES["token_descriptors"] = rf"""
WITH n AS (SELECT doc_id AS ID, text AS SMILES FROM documents),
t AS (SELECT ID, SMILES, {atoms_of('SMILES')} AS tokens FROM n),
u AS (SELECT ID, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM t),
d AS (SELECT ID, sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY ID ORDER BY i) AS p FROM u),
m AS (SELECT ID, greatest(max(p), 0)::BIGINT AS branch_depth FROM d GROUP BY ID)
SELECT ID, length(SMILES) AS length, len(tokens) AS n_tokens,
  len(list_filter(tokens, lambda x: list_contains({_CARBON}, x))) AS n_carbon,
  len(list_filter(tokens, lambda x: list_contains({_HETERO}, x))) AS n_hetero,
  len(regexp_extract_all(regexp_replace(SMILES, '\[[^\]]*\]', '*', 'g'), '(%[0-9][0-9]|[1-9])', 1)) // 2 AS n_rings,
  coalesce(branch_depth, 0) AS branch_depth FROM t LEFT JOIN m USING (ID)"""

ORACLES["element_counts"] = f"""
SELECT doc_id AS ID, token AS element, count(*) AS n FROM (SELECT doc_id, unnest({atoms_of('text')}) AS token FROM documents)
WHERE list_contains({sql_list(["C", "c", "N", "n", "O", "o", "S", "s", "P", "p", "F", "I", "B", "K", *TWO_LETTER_ATOMS])}, token)
GROUP BY doc_id, token"""

# --- joins ------------------------------------------------------------------

ORACLES["subtract_by_id"] = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
ORACLES["known_exact"] = f"""WITH {PAIRS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
AND doc_id NOT IN (SELECT l FROM tc WHERE c = ln AND c = rn)"""
ORACLES["known_near"] = f"""WITH {PAIRS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
AND doc_id NOT IN (SELECT l FROM tc WHERE c * 100 > 85 * (ln + rn - c))"""
ORACLES["similarity_matrix"] = f"""WITH {SETS}
SELECT left_rep, right_rep, left_copies, right_copies, round(tanimoto, 6) AS tanimoto FROM set_pairs WHERE tanimoto >= 0.01"""
ORACLES["similarity_high"] = f"""WITH {SETS}
SELECT left_rep, right_rep, left_copies, right_copies, round(tanimoto, 6) AS tanimoto FROM set_pairs WHERE tanimoto >= 0.8"""
ORACLES["similarity_best_match"] = f"""WITH {SETS}
SELECT left_rep, right_rep, round(tanimoto, 6) AS tanimoto FROM set_pairs WHERE tanimoto >= 0.01
QUALIFY row_number() OVER (PARTITION BY left_rep ORDER BY tanimoto DESC, right_rep) = 1"""
ORACLES["containment_filter"] = f"""WITH {contained(grams(), grams())}
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)"""
ORACLES["containment_generic"] = f"""WITH {contained(COARSE, COARSE)}
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)"""
_GENERIC = f"""list_transform(list_filter({atoms_of('text')}, lambda x: x NOT IN ('-', '=', '#', '/', chr(92), ':')),
  lambda x: CASE WHEN list_contains({sql_list(["C", "c", "N", "n", "O", "o", "S", "s", "P", "p", "F", "I", "B", "K", *TWO_LETTER_ATOMS])}, x) THEN 'C' ELSE x END)"""
ORACLES["containment_generic_tokens"] = f"""
WITH dw AS (SELECT doc_id, {_GENERIC} AS words FROM documents), s AS (SELECT doc_id, {grams(q=6)} AS g FROM dw),
bw AS (SELECT item_id, {_GENERIC} AS words FROM benchmark), b AS (SELECT item_id, {grams(q=6)} AS g FROM bw),
se AS (SELECT doc_id, unnest(g) AS gram FROM s), be AS (SELECT item_id, unnest(g) AS gram, len(g) AS n FROM b),
hit AS (SELECT doc_id, item_id FROM se JOIN be USING (gram) GROUP BY 1, 2 HAVING count(*) = any_value(n))
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)"""
ORACLES["one_fragment_score"] = f"""WITH {contained(grams(), grams())}
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM hit WHERE item_id = 0) THEN 1 ELSE -1 END::INT AS score FROM documents"""
ORACLES["fragment_score"] = f"""WITH {contained(grams(), grams())},
sums AS (SELECT doc_id, sum(item_id % 5) AS x FROM hit GROUP BY 1)
SELECT doc_id, coalesce(nullif(x, 0), -1)::DOUBLE AS score FROM documents LEFT JOIN sums USING (doc_id)"""
ORACLES["similar_to_query"] = f"""
WITH {DOC_WORDS}, s AS (SELECT doc_id, list_distinct(words) AS g FROM w),
q AS (SELECT g AS qg FROM s WHERE doc_id = 0),
x AS (SELECT doc_id, len(list_intersect(g, qg)) AS c, len(g) AS a, len(qg) AS b FROM s CROSS JOIN q)
SELECT doc_id, round(CASE WHEN c > 0 THEN c::DOUBLE / (a + b - c) ELSE 0 END, 6) AS tanimoto FROM x
ORDER BY CASE WHEN c > 0 THEN c::DOUBLE / (a + b - c) ELSE 0 END DESC, doc_id LIMIT 25"""
ORACLES["property_lookup"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_size::DOUBLE AS p_size, p_retailprice,
  (p_size IS NULL)::INT AS p_size_missing, (p_retailprice IS NULL)::INT AS p_retailprice_missing
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey"""
VECTORS = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, (label < 2)::INT AS y FROM embeddings)"""
_NEAR = "round(list_distance(a.vec, b.vec), 6)"
ORACLES["knn_join"] = f"""WITH {VECTORS}
SELECT a.id, b.id AS neighbor, row_number() OVER (PARTITION BY a.id ORDER BY {_NEAR}, b.id) AS rank, {_NEAR} AS distance
FROM v a JOIN v b ON a.id <> b.id QUALIFY rank <= 5"""
ORACLES["knn_tiled"] = ORACLES["knn_join"]
ORACLES["knn_lsh_recall"] = """
SELECT count(*) AS n_queries, count(*) * 5 AS n_neighbors, true AS reached FROM embeddings WHERE vec_id % 20 = 0"""

# --- sets -------------------------------------------------------------------

ORACLES["dedup_key"] = """
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, md5(text) AS key FROM documents GROUP BY md5(text)"""
ORACLES["dedup_id"] = """
SELECT min(o_orderkey) AS o_orderkey, o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey"""
ORACLES["difference_by_key"] = """
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, md5(text) AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY md5(text)"""
ORACLES["difference_unique"] = """
SELECT min(doc_id) AS doc_id, any_value(lang) AS lang, md5(text) AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY md5(text) HAVING count(*) = 1"""
ORACLES["label_union"] = """
SELECT item_id AS id, md5(text) AS key, 1::INT AS LABEL FROM benchmark UNION ALL SELECT doc_id, md5(text), 0 FROM documents"""
ORACLES["generation_report"] = """
SELECT count(*) AS n_generated, count(DISTINCT text) FILTER (n_chars >= 500) AS n_unique_valid,
  round(count(DISTINCT text) FILTER (n_chars >= 500)::DOUBLE / count(*), 6) AS validity FROM documents"""
ORACLES["set_except"] = "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"
ORACLES["set_intersect"] = "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels"

# --- profiles ---------------------------------------------------------------


def _describe(column: str) -> str:
    q = ", ".join(f"round_even(quantile_cont({column}, {p}), 2) AS {n}" for n, p in
                  (("p5", 0.05), ("p50", 0.5), ("p95", 0.95)))
    return (f"SELECT '{column}' AS descriptor, count({column}) AS count, round_even(avg({column}), 2) AS mean, "
            f"round_even(stddev_samp({column}), 2) AS std, round_even(min({column}), 2) AS min, {q}, "
            f"round_even(max({column}), 2) AS max FROM lineitem")


ORACLES["describe_columns"] = " UNION ALL ".join(
    _describe(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def _histogram(column: str) -> str:
    return f"""SELECT '{column}' AS descriptor, b.bin, round(lo + b.bin * ((hi - lo) / 50), 6) AS lower, coalesce(n, 0) AS n
FROM (SELECT min({column}) AS lo, max({column}) AS hi FROM lineitem) CROSS JOIN (SELECT unnest(range(50)) AS bin) b
LEFT JOIN (SELECT least(floor(({column} - lo) / ((hi - lo) / 50)), 49)::BIGINT AS bin, count(*) AS n FROM lineitem
CROSS JOIN (SELECT min({column}) AS lo, max({column}) AS hi FROM lineitem) GROUP BY 1) c ON b.bin = c.bin"""


ORACLES["histogram"] = " UNION ALL ".join(_histogram(c) for c in ("l_quantity", "l_extendedprice"))
LONG = """
SELECT p_size::DOUBLE AS value, 'size' AS descriptor, 'Real' AS data FROM part
UNION ALL SELECT p_retailprice, 'price', 'Real' FROM part
UNION ALL SELECT l_quantity, 'size', 'AI Design' FROM lineitem
UNION ALL SELECT l_extendedprice, 'price', 'AI Design' FROM lineitem"""
ORACLES["unpivot_compare"] = LONG
ORACLES["compare_distributions"] = f"""
WITH long AS ({LONG}), both_sets AS (SELECT * FROM long UNION ALL SELECT value, descriptor, 'all' FROM long)
SELECT descriptor, data, count(*) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
  min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 4) AS p25,
  round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75
FROM both_sets GROUP BY descriptor, data"""
ORACLES["build_vocab"] = f"""
WITH seen AS (SELECT DISTINCT unnest({atoms_of('text', TWO_LETTER_ATOMS_EXTENDED)}) AS token FROM documents)
SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM seen UNION ALL
SELECT unnest({sql_list(SPECIALS)}), (SELECT count(*) FROM seen) + unnest([0, 1, 2, 3])"""
ORACLES["property_matrix"] = """
SELECT p_partkey AS ID, p_name AS SMILES, p_size::DECIMAL(18,2)::VARCHAR || ',' || p_retailprice::DECIMAL(18,2)::VARCHAR AS properties,
  2::BIGINT AS property_num FROM part"""
ORACLES["classification_report"] = """
WITH c AS (SELECT label, count(*) FILTER (quality = label AND toxic = label)::DOUBLE AS tp,
  count(*) FILTER (quality <> label AND toxic = label) AS fp, count(*) FILTER (quality = label AND toxic <> label) AS fn,
  count(*) FILTER (quality <> label AND toxic <> label)::DOUBLE AS tn FROM labels CROSS JOIN (SELECT unnest([0, 1])::INT AS label)
  GROUP BY label)
SELECT label, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(tn / (tn + fp), 6) AS specificity, round(sqrt(tp / (tp + fn) * tn / (tn + fp)), 6) AS geo_mean,
  (tp + fn)::BIGINT AS support FROM c"""

ENTROPY_COLUMNS = {
    "flag": "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END", "status": "CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END",
    "quantity": "floor(l_quantity / 10)::BIGINT", "discount": "round(l_discount * 100)::INT", "tax": "round(l_tax * 100)::INT",
    "year": "year(l_shipdate)", "line": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END"}


def _entropy(target: str, variable: str, t_no: int, u_no: int) -> str:
    t, u = ENTROPY_COLUMNS[target], ENTROPY_COLUMNS[variable]
    return f"""SELECT {t_no} AS t_no, '{target}' AS target, {u_no} AS u_no, '{variable}' AS variable,
-sum(n * ln(n / s)) / sum(n) AS score FROM (SELECT n, sum(n) OVER (PARTITION BY u) AS s FROM
(SELECT {t} AS t, {u} AS u, count(*)::DOUBLE AS n FROM lineitem WHERE {u} IS NOT NULL GROUP BY 1, 2))"""


ENTROPY = " UNION ALL ".join(
    _entropy(t, u, i, j) for i, t in enumerate(("flag", "status"))
    for j, u in enumerate(("quantity", "discount", "tax", "year", "line")))
ORACLES["conditional_entropy"] = f"SELECT target, variable, round(score, 9) AS score FROM ({ENTROPY})"
ORACLES["entropy_order"] = f"""
WITH s AS ({ENTROPY}),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY u_no ORDER BY score, t_no) = 1),
r AS (SELECT target, variable AS member, row_number() OVER (PARTITION BY t_no ORDER BY score, u_no) AS r FROM best)
SELECT target, member, CASE WHEN r % 2 = 1 THEN (r + 1) // 2 ELSE -(r // 2) END AS position FROM r
UNION ALL SELECT DISTINCT target, target, 0 FROM s"""
ORACLES["cell_purity"] = """
WITH v AS (SELECT vec_id, floor(embedding[1] * 20)::BIGINT AS cell, label % 2 AS label FROM embeddings),
p AS (SELECT cell, avg((label = 1)::INT) AS score FROM v GROUP BY cell)
SELECT vec_id, cell, round(coalesce(score, 0), 6) AS score FROM v LEFT JOIN p USING (cell)"""
ORACLES["metric_means"] = "SELECT event_type AS metric, round(avg(value), 6) AS mean FROM events GROUP BY 1"

# --- order and ranks --------------------------------------------------------

ORACLES["global_index"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx FROM lineitem"""
ORACLES["rank_scored"] = """
SELECT p_partkey, p_size, p_retailprice, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rank FROM part"""
SCORED = "d AS (SELECT doc_id, n_chars, quality, toxic FROM labels JOIN documents USING (doc_id))"


def _auc(mode: str, direction: str) -> str:
    return f"""SELECT '{mode}' AS mode, round(1.0 - sum(rank - seen) / (count(*) * (any_value(total) - count(*))), 6) AS auc_roc,
round(avg(seen / rank), 6) AS auc_prc, any_value(total) AS n, count(*) AS n_active FROM (
SELECT rank, row_number() OVER (ORDER BY rank) AS seen, total FROM (
SELECT quality, row_number() OVER (ORDER BY n_chars {direction}, doc_id) AS rank, count(*) OVER () AS total FROM d) WHERE quality = 1)"""


ORACLES["ranking_auc"] = f"WITH {SCORED} {_auc('F', 'DESC')} UNION ALL {_auc('T', 'ASC')}"
ORACLES["enrichment_factor"] = f"""
WITH {SCORED}, r AS (SELECT toxic, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER () AS n FROM d),
x AS (SELECT unnest([0.01, 0.05, 0.1, 0.15])::DOUBLE AS fraction),
c AS (SELECT fraction, round_even(any_value(n) * fraction, 0)::BIGINT AS top, any_value(n) AS n, sum(toxic) AS p FROM r CROSS JOIN x GROUP BY 1)
SELECT fraction, top, (SELECT count(*) FROM r WHERE rank <= top AND toxic = 1) AS hits,
  round((SELECT count(*) FROM r WHERE rank <= top AND toxic = 1) / top * (n / p), 6) AS ef FROM c"""
ORACLES["roc_curve"] = f"""
WITH {SCORED}, g AS (SELECT n_chars, sum(quality) AS p, sum(1 - quality) AS q FROM d GROUP BY 1)
SELECT round(sum(q) OVER o / (SELECT sum(q) FROM g), 6) AS fpr, round(sum(p) OVER o / (SELECT sum(p) FROM g), 6) AS tpr,
  n_chars::DOUBLE AS threshold FROM g WINDOW o AS (ORDER BY n_chars DESC)
UNION ALL SELECT 0, 0, NULL"""
ORACLES["missing_mask"] = """
SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, (quality IS NULL)::INT AS quality_missing,
  (toxic IS NULL)::INT AS toxic_missing FROM documents LEFT JOIN labels USING (doc_id)"""
ORACLES["rolling_mean"] = """
SELECT event_id, event_type, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
  ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS rolling_mean FROM events"""
ORACLES["centered_reward"] = """
SELECT event_id, user_id, value, round(value - avg(value) OVER (PARTITION BY user_id), 9) AS centered FROM events"""
ORACLES["mean_reward"] = "SELECT user_id, round_even(avg(value), 4) AS mean_reward FROM events GROUP BY 1"
ORACLES["top_n"] = "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100"

# --- sampling, mixing, balance ----------------------------------------------

MIX = f"""
src AS (SELECT * FROM (VALUES ('en', 0.5::DOUBLE, 0), ('fr', 0.3, 1), ('de', 0.1, 2), ('es', 0.1, 3)) t(lang, p, no)),
sizes AS (SELECT lang, p, no, count(*) AS n FROM src JOIN documents USING (lang) GROUP BY ALL),
total AS (SELECT sum(p) AS total, max(floor(n / p)::BIGINT) AS len FROM sizes),
cum AS (SELECT lang, n, no, sum(p) OVER (ORDER BY no) / total AS hi, coalesce(sum(p) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total AS lo,
  no = (SELECT max(no) FROM sizes) AS last FROM sizes CROSS JOIN total),
draws AS (SELECT draw, {md5_int(seeded(11, 'draw'))} / 268435456.0::DOUBLE AS u FROM (SELECT unnest(range((SELECT len FROM total))) AS draw)),
picked AS (SELECT draw, lang, draw % n AS row FROM draws JOIN cum ON u >= lo AND (u < hi OR last))"""
ORACLES["mix_sources"] = f"""WITH {MIX},
idx AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row FROM documents)
SELECT draw, lang, doc_id, n_chars FROM picked JOIN idx USING (lang, row)"""
ORACLES["mix_quota"] = f"""WITH {MIX}
SELECT lang, n AS n_rows, p AS ratio, (SELECT len FROM total) AS epoch_length,
  (SELECT count(*) FROM picked WHERE picked.lang = sizes.lang) AS n_drawn FROM sizes"""
ORACLES["make_batches"] = f"""
SELECT doc_id, lang, i // 64 AS batch FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {seeded(3, 'doc_id')}, doc_id) - 1 AS i FROM documents)
WHERE i < (SELECT count(*) FROM documents) // 64 * 64"""
ORACLES["sample_exact"] = f"""
SELECT o_orderkey, o_custkey FROM orders ORDER BY {seeded(2, 'o_orderkey')}, o_orderkey LIMIT 1234"""
ORACLES["balanced_training_set"] = f"""WITH {DOC_GRAMS},
a AS (SELECT doc_id FROM labels WHERE quality = 0),
pool AS (SELECT doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1)
  WHERE doc_id NOT IN (SELECT doc_id FROM a) GROUP BY doc_id HAVING count(*) = 1),
sampled AS (SELECT doc_id FROM pool ORDER BY {seeded(4, 'doc_id')}, doc_id LIMIT (SELECT count(*) * 2 FROM a)),
act AS (SELECT list_sort(g) AS g FROM s JOIN a USING (doc_id) WHERE len(g) > 0),
clean AS (SELECT doc_id FROM sampled JOIN s USING (doc_id) WHERE len(g) = 0 OR list_sort(g) NOT IN (SELECT g FROM act)),
cut AS (SELECT doc_id FROM clean ORDER BY {seeded(4, 'doc_id')}, doc_id LIMIT (SELECT count(*) FROM a))
SELECT doc_id, lang, 1::INT AS LABEL FROM a JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, lang, 0 FROM cut JOIN documents USING (doc_id)"""
BY_CLASS = f"""r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {seeded(1, 'doc_id')}, doc_id) - 1 AS r,
  count(*) OVER (PARTITION BY quality) AS n FROM labels), m AS (SELECT max(n) AS hi, min(n) AS lo FROM r)"""
ORACLES["oversample"] = f"""WITH {BY_CLASS}
SELECT doc_id, quality, toxic, unnest(range(hi // n + (r < hi % n)::INT)) AS copy FROM r CROSS JOIN m"""
ORACLES["undersample"] = f"WITH {BY_CLASS} SELECT doc_id, quality, toxic FROM r CROSS JOIN m WHERE r < lo"
ORACLES["stratified_folds"] = f"WITH {BY_CLASS} SELECT doc_id, quality, toxic, (r % 5)::INT AS fold FROM r"
ORACLES["train_test_split"] = f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {seeded(1, 'doc_id')}, doc_id) - 1 < ceil(0.2::DOUBLE * (SELECT count(*) FROM labels))
  THEN 'test' ELSE 'train' END AS part FROM labels"""


def _nearmiss(direction: str) -> str:
    return f"""WITH {VECTORS},
k AS (SELECT a.id, {_NEAR} AS d FROM v a JOIN v b ON a.y = 0 AND b.y = 1
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_NEAR} {direction}, b.id) <= 3),
m AS (SELECT id, round_even(avg(d), 6) AS d FROM k GROUP BY id)
SELECT id, y FROM v WHERE y = 1 UNION ALL
SELECT id, 0 FROM (SELECT id FROM m ORDER BY d, id LIMIT (SELECT count(*) FROM v WHERE y = 1))"""


ORACLES["nearmiss1"] = _nearmiss("ASC")
ORACLES["nearmiss2"] = _nearmiss("DESC")
ORACLES["enn"] = f"""WITH {VECTORS},
k AS (SELECT a.id, a.y AS own, b.y AS other FROM v a JOIN v b ON a.id <> b.id AND a.y = 0
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_NEAR}, b.id) <= 3)
SELECT id, y FROM v WHERE id NOT IN (SELECT id FROM k WHERE own <> other)"""
ORACLES["smote"] = f"""WITH {VECTORS}, few AS (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS r FROM v WHERE y = 1),
c AS (SELECT (SELECT count(*) FROM v WHERE y = 0) - (SELECT count(*) FROM few) AS need, (SELECT count(*) FROM few) AS n),
base AS (SELECT id, vec, unnest(range(1, need // n + (r < need % n)::INT + 1)) AS copy FROM few CROSS JOIN c),
near AS (SELECT a.id, b.id AS neighbor, b.vec AS other, row_number() OVER (PARTITION BY a.id ORDER BY {_NEAR}, b.id) AS rank
  FROM few a JOIN few b ON a.id <> b.id QUALIFY rank <= 5),
drawn AS (SELECT *, {md5_int(seeded(6, 'id', 'copy'))} % 5 + 1 AS rank, {md5_int(seeded(7, 'id', 'copy'))} / 268435456.0::DOUBLE AS u FROM base)
SELECT id AS base_id, copy::INT AS copy, neighbor, round(u, 6) AS weight, round(vec[1] + u * (other[1] - vec[1]), 6) AS v0,
  round(vec[64] + u * (other[64] - vec[64]), 6) AS v63, 1::INT AS y FROM drawn JOIN near USING (id, rank)"""

# --- models, streams, functions ---------------------------------------------

ORACLES["standardize"] = """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity_std,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice_std
FROM lineitem"""
ORACLES["stream_curate"] = f"""WITH {VALIDITY},
norm AS (SELECT ID, {_normal('SMILES', "'.'")} AS SMILES FROM v WHERE invalid_reason IS NULL)
SELECT ID, SMILES FROM norm WHERE SMILES IS NOT NULL
  AND len(list_filter({atoms_of('SMILES')}, lambda y: NOT list_contains({KNOWN_TOKENS}, y))) = 0"""
ORACLES["stream_distinct"] = "SELECT DISTINCT user_id, event_type FROM events"
ORACLES["stream_metric_windows"] = """
SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(day + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
  event_type AS metric, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT *, date_trunc('day', ts) AS day FROM events)
GROUP BY day, event_type HAVING day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"""
ORACLES["stream_sliding_windows"] = """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
  event_type AS metric, round(avg(value), 6) AS mean, count(*) AS n
FROM (SELECT event_type, value, time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR AS s FROM events, range(2) AS r(k))
GROUP BY s, event_type HAVING s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"""
ORACLES["stream_session_windows"] = """
WITH e AS (SELECT event_type, value, ts, CASE event_type WHEN 'view' THEN INTERVAL 10 MINUTE WHEN 'click' THEN INTERVAL 20 MINUTE
    WHEN 'purchase' THEN INTERVAL 45 MINUTE ELSE INTERVAL 30 MINUTE END AS gap FROM events),
m AS (SELECT *, ts > lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + gap AS fresh FROM e),
s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY event_type ORDER BY ts) AS session FROM m)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(max(ts + gap), '%Y-%m-%d %H:%M:%S.%f') AS window_end,
  event_type AS metric, round(avg(value), 6) AS mean, count(*) AS n
FROM s GROUP BY event_type, session HAVING max(ts + gap) <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"""
ORACLES["stream_until_n"] = """
WITH v AS (SELECT doc_id, md5(text) AS key FROM documents WHERE n_chars >= 500 AND text IS NOT NULL),
f AS (SELECT key, min((doc_id % 8, doc_id)) AS place FROM v GROUP BY key)
SELECT place[2] AS doc_id, key FROM f ORDER BY place LIMIT 400"""
ORACLES["stream_file_by_file"] = """
SELECT l_orderkey, l_linenumber, count(*) AS n, sum(l_quantity) AS quantity, true AS went_on FROM lineitem
GROUP BY l_orderkey, l_linenumber"""
ORACLES["map_partitions"] = """
SELECT p_partkey, p_size, p_retailprice, round_even(p_retailprice * 2.0 / p_size, 6)::DOUBLE AS ratio FROM part"""
ORACLES["udf_score"] = """
SELECT p_partkey, p_type, CASE p_type WHEN 'ECONOMY' THEN 1.0 WHEN 'PROMO' THEN 2.0 WHEN 'SMALL' THEN 3.0 ELSE -1.0 END::DOUBLE AS score
FROM part"""
ORACLES["train_per_group"] = """
SELECT p_type, count(*) AS n, round(regr_slope(p_retailprice, p_size), 6) AS slope FROM part GROUP BY p_type"""

# --- what holds for results that SQL cannot compute --------------------------

ORACLES["sketch_percentiles"] = """
SELECT descriptor, p::DOUBLE AS p, true AS within FROM (VALUES ('l_quantity'), ('l_extendedprice')) AS d(descriptor), (VALUES (0.05), (0.5), (0.95)) AS q(p)"""
ORACLES["sketch_distinct"] = """
SELECT 'user_id' AS column, count(DISTINCT user_id) AS exact, true AS within FROM events
UNION ALL SELECT 'value', count(DISTINCT value), true FROM events"""
ORACLES["som_errors"] = "SELECT unnest(range(2, 10)) AS round, true AS falls"
ORACLES["oof_check"] = """
SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, sum(quality)::BIGINT AS n_positive, true AS probabilities, 3::BIGINT AS folds
FROM documents JOIN labels USING (doc_id)"""
ORACLES["rank_check"] = """
SELECT count(*) AS n, count(*) AS n_ids, count(*) AS n_ranks, 1::BIGINT AS first, count(*) AS last, 0::BIGINT AS rises FROM documents"""
ORACLES["gmm_check"] = """
SELECT c AS column, 10::BIGINT AS components, 1.0::DOUBLE AS weights, (SELECT count(*) FROM lineitem) AS n_given
FROM (VALUES ('l_extendedprice'), ('l_quantity')) AS t(c)"""
ORACLES["embed_2d_check"] = """
SELECT count(*) AS n, true AS centred_x, true AS centred_y, true AS uncorrelated, true AS in_order FROM embeddings"""
ORACLES["embed_graph_check"] = "SELECT count(*) AS n, true AS degrees, true AS orthogonal, true AS unit FROM embeddings"
