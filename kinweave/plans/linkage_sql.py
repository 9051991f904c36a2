"""DuckDB SQL that states the rows of the record-linkage queries."""

from __future__ import annotations

from kinweave.functions import constants as k


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _case(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {x} END"


def _fold(x: str) -> str:
    return f"replace(replace(strip_accents(lower({x})), '&', ' and '), '+', ' and ')"


_TOKENS = "regexp_extract_all({}, '[a-z0-9]+')"


def _core(x: str) -> str:
    """Sorted core words, null for trading and domain names and for names without core words."""
    s = f"strip_accents(lower({x}))"
    words = f"list_filter(regexp_extract_all(replace({s}, '&', ' '), '[a-z0-9]+'), lambda w: w NOT IN {_list(k.CORE_LEGAL + k.CORE_STOP)})"
    words = f"list_sort(list_transform({words}, lambda w: {_case('w', k.CORE_WORDS)}))"
    trade = f"regexp_matches({s}, '\\b(dba|trading as|t/a|aka)\\b') OR regexp_matches({s}, '\\.(com|fr|net|org|in|co)\\b')"
    return f"CASE WHEN {trade} OR len({words}) = 0 THEN NULL ELSE {words} END"


_DOCS = """rec AS (
  SELECT doc_id, 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, doc_id % 3 + 1 AS src,
         array_to_string(string_split(text, ' ')[1:5], ' ') AS name, array_to_string(string_split(text, ' ')[6:], ' ') AS address,
         lang AS country, md5(text) AS content
  FROM documents
)"""
_PARTS = """rec AS (
  SELECT p_partkey AS doc_id, 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id, p_partkey % 3 + 1 AS src, p_name AS name,
         CAST(p_size AS VARCHAR) AS num, lower(replace(p_brand, '#', '')) AS street,
         p_size || ' ' || lower(replace(p_brand, '#', '')) || ' street' AS address, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'size' ELSE 'line' END AS country,
         list_sort(string_split(p_name, ' ')) AS key, string_split(p_name, ' ') AS words
  FROM part
)"""
_TRUTH = """truth AS (
  SELECT 'S1-' || o.q AS q_id, p.entity_id AS p_id
  FROM rec p JOIN (SELECT country, content, min(doc_id) AS q FROM rec WHERE src = 1 GROUP BY 1, 2) o USING (country, content)
  WHERE p.src > 1
)"""
_PAIRS = """pairs AS (
  SELECT l_orderkey AS q, l_partkey AS p, max((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 1000 / 1000) AS s
  FROM lineitem GROUP BY 1, 2
)"""
_LINE_TRUTH = "truth AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS p FROM lineitem WHERE l_quantity >= 25)"
_RANKED = """ranked AS (
  SELECT q, p, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) - 1 AS rank, max(s) OVER (PARTITION BY q) AS p1 FROM pairs
)"""


def _tfidf(name: str, terms: str, k_best: int) -> str:
    """CTEs that end in ``name``: (q_id, p_id, score, rank)."""
    return f"""
{name}_term AS (SELECT DISTINCT entity_id AS id, src, country, unnest({terms}) AS term FROM rec),
{name}_df AS (
  SELECT country, term, count(*) AS df, ln(n / count(*)) AS idf
  FROM {name}_term JOIN (SELECT country, count(*) AS n FROM rec WHERE src > 1 GROUP BY 1) USING (country)
  WHERE src > 1 GROUP BY country, term, n HAVING count(*) <= greatest(50, floor(n * 0.0005))
),
{name}_w AS (
  SELECT id, src, country, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY id)) AS w
  FROM {name}_term JOIN {name}_df USING (country, term) QUALIFY sum(idf * idf) OVER (PARTITION BY id) > 0
),
{name}_s AS (
  SELECT a.id AS q_id, b.id AS p_id, round(sum(a.w * b.w), 6) AS score
  FROM {name}_w a JOIN {name}_w b ON a.country = b.country AND a.term = b.term AND a.src = 1 AND b.src > 1 GROUP BY 1, 2
),
{name} AS (
  SELECT * FROM (SELECT q_id, p_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, p_id) - 1 AS rank FROM {name}_s) WHERE rank < {k_best}
)"""


_ADDR = (
    "list_filter(list_transform(list_transform(" + _TOKENS.format(_fold("address"))
    + f", lambda x: {_case('x', {n: k.ADDRESS_WORDS.get(c, c) for n, c in k.STATES.items() if ' ' not in n} | k.ADDRESS_WORDS)})"
    + ", lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END ELSE x END)"
    + f", lambda x: x NOT IN {_list(k.LANDMARKS)})"
)
_NAME = _TOKENS.format(_fold("name"))
_STRIPPED = f"list_filter({_NAME}, lambda x: x NOT IN {_list(k.LEGAL_SUFFIXES)})"
_NAME_TOKENS = f"CASE WHEN len({_STRIPPED}) > 0 THEN {_STRIPPED} ELSE {_NAME} END"
_SQUEEZED = f"regexp_replace({_fold('name')}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_GRAMS = f"list_transform(range(1, length({_SQUEEZED}) - 2), lambda i: 'g:' || substring({_SQUEEZED}, i, 4))"
_TERMS = (
    f"list_concat(list_concat(list_transform({_NAME_TOKENS}, lambda x: 'n:' || x), list_transform({_ADDR}, lambda x: 'a:' || x)),"
    f" list_concat(list_transform(list_filter({_ADDR}, lambda x: regexp_matches(x, '^[0-9]+$')), lambda x: 'd:' || x), {_GRAMS}))"
)
_NAME_PAIRS = """names AS (SELECT DISTINCT p_name AS name FROM part),
words AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS word FROM names),
pairs AS (SELECT DISTINCT x.name AS a, y.name AS b FROM words x JOIN words y ON x.word = y.word AND x.name < y.name)"""
_CHAR3 = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3)))"
_JACCARD = "round(len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))), 6)"
_DENSE = """score AS (
  SELECT q.vec_id AS q_id, p.vec_id AS p_id,
         round(list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v))), 6) AS score
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) q JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) p
    ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id
), top AS (
  SELECT * FROM (SELECT q_id, p_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, p_id) - 1 AS rank FROM score) WHERE rank < 10
)"""
#: "brandN" and "brandM" as streets: the longest common subsequence of one or two digits
_DIGITS_SHARED = "CASE WHEN a.street = b.street THEN length(a.street) - 5 WHEN len(list_intersect(string_split(a.street[6:], ''), string_split(b.street[6:], ''))) > 0 THEN 1 ELSE 0 END"
_STREET = f"2.0 * (5 + {_DIGITS_SHARED}) / (length(a.street) + length(b.street)) >= 0.85"
_F05 = """CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN n_hit > 0
 THEN 1.25 * (n_hit / n_pred) * (n_hit / n_true) / (0.25 * (n_hit / n_pred) + n_hit / n_true) ELSE 0.0 END"""


def _unique(join: str, kind: str, extra: str = "") -> str:
    return f"WITH {_PARTS}{extra}, hit AS ({join}) SELECT min(q_id) AS q_id, p_id, '{kind}' AS kind FROM hit GROUP BY p_id HAVING count(*) = 1"


_AT = f"SELECT a.entity_id AS q_id, b.entity_id AS p_id FROM rec a JOIN rec b ON a.src = 1 AND b.src > 1 AND a.country = b.country AND a.num = b.num AND {_STREET}"
_MATCHES = """m AS (
  SELECT a.entity_id AS q_id, b.entity_id AS p_id, row_number() OVER (PARTITION BY a.entity_id ORDER BY b.entity_id) - 1 AS rank
  FROM rec a JOIN rec b ON a.src = 1 AND b.src > 1 AND a.address = b.address AND a.country = b.country
)"""
_SOLE = f"WITH {_PARTS}, hit AS ({_AT}), sole AS (SELECT min(q_id) AS q_id, p_id FROM hit GROUP BY p_id HAVING count(*) = 1)"
_VALUE = "macro_f05"


def _grid_sql(gates: str, extras: str, same: bool) -> str:
    """The metric over a grid, by brute force."""
    keep = "(r.rank = 0 OR r.s >= g.extra) AND r.p1 >= g.gate"
    return f"""WITH {_PAIRS}, {_LINE_TRUTH}, {_RANKED},
y AS (SELECT r.*, t.q IS NOT NULL AS hit FROM ranked r LEFT JOIN truth t ON r.q = t.q AND r.p = t.p),
n AS (SELECT o_orderkey AS q, coalesce(n_true, 0) AS n_true FROM orders LEFT JOIN (SELECT q, count(*) AS n_true FROM truth GROUP BY 1) ON q = o_orderkey),
g AS (SELECT gate, extra FROM {gates} CROSS JOIN {extras} {'WHERE gate = extra' if same else ''}),
k AS (SELECT g.gate, g.extra, r.q, count(*) AS n_pred, count(*) FILTER (WHERE hit) AS n_hit FROM y r JOIN g ON {keep} GROUP BY 1, 2, 3),
f AS (SELECT g.gate, g.extra, n.n_true, coalesce(k.n_pred, 0) AS n_pred, coalesce(k.n_hit, 0) AS n_hit
      FROM g CROSS JOIN n LEFT JOIN k ON k.q = n.q AND k.gate = g.gate AND k.extra = g.extra)
SELECT {'gate AS threshold' if same else 'gate, extra'}, round(avg({_F05}), 6) AS macro_f05 FROM f GROUP BY {'gate' if same else 'gate, extra'}"""


SQL: dict[str, str] = {
    "text_fold_ascii": f"SELECT doc_id, {_fold('text')} AS folded FROM documents",
    "text_tokens": f"WITH {_DOCS} SELECT doc_id, array_to_string({_NAME_TOKENS}, ' ') AS norm_name, len({_NAME_TOKENS}) AS n_tokens FROM rec",
    "text_char3": f"WITH {_DOCS} SELECT doc_id, len({_CHAR3.format(_fold('name'))}) AS n_char3 FROM rec",
    "core_keys": f"WITH {_DOCS} SELECT doc_id, array_to_string({_core('name')}, ' ') AS core_key FROM rec",
    "packed_ids": "SELECT doc_id, doc_id + CASE WHEN doc_id % 3 = 2 THEN 10000000000 ELSE 0 END AS packed FROM documents",
    "street_parse": f"WITH {_PARTS} SELECT doc_id, num, street, address AS norm_addr FROM rec",
    "ground_truth": f"WITH {_DOCS}, {_TRUTH} SELECT q_id, p_id FROM truth",
    "match_lists": f"""WITH {_DOCS}, c AS (SELECT *, {_core('name')} AS key FROM rec),
o AS (SELECT country, key, min(entity_id) AS q_id FROM c WHERE src = 1 AND key IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
f AS (SELECT q_id, entity_id AS p_id FROM c JOIN o USING (country, key) WHERE src > 1)
SELECT r.entity_id AS q_id, coalesce(string_agg(f.p_id, ',' ORDER BY f.p_id), '') AS matched_entity_ids
FROM rec r LEFT JOIN f ON f.q_id = r.entity_id WHERE r.src = 1 GROUP BY 1""",
    "country_counts": "SELECT lang AS country, count(*) AS n FROM documents GROUP BY 1",
    "term_df_idf": f"WITH {_DOCS}, {_tfidf('x', _TERMS, 10)} SELECT country, term, df, round(idf, 6) AS idf FROM x_df",
    "tfidf_topk": f"WITH {_DOCS}, {_tfidf('x', _TERMS, 10)} SELECT * FROM x",
    "dense_topk": f"WITH {_DENSE} SELECT * FROM top",
    "neighbour_labels": f"""WITH {_DENSE}, f AS (
  SELECT q.vec_id, min(t.rank) FILTER (WHERE p.label = q.label) AS first FROM embeddings q LEFT JOIN top t ON t.q_id = q.vec_id LEFT JOIN embeddings p ON p.vec_id = t.p_id
  WHERE q.vec_id % 20 = 0 GROUP BY 1)
SELECT k, round(avg(CASE WHEN first < k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM f CROSS JOIN (VALUES (1), (5), (10)) v(k) GROUP BY k""",
    "levenshtein_pairs": f"WITH {_NAME_PAIRS} SELECT a, b, levenshtein(a, b) AS distance FROM pairs",
    "jaccard_pairs": f"""WITH {_NAME_PAIRS} SELECT a, b, {_JACCARD.format("string_split(a, ' ')", "string_split(b, ' ')")} AS words,
 {_JACCARD.format(_CHAR3.format('a'), _CHAR3.format('b'))} AS char3 FROM pairs""",
    "jaro_winkler_pairs": f"WITH {_NAME_PAIRS} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS similarity FROM pairs",
    "rank_gap": f"WITH {_PAIRS}, {_RANKED} SELECT q, p, s, rank, round(p1 - s, 6) AS gap, count(*) OVER (PARTITION BY q) AS n_cands FROM ranked",
    "rank_gap_ties": f"""WITH pairs AS (SELECT l_orderkey AS q, l_partkey AS p, max(l_discount * 10) AS s FROM lineitem GROUP BY 1, 2), {_RANKED}
SELECT q, p, round(s, 6) AS s, rank, round(p1 - s, 6) AS gap, count(*) OVER (PARTITION BY q) AS n_cands FROM ranked""",
    "contention_features": f"""WITH {_PAIRS}, {_RANKED}, c AS (SELECT q, p, s FROM ranked WHERE rank < 8)
SELECT q, p, s, row_number() OVER w - 1 AS rank, count(*) OVER a AS nclaim,
 round(s - CASE WHEN row_number() OVER w = 1 THEN coalesce(nth_value(s, 2) OVER a, -1) ELSE first_value(s) OVER a END, 6) AS gap,
 round(s - coalesce(lead(s) OVER w, 0), 6) AS gap_next
FROM c WINDOW w AS (PARTITION BY p ORDER BY s DESC, q), a AS (PARTITION BY p ORDER BY s DESC, q ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "contention_lookup": f"""WITH {_PAIRS}, {_RANKED}, c AS (SELECT q, p, s FROM ranked WHERE rank < 2), t AS (
SELECT q, p, CAST(row_number() OVER w - 1 AS DOUBLE) AS c_rank, CAST(count(*) OVER a AS DOUBLE) AS c_nclaim,
 s - CASE WHEN row_number() OVER w = 1 THEN coalesce(nth_value(s, 2) OVER a, -1) ELSE first_value(s) OVER a END AS c_gap, s - coalesce(lead(s) OVER w, 0) AS c_gap_next
FROM c WINDOW w AS (PARTITION BY p ORDER BY s DESC, q), a AS (PARTITION BY p ORDER BY s DESC, q ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT q, p, s, coalesce(c_nclaim, 0) AS c_nclaim, coalesce(c_rank, 0) AS c_rank, round(coalesce(c_gap, 0), 6) AS c_gap, round(coalesce(c_gap_next, 0), 6) AS c_gap_next
FROM pairs LEFT JOIN t USING (q, p)""",
    "ce_style_features": f"""WITH {_PAIRS}, l AS (SELECT q, p, round(s * 10 - 5, 2) AS s FROM pairs)
SELECT q, p, round(s, 6) AS s, row_number() OVER a - 1 AS ce_rank, round(first_value(s) OVER a - s, 6) AS ce_gap_best,
 round(s - CASE WHEN row_number() OVER a = 1 THEN coalesce(nth_value(s, 2) OVER a, -12) ELSE first_value(s) OVER a END, 6) AS ce_margin, round(avg(s) OVER a, 6) + 0.0 AS ce_mean_q
FROM l WINDOW a AS (PARTITION BY q ORDER BY s DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "stage2_context": f"""WITH {_PAIRS}
SELECT q, p, s, row_number() OVER a - 1 AS s2_rank, first_value(s) OVER a AS s2_p1, round(first_value(s) OVER a - s, 6) AS s2_gap1, coalesce(nth_value(s, 2) OVER a, 0) AS s2_p2,
 CAST(count(*) FILTER (WHERE s >= 0.5) OVER a AS BIGINT) AS s2_nconf, round(sum(s) OVER a, 6) AS s2_sump
FROM pairs WINDOW a AS (PARTITION BY q ORDER BY s DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "gate_extra": f"WITH {_PAIRS}, {_RANKED} SELECT q, p, s, rank FROM ranked WHERE p1 >= 0.8 AND (rank = 0 OR s >= 0.5)",
    "one_owner": f"WITH {_PAIRS} SELECT p, q, s FROM pairs QUALIFY row_number() OVER (PARTITION BY p ORDER BY s DESC, q) = 1",
    "gate_then_owner": f"""WITH {_PAIRS}, {_RANKED}, g AS (SELECT q, p, s, rank FROM ranked WHERE p1 >= 0.8 AND (rank = 0 OR s >= 0.5))
SELECT p, q, s, rank FROM g QUALIFY row_number() OVER (PARTITION BY p ORDER BY s DESC, q) = 1""",
    "macro_f05": f"""WITH {_PAIRS}, {_LINE_TRUTH}, {_RANKED}, g AS (SELECT q, p FROM ranked WHERE p1 >= 0.6 AND (rank = 0 OR s >= 0.4)),
h AS (SELECT g.q, count(*) AS n_pred, count(t.q) AS n_hit FROM g LEFT JOIN truth t ON g.q = t.q AND g.p = t.p GROUP BY 1),
n AS (SELECT q, count(*) AS n_true FROM truth GROUP BY 1),
f AS (SELECT coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(n_hit, 0) AS n_hit FROM orders LEFT JOIN h ON h.q = o_orderkey LEFT JOIN n ON n.q = o_orderkey)
SELECT round(avg({_F05}), 6) AS macro_f05, count(*) AS n_queries FROM f""",
    "threshold_tuner": _grid_sql("(SELECT i / 1000 AS gate FROM range(50, 951, 10) r(i))", "(SELECT i / 1000 AS extra FROM range(50, 951, 10) r(i))", True),
    "gate_extra_tuner": _grid_sql("(SELECT i / 1000 AS gate FROM range(50, 951, 25) r(i))", "(SELECT i / 1000 AS extra FROM range(50, 951, 25) r(i))", False),
    "target_rate": f"""WITH {_PAIRS}, t AS (SELECT i / 1000 AS threshold FROM range(300, 995, 5) r(i)),
k AS (SELECT threshold, count(*) * 0.995 / (SELECT count(*) FROM orders) AS rate FROM pairs JOIN t ON s >= threshold GROUP BY 1)
SELECT threshold, round(rate, 6) AS rate FROM k ORDER BY round(abs(rate - 1.5), 9), threshold LIMIT 1""",
    "name_frequency": "SELECT p_name AS name_key, count(*) AS n, round(ln(1 + count(*)), 6) AS log_n FROM part GROUP BY 1",
    "vocab_df30": f"WITH {_PARTS}, w AS (SELECT DISTINCT country, entity_id, unnest(key) AS word FROM rec WHERE src = 1) SELECT country, word, count(*) AS n FROM w WHERE length(word) > 2 GROUP BY 1, 2 HAVING count(*) >= 30",
    "exact_core_unique": f"""WITH {_PARTS}, hit AS (
  SELECT a.entity_id AS q_id, b.entity_id AS p_id, CASE WHEN b.doc_id % 7 = 0 THEN 'empty' ELSE 'addr' END AS kind
  FROM rec a JOIN rec b ON a.src = 1 AND b.src > 1 AND a.country = b.country AND a.key = b.key AND (b.doc_id % 7 = 0 OR (a.num = b.num AND {_STREET})))
SELECT min(q_id) AS q_id, p_id, min(kind) AS kind FROM hit GROUP BY p_id HAVING count(*) = 1""",
    "number_missing": _unique(f"SELECT a.entity_id AS q_id, b.entity_id AS p_id FROM rec a JOIN rec b ON a.src = 1 AND b.src > 1 AND a.country = b.country AND a.key = b.key AND a.doc_id % 50 = b.doc_id % 50 AND {_STREET}", "nonum"),
    "typo_tolerant": _unique(_AT + " AND a.key = b.key", "typo"),
    "words_dropped": _unique(_AT + " AND list_contains(a.words, b.words[2])", "del"),
    "words_added": _unique(_AT + " AND a.key = b.key", "add"),
    "domain": f"{_SOLE} SELECT q_id, p_id, 'domain' AS kind FROM sole JOIN rec a ON a.entity_id = q_id JOIN rec b ON b.entity_id = p_id WHERE contains(replace(b.name, ' ', '') || '.com', replace(a.name, ' ', ''))",
    "acronym": f"{_SOLE} SELECT q_id, p_id, 'acro' AS kind FROM sole JOIN rec a ON a.entity_id = q_id JOIN rec b ON b.entity_id = p_id WHERE a.words[1][1] || a.words[2][1] = b.words[1][1] || b.words[2][1]",
    "pseudo_name": f"{_SOLE} SELECT q_id, p_id, 'pseudo' AS kind FROM sole JOIN rec b ON b.entity_id = p_id WHERE b.doc_id % 2 = 0",
    "any_relation": f"{_SOLE} SELECT q_id, p_id, 'any' AS kind FROM sole JOIN rec a ON a.entity_id = q_id JOIN rec b ON b.entity_id = p_id WHERE len(list_intersect(a.words, b.words)) = 0",
    "descriptor_swap": f"""WITH {_PARTS}, {_MATCHES}, w AS (SELECT DISTINCT country, entity_id, unnest(key) AS word FROM rec WHERE src = 1),
v AS (SELECT country, list(word) AS vocab FROM (SELECT country, word FROM w WHERE length(word) > 2 GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY 1)
SELECT m.q_id, m.p_id, m.rank FROM m JOIN rec a ON a.entity_id = q_id JOIN rec b ON b.entity_id = p_id LEFT JOIN v ON v.country = a.country
WHERE NOT (rank > 0 AND len(list_filter(b.words, lambda x: NOT list_contains(a.words, x))) > 0 AND len(list_filter(a.words, lambda x: NOT list_contains(b.words, x))) > 0
 AND len(list_intersect(a.words, b.words)) > 0
 AND len(list_filter(list_concat(a.words, b.words), lambda x: NOT (list_contains(a.words, x) AND list_contains(b.words, x)) AND NOT list_contains(coalesce(v.vocab, []), x))) = 0)""",
    "competition_filter": f"""WITH {_PARTS}, {_MATCHES}
SELECT m.q_id, m.p_id, m.rank FROM m JOIN rec a ON a.entity_id = q_id JOIN rec b ON b.entity_id = p_id
WHERE NOT (rank > 0 AND a.key <> b.key AND EXISTS (SELECT 1 FROM rec c WHERE c.src = 1 AND c.country = a.country AND c.key = b.key))""",
    "empty_address_assign": f"""WITH {_PARTS}, {_MATCHES}, n AS (SELECT *, name || ' x' || (doc_id // 3) AS full_name FROM rec),
o AS (SELECT country, full_name, min(entity_id) AS q_id FROM n WHERE src = 1 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT q_id, n.entity_id AS p_id, 'empty' AS kind FROM n JOIN o USING (country, full_name)
WHERE n.src > 1 AND n.doc_id % 7 = 0 AND n.entity_id NOT IN (SELECT p_id FROM m) AND q_id IN (SELECT q_id FROM m)""",
    "rule_precision": f"""WITH {_DOCS}, {_TRUTH}, c AS (SELECT *, {_core('name')} AS key FROM rec),
u AS (SELECT min(a.entity_id) AS q_id, b.entity_id AS p_id FROM c a JOIN c b ON a.src = 1 AND b.src > 1 AND a.country = b.country AND a.key = b.key GROUP BY b.entity_id HAVING count(*) = 1)
SELECT 'core' AS kind, count(*) AS n, round(avg(CASE WHEN t.q_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS precision FROM u LEFT JOIN truth t ON t.q_id = u.q_id AND t.p_id = u.p_id""",
    "country_merge": f"""WITH {_DOCS}, {_TRUTH}, l AS (SELECT r.entity_id AS q_id, r.country, coalesce(string_agg(t.p_id, ',' ORDER BY t.p_id), '') AS matched FROM rec r LEFT JOIN truth t ON t.q_id = r.entity_id WHERE r.src = 1 GROUP BY 1, 2)
SELECT q_id, CASE WHEN country = 'fr' THEN CASE WHEN q_id LIKE '%1' THEN 'X' || matched ELSE '' END WHEN q_id NOT LIKE '%2' THEN matched ELSE '' END AS matched FROM l""",
    "match_report": f"""WITH {_DOCS}, {_TRUTH}, n AS (SELECT r.entity_id, r.country, count(t.p_id) AS n FROM rec r LEFT JOIN truth t ON t.q_id = r.entity_id WHERE r.src = 1 GROUP BY 1, 2)
SELECT country, count(*) AS n_queries, round(avg(n), 6) AS mean_matches, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS share_empty FROM n GROUP BY 1""",
    "validate_output": f"""WITH {_DOCS}, {_TRUTH}, l0 AS (SELECT r.entity_id AS q_id, t.p_id FROM rec r LEFT JOIN truth t ON t.q_id = r.entity_id WHERE r.src = 1),
l AS (SELECT * FROM l0 WHERE q_id NOT LIKE '%7' UNION ALL SELECT * FROM l0 WHERE q_id LIKE '%5')
SELECT 'query missing' AS issue, count(*) AS n FROM rec WHERE src = 1 AND entity_id NOT IN (SELECT q_id FROM l)
UNION ALL SELECT 'query unknown', count(*) FROM l WHERE q_id NOT IN (SELECT entity_id FROM rec WHERE src = 1)
UNION ALL SELECT 'query without match repeated', count(*) FROM (SELECT q_id FROM l GROUP BY 1 HAVING count(*) > greatest(count(p_id), 1))
UNION ALL SELECT 'match repeated', count(*) FROM (SELECT q_id, p_id FROM l WHERE p_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'match not in pool', count(*) FROM l WHERE p_id NOT IN (SELECT entity_id FROM rec WHERE src > 1)
UNION ALL SELECT 'match with wrong prefix', count(*) FROM l WHERE NOT regexp_matches(p_id, '^S[23]-')
UNION ALL SELECT 'match not a candidate', count(*) FROM l WHERE p_id IS NOT NULL AND p_id LIKE '%3'""",
    "split_digit": "SELECT doc_id % 10 AS digit, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_good FROM labels GROUP BY 1",
    "oof_folds": "SELECT doc_id, doc_id % 5 AS fold, doc_id % 10 = 0 AS held_out FROM labels",
    "pseudo_label_filter": f"WITH {_PAIRS} SELECT q, p, s, CAST(CASE WHEN s >= 0.95 THEN 1 ELSE 0 END AS BIGINT) AS y FROM pairs WHERE s >= 0.95 OR s <= 0.05",
    "incremental_link": f"""WITH {_DOCS}, c AS (SELECT *, {_core('name')} AS key, array_to_string({_ADDR}, ' ') AS place FROM rec),
o AS (SELECT country, key, place, min(entity_id) AS q_id FROM c WHERE src = 1 AND key IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT q_id, entity_id AS p_id FROM c JOIN o USING (country, key, place) WHERE src > 1""",
}
_TWO = f"WITH {_DOCS}, {_tfidf('x', _NAME, 10)}, {_tfidf('y', _TOKENS.format(_fold('address')), 10)}"
_UNION = """SELECT coalesce(x.q_id, y.q_id) AS q_id, coalesce(x.p_id, y.p_id) AS p_id, coalesce(x.rank, 99) AS d_rank, coalesce(y.rank, 99) AS l_rank,
 coalesce(x.score, 0) AS bi_score, coalesce(y.score, 0) AS l_score, CAST(x.rank IS NOT NULL AND y.rank IS NOT NULL AS INTEGER) AS in_both
FROM x FULL JOIN y ON x.q_id = y.q_id AND x.p_id = y.p_id WHERE x.rank < 8 OR y.rank < 8"""
SQL["candidate_union"] = f"{_TWO} {_UNION}"
SQL["retrieval_features"] = f"""{_TWO}, u AS ({_UNION})
SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY bi_score DESC, p_id) - 1 AS bi_rank, round(max(bi_score) OVER (PARTITION BY q_id) - bi_score, 6) AS bi_gap,
 round(max(l_score) OVER (PARTITION BY q_id) - l_score, 6) AS l_gap, count(*) OVER (PARTITION BY q_id) AS n_cands FROM u"""
SQL["candidate_assembly"] = f"""{_TWO.replace('rank < 10', 'rank < 5')}, u AS (SELECT q_id, p_id, 0 AS part, rank FROM x UNION ALL SELECT q_id, p_id, 1, rank FROM y)
SELECT q_id, p_id, part, rank FROM u QUALIFY row_number() OVER (PARTITION BY q_id, p_id ORDER BY part, rank) = 1"""
SQL["sampling"] = "SELECT doc_id, lang AS country FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('S' || (doc_id % 3 + 1) || '-' || doc_id)) <= 20"
SQL["positive_pairs"] = f"""WITH {_DOCS}, {_TRUTH} SELECT q_id, p_id FROM truth WHERE q_id NOT LIKE '%0'
QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY md5(q_id || ' ' || p_id), p_id) <= 2"""
SQL["hard_negatives"] = f"""WITH {_DOCS}, {_tfidf('x', _NAME, 10)}, {_TRUTH}
SELECT x.q_id, x.p_id, CAST(CASE WHEN t.q_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS y FROM x LEFT JOIN truth t ON t.q_id = x.q_id AND t.p_id = x.p_id WHERE x.rank < 8"""
SQL["decide_by_country"] = """WITH pairs AS (
  SELECT l_orderkey AS q, l_partkey AS p, max((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 1000 / 1000) AS s, min(l_returnflag) AS country
  FROM lineitem GROUP BY 1, 2
), t AS (SELECT *, CASE country WHEN 'A' THEN 0.8 WHEN 'N' THEN 0.6 ELSE 0.7 END AS gate, CASE country WHEN 'A' THEN 0.6 WHEN 'N' THEN 0.5 ELSE 0.7 END AS extra FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY q, country ORDER BY s DESC, p) - 1 AS rank, max(s) OVER (PARTITION BY q, country) AS p1 FROM t),
g AS (SELECT country, q, p, s, rank FROM r WHERE p1 >= gate AND (rank = 0 OR s >= extra))
SELECT country, p, q, s, rank FROM g QUALIFY row_number() OVER (PARTITION BY country, p ORDER BY s DESC, q) = 1"""

# --- string kernels, by dynamic programming over distinct pairs of strings

#: (a, b, i, row) of ``need`` (a, b): row[j + 1] is the longest common subsequence of the first j characters of a and i of b; then ``lcs`` (a, b, n).
_LCS = """grid(a, b, i, cells) AS (
  SELECT a, b, 0, list_transform(range(0, length(a) + 1), lambda x: 0) FROM (SELECT DISTINCT a, b FROM need)
  UNION ALL
  SELECT a, b, i + 1, list_concat([0], list_transform(range(1, length(a) + 1), lambda j: list_max(best[1:j])))
  FROM (SELECT a, b, i, list_transform(range(1, length(a) + 1), lambda j: greatest(cells[j + 1], cells[j] + CASE WHEN a[j] = b[i + 1] THEN 1 ELSE 0 END)) AS best
        FROM grid WHERE i < length(b))
), lcs AS (SELECT a, b, cells[length(a) + 1] AS n FROM grid WHERE i = length(b))"""
_WORDS = "list_sort(list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> '')))"
_SORTED = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda w: w <> '')), ' ')"


def _ratio(a: str, b: str, n: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0 * {n} / (length({a}) + length({b})) END)"


def _kernels(pairs: str) -> str:
    """CTEs from ``pairs`` (x, y), distinct strings: ``kernel`` (x, y, ratio, sorted, shared, part)."""
    return f"""
side AS (SELECT x, y, {_SORTED.format('x')} AS sx, {_SORTED.format('y')} AS sy, {_WORDS.format('x')} AS wx, {_WORDS.format('y')} AS wy FROM (SELECT DISTINCT x, y FROM {pairs})),
rest AS (SELECT *, array_to_string(list_filter(wx, lambda w: list_contains(wy, w)), ' ') AS common,
         array_to_string(list_filter(wx, lambda w: NOT list_contains(wy, w)), ' ') AS rx, array_to_string(list_filter(wy, lambda w: NOT list_contains(wx, w)), ' ') AS ry FROM side),
turn AS (SELECT x, y, x AS short, y AS long FROM side WHERE length(x) <= length(y) UNION ALL SELECT x, y, y, x FROM side WHERE length(y) <= length(x)),
turns AS (SELECT DISTINCT short, long FROM turn),
piece AS (SELECT short, long, substring(long, i, length(short)) AS w FROM (SELECT short, long, unnest(range(1, length(long) - length(short) + 2)) AS i FROM turns)),
need AS (
  SELECT x AS a, y AS b FROM side UNION SELECT sx, sy FROM side UNION SELECT rx, ry FROM rest UNION SELECT short, w FROM piece
  UNION SELECT short, long FROM turns UNION SELECT reverse(short), reverse(long) FROM turns
), {_LCS},
ends AS (
  SELECT short, long, max(2.0 * cells[length(short) + 1] / (length(short) + i)) AS v FROM (
    SELECT short, long, cells, i FROM turns JOIN grid ON a = short AND b = long
    UNION ALL SELECT short, long, cells, i FROM turns JOIN grid ON a = reverse(short) AND b = reverse(long)
  ) WHERE i > 0 AND i < length(short) GROUP BY 1, 2
),
spans AS (SELECT p.short, p.long, max(CASE WHEN length(p.short) = 0 THEN 0 ELSE l.n / length(p.short) END) AS v FROM piece p JOIN lcs l ON l.a = p.short AND l.b = p.w GROUP BY 1, 2),
parts AS (SELECT t.x, t.y, max(CASE WHEN contains(t.long, t.short) AND length(t.short) > 0 THEN 1.0 ELSE greatest(s.v, coalesce(e.v, 0)) END) AS part
  FROM turn t LEFT JOIN spans s USING (short, long) LEFT JOIN ends e USING (short, long) GROUP BY 1, 2),
kernel AS (
  SELECT r.x, r.y, {_ratio('r.x', 'r.y', 'l.n')} AS ratio, {_ratio('r.sx', 'r.sy', 's.n')} AS sorted,
    CASE WHEN len(r.wx) = 0 OR len(r.wy) = 0 THEN 0.0 WHEN common <> '' AND (rx = '' OR ry = '') THEN 1.0
      WHEN common = '' THEN 1 - (length(rx) + length(ry) - 2.0 * t.n) / (length(rx) + length(ry))
      ELSE greatest(1 - (length(rx) + length(ry) - 2.0 * t.n) / (2 * length(common) + 2 + length(rx) + length(ry)),
        2.0 * length(common) / (2 * length(common) + 1 + length(rx)), 2.0 * length(common) / (2 * length(common) + 1 + length(ry))) END AS shared,
    CASE WHEN r.x = '' AND r.y = '' THEN 1.0 WHEN r.x = '' OR r.y = '' THEN 0.0 ELSE p.part END AS part
  FROM rest r JOIN lcs l ON l.a = r.x AND l.b = r.y JOIN lcs s ON s.a = r.sx AND s.b = r.sy JOIN lcs t ON t.a = r.rx AND t.b = r.ry JOIN parts p ON p.x = r.x AND p.y = r.y
)"""


def _skeletons(texts: str) -> str:
    """CTEs from ``texts`` (x): ``skeleton`` (x, sk)."""
    sounds = "regexp_replace(lower(x), '[^a-z0-9 ]+', ' ', 'g')"
    for a, b in k.SOUNDS:
        sounds = f"replace({sounds}, '{a}', '{b}')"
    return f"""
sk1 AS (SELECT x, string_split(regexp_replace({sounds}, '([a-z])[aeiou]+', '\\1', 'g'), '') AS c FROM (SELECT DISTINCT x FROM {texts})),
skeleton AS (SELECT x, trim(array_to_string(list_filter(c, lambda y, i: i = 1 OR y <> c[i - 1]), '')) AS sk FROM sk1)"""


_SHORT = f"list_filter(string_split(sk, ' '), lambda w: w NOT IN {_list(k.LEGAL_SKELETONS)})"
_NAME_SK = f"CASE WHEN len({_SHORT}) > 0 THEN array_to_string({_SHORT}, ' ') ELSE sk END"
_PARTNAMES = f"{_NAME_PAIRS}, xy AS (SELECT a AS x, b AS y FROM pairs), {_kernels('xy')}"
SQL["ratio_pairs"] = f"WITH RECURSIVE {_PARTNAMES} SELECT x AS a, y AS b, round(ratio, 6) AS similarity, round(sorted, 6) AS sorted_similarity FROM kernel"
SQL["token_set_pairs"] = f"WITH RECURSIVE {_PARTNAMES} SELECT x AS a, y AS b, round(shared, 6) AS similarity FROM kernel"
SQL["partial_pairs"] = f"WITH RECURSIVE {_PARTNAMES} SELECT x AS a, y AS b, round(part, 6) AS similarity FROM kernel"
SQL["skeleton_text"] = f"WITH {_DOCS}, xs AS (SELECT name AS x FROM rec), {_skeletons('xs')} SELECT doc_id, sk AS skeleton, {_NAME_SK} AS name_skeleton FROM rec JOIN skeleton ON x = name"

_JAC = "(CASE WHEN len(list_concat({0}, {1})) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END)"
_C3 = lambda x: f"list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substring({x}, i, 3)))"
_C3JAC = lambda x, y: _JAC.format(_C3(x), _C3(y))
_WJAC = lambda x, y: _JAC.format(_WORDS.format(x), _WORDS.format(y))
#: Part records fold to themselves: lower case, single blanks, no legal form; their address is one part, and its own state
SQL["pair_features"] = f"""WITH RECURSIVE {_PARTS},
pr AS (SELECT a.entity_id AS q_id, b.entity_id AS p_id, a.name AS n1, b.name AS n2, a.address AS a1, b.address AS a2, a.street AS s1, b.street AS s2, a.num AS num
       FROM rec a JOIN rec b ON a.src = 1 AND b.src > 1 AND a.country = b.country AND a.num = b.num),
xs AS (SELECT name AS x FROM rec UNION SELECT address FROM rec), {_skeletons('xs')},
named AS (SELECT x, sk, {_NAME_SK} AS nsk, replace({_NAME_SK}, ' ', '') AS nsq, replace(sk, ' ', '') AS sq FROM skeleton),
pk AS (SELECT pr.*, m1.nsk AS k1, m2.nsk AS k2, m1.nsq AS j1, m2.nsq AS j2, d1.sk AS b1, d2.sk AS b2, d1.sq AS c1, d2.sq AS c2
       FROM pr JOIN named m1 ON m1.x = n1 JOIN named m2 ON m2.x = n2 JOIN named d1 ON d1.x = a1 JOIN named d2 ON d2.x = a2),
xy AS (SELECT n1 AS x, n2 AS y FROM pk UNION SELECT a1, a2 FROM pk UNION SELECT k1, k2 FROM pk UNION SELECT j1, j2 FROM pk UNION SELECT b1, b2 FROM pk UNION SELECT c1, c2 FROM pk UNION SELECT s1, s2 FROM pk),
{_kernels('xy')},
val AS (SELECT pk.*, n.ratio AS nr, n.part AS np, n.sorted AS ns, n.shared AS nt, jaro_winkler_similarity(n1, n2) AS nw, a.ratio AS ar, a.part AS ap, a.sorted AS asr, a.shared AS ats,
        j.ratio AS jr, kk.shared AS kt, bb.ratio AS br, bb.shared AS bt, c.ratio AS cr, s.ratio AS sr
  FROM pk JOIN kernel n ON n.x = n1 AND n.y = n2 JOIN kernel a ON a.x = a1 AND a.y = a2 JOIN kernel kk ON kk.x = k1 AND kk.y = k2 JOIN kernel j ON j.x = j1 AND j.y = j2
  JOIN kernel bb ON bb.x = b1 AND bb.y = b2 JOIN kernel c ON c.x = c1 AND c.y = c2 JOIN kernel s ON s.x = s1 AND s.y = s2)
SELECT q_id, p_id, round(nr, 6) AS n_ratio, round(np, 6) AS n_partial, round(ns, 6) AS n_tsort, round(nt, 6) AS n_tset, round(nw, 6) AS n_jw,
  round({_WJAC('n1', 'n2')}, 6) AS n_jac_tok, round({_C3JAC('n1', 'n2')}, 6) AS n_jac_c3, round(nr, 6) AS nn_ratio, round(nt, 6) AS nn_tset, round(nw, 6) AS nn_jw,
  round({_WJAC('n1', 'n2')}, 6) AS nn_jac_tok, round({_C3JAC('n1', 'n2')}, 6) AS nn_jac_c3, CAST(n1 = n2 AS INT)::DOUBLE AS nn_exact,
  round(ar, 6) AS a_ratio, round(ap, 6) AS a_partial, round(asr, 6) AS a_tsort, round({_WJAC('a1', 'a2')}, 6) AS a_jac_tok, round({_C3JAC('a1', 'a2')}, 6) AS a_jac_c3,
  round(ar, 6) AS an_ratio, round(ats, 6) AS an_tset, round({_WJAC('a1', 'a2')}, 6) AS an_jac_tok, round({_C3JAC('a1', 'a2')}, 6) AS an_jac_c3, CAST(a1 = a2 AS INT)::DOUBLE AS an_exact,
  1.0::DOUBLE AS num_jac, 1.0::DOUBLE AS num_first_eq, 1.0::DOUBLE AS num_any, 1.0::DOUBLE AS both_addr,
  length(n1)::DOUBLE AS len_n1, length(n2)::DOUBLE AS len_n2, length(a1)::DOUBLE AS len_a1, length(a2)::DOUBLE AS len_a2,
  round(jr, 6) AS sk_n_ratio, round(kt, 6) AS sk_n_tset, round({_C3JAC('j1', 'j2')}, 6) AS sk_n_c3, round(br, 6) AS sk_a_ratio, round(bt, 6) AS sk_a_tset,
  CAST(cr >= 0.8 AS INT)::DOUBLE AS comp_a, CAST(cr >= 0.8 AS INT)::DOUBLE AS comp_b, round(cr, 6) AS state_sim, CAST(c1 = c2 AS INT)::DOUBLE AS state_eq,
  0.0::DOUBLE AS a1_empty, 0.0::DOUBLE AS a2_empty, 0.0::DOUBLE AS n2_nonlatin, 0.0::DOUBLE AS a2_nonlatin, CAST(j1 = j2 AND j1 <> '' AS INT)::DOUBLE AS sk_n_exact,
  round(sr, 6) AS st_ratio, 1.0::DOUBLE AS st_num_eq, CAST(sr >= 0.85 AS INT)::DOUBLE AS st_match, 1.0::DOUBLE AS st_both, 0.0::DOUBLE AS st_num_diff FROM val"""
SQL["stage2_similarities"] = f"""WITH RECURSIVE {_PARTS}, {_MATCHES},
half AS (SELECT name, entity_id FROM rec WHERE src = 1 AND CAST('0x' || substring(md5(entity_id), 1, 8) AS BIGINT) < 2147483648),
c AS (SELECT a.entity_id AS q, b.entity_id AS p, (a.doc_id * 31 + b.doc_id * 17) % 1000 / 1000 AS s, b.name, b.address AS addr, substring(b.entity_id, 1, 2) AS src, a.name AS q_name,
      (SELECT count(*) FROM half h WHERE h.name = a.name) + CASE WHEN a.entity_id IN (SELECT entity_id FROM half) THEN 0 ELSE 1 END AS q_count
      FROM m JOIN rec a ON a.entity_id = q_id JOIN rec b ON b.entity_id = p_id),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) - 1 AS i FROM c),
xy AS (SELECT DISTINCT a.name AS x, b.name AS y FROM o a JOIN o b ON a.q = b.q AND a.i <> b.i UNION SELECT DISTINCT a.addr, b.addr FROM o a JOIN o b ON a.q = b.q AND a.i <> b.i), {_kernels('xy')},
pair AS (SELECT a.q, a.p, b.i = CASE WHEN a.i = 0 THEN 1 ELSE 0 END AS ref, b.s >= 0.5 AS conf, n.sorted AS n, d.sorted AS d, CAST(a.src = b.src AS INT) AS same_src, CAST(a.name = b.name AS INT) AS same
         FROM o a JOIN o b ON a.q = b.q AND a.i <> b.i JOIN kernel n ON n.x = a.name AND n.y = b.name JOIN kernel d ON d.x = a.addr AND d.y = b.addr),
g AS (SELECT q, p, max(n) FILTER (WHERE ref) AS s2_name_top1, max(d) FILTER (WHERE ref) AS s2_addr_top1, max(same_src) FILTER (WHERE ref) AS s2_src_top1, max(n) FILTER (WHERE conf) AS s2_name_conf,
      max(d) FILTER (WHERE conf) AS s2_addr_conf, sum(same) AS s2_nsame, sum(same_src) FILTER (WHERE conf) AS s2_nconf_src, sum(same) FILTER (WHERE conf) AS s2_nconf_same FROM pair GROUP BY 1, 2)
SELECT o.q, o.p, 0 AS s2_cempty, CAST(o.name = o.q_name AS INT) AS s2_eq_q, round(ln(1 + o.q_count), 6) AS s2_s1namecnt,
  round(coalesce(s2_name_top1, -1), 6) AS s2_name_top1, round(coalesce(s2_addr_top1, -1), 6) AS s2_addr_top1, coalesce(s2_src_top1, -1)::DOUBLE AS s2_src_top1, round(coalesce(s2_name_conf, -1), 6) AS s2_name_conf,
  round(coalesce(s2_addr_conf, -1), 6) AS s2_addr_conf, coalesce(s2_nsame, 0)::BIGINT AS s2_nsame, coalesce(s2_nconf_src, 0)::BIGINT AS s2_nconf_src, coalesce(s2_nconf_same, 0)::BIGINT AS s2_nconf_same, 0 AS s2_t1empty
FROM o LEFT JOIN g ON g.q = o.q AND g.p = o.p"""
#: Two words against two, none inside the other name's joined words: the first takes its first fit, the second what is left
SQL["ops_profile"] = f"""WITH RECURSIVE {_PARTS}, {_MATCHES}, pr AS (SELECT a.words AS w, b.words AS o, m.rank FROM m JOIN rec a ON a.entity_id = q_id JOIN rec b ON b.entity_id = p_id),
need AS (SELECT DISTINCT unnest(o) AS a, w[1] AS b FROM pr UNION SELECT DISTINCT unnest(o), w[2] FROM pr), {_LCS},
near AS (SELECT a, b, a = b OR (length(a) >= 3 AND (starts_with(a, b) OR starts_with(b, a))) OR (length(a) > 3 AND 2.0 * n / (length(a) + length(b)) >= 0.75) AS fits FROM lcs),
fit AS (SELECT pr.*, f11.fits AS f11, f12.fits AS f12, f21.fits AS f21, f22.fits AS f22, contains(w[1] || w[2], o[1]) AS in1, contains(w[1] || w[2], o[2]) AS in2
  FROM pr JOIN near f11 ON f11.a = o[1] AND f11.b = w[1] JOIN near f12 ON f12.a = o[1] AND f12.b = w[2] JOIN near f21 ON f21.a = o[2] AND f21.b = w[1] JOIN near f22 ON f22.a = o[2] AND f22.b = w[2]),
one AS (SELECT *, CASE WHEN f11 THEN 1 WHEN f12 THEN 2 WHEN in1 THEN 1 ELSE 0 END AS taken FROM fit),
two AS (SELECT *, CASE WHEN taken = 1 THEN f22 OR in2 WHEN taken = 2 THEN f21 OR in2 ELSE f21 OR f22 OR in2 END AS second FROM one)
SELECT CASE WHEN taken > 0 AND second THEN 'core=' ELSE 'core-swap' END || ' legal-ok' AS name_op, 'num=' AS num_op, round(count(*) / (SELECT count(*) FROM rec WHERE src = 1), 6) AS rate FROM two GROUP BY 1"""
SQL["ops_drift"] = SQL["ops_profile"].replace("'num=' AS num_op, round(count(*) / (SELECT count(*) FROM rec WHERE src = 1), 6) AS rate FROM two GROUP BY 1",
    "'num=' AS num_op, round(count(*) / (SELECT count(*) FROM rec WHERE src = 1), 6) AS truth_rate, round(count(*) FILTER (WHERE rank = 0) / (SELECT count(*) FROM rec WHERE src = 1), 6) AS accepted_rate FROM two GROUP BY 1")
_ONLY = "SELECT min(q_id) AS q_id, p_id FROM ({0}) GROUP BY p_id HAVING count(*) = 1"
SQL["rule_chain"] = f"""WITH {_PARTS}, one AS ({_ONLY.format(_AT + ' AND a.key = b.key')}),
two AS ({_ONLY.format(_AT + ' AND a.key = b.key AND b.entity_id NOT IN (SELECT p_id FROM one)')})
SELECT q_id, p_id, 1 AS step FROM one UNION ALL SELECT q_id, p_id, 2 FROM two"""
SQL["rule_harness"] = f"""WITH {_PARTS}, pool AS (SELECT * FROM rec WHERE src > 1 AND CAST('0x' || substring(md5(entity_id), 1, 8) AS BIGINT) < 644245094),
hit AS ({_AT.replace('JOIN rec b', 'JOIN pool b')}), sole AS (SELECT min(q_id) AS q_id, p_id FROM hit GROUP BY p_id HAVING count(*) = 1),
same AS (SELECT h.* FROM hit h JOIN rec a ON a.entity_id = q_id JOIN rec b ON b.entity_id = p_id WHERE a.key = b.key), eq AS ({_ONLY.format('SELECT * FROM same')}),
truth AS (SELECT min(a.entity_id) AS q_id, b.entity_id AS p_id FROM rec a JOIN rec b ON a.src = 1 AND b.src > 1 AND a.country = b.country AND a.name = b.name AND a.address = b.address GROUP BY 2),
found AS (
  SELECT 'exact' AS rule, 'addr' AS kind, * FROM eq UNION ALL SELECT 'typo', 'typo', * FROM eq
  UNION ALL SELECT 'acro', 'acro', sole.* FROM sole JOIN rec a ON a.entity_id = q_id JOIN rec b ON b.entity_id = p_id WHERE len(list_intersect(a.words, b.words)) = 0 AND a.words[1][1] || a.words[2][1] = b.words[1]
  UNION ALL SELECT 'any', 'any', sole.* FROM sole JOIN rec a ON a.entity_id = q_id JOIN rec b ON b.entity_id = p_id WHERE len(list_intersect(a.words, b.words)) = 0)
SELECT rule, kind, count(*) AS n, round(avg(CASE WHEN t.q_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS precision, round(count(*) / (SELECT count(*) FROM pool), 6) AS fired
FROM found f LEFT JOIN truth t ON t.q_id = f.q_id AND t.p_id = f.p_id GROUP BY 1, 2"""

# --- the rest of the list
SQL["dense_topk_by_country"] = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (
  SELECT 'S2-' || q.vec_id AS q_id, 'S2-' || p.vec_id AS p_id, round(list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v))), 6) AS score
  FROM v q JOIN v p ON q.vec_id % 20 = 0 AND p.label = q.label AND p.vec_id <> q.vec_id)
SELECT * FROM (SELECT q_id, p_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, p_id) - 1 AS rank FROM s) WHERE rank < 3"""
_NAMED = f"WITH {_DOCS}, {_TRUTH}, {_tfidf('x', _NAME, 10)}"
SQL["recall_at_k"] = f"""{_NAMED}, h AS (SELECT x.rank FROM truth t LEFT JOIN x ON x.q_id = t.q_id AND x.p_id = t.p_id)
SELECT k, round(avg(CASE WHEN rank < k THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n_true FROM h CROSS JOIN (VALUES (1), (5), (10)) v(k) GROUP BY k"""
SQL["pool_coverage"] = f"""{_NAMED} SELECT country, round(avg(CASE WHEN entity_id IN (SELECT p_id FROM x WHERE rank < 8) THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n
FROM rec WHERE src > 1 GROUP BY 1"""
SQL["dense_scores"] = f"""WITH {_DENSE}, x AS (SELECT * FROM top WHERE rank < 5),
y AS (SELECT q.vec_id AS q_id, p.vec_id AS p_id, 0.5 AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY p.vec_id) - 1 AS rank
      FROM embeddings q JOIN embeddings p ON q.vec_id % 20 = 0 AND p.label = q.label AND p.vec_id <> q.vec_id QUALIFY rank < 5)
SELECT u.* EXCLUDE (bi_score), s.score AS bi_score FROM (
  SELECT coalesce(x.q_id, y.q_id) AS q_id, coalesce(x.p_id, y.p_id) AS p_id, coalesce(x.rank, 99) AS d_rank, coalesce(y.rank, 99) AS l_rank,
    0 AS bi_score, coalesce(y.score, 0)::DOUBLE AS l_score, CAST(x.rank IS NOT NULL AND y.rank IS NOT NULL AS INTEGER) AS in_both
  FROM x FULL JOIN y ON x.q_id = y.q_id AND x.p_id = y.p_id) u JOIN score s ON s.q_id = u.q_id AND s.p_id = u.p_id"""
SQL["bernoulli_sample"] = f"WITH {_DOCS} SELECT entity_id FROM rec WHERE CAST('0x' || substring(md5(entity_id), 1, 8) AS BIGINT) < 644245094"
SQL["feature_blocks"] = f"""WITH {_PAIRS}, l AS (SELECT q, p, round(round(s * 10 - 5, 2), 2) AS a, round(5 - s * 10, 2) AS b FROM pairs)
SELECT q AS q_id, p AS p_id, round(first_value(a) OVER x - a, 6) AS ce_gap_best, round(a - CASE WHEN row_number() OVER x = 1 THEN coalesce(nth_value(a, 2) OVER x, -12) ELSE first_value(a) OVER x END, 6) AS ce_margin,
 round(first_value(b) OVER y - b, 6) AS xce_gap_best, round(b - CASE WHEN row_number() OVER y = 1 THEN coalesce(nth_value(b, 2) OVER y, -12) ELSE first_value(b) OVER y END, 6) AS xce_margin
FROM l WINDOW x AS (PARTITION BY q ORDER BY a DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), y AS (PARTITION BY q ORDER BY b DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
SQL["one_owner_ids"] = """WITH pairs AS (SELECT 'S1-' || l_orderkey AS q, 'S2-' || l_partkey AS p, max(l_discount * 10) AS s FROM lineitem GROUP BY 1, 2)
SELECT p, q, round(s, 6) AS s FROM pairs QUALIFY row_number() OVER (PARTITION BY p ORDER BY s DESC, q) = 1"""
SQL["best_gate_extra"] = f"""SELECT * FROM ({_grid_sql("(SELECT i / 1000 AS gate FROM range(200, 951, 50) r(i))", "(SELECT i / 1000 AS extra FROM range(200, 951, 50) r(i))", False)})
ORDER BY macro_f05 DESC, gate DESC, extra DESC LIMIT 1"""
SQL["country_thresholds"] = f"""WITH {_PAIRS}, {_LINE_TRUTH}, {_RANKED},
y AS (SELECT r.*, t.q IS NOT NULL AS hit FROM ranked r LEFT JOIN truth t ON r.q = t.q AND r.p = t.p),
n AS (SELECT o_orderkey AS q, o_orderstatus AS country, coalesce(n_true, 0) AS n_true FROM orders LEFT JOIN (SELECT q, count(*) AS n_true FROM truth GROUP BY 1) ON q = o_orderkey),
g AS (SELECT i / 1000 AS threshold FROM range(50, 951, 10) r(i)),
k AS (SELECT g.threshold, r.q, count(*) AS n_pred, count(*) FILTER (WHERE hit) AS n_hit FROM y r JOIN g ON r.s >= g.threshold GROUP BY 1, 2),
f AS (SELECT g.threshold, n.country, n.n_true, coalesce(k.n_pred, 0) AS n_pred, coalesce(k.n_hit, 0) AS n_hit FROM g CROSS JOIN n LEFT JOIN k ON k.q = n.q AND k.threshold = g.threshold),
v AS (SELECT country, threshold, avg({_F05}) AS f FROM f GROUP BY 1, 2),
b AS (SELECT country, threshold, round(f, 6) AS macro_f05 FROM v QUALIFY row_number() OVER (PARTITION BY country ORDER BY round(f, 9) DESC, threshold) = 1)
SELECT * FROM b UNION ALL SELECT 'unseen', max(threshold), NULL FROM b"""
SQL["positive_rate"] = f"""WITH {_PAIRS}, {_LINE_TRUTH}, y AS (SELECT r.q, CASE WHEN t.q IS NULL THEN 0.0 ELSE 1.0 END AS y FROM pairs r LEFT JOIN truth t ON r.q = t.q AND r.p = t.p),
h AS (SELECT q, sum(y) AS hits, count(*) AS n FROM y GROUP BY 1) SELECT round(sum(hits) / sum(n), 6) AS positive_rate, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM h"""
SQL["candidates_with_matches"] = f"""WITH {_DOCS}, {_TRUTH}, {_tfidf('x', _NAME, 3)} SELECT q_id, p_id, 0 AS part, rank FROM x
UNION ALL SELECT DISTINCT t.q_id, t.p_id, 1, 0 FROM truth t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.q_id = t.q_id AND x.p_id = t.p_id)"""
SQL["candidate_report"] = f"""WITH {_DOCS}, {_tfidf('x', _NAME, 5)}, n AS (SELECT entity_id, country, count(x.p_id) AS n FROM rec LEFT JOIN x ON x.q_id = entity_id WHERE src = 1 GROUP BY 1, 2)
SELECT country, count(*) AS n_queries, round(avg(n), 6) AS mean_candidates, max(n) AS max_candidates FROM n GROUP BY 1"""
SQL["unowned_pool"] = f"WITH {_DOCS}, {_TRUTH} SELECT entity_id FROM rec WHERE src > 1 AND entity_id NOT IN (SELECT p_id FROM truth)"
SQL["append_ids"] = f"""WITH {_DOCS}, {_TRUTH}, o AS (SELECT q_id, p_id, CASE WHEN right(p_id, 1) IN ('1', '3', '5', '7', '9') THEN 0 WHEN p_id LIKE 'S3%' THEN 1 ELSE 2 END AS step FROM truth)
SELECT entity_id AS q_id, coalesce(string_agg(p_id, ',' ORDER BY step, p_id), '') AS matched_entity_ids FROM rec LEFT JOIN o ON q_id = entity_id WHERE src = 1 GROUP BY 1"""
SQL["country_rows"] = f"""WITH {_PAIRS}, {_RANKED}, g AS (SELECT q, 'S2-' || p AS p, s FROM ranked WHERE p1 >= 0.8 AND (rank = 0 OR s >= 0.5))
SELECT 'S1-' || q AS q_id, string_agg(p, ',' ORDER BY s DESC, p) AS ids FROM g GROUP BY 1"""
SQL["text_blob"] = f"WITH {_DOCS} SELECT entity_id, {_fold('name')} || ' | ' || {_fold('address')} AS text FROM rec"
SQL["fold_plain"] = f"WITH {_PARTS} SELECT doc_id, name || ' & cafe + ' || address AS folded FROM rec"
SQL["ciphered_names"] = f"WITH {_PARTS} SELECT doc_id, translate(name, 'abcdefghijklmnopqrstuvwxyz', 'lmnopqrstuvwxyzabcdefghijk') AS name FROM rec"
SQL["tsv_roundtrip"] = f"""WITH {_PARTS} SELECT entity_id, '"' || name || '" NA' AS name, CASE WHEN doc_id % 7 = 0 THEN '' ELSE address END AS address, country FROM rec"""

#: Planted names and what they come to, traced by hand.
INDIC = {
    "गुड ट्रेडिंग": ("guda treding", "gd trdng"), "कमल": ("kamal", "kml"), "Good Trading": ("Good Trading", "gd trdng"), "Philly": ("Philly", "fl"), "1100 Main": ("1100 Main", "10 mn"),
}
NAME_PAIRS = [
    ("Martin Dupont SARL", "Dupont Martin"), ("Martin Dupont SARL", "Dupont Martin SAS"), ("Martin Dupont", "Martin"), ("Martin", "Martin Dupont"), ("Martin Dupont", "Martin Leroy"),
    ("Foo dba Bar", "Foo"), ("Foo", "SARL"), ("Boulangerie Leroy", "Boulangere Leroy"), ("Alpha Beta", "lphaB"),
]
_OPERATIONS = ["core= legal-ok", "core= legal-swap", "core-del legal-ok", "core+add legal-ok", "core-swap legal-ok", "dba/domain", "no-core", "core= legal-ok", "core-del legal-ok"]
CORE_NAMES = {
    "Café Ẽlan Ａcme": ("cafe elan acme", ""), "S.A.S. Dupont": ("dupont", "sas"), "Foo dba Bar": (None, None), "shop.fr": (None, None), "Ets Martin SARL": ("ets martin", "sarl"),
    "Café & Co": ("cafe", "co"), "ﬁn ½ Ltd": ("fin 1 2", "ltd"), "𝐀𝐜𝐦𝐞 ⁵": ("cme 5", ""),
}


def _values(columns: str, rows) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({columns})"


SQL["indic_text"] = _values("text, latin, skeleton", [(a, *b) for a, b in INDIC.items()])
SQL["name_operations"] = _values("a, b, operation", [(*x, y) for x, y in zip(NAME_PAIRS, _OPERATIONS, strict=True)])
SQL["core_words"] = _values("name, core, legal", [(a, *b) for a, b in CORE_NAMES.items()])
