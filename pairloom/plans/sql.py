"""DuckDB SQL for the registered queries of the matching operators."""

from __future__ import annotations

from .fixtures import with_views

MIN_SUPPORT, SEED, TOP, HARD_NEGATIVES = 5, 42, 100, 4000

CLEAN = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"

#: Names are ASCII words parted by single blanks; numbers and codes are picked from the words.
RECORDS = r"""
words AS (SELECT *, lower(name) AS name_clean, regexp_split_to_array(lower(name || ' ' || lower(brand) || ' ' || lower(size)), '[^0-9a-z_.,#-]+') AS ws FROM items_part),
records AS (SELECT id, category, name, name_clean, regexp_replace(name_clean, '[^0-9a-z]+', '', 'g') AS name_compact, length(name)::BIGINT AS name_len, lower(brand) AS brand, lower(size) AS size,
  list_sort(list_distinct(flatten(list_transform(ws, lambda x: regexp_extract_all(' ' || regexp_replace(x, '[^0-9a-z]', ' ', 'g') || ' ', ' ([0-9]+[a-z]*)', 1))))) AS numbers,
  list_sort(list_distinct(list_filter(regexp_split_to_array(lower(name || ' ' || lower(brand) || ' ' || lower(size)), '[^0-9a-z-]+'), lambda x: length(x) >= 3 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-z]')))) AS codes,
  list_distinct(list_filter(regexp_split_to_array(name_clean, '[^0-9a-z]+'), lambda x: x <> '')) AS tokens
 FROM words)"""

PAIRED = """
p AS (SELECT p.*, l.name_clean AS c1, r.name_clean AS c2, l.name_compact AS k1, r.name_compact AS k2, l.name_len AS n1, r.name_len AS n2, l.numbers AS a, r.numbers AS b, l.codes AS c, r.codes AS d, l.tokens AS t1, r.tokens AS t2,
  l.brand AS brand1, r.brand AS brand2, l.size AS size1, r.size AS size2
 FROM pairs_part p JOIN records l ON p.id1 = l.id JOIN records r ON p.id2 = r.id)"""

COMMON = "len(list_intersect({0}, {1}))"
UNION = "len(list_distinct(list_concat({0}, {1})))"


def _jac(x: str, y: str) -> str:
    return f"CASE WHEN {UNION.format(x, y)} > 0 THEN {COMMON.format(x, y)}::DOUBLE / {UNION.format(x, y)}::DOUBLE ELSE 0.0::DOUBLE END"


SIMILARITY = "CASE WHEN greatest(length(c1), length(c2)) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(c1, c2)::DOUBLE / greatest(length(c1), length(c2))::DOUBLE END"


def _ap(rows: str, by: str | None, score: str = "score", label: str = "target") -> str:
    """CTEs g, w and ap over a relation with the label, the score and the group."""
    keys, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""
g AS (SELECT {keys}{score} AS score, sum({label})::BIGINT AS tp, count(*)::BIGINT AS n FROM {rows} GROUP BY {keys}{score}),
w AS (SELECT *, sum(tp) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp, sum(n) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn FROM g),
ap AS (SELECT {keys}sum(n)::BIGINT AS pairs, sum(tp)::BIGINT AS positives, sum(tp)::DOUBLE / sum(n)::DOUBLE AS positive_rate,
  CASE WHEN sum(tp) > 0 THEN sum(tp::DOUBLE * ctp::DOUBLE / cn::DOUBLE) / sum(tp)::DOUBLE END AS average_precision FROM w {group})"""


AP_OUT = "pairs, positives, round(positive_rate, 6) AS positive_rate, round(average_precision, 6) AS average_precision"
MACRO_ROWS = "mr AS (SELECT category, target::INT AS target, ((id1 * 31 + id2 * 17) % 997)::DOUBLE / 997.0::DOUBLE AS score FROM pairs_part)"


def _macro(value: str, where: str) -> str:
    return f"{with_views('pairs_part')}, {MACRO_ROWS}, {_ap('mr', 'category')}\nSELECT round(avg({value}), 6) AS macro_average_precision, count(*)::BIGINT AS categories FROM ap WHERE {where}"


BASELINE = f"""{with_views("items_part", "pairs_part")}, {RECORDS}, {PAIRED},
s AS (SELECT 'name_similarity' AS experiment, category, target::INT AS target, {SIMILARITY} AS score FROM p
 UNION ALL SELECT 'model_tokens', category, target::INT, ((len(list_intersect(c, d)) > 0)::INT - (len(c) > 0 AND len(d) > 0 AND len(list_intersect(c, d)) = 0)::INT)::DOUBLE FROM p),
{_ap("s", "experiment, category")}"""

SOME_ITEMS = "some_items AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE category END AS category FROM items_part WHERE id % 7 <> 0)"

#: Pairs of one type and name are one block, and blocks are the components.
BLOCKS = """
labelled AS (SELECT p.*, min(least(id1, id2)) OVER (PARTITION BY a.p_type, a.p_name) AS component FROM pairs_part p JOIN part a ON p.id1 = a.p_partkey),
comp AS (SELECT component, min(category) AS category, count(*)::BIGINT AS pairs, sum((target >= 0.5)::INT)::BIGINT AS positives FROM labelled GROUP BY component)"""

#: The walk itself, component by component.
WALK = f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('{SEED}|' || component), component) AS i FROM comp),
goal AS (SELECT category, round_even(sum(pairs) * 0.2::DOUBLE, 0)::BIGINT AS goal FROM comp GROUP BY category),
walk AS (SELECT category, goal, 0::BIGINT AS i, 0::BIGINT AS cur, -1::BIGINT AS component, FALSE AS taken FROM goal
 UNION ALL SELECT w.category, w.goal, o.i, CASE WHEN w.cur < w.goal AND (w.cur + o.pairs <= w.goal OR abs(w.goal - w.cur - o.pairs) < abs(w.goal - w.cur)) THEN w.cur + o.pairs ELSE w.cur END, o.component,
  w.cur < w.goal AND (w.cur + o.pairs <= w.goal OR abs(w.goal - w.cur - o.pairs) < abs(w.goal - w.cur))
  FROM walk w JOIN ordered o ON w.category = o.category AND o.i = w.i + 1),
chosen AS (SELECT component, category FROM walk WHERE taken)"""

SPLIT = f"""{with_views("pairs_part")}, {BLOCKS}, {WALK},
sp AS (SELECT id1, id2, target, l.category, c.component IS NOT NULL AS is_val FROM labelled l LEFT JOIN chosen c ON l.component = c.component)"""


def _quota(capacity: str, count: str, name: str = "quota") -> str:
    """A loop over rounds would do; this is the level by trying every one: the largest that doesn't go beyond the count."""
    return f"""
{name}_c AS (SELECT category, capacity, {count} AS cnt FROM {capacity}),
{name}_l AS (SELECT coalesce(max(l), 0) AS level FROM (SELECT l, sum(least(capacity, l)) AS s, any_value(cnt) AS cnt FROM {name}_c, (SELECT unnest(range(0, (SELECT max(capacity) + 1 FROM {name}_c))) AS l) GROUP BY l) WHERE s <= cnt),
{name}_q AS (SELECT category, capacity, cnt, least(capacity, level) AS q FROM {name}_c, {name}_l),
{name}_r AS (SELECT *, cnt - sum(q) OVER () AS rest, row_number() OVER (ORDER BY (capacity > q) DESC, capacity - q DESC, category DESC) AS turn FROM {name}_q),
{name} AS (SELECT category, capacity::BIGINT AS capacity, (q + CASE WHEN capacity > q AND turn <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM {name}_r)"""


BY_LANG = "docs AS (SELECT doc_id, lang AS category FROM documents), cap AS (SELECT category, count(*) AS capacity FROM docs GROUP BY category)"
LANG_COUNT = "(SELECT count(*) * 3 // 5 FROM docs)"
VAL = "val AS (SELECT id FROM items_part WHERE id % 11 = 0)"
ABLE = "able AS (SELECT * FROM soft_pairs WHERE (target >= 0.7::DOUBLE OR target <= 0.3::DOUBLE) AND id1 NOT IN (SELECT id FROM val) AND id2 NOT IN (SELECT id FROM val))"
HARD = f"""hard AS (SELECT id1, id2, target, category FROM (SELECT p.*, row_number() OVER (PARTITION BY category ORDER BY cross_encoder_score DESC, id1, id2) AS k
 FROM pairs_part p JOIN scores USING (id1, id2) WHERE target <= 0.0) WHERE k <= {HARD_NEGATIVES})"""


def _drawn(name: str, where: str, seed: int) -> str:
    return f"""
{name}_rows AS (SELECT * FROM able WHERE {where}), {name}_cap AS (SELECT category, count(*) AS capacity FROM {name}_rows GROUP BY category),
{_quota(f"{name}_cap", f"(SELECT count(*) // 2 FROM {name}_rows)", f"{name}_quota")},
{name} AS (SELECT id1, id2, target, r.category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('{seed}|' || id1 || '|' || id2)) AS k FROM {name}_rows) r JOIN {name}_quota q ON r.category = q.category WHERE k <= quota)"""


JOINT = f"""{with_views("items_part", "pairs_part", "soft_pairs", "scores")}, {VAL}, {ABLE}, {HARD},{_drawn("high", "target >= 0.7::DOUBLE", SEED)},{_drawn("low", "target <= 0.3::DOUBLE", SEED + 1)},
once AS (SELECT *, 'soft_high' AS origin FROM high UNION ALL SELECT *, 'soft_low' FROM low UNION ALL SELECT id1, id2, target, category, 'human' FROM pairs_part, range(4)
 UNION ALL SELECT *, 'hard' FROM hard),
joint AS (SELECT id1, id2, target, category, origin FROM once UNION ALL SELECT id2, id1, target, category, origin FROM once)"""

ORACLE_SQL = {
    "item_text_render": f"""{with_views("items_part")}
SELECT id, 'Name: ' || name || ' Category: ' || category || ' Attributes: brand: ' || brand || ' size: ' || size AS text, category FROM items_part""",
    "clean_compact_text": rf"""SELECT p_partkey AS id, {CLEAN.format("p_name")} AS name_clean, {CLEAN.format("'  ' || upper(p_name) || chr(9) || chr(10) || p_brand || ' '")} AS raw_clean,
 regexp_replace({CLEAN.format("'  ' || upper(p_name) || chr(9) || chr(10) || p_brand || ' '")}, '[^0-9a-z]+', '', 'g') AS name_compact FROM part""",
    "number_tokens": f"""{with_views("items_part")}, {RECORDS}
SELECT id, array_to_string(numbers, ' ') AS numbers, array_to_string(codes, ' ') AS codes FROM records""",
    "item_records": f"""{with_views("items_part")}, {RECORDS}
SELECT id, category, name_compact, name_len, '{{"brand":"' || brand || '","size":"' || size || '"}}' AS attributes FROM records""",
    "pair_lookup_join": f"""{with_views("items_part", "pairs_part")}
SELECT id1, id2, l.name AS name1, r.name AS name2 FROM pairs_part JOIN items_part l ON id1 = l.id JOIN items_part r ON id2 = r.id""",
    "missing_ids_check": f"""{with_views("items_part", "pairs_part")}, {SOME_ITEMS}
SELECT id FROM (SELECT id1 AS id FROM pairs_part UNION SELECT id2 FROM pairs_part) WHERE id NOT IN (SELECT id FROM some_items) ORDER BY id LIMIT 10""",
    "needed_items": f"""{with_views("items_part", "pairs_part")}
SELECT id, category FROM items_part WHERE id IN (SELECT id1 FROM pairs_part UNION SELECT id2 FROM pairs_part)""",
    "category_fallback_join": f"""{with_views("items_part", "pairs_part")}, {SOME_ITEMS}, named AS (SELECT id, coalesce(category, '<NULL>') AS c FROM some_items)
SELECT id1, id2, target, coalesce(a.c, b.c, '<NULL>') AS category FROM pairs_part LEFT JOIN named a ON id1 = a.id LEFT JOIN named b ON id2 = b.id""",
    "pair_features_core": f"""{with_views("items_part", "pairs_part")}, {RECORDS}, {PAIRED}
SELECT id1, id2, (target >= 0.5)::BIGINT AS target, category, (k1 = k2)::BIGINT AS name_exact, round({SIMILARITY}, 6) AS name_similarity, round({_jac("t1", "t2")}, 6) AS name_token_jaccard,
 n1 AS name_length_a, n2 AS name_length_b, abs(n1 - n2) AS name_length_diff, ({COMMON.format("a", "b")} > 0)::BIGINT AS number_match, (len(a) > 0 AND len(b) > 0 AND {COMMON.format("a", "b")} = 0)::BIGINT AS number_conflict,
 len(a) AS numbers_a_count, len(b) AS numbers_b_count, {COMMON.format("a", "b")} AS numbers_intersection_count, {UNION.format("a", "b")} AS numbers_union_count, round({_jac("a", "b")}, 6) AS numbers_jaccard,
 ({COMMON.format("c", "d")} > 0)::BIGINT AS model_token_match, (len(c) > 0 AND len(d) > 0 AND {COMMON.format("c", "d")} = 0)::BIGINT AS model_token_conflict, len(c) AS model_tokens_a_count, len(d) AS model_tokens_b_count,
 {COMMON.format("c", "d")} AS model_token_intersection_count FROM p""",
    "pair_features_attrs": f"""{with_views("items_part", "pairs_part")}, {RECORDS}, {PAIRED}, e AS (SELECT *, (brand1 = brand2)::BIGINT + (size1 = size2)::BIGINT AS eq FROM p)
SELECT id1, id2, 2::BIGINT AS common_attribute_keys, eq AS equal_attribute_values, 2 - eq AS different_attribute_values, round(eq / 2.0::DOUBLE, 6) AS equal_value_fraction, round((2 - eq) / 2.0::DOUBLE, 6) AS different_value_fraction FROM e""",
    "attribute_stats": f"""{with_views("pairs_part")}
SELECT category, attribute, count(*)::BIGINT AS pairs_with_attribute_both FROM pairs_part, (SELECT unnest(['brand', 'size']) AS attribute) GROUP BY category, attribute""",
    "attribute_states": f"""{with_views("items_part", "pairs_part")}, {RECORDS}, {PAIRED}, big AS (SELECT category FROM pairs_part GROUP BY category HAVING count(*) >= {MIN_SUPPORT})
SELECT id1, id2, 'brand' AS attribute, CASE WHEN brand1 = brand2 THEN 1 ELSE 2 END::BIGINT AS state FROM p WHERE category IN (SELECT category FROM big)
UNION ALL SELECT id1, id2, 'size', CASE WHEN size1 = size2 THEN 1 ELSE 2 END::BIGINT FROM p WHERE category IN (SELECT category FROM big)""",
    "ap_per_category": f"{with_views('metric_rows')}, {_ap('metric_rows', 'category')}\nSELECT category, {AP_OUT} FROM ap",
    "ap_overall": f"{with_views('metric_rows')}, {_ap('metric_rows', None)}\nSELECT {AP_OUT} FROM ap",
    "macro_ap_skip": _macro("average_precision", "average_precision IS NOT NULL"),
    "macro_ap_two_classes": _macro("average_precision", "positives > 0 AND positives < pairs"),
    "macro_ap_zero": _macro("coalesce(average_precision, 0.0::DOUBLE)", "TRUE"),
    "baseline_report": f"{BASELINE}\nSELECT experiment, category, {AP_OUT} FROM ap",
    "experiment_summary": f"{BASELINE}\nSELECT experiment, round(avg(average_precision), 6) AS macro_average_precision FROM ap GROUP BY experiment",
    "cosine_pair_ap": f"""WITH v AS (SELECT a.vec_id AS id1, b.vec_id AS id2, (a.label = b.label)::INT AS target, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
 FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 8), {_ap("v", None)}
SELECT {AP_OUT} FROM ap""",
    "component_labels_blocks": """WITH b AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_type, p_name) AS component, count(*) OVER (PARTITION BY p_type, p_name) AS n FROM part)
SELECT p_partkey AS node, component FROM b WHERE n > 1""",
    "component_labels_chains": """WITH b AS (SELECT event_id, min(event_id) OVER (PARTITION BY user_id) AS component, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id AS node, component FROM b WHERE n > 1""",
    "component_rollup": f"{with_views('pairs_part')}, {BLOCKS}\nSELECT * FROM comp",
    "val_component_selection": f"{with_views('pairs_part')}, {BLOCKS}, {WALK}\nSELECT * FROM chosen",
    "split_pairs": f"{SPLIT}\nSELECT * FROM sp",
    "split_stats": f"""{SPLIT}, ends AS (SELECT is_val, count(*)::BIGINT AS items FROM (SELECT is_val, id1 AS id FROM sp UNION SELECT is_val, id2 FROM sp) GROUP BY is_val)
SELECT sp.is_val, count(*)::BIGINT AS rows, sum((target >= 0.5)::INT)::BIGINT AS positives, round(avg((target >= 0.5)::INT::DOUBLE), 6) AS positive_rate, count(DISTINCT category)::BIGINT AS categories, any_value(items) AS items
 FROM sp JOIN ends ON sp.is_val = ends.is_val GROUP BY sp.is_val""",
    "quota_waterfill": f"WITH {BY_LANG}, {_quota('cap', LANG_COUNT)}\nSELECT * FROM quota",
    "balanced_sample": f"""WITH {BY_LANG}, {_quota("cap", LANG_COUNT)}
SELECT doc_id, r.category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('{SEED}|' || doc_id)) AS k FROM docs) r JOIN quota q ON r.category = q.category WHERE k <= quota""",
    "confident_antijoin": f"{with_views('items_part', 'pairs_part', 'soft_pairs')}, {VAL}, {ABLE}\nSELECT * FROM able",
    "hard_negatives_topk": f"{with_views('pairs_part', 'scores')}, {HARD}\nSELECT * FROM hard",
    "human_repeat_reverse": f"""{with_views("pairs_part")}, h AS (SELECT id1, id2, target, category FROM pairs_part, range(4) WHERE target >= 0.5)
SELECT id1, id2, target, category FROM h UNION ALL SELECT id2, id1, target, category FROM h""",
    "joint_dataset": f"{JOINT}\nSELECT id1, id2, target, category, origin FROM joint",
    "joint_summary": f"{JOINT}\nSELECT origin, category, count(*)::BIGINT AS rows, sum((target >= 0.5)::INT)::BIGINT AS positives FROM joint GROUP BY origin, category",
    "hard_fp_fn": f"""{with_views("items_part", "pairs_part", "scores")}, {RECORDS}, s AS (SELECT p.id1, p.id2, p.target, cross_encoder_score AS score FROM pairs_part p JOIN scores c ON p.id1 = c.id1 AND p.id2 = c.id2),
e AS ((SELECT 'false_positive' AS kind, id1, id2, score FROM s WHERE target < 0.5 ORDER BY score DESC, id1, id2 LIMIT {TOP}) UNION ALL (SELECT 'false_negative', id1, id2, score FROM s WHERE target >= 0.5 ORDER BY score, id1, id2 LIMIT {TOP}))
SELECT kind, id1, id2, score, l.name AS name1, '{{"brand":"' || l.brand || '","size":"' || l.size || '"}}' AS attributes1, r.name AS name2, '{{"brand":"' || r.brand || '","size":"' || r.size || '"}}' AS attributes2
 FROM e JOIN records l ON id1 = l.id JOIN records r ON id2 = r.id""",
    "target_histogram": f"{with_views('pairs_part', 'soft_pairs')}\nSELECT floor(target * 10)::BIGINT AS tenth, count(*)::BIGINT AS rows FROM soft_pairs GROUP BY 1",
    "id_signature": f"""{with_views("pairs_part")}, i AS (SELECT id1 AS x FROM pairs_part UNION SELECT id2 FROM pairs_part)
SELECT count(*)::BIGINT AS n, sum(x)::BIGINT AS total, min(x) AS least, max(x) AS greatest, bit_xor(('0x' || substr(md5(x::VARCHAR), 1, 15))::BIGINT) AS hash, any_value(sha256) AS sha256 FROM i,
 (SELECT sha256(string_agg(digest, '' ORDER BY k)) AS sha256 FROM (SELECT floor(x / 65536.0)::BIGINT AS k, sha256(string_agg(x || chr(10), '' ORDER BY x)) AS digest FROM i GROUP BY k))""",
    "text_pair_score": f"""{with_views("items_part", "pairs_part")},
t AS (SELECT id, list_distinct(string_split('Name: ' || name || ' Category: ' || category || ' Attributes: brand: ' || brand || ' size: ' || size, ' ')) AS ws FROM items_part)
SELECT id1, id2, round({COMMON.format("l.ws", "r.ws")}::DOUBLE / {UNION.format("l.ws", "r.ws")}::DOUBLE, 6) AS predict FROM pairs_part JOIN t l ON id1 = l.id JOIN t r ON id2 = r.id""",
}

_WORDS = "t AS (SELECT id, list_distinct(string_split('Name: ' || name || ' Category: ' || category || ' Attributes: brand: ' || brand || ' size: ' || size, ' ')) AS ws FROM items_part)"
_SHARE = f"{COMMON.format('l.ws', 'r.ws')}::DOUBLE / {UNION.format('l.ws', 'r.ws')}::DOUBLE"

ORACLE_SQL |= {
    "submission": f"""{with_views("items_part", "pairs_part")}, {_WORDS}, twice AS (SELECT id1, id2 FROM pairs_part UNION ALL SELECT id1, id2 FROM pairs_part WHERE id1 % 5 = 0)
SELECT id1, id2, round({_SHARE}, 6) AS predict FROM twice JOIN t l ON id1 = l.id JOIN t r ON id2 = r.id""",
    "logit_heads": f"""{with_views("pairs_part")}, x AS (SELECT id1, id2, (id1 - id2)::DOUBLE / 7.0::DOUBLE AS x FROM pairs_part)
SELECT id1, id2, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, x)))), 6) AS one,
 round(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-700.0::DOUBLE, least(700.0::DOUBLE, -2.0::DOUBLE * x)))), 6) AS two FROM x""",
    "csv_statistics": ORACLE_SQL["attribute_stats"],
    "feature_table": f"""{with_views("items_part", "pairs_part")}, {RECORDS}, {PAIRED}
SELECT id1, id2, (target >= 0.5)::BIGINT AS target, category, n1::DOUBLE AS name_length_a, len(a)::DOUBLE AS numbers_a_count, 0.0::DOUBLE AS attr_state__none, count(*) OVER () AS rows FROM p""",
    "split_checks": f"""{SPLIT}, ends AS (SELECT DISTINCT is_val, id1 AS id FROM sp UNION SELECT is_val, id2 FROM sp),
mixed AS (SELECT component FROM labelled GROUP BY component HAVING count(DISTINCT category) > 1),
both_ AS (SELECT id FROM (SELECT component, id1 AS id FROM labelled UNION SELECT component, id2 FROM labelled) GROUP BY id HAVING count(DISTINCT component) > 1)
SELECT (SELECT count(*) FROM (SELECT id FROM ends GROUP BY id HAVING count(*) > 1)) AS shared_items, (SELECT count(*) FROM mixed) AS mixed_components, (SELECT count(*) FROM both_) AS items_of_two_components""",
    "mined_summary": f"""{with_views("items_part", "pairs_part")}, {_WORDS},
h AS (SELECT p.category, row_number() OVER (PARTITION BY p.category ORDER BY {_SHARE} DESC, id1, id2) AS k FROM pairs_part p JOIN t l ON id1 = l.id JOIN t r ON id2 = r.id WHERE target <= 0.0)
SELECT 'hard' AS origin, category, 2 * count(*)::BIGINT AS rows, 0::BIGINT AS positives FROM h WHERE k <= 50 GROUP BY category
UNION ALL SELECT 'human', category, 4 * count(*)::BIGINT, 4 * sum((target >= 0.5)::INT)::BIGINT FROM pairs_part GROUP BY category""",
}
