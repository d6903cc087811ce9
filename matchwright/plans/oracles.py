"""SQL (DuckDB) with the results of the registered queries, written from the operators' definitions."""

from __future__ import annotations

import re

from ..functions.text import ADDRESS_WORDS, LEGAL_SUFFIXES


def _norm(x: str, words: dict | None = None, keep: str = r"\p{L}\p{N}_") -> str:
    out = rf"trim(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^{keep}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    if words:
        case = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " ELSE t END"
        out = f"array_to_string(list_transform(string_split({out}, ' '), lambda t: {case}), ' ')"
    return out


def _ascii(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(trim(lower({x})), '&', ' and '), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def _toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _jac(a: str, b: str, empty: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::double END"


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - 2, 0) + 1), lambda i: substring({x}, i, 3)))"


def _topk(field: str, k: int, window: str = "true") -> str:
    return f"""
  SELECT source1_entity_id, candidate_entity_id, candidate_source, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY source1_entity_id, candidate_source ORDER BY similarity DESC, candidate_entity_id) AS rk FROM (
      SELECT q.entity_id AS source1_entity_id, t.entity_id AS candidate_entity_id, t.src AS candidate_source,
        count(*) / (any_value(q.n) + any_value(t.n) - count(*))::double AS similarity
      FROM grams_{field} q JOIN grams_{field} t USING (country, gram) WHERE q.src = 'S1' AND t.src <> 'S1' AND {window} GROUP BY ALL))
  WHERE rk <= {k}"""


def _exact(field: str, cap: str = "") -> str:
    targets = f"(SELECT * FROM norm WHERE src <> 'S1' AND {field} <> '' {cap})"
    return f"SELECT DISTINCT q.entity_id AS source1_entity_id, t.entity_id AS candidate_entity_id, t.src AS candidate_source FROM norm q JOIN {targets} t USING (country, {field}) WHERE q.src = 'S1'"


def _combined(parts: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT source1_entity_id, candidate_entity_id, candidate_source, {k} AS p FROM {name}" for k, name in enumerate(parts))
    names = "['exact_name', 'exact_address', 'name_similarity', 'address_similarity']"
    return f"SELECT source1_entity_id, candidate_entity_id, candidate_source, candidate_source AS source, {names}[min(p) + 1] AS strategy FROM ({union}) GROUP BY ALL"


_RATES = """CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::double END AS precision,
  CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn)::double END AS recall"""
_MACRO = """count(*)::bigint AS entities, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f), 6) AS macro_f0_5,
  sum(tp)::bigint AS total_tp, sum(fp)::bigint AS total_fp, sum(fn)::bigint AS total_fn,
  count(*) FILTER (tp + fn = 0)::bigint AS zero_match_entities, count(*) FILTER (tp + fn = 1)::bigint AS singleton_entities,
  count(*) FILTER (tp + fn = 0 AND tp + fp = 0)::bigint AS correctly_empty, round(min(f), 6) AS min_f0_5, round(max(f), 6) AS max_f0_5"""
_F = "CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 WHEN 0.25 * precision + recall = 0 THEN 0.0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS f"
_STATS = """SELECT *, total_ground_truth_matches - candidate_present AS candidate_missing,
  CASE WHEN total_ground_truth_matches = 0 THEN 0.0 ELSE candidate_present / total_ground_truth_matches::double END AS candidate_recall FROM
  (SELECT count(*) AS total_ground_truth_matches, count(*) FILTER (c.source1_entity_id IS NOT NULL) AS candidate_present
   FROM pairs_true t LEFT JOIN {c} c ON c.source1_entity_id = t.source1_entity_id AND c.candidate_entity_id = t.true_entity_id),
  (SELECT sum(n) AS total_candidate_pairs, round_even(avg(n), 4) AS average_candidates_per_s1, quantile_cont(n, 0.5) AS median_candidates_per_s1, max(n) AS maximum_candidates_per_s1
   FROM (SELECT t.source1_entity_id, count(c.candidate_entity_id) AS n FROM truth t LEFT JOIN {c} c USING (source1_entity_id) GROUP BY 1))"""
_ALL4 = "'exact_name_blocking|exact_address_blocking|name_similarity|address_similarity'"
_RUNS = r"list_distinct(regexp_extract_all({}, '\p{{Nd}}+'))"

#: Common table expressions; each may use those before it.
CTES = {
    "proj": "SELECT doc_id, 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, 'S' || (1 + doc_id % 3) AS src, substring(coalesce(text, ''), 1, 60) AS business_name, substring(coalesce(text, ''), 61, 80) AS business_address, coalesce(lang, '') AS country, coalesce(text, '') AS text FROM documents",
    "norm": f"SELECT doc_id, entity_id, src, business_name, business_address, {_norm('business_name', LEGAL_SUFFIXES)} AS name, {_norm('business_address', ADDRESS_WORDS)} AS address, {_norm('country')} AS country FROM proj",
    "tails": f"SELECT entity_id, src, country, right({_norm('text')}, 60) AS tail FROM proj",
    "truth": "SELECT a.entity_id AS source1_entity_id, coalesce(string_agg(b.entity_id, ',' ORDER BY b.entity_id), '') AS matched_entity_ids FROM tails a LEFT JOIN tails b ON b.src <> 'S1' AND a.country = b.country AND a.tail = b.tail WHERE a.src = 'S1' GROUP BY 1",
    "pairs_true": "SELECT source1_entity_id, x AS true_entity_id, substr(x, 1, 2) AS true_source FROM (SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS x FROM truth) WHERE x <> ''",
    "grams_name": f"SELECT entity_id, src, doc_id, country, len({_grams('name')}) AS n, unnest({_grams('name')}) AS gram FROM norm WHERE country <> ''",
    "grams_address": f"SELECT entity_id, src, doc_id, country, len({_grams('address')}) AS n, unnest({_grams('address')}) AS gram FROM norm WHERE country <> ''",
    "exact_name": _exact("name"),
    "exact_address": _exact("address"),
    "near_name": _topk("name", 10),
    "near_address": _topk("address", 10),
    "cand": _combined(["exact_name", "exact_address", "near_name", "near_address"]),
    **{f"near_name_{k}": _topk("name", k) for k in (2, 4)},
    **{f"near_address_{k}": _topk("address", k) for k in (2, 4)},
    **{f"cand_{k}": _combined(["exact_name", "exact_address", f"near_name_{k}", f"near_address_{k}"]) for k in (2, 4)},
    "cand_exact": _combined(["exact_name", "exact_address"]),
    "feats": f"""SELECT c.source1_entity_id, c.candidate_entity_id, c.candidate_source,
      (a.name = b.name)::bigint AS name_exact_match, (a.name = b.name)::bigint AS normalized_name_exact, {_jac(_toks("a.name"), _toks("b.name"), "0.0")} AS name_token_jaccard,
      len(list_intersect({_toks("a.name")}, {_toks("b.name")}))::bigint AS shared_name_token_count, abs(length(a.name) - length(b.name))::bigint AS name_length_difference,
      CASE WHEN greatest(length(a.name), length(b.name)) = 0 THEN 0.0 ELSE least(length(a.name), length(b.name)) / greatest(length(a.name), length(b.name))::double END AS name_length_ratio,
      (a.name = '')::bigint AS name_missing_s1, (b.name = '')::bigint AS name_missing_target,
      (a.address = b.address)::bigint AS address_exact_match, (a.address = b.address)::bigint AS normalized_address_exact, {_jac(_toks("a.address"), _toks("b.address"), "0.0")} AS address_token_jaccard,
      len(list_intersect({_toks("a.address")}, {_toks("b.address")}))::bigint AS shared_address_token_count, abs(length(a.address) - length(b.address))::bigint AS address_length_difference,
      CASE WHEN greatest(length(a.address), length(b.address)) = 0 THEN 0.0 ELSE least(length(a.address), length(b.address)) / greatest(length(a.address), length(b.address))::double END AS address_length_ratio,
      (a.address = '')::bigint AS address_missing_s1, (b.address = '')::bigint AS address_missing_target,
      abs(len({_toks("a.name")}) - len({_toks("b.name")}))::bigint AS name_token_count_difference,
      len(list_intersect(regexp_extract_all(a.address, '\\p{{Nd}}'), regexp_extract_all(b.address, '\\p{{Nd}}')))::bigint AS shared_digit_count,
      len(list_intersect(regexp_extract_all(a.address, '\\p{{Nd}}'), regexp_extract_all(b.address, '\\p{{Nd}}')))::bigint AS address_digit_overlap,
      (a.country = b.country)::bigint AS country_exact_match, (c.candidate_source = 'S2')::bigint AS same_source_indicator,
      (a.name = b.name AND a.address = b.address)::bigint AS name_and_address_exact, (a.name = b.name OR a.address = b.address)::bigint AS name_or_address_exact,
      (a.name = '' AND b.name = '' AND a.address = '' AND b.address = '')::bigint AS both_name_address_missing
      FROM cand c JOIN norm a ON a.entity_id = c.source1_entity_id JOIN norm b ON b.entity_id = c.candidate_entity_id""",
    "preds": "SELECT f.source1_entity_id, f.candidate_entity_id, f.candidate_source, (name_token_jaccard + address_token_jaccard) / 2 AS match_probability, (t.true_entity_id IS NOT NULL)::int AS ground_truth_label FROM feats f LEFT JOIN pairs_true t ON t.source1_entity_id = f.source1_entity_id AND t.true_entity_id = f.candidate_entity_id",
    "ent": f"""SELECT *, {_F} FROM (SELECT *, {_RATES} FROM (
      SELECT source1_entity_id, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn,
        coalesce(string_agg(id, ',' ORDER BY id) FILTER (t), '') AS true_ids, coalesce(string_agg(id, ',' ORDER BY id) FILTER (p), '') AS predicted_ids
      FROM (SELECT source1_entity_id, id, bool_or(t) AS t, bool_or(p) AS p FROM (
        SELECT source1_entity_id, true_entity_id AS id, true AS t, false AS p FROM pairs_true UNION ALL
        SELECT source1_entity_id, candidate_entity_id, false, true FROM preds WHERE match_probability >= 0.5 UNION ALL
        SELECT source1_entity_id, NULL, false, false FROM truth) GROUP BY ALL) GROUP BY 1))""",
    "sweep": f"""SELECT threshold, {_MACRO} FROM (SELECT *, {_F} FROM (SELECT *, {_RATES} FROM (
      SELECT threshold, source1_entity_id, count(*) FILTER (ground_truth_label = 1 AND match_probability >= threshold) AS tp,
        count(*) FILTER (ground_truth_label = 0 AND match_probability >= threshold) AS fp, count(*) FILTER (ground_truth_label = 1 AND match_probability < threshold) AS fn
      FROM preds, (SELECT unnest(list_transform(range(2, 20), lambda i: round(0.05 * i, 2)))::double AS threshold) GROUP BY ALL))) GROUP BY 1""",
    "errors": """SELECT *, CASE WHEN error_type IN ('false_positive', 'false_negative') AND (name_exact_match = 1 OR address_exact_match = 1) THEN 'exact_match_error'
        WHEN name_token_jaccard < 0.5 AND address_token_jaccard < 0.5 THEN 'weak_similarity_error' ELSE '' END AS secondary_error_type FROM (
      SELECT p.match_probability, p.ground_truth_label::bigint AS ground_truth_label, f.*,
        CASE WHEN p.match_probability >= 0.45 AND ground_truth_label = 1 THEN 'true_positive' WHEN p.match_probability >= 0.45 THEN 'false_positive' WHEN ground_truth_label = 1 THEN 'false_negative' ELSE 'negative_unselected' END AS error_type,
        (p.match_probability >= 0.45 AND p.match_probability >= max(p.match_probability) OVER w - 0.05 AND count(*) FILTER (p.match_probability >= 0.45) OVER w > 1)::bigint AS ambiguity_flag
      FROM preds p JOIN feats f USING (source1_entity_id, candidate_entity_id, candidate_source) WINDOW w AS (PARTITION BY p.source1_entity_id)) WHERE error_type <> 'negative_unselected'""",
    "scalar": rf"SELECT entity_id, {_norm('business_name', LEGAL_SUFFIXES, r'\p{L}\p{N}\p{M}')} AS name, {_norm('business_address', ADDRESS_WORDS, r'\p{L}\p{N}\p{M}')} AS address, {_norm('country', None, r'\p{L}\p{N}\p{M}')} AS country FROM proj",
    "misses": f"""SELECT source1_entity_id, true_entity_id, true_source, n1 AS normalized_name_s1, n2 AS normalized_name_true, a1 AS normalized_address_s1, a2 AS normalized_address_true, c1 AS country_s1, c2 AS country_true,
        round_even(ns, 6) AS name_similarity, round_even(sa, 6) AS address_similarity, round_even(ds, 6) AS digit_similarity, r[1] AS candidate_missing_reason, r[2] AS failed_strategy FROM (
      SELECT *, CASE
        WHEN c1 <> '' AND c2 <> '' AND c1 <> c2 THEN ['country_mismatch', {_ALL4}]
        WHEN n1 = '' AND a1 = '' THEN ['missing_both_fields_s1', 'all_strategies']
        WHEN n2 = '' AND a2 = '' THEN ['missing_both_fields_target', 'all_strategies']
        WHEN (n1 = '' OR n2 = '') AND sa < 0.5 THEN ['missing_name_and_weak_address', 'exact_name_blocking|name_similarity|exact_address_blocking|address_similarity']
        WHEN n1 = '' OR n2 = '' THEN ['missing_name_field', 'exact_name_blocking|name_similarity']
        WHEN (a1 = '' OR a2 = '') AND ns < 0.5 THEN ['missing_address_and_weak_name', 'exact_address_blocking|address_similarity|exact_name_blocking|name_similarity']
        WHEN a1 = '' OR a2 = '' THEN ['missing_address_field', 'exact_address_blocking|address_similarity']
        WHEN n1 = n2 AND a1 = a2 THEN ['unexpected_miss_both_exact', 'unexpected_exact_block_failure']
        WHEN ns < 0.5 AND sa < 0.5 THEN ['both_name_and_address_weak', {_ALL4}]
        WHEN sa < 0.5 THEN [CASE WHEN len(d1) > 0 AND len(d2) > 0 AND list_sort(d1) <> list_sort(d2) THEN 'address_digit_variation' WHEN sa < 0.3 THEN 'address_token_order_or_variation' ELSE 'address_similarity_below_top_k_threshold' END, 'address_similarity|exact_address_blocking']
        WHEN ns < 0.5 THEN [CASE WHEN ns >= 0.5 THEN 'name_token_order_variation' WHEN len(list_intersect(t1, t2)) > 0 THEN 'name_abbreviation_or_suffix_variation' ELSE 'name_variation_no_shared_tokens' END, 'name_similarity|exact_name_blocking']
        WHEN ns >= 0.75 AND sa < 0.75 THEN ['address_variation_near_threshold', 'address_similarity|exact_address_blocking']
        WHEN sa >= 0.75 AND ns < 0.75 THEN ['name_variation_near_threshold', 'name_similarity|exact_name_blocking']
        WHEN ns >= 0.75 AND sa >= 0.75 THEN ['near_match_outside_top_k', 'name_similarity|address_similarity']
        ELSE ['moderate_similarity_below_retrieval_threshold', 'name_similarity|address_similarity'] END AS r FROM (
      SELECT t.*, a.name AS n1, b.name AS n2, a.address AS a1, b.address AS a2, a.country AS c1, b.country AS c2, {_toks("a.name")} AS t1, {_toks("b.name")} AS t2,
        {_jac(_toks("a.name"), _toks("b.name"), "1.0")} AS ns, {_jac(_toks("a.address"), _toks("b.address"), "1.0")} AS sa, {_RUNS.format("a.address")} AS d1, {_RUNS.format("b.address")} AS d2,
        {_jac(_RUNS.format("a.address"), _RUNS.format("b.address"), "1.0")} AS ds
      FROM pairs_true t ANTI JOIN cand_exact c ON c.source1_entity_id = t.source1_entity_id AND c.candidate_entity_id = t.true_entity_id
      JOIN scalar a ON a.entity_id = t.source1_entity_id JOIN scalar b ON b.entity_id = t.true_entity_id))""",
    "tf_pairs": f"SELECT source1_entity_id, candidate_entity_id, candidate_source FROM exact_address UNION SELECT source1_entity_id, candidate_entity_id, candidate_source FROM near_name_2",
    "tf_named": "SELECT p.*, a.name AS n1, b.name AS n2 FROM tf_pairs p JOIN norm a ON a.entity_id = p.source1_entity_id JOIN norm b ON b.entity_id = p.candidate_entity_id",
    "tf_names": "SELECT n1 AS name FROM tf_named UNION SELECT n2 FROM tf_named",
    "tf": "SELECT name, gram, count(*) AS tf FROM (SELECT name, unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(name) - n + 1, 0) + 1), lambda i: substring(name, i, n))))) AS gram FROM tf_names) GROUP BY ALL",
    "tf_w": "SELECT name, gram, tf * (ln((1 + (SELECT count(*) FROM tf_names)) / (1 + df)::double) + 1) AS w FROM tf JOIN (SELECT gram, count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, gram LIMIT 65536) USING (gram)",
    "tf_u": "SELECT name, gram, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS u FROM tf_w",
    "noise": f"""SELECT t.source1_entity_id, t.true_entity_id, a.business_name AS n1, b.business_name AS n2, a.business_address AS a1, b.business_address AS a2, {_ascii("a.business_name")} <> {_ascii("b.business_name")} AS nd, {_ascii("a.business_address")} <> {_ascii("b.business_address")} AS ad
      FROM pairs_true t JOIN proj a ON a.entity_id = t.source1_entity_id JOIN proj b ON b.entity_id = t.true_entity_id""",
    "noise_rows": r"""SELECT 'name differences' AS kind, source1_entity_id, true_entity_id, n1 AS value_s1, n2 AS value_true FROM noise WHERE nd
      UNION ALL SELECT 'address differences', source1_entity_id, true_entity_id, a1, a2 FROM noise WHERE ad
      UNION ALL SELECT 'legal suffix or punctuation differences', source1_entity_id, true_entity_id, n1, n2 FROM noise WHERE nd AND regexp_matches(lower(n1) || ' ' || lower(n2), '\b(ltd|limited|inc|corp|llc|llp|pvt|private)\b|[^\p{L}\p{N}_\s]')
      UNION ALL SELECT 'address formatting differences', source1_entity_id, true_entity_id, a1, a2 FROM noise WHERE ad AND regexp_matches(lower(a1) || ' ' || lower(a2), '\b(st|street|rd|road|ave|avenue|blvd|boulevard)\b|[,.-]')""",
    "diag": """SELECT t.entity_id, t.n, t.country, t.country IN (SELECT country FROM norm WHERE src = 'S1' AND doc_id < 30 AND country <> '') AS near,
      EXISTS (SELECT 1 FROM norm s WHERE s.src = 'S1' AND s.doc_id < 30 AND s.country = t.country AND ((s.name = t.name AND (s.country <> '' OR s.name <> '')) OR (s.address = t.address AND (s.country <> '' OR s.address <> '')))) AS hit
      FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM norm WHERE src = 'S2') t WHERE n <= 150""",
}
_FEATS = [m for m in re.findall(r"AS (\w+)[,\s]", CTES["feats"])]
_NAMES = ("source1_entity_id", "candidate_entity_id", "candidate_source")
_ROUND = ", ".join(f"round({c}, 6) AS {c}" if c.endswith(("jaccard", "ratio")) else c for c in _FEATS)

FINAL = {
    "normalize_name": f"SELECT entity_id, {_norm('business_name', LEGAL_SUFFIXES)} AS value FROM proj",
    "normalize_address": f"SELECT entity_id, {_norm('business_address', ADDRESS_WORDS)} AS value FROM proj",
    "normalize_country": f"SELECT entity_id, {_norm('country')} AS value FROM proj",
    "normalize_scalar_mode": rf"SELECT entity_id, {_norm('business_address', None, r'\p{L}\p{N}\p{M}')} AS value FROM proj",
    "normalize_ascii": f"SELECT entity_id, {_ascii('business_address')} AS value FROM proj",
    "preprocess_fields": "SELECT entity_id, name AS business_name_normalized, address AS business_address_normalized, country AS country_normalized, "
    + ", ".join(f"array_to_string({_toks(f)}, '|') AS {f}_tokens, len({_toks(f)})::bigint AS {f}_token_count, length({f})::bigint AS {f}_length, {f} <> '' AS has_{f}, {f} = '' AS missing_{f}" for f in ("name", "address"))
    + " FROM norm",
    "exact_name_candidates": "SELECT * FROM exact_name",
    "exact_address_candidates": "SELECT * FROM exact_address",
    "exact_block_cap": _exact("name", "QUALIFY row_number() OVER (PARTITION BY src, country, name ORDER BY entity_id) = 1"),
    "name_similarity_topk": "SELECT * REPLACE (round(similarity, 6) AS similarity) FROM near_name",
    "address_similarity_topk": "SELECT * REPLACE (round(similarity, 6) AS similarity) FROM near_address",
    "bounded_similarity": f"SELECT * REPLACE (round(similarity, 6) AS similarity) FROM ({_topk('name', 10, 't.entity_id IN (SELECT entity_id FROM norm WHERE src <> $$S1$$ QUALIFY row_number() OVER (PARTITION BY src ORDER BY entity_id) <= 100)')})",
    "topk_growth": f"SELECT (SELECT count(*) FROM ({_topk('name', 5)}))::bigint AS pairs_k5, (SELECT count(*) FROM near_name)::bigint AS pairs_k10",
    "gram_intersection": f"SELECT entity_id, array_to_string(list_sort(list_intersect({_grams('name')}, {_grams('address')})), '|') AS common FROM norm",
    "combined_candidates": "SELECT * FROM cand",
    "block_stats": "SELECT s.entity_id AS source1_entity_id, x.candidate_source, "
    + ", ".join(f"(SELECT count(*) FROM {t} c WHERE c.source1_entity_id = s.entity_id AND c.candidate_source = x.candidate_source)::bigint AS {n}_count" for n, t in (("exact_name", "exact_name"), ("exact_address", "exact_address"), ("name_similarity", "near_name"), ("address_similarity", "near_address"), ("final_candidate", "cand")))
    + " FROM norm s, (SELECT unnest(['S2', 'S3']) AS candidate_source) x WHERE s.src = 'S1'",
    "candidate_lists": "SELECT source1_entity_id, string_agg(candidate_entity_id, ',' ORDER BY candidate_entity_id) AS candidate_entity_ids FROM cand GROUP BY 1",
    "candidate_recall": """SELECT x AS target, n::bigint AS true_matches, f::bigint AS recovered, round(CASE WHEN n = 0 THEN 1.0 ELSE f / n::double END, 6) AS recall, (n - f)::bigint AS missed FROM (
      SELECT x, count(t.true_entity_id) AS n, count(c.candidate_entity_id) AS f FROM (SELECT unnest(['S2', 'S3', 'ALL']) AS x) LEFT JOIN pairs_true t ON x = 'ALL' OR x = t.true_source
      LEFT JOIN cand c ON c.source1_entity_id = t.source1_entity_id AND c.candidate_entity_id = t.true_entity_id GROUP BY 1)""",
    "candidate_status": "SELECT t.*, CASE WHEN c.candidate_entity_id IS NULL THEN 'CANDIDATE_MISSING' ELSE 'CANDIDATE_PRESENT' END AS candidate_status FROM pairs_true t LEFT JOIN cand c ON c.source1_entity_id = t.source1_entity_id AND c.candidate_entity_id = t.true_entity_id",
    "recall_by_s1_counts": "SELECT total_ground_truth_matches::bigint AS total_ground_truth_matches, candidate_present::bigint AS candidate_present, candidate_missing::bigint AS candidate_missing, round(candidate_recall, 6) AS candidate_recall, total_candidate_pairs::bigint AS total_candidate_pairs, average_candidates_per_s1, median_candidates_per_s1::double AS median_candidates_per_s1, maximum_candidates_per_s1::bigint AS maximum_candidates_per_s1 FROM (" + _STATS.format(c="cand") + ")",
    "pair_features": f"SELECT {', '.join(_NAMES)}, {_ROUND} FROM feats",
    "tfidf_similarity": "SELECT source1_entity_id, candidate_entity_id, candidate_source, round(coalesce((SELECT sum(x.u * y.u) FROM tf_u x JOIN tf_u y USING (gram) WHERE x.name = n1 AND y.name = n2), 0.0), 6) AS name_tfidf_similarity FROM tf_named",
    "training_labels": "SELECT c.source1_entity_id, c.candidate_entity_id, c.candidate_source, (t.true_entity_id IS NOT NULL)::bigint AS label FROM cand c LEFT JOIN pairs_true t ON t.source1_entity_id = c.source1_entity_id AND t.true_entity_id = c.candidate_entity_id",
    "entity_metrics": "SELECT source1_entity_id, tp::bigint AS tp, fp::bigint AS fp, fn::bigint AS fn, true_ids, predicted_ids, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS f0_5 FROM ent",
    "macro_metrics": f"SELECT {_MACRO} FROM ent",
    "persisted_metrics": "SELECT * FROM sweep WHERE threshold = 0.5",
    "threshold_sweep": "SELECT * FROM sweep",
    "selected_threshold": "SELECT min(threshold) AS selected_threshold, count(*)::bigint AS tied FROM sweep WHERE macro_f0_5 = (SELECT max(macro_f0_5) FROM sweep)",
    "artifact_scope": "SELECT sum(ground_truth_label)::bigint AS positives, count(*)::bigint AS pairs, (SELECT count(*) FROM pairs_true SEMI JOIN preds USING (source1_entity_id))::bigint AS true_matches, sum(ground_truth_label) < (SELECT count(*) FROM pairs_true SEMI JOIN preds USING (source1_entity_id)) AS bounded FROM preds",
    "error_rows": """SELECT source1_entity_id, candidate_entity_id, candidate_source, error_type, secondary_error_type, ambiguity_flag, round(match_probability, 6) AS match_probability, ground_truth_label, name_exact_match,
      round(name_token_jaccard, 6) AS name_token_jaccard, round(name_token_jaccard, 6) AS name_char_similarity, address_exact_match, round(address_token_jaccard, 6) AS address_token_jaccard, round(address_token_jaccard, 6) AS address_char_similarity,
      country_exact_match, shared_name_token_count, shared_address_token_count, shared_digit_count, name_length_difference, address_length_difference, address_missing_target, same_source_indicator FROM errors""",
    "error_summary": "SELECT t AS error_type, (SELECT count(*) FROM errors WHERE error_type = t OR secondary_error_type = t OR (t = 'ambiguous' AND ambiguity_flag = 1))::bigint AS count FROM (SELECT unnest(['true_positive', 'false_positive', 'false_negative', 'ambiguous', 'exact_match_error', 'weak_similarity_error']) AS t)",
    "recall_analysis": """SELECT t.source1_entity_id, t.true_entity_id, t.true_source, CASE WHEN p.candidate_entity_id IS NULL THEN 'CANDIDATE_MISSING' ELSE 'CANDIDATE_PRESENT' END AS candidate_status, round(p.match_probability, 6) AS match_probability,
      f.name_exact_match::varchar AS name_exact_match, CASE WHEN f.name_exact_match IS NULL THEN (a.name = b.name AND a.name <> '')::int::varchar END AS name_exact, CASE WHEN f.name_exact_match IS NULL THEN a.name END AS normalized_name_s1, CASE WHEN f.name_exact_match IS NULL THEN a.country END AS country_s1,
      f.shared_name_token_count::varchar AS shared_name_token_count, f.name_length_difference::varchar AS name_length_difference, f.address_exact_match::varchar AS address_exact_match, f.shared_digit_count::varchar AS shared_digit_count, f.country_exact_match::varchar AS country_exact_match,
      coalesce(f.address_missing_target, (b.address = '')::int)::varchar AS address_missing_target, CASE WHEN f.name_exact_match IS NULL THEN b.name END AS normalized_name_target, CASE WHEN f.name_exact_match IS NULL THEN (a.address = b.address AND a.address <> '')::int::varchar END AS address_exact,
      CASE WHEN f.name_exact_match IS NULL THEN a.address END AS normalized_address_s1, CASE WHEN f.name_exact_match IS NULL THEN (a.address = '')::int::varchar END AS address_missing_s1, CASE WHEN f.name_exact_match IS NULL THEN b.country END AS country_target, CASE WHEN f.name_exact_match IS NULL THEN (a.country = b.country)::int::varchar END AS country_exact
      FROM pairs_true t LEFT JOIN preds p ON p.source1_entity_id = t.source1_entity_id AND p.candidate_entity_id = t.true_entity_id LEFT JOIN feats f ON f.source1_entity_id = t.source1_entity_id AND f.candidate_entity_id = t.true_entity_id
      JOIN scalar a ON a.entity_id = t.source1_entity_id JOIN scalar b ON b.entity_id = t.true_entity_id""",
    "recall_summary": """SELECT unnest(['total_ground_truth_matches', 'candidate_present_matches', 'candidate_missing_matches', 'candidate_generation_recall', 'candidate_present_above_threshold', 'candidate_present_below_threshold']) AS metric,
      unnest([n, p, n - p, round(CASE WHEN n = 0 THEN 0 ELSE p / n END, 6), a, p - a]) AS value FROM (SELECT count(*)::double AS n, count(p.candidate_entity_id)::double AS p, (count(*) FILTER (match_probability >= 0.45))::double AS a
      FROM pairs_true t LEFT JOIN preds p ON p.source1_entity_id = t.source1_entity_id AND p.candidate_entity_id = t.true_entity_id)""",
    "miss_categories": "SELECT * FROM misses",
    "failed_strategy_counts": "SELECT failed_strategy, count(*)::bigint AS misses FROM (SELECT unnest(string_split(failed_strategy, '|')) AS failed_strategy FROM misses) GROUP BY 1",
    "digit_similarity": f"SELECT e.*, round({_jac(_RUNS.format('a.address'), _RUNS.format('b.address'), '1.0')}, 6) AS digit_similarity FROM exact_name e JOIN norm a ON a.entity_id = e.source1_entity_id JOIN norm b ON b.entity_id = e.candidate_entity_id",
    "miss_recovery": "SELECT m.source1_entity_id, m.true_entity_id, m.true_source, 'CANDIDATE_MISSING' AS previous_status, CASE WHEN c.candidate_entity_id IS NULL THEN 'CANDIDATE_MISSING' ELSE 'CANDIDATE_PRESENT' END AS new_status, candidate_missing_reason AS previous_reason, CASE WHEN c.candidate_entity_id IS NULL THEN candidate_missing_reason ELSE '' END AS new_reason FROM misses m LEFT JOIN cand_2 c ON c.source1_entity_id = m.source1_entity_id AND c.candidate_entity_id = m.true_entity_id",
    "run_comparison": "SELECT metric, round(a, 6) AS baseline, round(b, 6) AS experimental, round(b - a, 6) AS absolute_change, round(CASE WHEN a <> 0 THEN (b - a) / abs(a) * 100 END, 6) AS percentage_change FROM (SELECT unnest(k) AS metric, unnest(x) AS a, unnest(y) AS b FROM (SELECT "
    + "['total_ground_truth_matches', 'candidate_present', 'candidate_missing', 'candidate_recall', 'total_candidate_pairs', 'average_candidates_per_s1', 'median_candidates_per_s1', 'maximum_candidates_per_s1'] AS k, "
    + ", ".join(f"(SELECT [total_ground_truth_matches::double, candidate_present, candidate_missing, candidate_recall, total_candidate_pairs, average_candidates_per_s1, median_candidates_per_s1, maximum_candidates_per_s1] FROM ({_STATS.format(c=f'cand_{k}')})) AS {v}" for k, v in ((2, "x"), (4, "y")))
    + "))",
    "truth_distribution": "SELECT matches, count(*)::bigint AS entities FROM (SELECT len(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> ''))::bigint AS matches FROM truth) GROUP BY 1",
    "truth_profile": "SELECT count(*)::bigint AS rows, count(*) FILTER (n = 0)::bigint AS empty_truth, count(*) FILTER (n = 1)::bigint AS single_truth, count(*) FILTER (n > 1)::bigint AS multiple_truth, (SELECT count(*) FROM pairs_true WHERE NOT regexp_matches(true_entity_id, '^S[23]-'))::bigint AS invalid_ids FROM (SELECT len(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '')) AS n FROM truth)",
    "source_profile": f"""SELECT *, rows - distinct_ids AS duplicate_ids, rows - distinct_names AS duplicate_names, rows - distinct_addresses AS duplicate_addresses FROM (
      SELECT src AS source, count(*)::bigint AS rows, count(*) FILTER (business_name = '')::bigint AS missing_business_name, count(*) FILTER (business_address = '')::bigint AS missing_business_address, count(*) FILTER (country = '')::bigint AS missing_country,
        count(DISTINCT entity_id)::bigint AS distinct_ids, count(DISTINCT country)::bigint AS countries, count(DISTINCT business_name)::bigint AS distinct_names, count(DISTINCT {_ascii("business_name")})::bigint AS distinct_normalized_names,
        count(DISTINCT business_address)::bigint AS distinct_addresses, count(DISTINCT {_ascii("business_address")})::bigint AS distinct_normalized_addresses, count(*) FILTER (NOT starts_with(entity_id, 'S'))::bigint AS bad_prefixes FROM proj GROUP BY 1)""",
    "length_stats": "SELECT src AS source, count(*)::bigint AS n, min(length(business_address))::bigint AS min_length, max(length(business_address))::bigint AS max_length, round(avg(length(business_address)), 6) AS mean_length, round(stddev_pop(length(business_address)), 6) AS std_length FROM proj GROUP BY 1",
    "country_overlap": "SELECT country, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM proj GROUP BY 1",
    "match_coverage": "SELECT count(*) FILTER (a)::bigint AS with_s2, count(*) FILTER (b)::bigint AS with_s3, count(*) FILTER (a AND b)::bigint AS with_both, count(*) FILTER (NOT a AND NOT b)::bigint AS with_none FROM (SELECT contains(matched_entity_ids, 'S2-') AS a, contains(matched_entity_ids, 'S3-') AS b FROM truth)",
    "noise_examples": "SELECT * FROM noise_rows QUALIFY row_number() OVER (PARTITION BY kind ORDER BY source1_entity_id, true_entity_id) <= 3",
    "id_prefix_check": "SELECT 'S1' AS source, count(*) FILTER (src = 'S1' AND NOT starts_with(entity_id, 'S1-'))::bigint AS violations FROM proj UNION ALL SELECT 'S2', count(*) FILTER (src = 'S2' AND NOT starts_with(entity_id, 'S2-'))::bigint FROM proj UNION ALL SELECT 'swapped', count(*) FILTER (src = 'S3' AND NOT starts_with(entity_id, 'S2-'))::bigint FROM proj",
    "diagnostic_target": "SELECT entity_id FROM diag QUALIFY hit OR (near AND row_number() OVER (PARTITION BY country, hit ORDER BY n) <= 5)",
    "records_by_ids": "SELECT entity_id, business_name, business_address, country FROM proj WHERE entity_id IN (SELECT source1_entity_id FROM truth WHERE matched_entity_ids <> '')",
}


def _render(final: str) -> str:
    """The final select with the expressions it needs, in order."""
    need, todo = set(), [final]
    while todo:
        sql = todo.pop()
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", sql):
                need.add(name)
                todo.append(CTES[name])
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in CTES if name in need)
    return f"WITH {ctes}\n{final}" if ctes else final


_STRONG = "({f}_token_jaccard >= 0.75 OR {f}_exact_match = 1)"
_WEAK = "({f}_token_jaccard < 0.5 OR {f}_missing_target = 1)"
_MISSED = "round_even(100.0 * count(*) / (SELECT count(*) FROM misses), 2)::double"

FINAL |= {
    # all targets lie within the BOUNDED window and all Source-1 rows within the sample, as long as there are under 5,000
    "sample_evaluation": """SELECT count(*)::bigint AS sample_rows, sum(n)::bigint AS pairs, round(avg(n), 6) AS average, round(median(n)::double, 6) AS median, max(n)::bigint AS maximum,
      round(1 - sum(n)::double / (count(*) * (SELECT count(*) FROM norm WHERE src <> 'S1')), 6) AS reduction_ratio
      FROM (SELECT s.entity_id, count(c.candidate_entity_id) AS n FROM norm s LEFT JOIN cand c ON c.source1_entity_id = s.entity_id WHERE s.src = 'S1' GROUP BY 1)""",
    "group_split": "SELECT (n - ceil(0.2 * n))::bigint AS training_entities, ceil(0.2 * n)::bigint AS validation_entities, 0::bigint AS shared_entities, pairs FROM (SELECT count(DISTINCT source1_entity_id) AS n, count(*)::bigint AS pairs FROM cand)",
    "strength_flags": f"SELECT {', '.join(_NAMES)}, ({_STRONG.format(f='name')} AND {_WEAK.format(f='address')})::bigint AS strong_name_weak_address, ({_WEAK.format(f='name')} AND {_STRONG.format(f='address')})::bigint AS weak_name_strong_address FROM feats",
    "checked_join": "SELECT e.source1_entity_id, e.candidate_entity_id, e.candidate_source, a.name AS name_1, b.name AS name_2 FROM exact_name e JOIN norm a ON a.entity_id = e.source1_entity_id JOIN norm b ON b.entity_id = e.candidate_entity_id",
    "miss_summary": f"""SELECT unnest(k) AS metric, unnest(v) AS value FROM (SELECT ['total_true_matches', 'candidate_present', 'candidate_missing', 'full_candidate_recall', 'candidate_missing_rate', 'candidate_missing_s2', 'candidate_missing_s3',
        'mean_name_similarity_missing', 'mean_address_similarity_missing', 'name_exact_match_count_in_missing', 'address_exact_match_count_in_missing', 'name_similarity_above_0_75_in_missing', 'address_similarity_above_0_75_in_missing'] AS k,
      [t::varchar, (t - m)::varchar, m::varchar, round_even((t - m) / t::double, 10)::varchar, round_even(m / t::double, 10)::varchar, s2::varchar, s3::varchar, mn::varchar, ma::varchar, n1::varchar, a1::varchar, n75::varchar, a75::varchar] AS v
      FROM (SELECT count(*) AS m, count(*) FILTER (true_source = 'S2') AS s2, count(*) FILTER (true_source = 'S3') AS s3, round_even(avg(name_similarity), 4) AS mn, round_even(avg(address_similarity), 4) AS ma, count(*) FILTER (name_similarity = 1) AS n1,
        count(*) FILTER (address_similarity = 1) AS a1, count(*) FILTER (name_similarity >= 0.75) AS n75, count(*) FILTER (address_similarity >= 0.75) AS a75 FROM misses), (SELECT count(*) AS t FROM pairs_true))
      UNION ALL SELECT 'miss_category::' || candidate_missing_reason, count(*) || ' (' || {_MISSED} || '%)' FROM misses GROUP BY candidate_missing_reason
      UNION ALL SELECT 'failed_strategy::' || f, count(*) || ' (' || {_MISSED} || '%)' FROM (SELECT unnest(string_split(failed_strategy, '|')) AS f FROM misses) GROUP BY f""",
    "missed_pairs": "SELECT t.source1_entity_id, t.true_entity_id, t.true_source FROM pairs_true t ANTI JOIN cand_exact c ON c.source1_entity_id = t.source1_entity_id AND c.candidate_entity_id = t.true_entity_id ORDER BY 1, 2 LIMIT 20",
    "country_counts": "SELECT src AS source, country, count(*)::bigint AS records FROM proj GROUP BY 1, 2",
    "matched_examples": "SELECT entity_id, business_name, business_address, country FROM proj WHERE entity_id IN (SELECT source1_entity_id FROM truth UNION SELECT true_entity_id FROM pairs_true) ORDER BY 1 LIMIT 20",
    "comparison_texts": "SELECT metric, CASE WHEN baseline <> 0 THEN printf('%+.4f%%', (experimental - baseline) / abs(baseline) * 100) ELSE 'N/A' END AS percentage_change FROM (" + FINAL["run_comparison"].replace("round(a, 6)", "a").replace("round(b, 6)", "b") + ")",
}

ORACLES = {name: _render(sql) for name, sql in FINAL.items()}
