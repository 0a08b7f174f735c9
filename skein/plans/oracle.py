"""DuckDB SQL for the queries of this package, over views named like the tables."""

from __future__ import annotations

from ..functions.text import AUDIT_STOPWORDS, LEXICAL_STOPWORDS, SCOPE_WORDS
from ..operators.classify import ERRORS, REJECTED, REJECTED_AS_WRITTEN, STATUS
from ..operators.qos import SCENARIOS
from .queries import POOLED, SAME, SEED


def _list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _std(x: str) -> str:
    body = f"lower(trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[^一-龥a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'))"
    return f"(CASE WHEN regexp_matches({body}, '^[0-9]') THEN 'get_' || {body} ELSE {body} END)"


def _named(x: str) -> str:
    return f"(CASE WHEN {_std(x)} IN ('from', 'class', 'return', 'false', 'true', 'id', 'and') THEN 'is_' || {_std(x)} ELSE {_std(x)} END)"


def _tokens(x: str, stop: list[str]) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN {_list(stop)})"


def _sha(*parts: str) -> str:
    return f"sha256(concat_ws(chr(31), {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"


def _pair(a: str, b: str) -> str:
    a, b = f"CAST({a} AS VARCHAR)", f"CAST({b} AS VARCHAR)"
    return f"('pair_' || substr(sha256(least({a}, {b}) || chr(0) || greatest({a}, {b})), 1, 20))"


def _seed(*parts: str) -> str:
    return f"(CAST('0x' || substr({_sha(*parts)}, 1, 8) AS BIGINT) & 2147483647)"


def _uniform(key: str, dimension: str) -> str:
    return f"(CAST(CAST('0x' || substr({_sha(repr(str(SEED)), key, dimension)}, 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)"


def _normal(key: str, dimension: str) -> str:
    u, v = _uniform(key, f"'{dimension}#1'"), _uniform(key, f"'{dimension}#2'")
    return f"(sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}))"


_KNN = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
u AS (SELECT id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v),
s AS (SELECT a.id AS source, b.id AS neighbor, round(list_dot_product(a.x, b.x) / (a.n * b.n), 6) + 0.0 AS score, a.label AS la, b.label AS lb FROM u a JOIN u b ON a.id <> b.id)"""
_TOP = "SELECT source, neighbor, score, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, neighbor) AS INT) AS rank FROM s"
_GLOBAL = f"{_KNN}, g AS ({_TOP} QUALIFY rank <= 10)"
_GROUPED = f"h AS ({_TOP} WHERE la = lb QUALIFY rank <= 5)"


def _bm25(corpus: str, k: int, where: str = "true") -> str:
    return f"""
w AS (SELECT doc_id, {_tokens('text', LEXICAL_STOPWORDS)} AS ws FROM {corpus}),
t AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
tf AS (SELECT term, doc_id, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(ws) AS length, unnest(ws) AS term FROM w) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens('text', LEXICAL_STOPWORDS)}) AS term FROM benchmark),
part AS (SELECT query_id, doc_id, ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean)) AS part FROM q JOIN tf USING (term) JOIN df USING (term), t),
scored AS (SELECT query_id, doc_id, round(sum(CAST(part AS DOUBLE)), 6) AS score FROM part WHERE {where} GROUP BY 1, 2),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored QUALIFY rank <= {k})"""

_BM25 = _bm25("documents", 10)
_POOL = f"""{_KNN}, g AS ({_TOP} QUALIFY rank <= {POOLED}),
h AS (WITH {_bm25("(SELECT item_id AS doc_id, text FROM benchmark)", POOLED, "query_id <> doc_id")} SELECT query_id AS source, doc_id AS neighbor, score, rank FROM top),
m AS (SELECT 'dense' AS method, * FROM g UNION ALL SELECT 'bm25', * FROM h),
pool AS (SELECT least(source, neighbor) AS left_id, greatest(source, neighbor) AS right_id, method, count(*) AS hits, count(DISTINCT source) AS directions,
                min(rank) AS best_rank, max(rank) AS worst_rank, max(score) AS best_score FROM m GROUP BY 1, 2, 3)"""
_FEATURES = f"""{_POOL},
f AS (SELECT {_pair('left_id', 'right_id')} AS pair_id, left_id, right_id, bool_or(method = 'dense') AS dense_present, bool_or(method = 'bm25') AS lexical_present,
             coalesce(max(directions) FILTER (method = 'dense') = 2, false) AS dense_reciprocal, max(best_rank) FILTER (method = 'dense') AS dense_best_rank,
             max(best_score) FILTER (method = 'dense') AS dense_best_score, max(best_rank) FILTER (method = 'bm25') AS lexical_best_rank FROM pool GROUP BY left_id, right_id),
features AS (SELECT *, CASE WHEN dense_present THEN (CASE WHEN dense_reciprocal THEN 'qwen_mutual' ELSE 'qwen_oneway' END) || (CASE WHEN dense_best_rank <= 3 THEN '_top3' WHEN dense_best_rank <= 10 THEN '_rank4_10' ELSE '_rank11_30' END)
                            WHEN lexical_best_rank <= 10 THEN 'bm25_only_top10' ELSE 'bm25_only_rank11_30' END AS stratum FROM f)"""
_SEEDED = _seed("pair_id")
_DECISIONS = f"""{_GLOBAL},
p0 AS (SELECT least(source, neighbor) AS left_id, greatest(source, neighbor) AS right_id, max(score) AS score FROM g GROUP BY 1, 2),
p1 AS (SELECT p0.*, {_pair('left_id', 'right_id')} AS pair_id, a.label AS left_label, b.label AS right_label FROM p0 JOIN v a ON a.id = left_id JOIN v b ON b.id = right_id),
p2 AS (SELECT *, {_SEEDED} AS seed, 'decision_' || substr({_sha('pair_id')}, 1, 20) AS decision_id, left_label <> right_label AS wrong FROM p1),
p3 AS (SELECT *, CASE WHEN score >= {SAME} THEN 'interchangeable' WHEN seed % 10 = 0 THEN 'contains' ELSE 'different_capability' END AS relation FROM p2),
decisions AS (SELECT *, CASE WHEN relation <> 'contains' THEN 'none' WHEN seed % 20 = 0 THEN 'left_contains_right' ELSE 'right_contains_left' END AS direction,
              CASE seed % 7 WHEN 0 THEN 'inferred' WHEN 1 THEN 'human' WHEN 2 THEN 'migrated_seed' ELSE 'llm' END AS decision_source FROM p3)"""
_COMPONENTS = f"""{_DECISIONS},
e AS (SELECT left_id AS a, right_id AS b FROM decisions WHERE relation = 'interchangeable' UNION SELECT right_id, left_id FROM decisions WHERE relation = 'interchangeable'),
walk(id, other) AS (SELECT id, id FROM v UNION SELECT w.id, e.b FROM walk w JOIN e ON e.a = w.other),
labels AS (SELECT id, min(other) AS root FROM walk GROUP BY id)"""


def _edges(which: str) -> str:
    return f"""projected AS (SELECT d.*, l.root AS l_root, r.root AS r_root FROM decisions d JOIN labels l ON l.id = left_id JOIN labels r ON r.id = right_id WHERE {which}),
edges AS (SELECT relation, CASE WHEN relation = 'contains' THEN (CASE WHEN direction = 'left_contains_right' THEN l_root ELSE r_root END) ELSE least(l_root, r_root) END AS source_root,
                 CASE WHEN relation = 'contains' THEN (CASE WHEN direction = 'left_contains_right' THEN r_root ELSE l_root END) ELSE greatest(l_root, r_root) END AS target_root,
                 count(*) AS support_count, string_agg(decision_id, ',' ORDER BY decision_id) AS support
          FROM projected WHERE relation <> 'interchangeable' AND l_root <> r_root GROUP BY 1, 2, 3),
steps AS (SELECT DISTINCT source_root AS s, target_root AS t FROM edges WHERE relation = 'contains'),
reach(s, t, depth) AS (SELECT s, t, 1 FROM steps UNION SELECT r.s, x.t, r.depth + 1 FROM reach r JOIN steps x ON x.s = r.t WHERE r.depth < 40),
paths AS (SELECT s, t, min(depth) AS depth FROM reach GROUP BY 1, 2)"""


_INFER = f"""{_COMPONENTS}, {_edges("decision_source <> 'inferred'")},
asked AS (SELECT pair_id, l.root AS l, r.root AS r FROM decisions JOIN labels l ON l.id = left_id JOIN labels r ON r.id = right_id WHERE decision_source = 'inferred'),
j AS (SELECT pair_id, l, r, d.relation IS NOT NULL AS differ, a.depth AS forth, b.depth AS back FROM asked
      LEFT JOIN edges d ON d.relation = 'different_capability' AND d.source_root = least(l, r) AND d.target_root = greatest(l, r)
      LEFT JOIN paths a ON a.s = l AND a.t = r LEFT JOIN paths b ON b.s = r AND b.t = l),
inferred AS (SELECT pair_id, CASE WHEN l = r THEN 'interchangeable' WHEN differ THEN 'different_capability' WHEN coalesce(forth, back) IS NOT NULL THEN 'contains' END AS inferred_relation,
             CASE WHEN l = r OR differ THEN 'none' WHEN forth IS NOT NULL THEN 'left_contains_right' WHEN back IS NOT NULL THEN 'right_contains_left' END AS inferred_direction,
             CASE WHEN l = r THEN 'interchangeable_component' WHEN differ THEN 'cluster_different_propagation' WHEN coalesce(forth, back) = 1 THEN 'cluster_contains_propagation' WHEN coalesce(forth, back) > 1 THEN 'transitive_cluster_contains' END AS rule FROM j)"""


_DONORS = """
line AS (SELECT l_suppkey, avg(l_discount) AS d, avg(CAST(l_returnflag = 'R' AS INT)) AS r, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1),
apis AS (SELECT s_suppkey AS api_id, s_nationkey AS tool_id, 100 - 100 * d AS service_level, 100 - 50 * r AS success_rate, p / 100 AS latency_ms FROM supplier JOIN line ON l_suppkey = s_suppkey),
first AS (SELECT * FROM apis WHERE latency_ms > 0 QUALIFY row_number() OVER (PARTITION BY tool_id ORDER BY api_id) = 1),
donors AS (SELECT *, row_number() OVER (ORDER BY api_id) - 1 AS idx FROM first)"""
_PROFILES = f"""{_DONORS},
targets AS (SELECT p_partkey AS api_id, p_size % 25 AS tool_id FROM part),
n AS (SELECT count(*) AS d FROM donors),
drawn AS (SELECT t.api_id, o.idx AS own, d, CAST(floor({_uniform('t.api_id', "'donor'")} * CASE WHEN d - CAST(o.idx IS NOT NULL AS INT) > 0 THEN d - CAST(o.idx IS NOT NULL AS INT) ELSE d END) AS BIGINT) AS k
          FROM targets t LEFT JOIN donors o ON o.tool_id = t.tool_id, n),
given AS (SELECT drawn.api_id, s.api_id AS donor_api_id, service_level, success_rate, latency_ms FROM drawn JOIN donors s ON s.idx = k + CAST(own IS NOT NULL AND k >= own AND d > 1 AS INT)),
profiles AS (SELECT api_id, donor_api_id, round(least(greatest(service_level / 100, 0), 1) * least(greatest(success_rate / 100, 0), 1), 8) AS base_success,
             round(least(greatest(latency_ms, 1.0), 300000.0), 4) AS base_latency_ms, round(least(greatest(0.001 * exp({_normal('api_id', 'cost')}), 0.00005), 0.05), 10) AS cost_units,
             round(0.05 + 0.2 * {_uniform('api_id', "'sigma'")}, 8) AS latency_log_sigma FROM given)"""
_FACTORS = ", ".join(f"('{n}', CAST({s} AS DOUBLE), CAST({x} AS DOUBLE))" for n, s, x in SCENARIOS)
_SCENARIOS = f"""{_PROFILES},
scenarios AS (SELECT api_id, donor_api_id, scenario, round(least(greatest(base_success * s, 0), 1), 8) AS success_rate, round(greatest(base_latency_ms * x, 1.0), 4) AS expected_latency_ms, cost_units, latency_log_sigma
              FROM profiles, (VALUES {_FACTORS}) AS f(scenario, s, x))"""
_KEY = "(CAST(c.api_id AS VARCHAR) || '#' || CAST(call_index AS VARCHAR))"
_CALLS = f"""{_SCENARIOS},
c AS (SELECT event_id, user_id AS api_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS call_index FROM events),
calls AS (SELECT c.event_id, c.api_id, c.call_index, success_rate IS NOT NULL AS profile_found, coalesce({_uniform(_KEY, "'outcome'")} < success_rate, false) AS succeeded,
          CASE WHEN success_rate IS NOT NULL THEN round(exp(ln(expected_latency_ms) - latency_log_sigma * latency_log_sigma / 2 + latency_log_sigma * {_normal(_KEY, 'latency')}), 4) END AS latency_ms,
          CASE WHEN success_rate IS NOT NULL THEN cost_units ELSE 0.0 END AS cost_units, success_rate
          FROM c LEFT JOIN scenarios s ON s.api_id = c.api_id AND scenario = 'normal')"""


def _contains(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join("contains(" + text + ", '" + p.replace("'", "''") + "')" for p in parts) + ")"


def _classified(x: str) -> dict[str, str]:
    pick = lambda k, last: "CASE " + " ".join(f"WHEN {_contains(x, e[0])} THEN {e[k]!r}" for e in ERRORS) + f" ELSE {last!r} END"
    error = pick(1, "")
    status = f"CASE {error} " + " ".join(f"WHEN '{label}' THEN {code}" for label, code in STATUS) + " ELSE 0 END"
    ok = f"(contains(lower({x}), 'got an unexpected keyword argument') OR NOT ({_contains(f'lower({x})', REJECTED)} OR {_contains(x, REJECTED_AS_WRITTEN)} OR {x} = ''))"
    return {"error": error, "save_cache": pick(2, True), "switch": pick(3, False), "status": status, "acceptable": ok}


_TURN = _classified("coalesce(text, '')")
_PAGE = _classified("coalesce(html, '')")
_REC = "WITH RECURSIVE"

SQL: dict[str, str] = {
    "normalize_ids": f"WITH x AS (SELECT p_partkey, regexp_replace(translate(p_brand, ' ,/', '___'), '_+', '_', 'g') || '/' || {_std('p_type')} AS tool_key, {_named('p_name')} AS api FROM part) SELECT p_partkey, tool_key || '/' || api AS api_id, tool_key FROM x",
    "hash_ids": f"SELECT doc_id, 'decision_' || substr({_sha('doc_id', 'source')}, 1, 20) AS decision_id, {_pair('doc_id', '(doc_id + 1)')} AS pair_id, {_seed('doc_id', 'source')} AS seed, round({_uniform('doc_id', chr(39) + 'outcome' + chr(39))}, 9) AS draw FROM documents",
    "catalog_flatten_stats": "WITH u AS (SELECT l_partkey, count(*) AS calls FROM lineitem GROUP BY 1) SELECT p_brand AS category, count(*) AS apis, count(DISTINCT p_type) AS tools, count(calls) AS apis_with_calls, round(count(calls) / count(*), 6) AS coverage, CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls FROM part LEFT JOIN u ON l_partkey = p_partkey GROUP BY 1",
    "candidate_filter_reasons": """WITH m AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
r AS (SELECT CASE WHEN length(text) < 50 THEN 'missing_description' WHEN quality IS NULL THEN 'incomplete_labels' WHEN toxic = 1 THEN 'toxic' WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN 'duplicate' ELSE 'accepted' END AS reason FROM documents LEFT JOIN m USING (doc_id))
SELECT reason, count(*) AS n FROM r GROUP BY 1""",
    "semantic_text": "SELECT doc_id, sha256(concat_ws(chr(10), CASE WHEN trim(lang) <> '' THEN 'Language: ' || trim(lang) END, CASE WHEN trim(source) <> '' THEN 'Source: ' || trim(source) END, CASE WHEN trim(text) <> '' THEN 'Text: ' || trim(text) END)) AS digest FROM documents",
    "param_signature": "SELECT p_partkey, array_to_string(list_sort([lower(trim(p_brand)) || ':STRING', lower(trim(p_type)) || ':UNKNOWN', 'size:' || CASE WHEN p_size > 25 THEN 'NUMBER' ELSE 'UNKNOWN' END]), ',') AS signature FROM part",
    "lexical_tokens": f"SELECT doc_id, len({_tokens('text', LEXICAL_STOPWORDS)}) AS n_tokens, len(list_distinct({_tokens('text', AUDIT_STOPWORDS)})) AS n_audit FROM documents",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM top",
    "dense_knn_global": f"WITH {_GLOBAL} SELECT * FROM g",
    "dense_knn_by_group": f"WITH {_KNN}, {_GROUPED} SELECT * FROM h",
    "dense_knn_other_tools": f"WITH {_KNN} {_TOP} WHERE la <> lb QUALIFY rank <= 5",
    "pair_pool": f"WITH {_POOL} SELECT *, {_pair('left_id', 'right_id')} AS pair_id FROM pool",
    "pair_features_strata": f"WITH {_FEATURES} SELECT * REPLACE (coalesce(dense_best_rank, 0) AS dense_best_rank, coalesce(dense_best_score, 0.0) AS dense_best_score, coalesce(lexical_best_rank, 0) AS lexical_best_rank) FROM features",
    "stratified_sample": f"""WITH {_FEATURES},
c AS (SELECT stratum, count(*) AS n, row_number() OVER (ORDER BY stratum) AS pos FROM features GROUP BY 1),
k AS (SELECT least(200, sum(n)) AS target, count(*) AS strata FROM c),
q AS (SELECT stratum, n, target // strata + CAST(pos <= target % strata AS INT) AS quota FROM c, k),
r AS (SELECT pair_id, f.stratum, quota, row_number() OVER (PARTITION BY f.stratum ORDER BY {_sha("'42'", 'f.stratum', 'pair_id')}, pair_id) AS rn FROM features f JOIN q USING (stratum)),
more AS (SELECT pair_id, stratum, row_number() OVER (ORDER BY {_sha("'42'", "'redistribution'", 'pair_id')}, pair_id) AS rn FROM r WHERE rn > quota)
SELECT pair_id, stratum FROM r WHERE rn <= quota UNION ALL SELECT pair_id, stratum FROM more WHERE rn <= (SELECT max(target) - sum(least(n, quota)) FROM q, k)""",
    "interleave_strata": "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, lang, row_number() OVER (ORDER BY rn, lang) AS position FROM r",
    "greedy_audit_select": f"""WITH {_FEATURES},
x AS (SELECT pair_id, CAST(dense_reciprocal AS INT) AS r, coalesce(dense_best_score, 0.0) AS s, CAST(lexical_present AS INT) AS g FROM features),
a AS (SELECT pair_id, 'duplicate' AS target, round(5 * g + r + s, 6) AS score FROM x ORDER BY score DESC, pair_id LIMIT 25),
b AS (SELECT pair_id, 'interchangeable' AS target, round(2 * s + r, 6) AS score FROM x WHERE pair_id NOT IN (SELECT pair_id FROM a) ORDER BY score DESC, pair_id LIMIT 25),
c AS (SELECT pair_id, 'contains' AS target, round(3 * g - s, 6) AS score FROM x WHERE pair_id NOT IN (SELECT pair_id FROM a UNION SELECT pair_id FROM b) ORDER BY score DESC, pair_id LIMIT 25),
d AS (SELECT pair_id, 'boundary' AS target, round(-abs(s - 0.5), 6) AS score FROM x WHERE pair_id NOT IN (SELECT pair_id FROM a UNION SELECT pair_id FROM b UNION SELECT pair_id FROM c) ORDER BY score DESC, pair_id LIMIT 25)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""",
    "jaccard_pairs": f"""WITH {_BM25},
x AS (SELECT query_id, top.doc_id, list_distinct({_tokens('b.text', AUDIT_STOPWORDS)}) AS a, list_distinct({_tokens('d.text', AUDIT_STOPWORDS)}) AS b FROM top JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = top.doc_id),
y AS (SELECT *, len(list_intersect(a, b)) AS k FROM x)
SELECT query_id, doc_id, round(CASE WHEN len(a) + len(b) - k > 0 THEN k / (len(a) + len(b) - k) ELSE 0 END, 6) AS jaccard, round(greatest(k / greatest(1, len(a)), k / greatest(1, len(b))), 6) AS containment,
       len(list_filter(list_distinct(list_concat(a, b)), lambda t: list_contains(a, t) <> list_contains(b, t) AND t IN {_list(SCOPE_WORDS)})) > 0 AS scope_contrast FROM y""",
    "latest_event_wins": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "override_transitions": f"WITH {_DECISIONS}, x AS (SELECT relation, CASE WHEN wrong THEN 'different_capability' ELSE 'interchangeable' END AS human FROM decisions) SELECT relation || '->' || human AS transition, count(*) AS n, count(*) FILTER (relation = human) AS confirmed FROM x GROUP BY 1",
    "direct_decision_filter": f"WITH {_DECISIONS} SELECT relation, count(*) FILTER (decision_source IN ('llm', 'migrated_seed')) AS expand, count(*) FILTER (decision_source IN ('llm', 'migrated_seed', 'human')) AS export, count(*) FILTER (decision_source = 'llm') AS migrate FROM decisions GROUP BY 1",
    "review_queue": f"WITH {_DECISIONS} SELECT pair_id, wrong AS flagged, score, CAST(row_number() OVER (PARTITION BY wrong ORDER BY score, pair_id) AS INT) AS place FROM decisions WHERE decision_source IN ('llm', 'migrated_seed') AND relation IN ('interchangeable', 'contains') AND left_id NOT IN (SELECT doc_id FROM labels)",
    "unordered_pair_regression": f"WITH {_DECISIONS} SELECT CASE WHEN direction = 'right_contains_left' THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n FROM decisions WHERE relation = 'contains' GROUP BY 1",
    "components_clusters": f"{_REC} {_COMPONENTS} SELECT root, 'cluster_' || substr(sha256(string_agg(CAST(id AS VARCHAR), chr(31) ORDER BY CAST(id AS VARCHAR))), 1, 20) AS cluster_id, CAST(count(*) AS INT) AS member_count FROM labels GROUP BY root",
    "cluster_statistics": f"{_REC} {_COMPONENTS} SELECT member_count, count(*) AS n_clusters FROM (SELECT root, count(*) AS member_count FROM labels GROUP BY 1) GROUP BY 1",
    "contains_closure": f"""{_REC} h AS (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
w(s, t, depth) AS (SELECT s, t, 1 FROM h UNION SELECT w.s, h.t, depth + 1 FROM w JOIN h ON h.s = w.t) SELECT s AS source, t AS target, min(depth) AS depth FROM w GROUP BY 1, 2""",
    "cluster_edges": f"{_REC} {_COMPONENTS}, {_edges('true')} SELECT relation, source_root, target_root, support_count, support FROM edges",
    "infer_relations": f"{_REC} {_INFER} SELECT * FROM inferred",
    "candidate_coverage": f"{_REC} {_INFER} SELECT coalesce(inferred_relation, 'unknown') AS relation, count(*) AS n FROM inferred GROUP BY 1",
    "graph_diagnostics": f"""{_REC} {_COMPONENTS}, {_edges('true')}
SELECT 'relation_inside_interchangeable_cluster' AS issue_type, decision_id AS key FROM projected WHERE relation <> 'interchangeable' AND l_root = r_root
UNION ALL SELECT 'multiple_relations_between_clusters', a || '|' || b FROM (SELECT least(source_root, target_root) AS a, greatest(source_root, target_root) AS b FROM edges GROUP BY 1, 2 HAVING count(DISTINCT relation) > 1)
UNION ALL SELECT 'contains_cycle', CAST(s AS VARCHAR) FROM paths WHERE s = t""",
    "histogram_relation_error": f"""WITH {_DECISIONS} SELECT low, high, count(*) AS n, count(*) FILTER (relation = 'interchangeable') AS interchangeable, count(*) FILTER (relation = 'contains') AS contains, count(*) FILTER (relation = 'different_capability') AS different_capability,
count(*) FILTER (wrong) AS false_count, round(avg(CAST(wrong AS INT)), 6) AS false_rate
FROM decisions JOIN (VALUES (CAST(0.0 AS DOUBLE), CAST(0.3 AS DOUBLE)), (0.3, 0.4), (0.4, 0.5), (0.5, 0.6), (0.6, 1.0000001)) AS b(low, high) ON score >= low AND score < high GROUP BY 1, 2""",
    "confidence_cumulative": f"WITH {_DECISIONS} SELECT threshold, count(*) AS n, count(*) FILTER (wrong) AS errors, round(avg(CAST(wrong AS INT)), 6) AS rate FROM decisions JOIN (VALUES (CAST(0.3 AS DOUBLE)), (0.35), (0.4), (0.45), (0.5), (0.55), (0.6), (0.8), (1.0)) AS b(threshold) ON score <= threshold GROUP BY 1",
    "confidence_exact": f"WITH {_DECISIONS} SELECT round(score, 2) AS confidence, count(*) AS n, count(*) FILTER (wrong) AS errors, round(count(*) FILTER (wrong) / count(*), 6) AS rate FROM decisions GROUP BY 1",
    "threshold_recall": f"""WITH {_DECISIONS}, p AS (SELECT score, count(*) AS n FROM decisions WHERE NOT wrong GROUP BY 1), r AS (SELECT score, sum(n) OVER (ORDER BY score DESC) / (SELECT sum(n) FROM p) AS recall FROM p)
SELECT target, max(score) AS threshold FROM r JOIN (VALUES (CAST(1.0 AS DOUBLE)), (0.95), (0.9)) AS t(target) ON recall >= target - 1e-12 GROUP BY 1""",
    "threshold_sensitivity": f"""WITH {_DECISIONS} SELECT threshold, round(count(*) FILTER (NOT wrong AND score >= threshold) / count(*) FILTER (NOT wrong), 6) AS positive_recall, round(count(*) FILTER (wrong AND score < threshold) / count(*) FILTER (wrong), 6) AS negatives_filtered, round(count(*) FILTER (score >= threshold) / count(*), 6) AS pool_retained
FROM decisions, (VALUES (CAST(0.3 AS DOUBLE)), (0.4), (0.5), (0.6)) AS t(threshold) GROUP BY 1""",
    "score_by_relation_upper_median": f"WITH {_DECISIONS} SELECT relation, count(score) AS n, count(*) - count(score) AS missing, min(score) AS min, max(score) AS max, list_sort(list(score))[len(list(score)) // 2 + 1] AS upper_median FROM decisions GROUP BY 1",
    "numeric_summary": "SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median FROM lineitem GROUP BY 1, 2",
    "length_quantiles": "SELECT lang, min(n_chars) AS min, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.9), 6) AS p90, max(n_chars) AS max FROM documents GROUP BY 1",
    "token_length_stats": f"""WITH x AS (SELECT lang, len({_tokens('text', LEXICAL_STOPWORDS)}) AS n FROM documents)
SELECT lang, count(*) AS texts, count(*) FILTER (n > 512) AS truncated, round(avg(CAST(n > 512 AS INT)), 6) AS truncated_ratio, CAST(sum(greatest(0, n - 512)) AS BIGINT) AS tokens_lost,
round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99 FROM x GROUP BY 1""",
    "fingerprint": f"""WITH r AS (SELECT source, doc_id // 1000 AS run, sha256(string_agg({_sha('doc_id', 'text')}, '' ORDER BY doc_id)) AS d FROM documents GROUP BY 1, 2) SELECT source, sha256(string_agg(d, '' ORDER BY run)) AS fingerprint FROM r GROUP BY 1""",
    "qos_donor_pool": f"WITH {_DONORS} SELECT api_id, round(service_level, 5) AS service_level, round(success_rate, 5) AS success_rate, round(latency_ms, 4) AS latency_ms, tool_id, idx FROM donors",
    "qos_profiles": f"WITH {_PROFILES} SELECT api_id, donor_api_id, floor(base_success * 1e6) / 1e6 AS base_success, floor(base_latency_ms * 1e3) / 1e3 AS base_latency_ms, floor(cost_units * 1e7) / 1e7 AS cost_units, floor(latency_log_sigma * 1e6) / 1e6 AS latency_log_sigma FROM profiles",
    "qos_scenarios": f"WITH {_SCENARIOS} SELECT api_id, donor_api_id, scenario, floor(success_rate * 1e6) / 1e6 AS success_rate, floor(expected_latency_ms * 1e2) / 1e2 AS expected_latency_ms, floor(cost_units * 1e7) / 1e7 AS cost_units, floor(latency_log_sigma * 1e6) / 1e6 AS latency_log_sigma FROM scenarios",
    "qos_simulate_calls": f"WITH {_CALLS} SELECT event_id, api_id, call_index, profile_found, succeeded, floor(latency_ms * 1e2) / 1e2 AS latency_ms, floor(cost_units * 1e7) / 1e7 AS cost_units, floor(success_rate * 1e6) / 1e6 AS success_rate FROM calls",
    "qos_call_summary": f"WITH {_CALLS} SELECT profile_found, count(*) AS calls, round(avg(CAST(succeeded AS INT)), 6) AS observed_rate, round(avg(latency_ms), 1) AS mean_latency, round(quantile_cont(latency_ms, 0.5), 1) AS median_latency, round(quantile_cont(latency_ms, 0.95), 1) AS p95_latency, round(sum(cost_units), 4) AS total_cost FROM calls GROUP BY 1",
    "task_expansion": """WITH m AS (SELECT p_brand || '|' || p_type || '|' || p_size AS cluster_id, p_partkey AS api_id FROM part), k AS (SELECT * FROM m WHERE cluster_id IN (SELECT cluster_id FROM m GROUP BY 1 HAVING count(*) >= 2)),
u AS (SELECT DISTINCT l_orderkey AS task_id, l_partkey AS api_id FROM lineitem), t AS (SELECT DISTINCT task_id, cluster_id FROM u JOIN k USING (api_id))
SELECT task_id, cluster_id, k.api_id FROM t JOIN k USING (cluster_id) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.task_id = t.task_id AND u.api_id = k.api_id)""",
    "all_or_nothing_lookup": "SELECT l_orderkey AS task_id, count(*) AS n_keys FROM lineitem LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_size <= 40) ON p_partkey = l_partkey GROUP BY 1 HAVING bool_and(p_partkey IS NOT NULL)",
    "paraphrase_variants": r"""WITH x AS (SELECT CAST(item_id AS VARCHAR) AS source_id, text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS a, trim(regexp_replace('Please: ' || text, '\s+', ' ', 'g')) AS b FROM benchmark)
SELECT source_id, 0 AS variant_index, source_id AS task_id, text FROM x UNION ALL SELECT source_id, 1, source_id || '-p01', a FROM x UNION ALL SELECT source_id, 2, source_id || '-p02', b FROM x""",
    "cache_gap_plan": """WITH x AS (SELECT user_id || '/' || event_type AS api, CAST(json(props) AS VARCHAR) AS c FROM events), p AS (SELECT api, count(DISTINCT c) AS have, CASE WHEN bool_and(coalesce(c, '{}') = '{}') THEN 1 ELSE 3 END AS wanted FROM x GROUP BY 1)
SELECT api, have, wanted, greatest(0, wanted - have) AS needed FROM p""",
    "cache_overlay": """WITH a AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT coalesce(b.user_id, a.user_id) AS user_id, CASE WHEN b.user_id IS NOT NULL THEN b.v ELSE a.v END AS value, CASE WHEN b.user_id IS NOT NULL THEN 'generated' ELSE 'official' END AS origin FROM a FULL JOIN b ON a.user_id = b.user_id""",
    "few_shot_examples": """WITH e AS (SELECT user_id AS api, event_id AS seq, CAST(json(props) AS VARCHAR) AS c, concat_ws(' => ', props, event_type) AS line FROM events),
i AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY api, c ORDER BY seq) = 1),
f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY api ORDER BY seq) <= 6),
o AS (SELECT a.seq AS request_id, f.seq, f.line, row_number() OVER w AS n, sum(length(f.line) + 1) OVER w AS used FROM e a JOIN f ON f.api = a.api AND f.c <> a.c WINDOW w AS (PARTITION BY a.seq ORDER BY f.seq)),
k AS (SELECT request_id, count(*) AS n_examples, string_agg(line, chr(10) ORDER BY seq) AS examples FROM o WHERE n <= 5 AND used <= 2048 GROUP BY 1)
SELECT e.seq AS request_id, coalesce(n_examples, 0) AS n_examples, coalesce(examples, '') AS examples FROM e LEFT JOIN k ON k.request_id = e.seq""",
    "error_classify": f"SELECT {_TURN['error']} AS error, {_TURN['save_cache']} AS save_cache, {_TURN['switch']} AS switch, {_TURN['status']} AS status, {_TURN['acceptable']} AS acceptable, count(*) AS n FROM conversations GROUP BY ALL",
    "page_classify": f"SELECT page_id, {_PAGE['error']} AS error, {_PAGE['status']} AS status, {_PAGE['acceptable']} AS acceptable FROM pages",
    "react_parse": "SELECT conv_id, turn, role AS thought, 'act_' || turn AS action, CAST(conv_id AS VARCHAR) AS k, CASE WHEN length(text) > 200 THEN 203 ELSE length(text) END AS shown FROM conversations",
    "code_fence_parse": "SELECT event_id, CAST(json(props) AS VARCHAR) AS canonical FROM events",
    "tree_metrics": """WITH n AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS up FROM conversations), c AS (SELECT conv_id, up, count(*) AS k FROM n WHERE up IS NOT NULL GROUP BY 1, 2), i AS (SELECT conv_id, count(*) AS inner_nodes, max(k) AS most FROM c GROUP BY 1)
SELECT n.conv_id AS task_id, count(*) AS n_nodes, CAST(max(floor(log2(turn + 1))) AS INT) AS max_depth, count(*) - any_value(coalesce(inner_nodes, 0)) AS n_leaves, any_value(coalesce(most, 0)) AS max_children FROM n LEFT JOIN i USING (conv_id) GROUP BY 1""",
    "trajectory_chain": "SELECT conv_id AS task_id, CAST(count(*) AS INT) AS n_steps, string_agg(turn || ': ' || role, chr(10) ORDER BY turn) AS trace FROM conversations GROUP BY 1",
    "tournament_scores": "WITH b AS (SELECT source, n_chars, count(*) AS n, coalesce(sum(count(*)) OVER (PARTITION BY source ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM documents GROUP BY 1, 2) SELECT source, doc_id, CAST(lower + (n - 1) * 0.5 AS DOUBLE) AS points FROM documents JOIN b USING (source, n_chars)",
    "call_index": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS call_index FROM events",
    "stream_call_index": "SELECT user_id AS api_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS call_index FROM events",
    "annotation_validation": f"""WITH {_DECISIONS} SELECT CASE WHEN seed % 11 = 0 OR score < 0 OR score > 1 THEN 'confidence_out_of_range' WHEN seed % 5 = 0 THEN 'empty_reasoning' ELSE 'ok' END AS error, count(*) AS n FROM decisions GROUP BY 1""",
    "function_schemas": f"""WITH x AS (SELECT *, {_named('p_name')} || '_for_' || {_std('p_brand')} AS whole FROM part), y AS (SELECT *, right(whole, 64) AS name FROM x)
SELECT p_partkey, name, 'This is the subfunction for tool "' || {_std('p_brand')} || '", you can use this tool.' || CASE WHEN trim(p_type) <> '' THEN 'The description of this function is: "' || left(replace(trim(p_type), p_name, name), 256) || '"' ELSE '' END AS description, 'size_of|integer|' || p_size AS property FROM y""",
    "migration_split": f"WITH {_DECISIONS} SELECT relation, CASE WHEN relation = 'different_capability' THEN 'llm' ELSE 'migrated_seed' END AS decision_source, CASE WHEN relation = 'different_capability' THEN 'reconsider' ELSE 'reused' END AS fate, count(*) AS n FROM decisions WHERE decision_source = 'llm' GROUP BY 1, 2, 3",
    "human_overrides": f"""WITH {_DECISIONS}, x AS (SELECT *, seed % 3 = 0 AS told, CASE WHEN wrong THEN 'different_capability' ELSE 'interchangeable' END AS human FROM decisions)
SELECT pair_id, CASE WHEN told THEN human ELSE relation END AS relation, CASE WHEN told THEN 'none' ELSE direction END AS direction, CASE WHEN told THEN 'human' ELSE decision_source END AS decision_source,
CASE WHEN NOT told THEN 'none' WHEN human = relation AND direction = 'none' THEN 'confirmed' ELSE 'changed' END AS review FROM x""",
    "elo_shares": "SELECT event_id, round(pow(10.0, (value - max(value) OVER (PARTITION BY user_id)) / 400) / sum(pow(10.0, (value - m) / 400)) OVER (PARTITION BY user_id), 6) AS share FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events)",
    "first_event_per_user": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "request_budget": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_ratio FROM events GROUP BY 1",
}
