"""Queries of requests, caches, reviews, sets and trajectories, each followed by its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import catalog, graph, qos, quality, requests, retrieval, reviews, sampling, trajectory
from . import oracle
from . import queries as base
from .queries import SEED, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_CALLS = oracle.SQL["qos_simulate_calls"]
_ANSWERED = f"""c AS ({_CALLS}), e AS (SELECT c.*, e.event_type, e.value FROM c JOIN events e USING (event_id)),
r AS (SELECT *, profile_found AND succeeded AS generate, CASE WHEN profile_found AND succeeded THEN '' WHEN NOT profile_found THEN 'No service profile for this API' ELSE 'Simulated service failure' END AS error FROM e)"""


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, each with the answer that its event type stands for where the gate lets it through."""
    rows = base.qos_simulate_calls(spark, sf).join(table(spark, sf, "events").select("event_id", "event_type", "value"), "event_id")
    return requests.resolve(requests.gate(rows), F.concat(F.lit("answer to "), F.col("event_type")))


@query(f"WITH {_ANSWERED} SELECT event_id, error, CASE WHEN generate THEN 'answer to ' || event_type END AS response, round(greatest(0.0, (coalesce(latency_ms, 0.0) - value) / 1000), 5) AS wait FROM r")
def virtual_responses(spark, sf):
    return answered(spark, sf).select("event_id", "error", "response", F.round(requests.remaining_wait(F.col("latency_ms"), F.col("value")), 5).alias("wait"))


@query(f"WITH {_ANSWERED} SELECT generate, error, count(*) AS n FROM r GROUP BY 1, 2")
def gate_before_generation(spark, sf):
    """The generator is a function of the rows that pass alone."""
    rows = requests.gate(base.qos_simulate_calls(spark, sf))
    made = requests.resolve(rows, lambda passed: passed.withColumn("response", F.lit("generated")))
    return made.groupBy((F.col("response") == "generated").alias("generate"), "error").agg(F.count(F.lit(1)).alias("n")).withColumn("generate", F.coalesce("generate", F.lit(False)))


@query("SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS line FROM events")
def request_log(spark, sf):
    return requests.log_lines(table(spark, sf, "events").select("event_id", "event_type", "user_id"), "event_id")


_LOADED = oracle._uniform("i", "'load'")


@query(f"SELECT i AS request_index, CAST(floor({_LOADED} * 100) AS BIGINT) AS api_id FROM range(10000) t(i)")
def load_requests(spark, sf):
    return requests.load(spark, 10_000, 100, SEED)


@query("SELECT event_id, CASE WHEN lower(event_type) IN ('view') THEN NULL WHEN event_id % 4 IN (0, 1) THEN event_id % 4 = 0 END AS flag FROM events")
def boolean_settings(spark, sf):
    word = F.when(F.col("event_type") == "view", "maybe").otherwise(F.element_at(F.array(*map(F.lit, [" Yes", "OFF ", "2", ""])), (F.col("event_id") % 4 + 1).cast("int")))
    return table(spark, sf, "events").select("event_id", requests.parse_bool(word).alias("flag"))


_WHOLE = "event_id % 3 = 0"


@query(f"SELECT event_id, event_type AS error, CASE WHEN {_WHOLE} THEN CAST(user_id AS VARCHAR) END AS response FROM events")
def tolerant_attributes(spark, sf):
    """Every third answer is JSON; the others break off after their first field."""
    whole = F.to_json(F.struct(F.col("event_type").alias("error"), F.col("user_id").cast("string").alias("response")))
    broken = F.concat(F.lit('{"error": "'), F.col("event_type"), F.lit('", "respon'))
    found = requests.attributes(F.when(F.expr(_WHOLE), whole).otherwise(broken), ["error", "response"])
    return table(spark, sf, "events").select("event_id", found["error"].alias("error"), found["response"].alias("response"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN 'give_up' ELSE 'give_answer' END AS return_type, CASE turn % 3 WHEN 2 THEN '' ELSE role END AS final_answer FROM conversations")
def finish_calls(spark, sf):
    """JSON, an answer alone in broken JSON, and nothing that can be read."""
    kind = F.col("turn") % 3
    made = F.when(kind == 0, F.to_json(F.struct(F.lit("give_answer").alias("return_type"), F.col("role").alias("final_answer")))).when(kind == 1, F.concat(F.lit('{"final_answer": "'), F.col("role"), F.lit('", '))).otherwise("none")
    found = requests.finish_arguments(made)
    return table(spark, sf, "conversations").select("conv_id", "turn", found["return_type"].alias("return_type"), found["final_answer"].alias("final_answer"))


@query("SELECT count(*) AS n, count(DISTINCT p_partkey) AS keys FROM part")
def unique_keys(spark, sf):
    return catalog.require_unique(table(spark, sf, "part"), "p_partkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_partkey").alias("keys"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY 1")
def missing_references(spark, sf):
    return catalog.missing(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").where("p_size <= 40"), "p_partkey")


_CACHED = """u AS (SELECT user_id, min(event_id) AS e FROM events GROUP BY 1),
f AS (SELECT user_id, user_id % 7 <> 0 AS found, user_id % 5 = 0 AS broken, props FROM u JOIN events USING (user_id) WHERE event_id = e)"""


@query(f"WITH {_CACHED} SELECT c.c_custkey, coalesce(found, false) AS exists, CASE WHEN found AND NOT broken THEN 1 ELSE 0 END AS entries, CASE WHEN found AND broken THEN 'root is no object' END AS error FROM customer c LEFT JOIN f ON c_custkey = user_id")
def cache_probes(spark, sf):
    """Customers as a catalogue; the first event of some users is their cache file, in some of them inside an array."""
    first = sampling.first_by(table(spark, sf, "events"), ["user_id"], [F.asc("event_id")]).where("user_id % 7 <> 0")
    path = lambda c: catalog.cache_path("cache", (F.col(c) % 3).cast("string"), F.lit("tool"), F.col(c).cast("string"))
    files = first.select(path("user_id").alias("path"), F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props")).alias("text"))
    return catalog.with_cache(table(spark, sf, "customer").select("c_custkey", path("c_custkey").alias("path")), files).select("c_custkey", "exists", "entries", "error")


@query("SELECT c_custkey, CAST(c_custkey % 3 AS VARCHAR) AS category, 'tool' AS tool, CAST(c_custkey AS VARCHAR) AS api FROM customer")
def cache_keys(spark, sf):
    key = catalog.cache_key(catalog.cache_path("some/cache", (F.col("c_custkey") % 3).cast("string"), F.lit("tool"), F.col("c_custkey").cast("string")))
    return table(spark, sf, "customer").select("c_custkey", key["category"].alias("category"), key["tool"].alias("tool"), key["api"].alias("api"))


@query("SELECT source, doc_id, length(text) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1")
def largest_descriptors(spark, sf):
    return catalog.largest(table(spark, sf, "documents").select("source", "doc_id", "text"), "source", "text", "doc_id").select("source", "doc_id", F.length("text").alias("n"))


@query("SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY length(p_type) DESC, p_size DESC, p_type DESC, p_partkey) = 1")
def best_duplicates(spark, sf):
    return catalog.best_duplicate(table(spark, sf, "part").select("p_name", "p_partkey", "p_type", "p_size"), "p_name", "p_type", ["p_size"], "p_partkey").select("p_name", "p_partkey")


@query("SELECT user_id, event_type, min(event_id) AS first_seq FROM events GROUP BY 1, 2")
def stable_distinct(spark, sf):
    return catalog.stable_distinct(table(spark, sf, "events"), ["user_id", "event_type"], "event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_documents(spark, sf):
    return catalog.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, b.p_partkey AS first_part FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN (SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1) b USING (p_brand)")
def first_matches(spark, sf):
    part = table(spark, sf, "part")
    wanted = table(spark, sf, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name")), "l_partkey").select("l_orderkey", "l_linenumber", "name")
    apis = part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("first_part"))
    return catalog.first_match(wanted, apis, "name", "first_part").drop("name")


@query(f"SELECT {oracle._std('p_type')} AS tool, max(p_partkey) AS p_partkey FROM part GROUP BY 1")
def tool_whitelist(spark, sf):
    rows = table(spark, sf, "part").select(ids.standardize(F.col("p_type")).alias("tool"), "p_partkey")
    return sampling.latest_by(rows, ["tool"], ["p_partkey"])


@query("""WITH l AS (SELECT DISTINCT l_orderkey, p_type, p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_type, p_name) AS k FROM l)
SELECT l_orderkey, string_agg(k || '.' || p_type || ': ' || substr(p_name, 1, 6), chr(10) ORDER BY k) AS description FROM n GROUP BY 1""")
def task_descriptions(spark, sf):
    tools = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("p_type").alias("name"), F.col("p_name").alias("description")))).alias("t"))
    return tools.select("l_orderkey", catalog.task_description(F.col("t"), 6).alias("description"))


@query("SELECT p_partkey, concat(p_brand, ', ', p_type, ', ', p_name, ', , required_params: [\"', p_size, '\"]') AS doc FROM part")
def retrieval_corpus(spark, sf):
    made = catalog.corpus_text(F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.lit(None).cast("string"), F.array(F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", made.alias("doc"))


@query("SELECT page_id, substr(trim(regexp_replace(lower(url), '[^a-z0-9._]+', '-', 'g'), '-'), 1, 60) || '-' || substr(sha256(url), 1, 8) AS name FROM pages")
def artifact_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", catalog.artifact_name(F.col("url")).alias("name"))


@query("SELECT p_partkey AS api_id, s AS scenario FROM part, unnest(['normal', 'degraded', 'outage']) u(s) WHERE (p_partkey % 2 = 0 AND s = 'outage') OR (p_partkey % 3 = 0 AND s = 'degraded')")
def scenario_gaps(spark, sf):
    names = [x for x, _, _ in qos.SCENARIOS]
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("api_id"), F.explode(F.lit(names)).alias("scenario"))
    return catalog.scenario_gaps(rows.where("not (api_id % 2 = 0 and scenario = 'outage') and not (api_id % 3 = 0 and scenario = 'degraded')"), names)


@query("SELECT l.doc_id, quality, d.doc_id IS NOT NULL AS matched FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 500) d USING (doc_id)")
def review_matches(spark, sf):
    queue = table(spark, sf, "documents").where("n_chars > 500").select("doc_id")
    return reviews.match_queue(table(spark, sf, "labels").select("doc_id", "quality"), queue, "doc_id", "quality")


_EVIDENCE = "ev AS (SELECT user_id, event_type AS method, value AS score FROM events)"


@query(f"WITH {_EVIDENCE} SELECT c_custkey AS user_id, max(score) AS best_score FROM customer LEFT JOIN ev ON user_id = c_custkey AND method = 'click' GROUP BY 1")
def best_scores(spark, sf):
    evidence = table(spark, sf, "events").select("user_id", F.col("event_type").alias("method"), F.col("value").alias("score"))
    return reviews.best_score_of(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), evidence, "user_id", "click")


@query(f"WITH {_EVIDENCE} SELECT user_id, max(score) AS score FROM ev WHERE method LIKE 'dense%' OR starts_with(method, 's') GROUP BY 1")
def dense_scores(spark, sf):
    """Every method whose name begins with s, as dense methods do with their model's."""
    evidence = table(spark, sf, "events").select("user_id", F.col("event_type").alias("method"), F.col("value").alias("score"))
    return reviews.dense_score(evidence, "user_id", "s")


@query(f"WITH {oracle._DECISIONS} SELECT pair_id, score FROM decisions WHERE score >= 0.4 AND left_label <> right_label")
def dense_pairs(spark, sf):
    rows = base._pairs(spark, sf).withColumnsRenamed({"left_label": "left_tool", "right_label": "right_tool"})
    return reviews.dense_pairs(rows, 0.4, other_tool=True).select("pair_id", "score")


@query("SELECT user_id, max_by(event_type, p) AS last_type, min_by(event_type, p) AS first_type FROM (SELECT user_id, event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS p FROM events WHERE event_type IN ('view', 'click', 'purchase')) GROUP BY 1")
def pool_union(spark, sf):
    """Later tables win, then earlier ones."""
    e = table(spark, sf, "events")
    tables = [e.where(F.col("event_type") == x).select("user_id", "event_type").distinct() for x in ("view", "click", "purchase")]
    last = reviews.union_by_priority(tables, "user_id").withColumnRenamed("event_type", "last_type")
    return last.join(reviews.union_by_priority(tables, "user_id", last_wins=False).withColumnRenamed("event_type", "first_type"), "user_id")


@query("""WITH s AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'view' GROUP BY 1), l AS (SELECT user_id, max(event_id) AS m FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN l.m % 2 = 0 THEN CAST(l.m AS VARCHAR) END, CAST(s.m AS VARCHAR), '') AS human FROM customer LEFT JOIN s ON s.user_id = c_custkey LEFT JOIN l ON l.user_id = c_custkey""")
def human_columns(spark, sf):
    """Some of the log's rows have no value, so the sheet's stays."""
    pick = lambda kind: table(spark, sf, "events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("event_id").alias("m"))
    sheet = pick("view").select("c_custkey", F.col("m").cast("string").alias("human"))
    log = pick("error").select("c_custkey", F.when(F.col("m") % 2 == 0, F.col("m").cast("string")).alias("human"))
    return reviews.merge_human(table(spark, sf, "customer").select("c_custkey"), sheet, log, "c_custkey", ["human"])


@query("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_size BETWEEN 5 AND 30 AND contains(lower(p_name || ' ' || p_brand), 'ring brand#1')")
def review_search(spark, sf):
    return reviews.search(table(spark, sf, "part"), ["p_name", "p_brand"], "RING brand#1", p_type="ECONOMY", p_size=(5, 30)).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type ELSE 'unknown' END AS version FROM part")
def prompt_versions(spark, sf):
    own = F.struct(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("prompt_version"))
    source = F.struct(F.when(F.col("p_size") % 3 == 1, F.col("p_type")).alias("prompt_version"))
    return table(spark, sf, "part").select("p_partkey", reviews.provenance(own, source, "prompt_version").alias("version"))


@query("""WITH x AS (SELECT [quantile_cont(value, 0.0), quantile_cont(value, 0.25), quantile_cont(value, 0.5), quantile_cont(value, 0.75), quantile_cont(value, 1.0) + 1e-9] AS x FROM events),
b AS (SELECT k, list_extract(x, k + 1) AS lo, list_extract(x, k + 2) AS hi FROM x, range(4) t(k))
SELECT k AS bin, format('[{:.6f}, {:.6f}', lo, hi) || CASE WHEN k = 3 THEN ']' ELSE ')' END AS label, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate
FROM events JOIN b ON value >= lo AND value < hi GROUP BY k, lo, hi""")
def quartile_histogram(spark, sf):
    e = table(spark, sf, "events")
    return reviews.histogram(e, "value", quality.quartile_edges(e, "value"), F.col("event_type") == "error", digits=6)


@query(f"WITH {oracle._GLOBAL} SELECT count(*) AS pairs, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, min(score) AS min, max(score) AS max, count(*) FILTER (a.label = b.label) AS flag0 FROM g JOIN v a ON a.id = source JOIN v b ON b.id = neighbor")
def neighbor_summary(spark, sf):
    label = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    rows = base.dense_knn_global(spark, sf).join(label.select(F.col("id").alias("source"), F.col("label").alias("la")), "source").join(label.select(F.col("id").alias("neighbor"), F.col("label").alias("lb")), "neighbor")
    return reviews.neighbor_summary(rows, F.col("la") == F.col("lb"))


@query(f"WITH {oracle._POOL} SELECT method, count(*) AS pairs FROM pool GROUP BY 1 UNION ALL SELECT 'several', count(*) FROM (SELECT 1 FROM pool GROUP BY left_id, right_id HAVING count(*) > 1)")
def pool_statistics(spark, sf):
    return reviews.pool_statistics(base.pair_pool(spark, sf))


@query(f"{oracle._REC} {oracle._COMPONENTS} SELECT root, string_agg(decision_id, ',' ORDER BY decision_id) AS decisions FROM decisions JOIN labels ON id = left_id WHERE relation = 'interchangeable' GROUP BY 1")
def cluster_support(spark, sf):
    decided = base.decisions(spark, sf)
    rows = reviews.cluster_support(decided, base.component_labels(spark, sf, decided))
    return rows.select("root", F.array_join("decisions", ",").alias("decisions"))


_AUDIT = f"""a AS (SELECT item_id, list_distinct({oracle._tokens('text', oracle.AUDIT_STOPWORDS)}) AS ws FROM benchmark),
p AS (SELECT x.item_id AS l, y.item_id AS r, len(list_intersect(x.ws, y.ws)) AS k, len(x.ws) AS n, len(y.ws) AS m FROM a x JOIN a y ON y.item_id = x.item_id + 1),
j AS (SELECT l, r, CASE WHEN n + m > 0 THEN k / (n + m - k) ELSE 0 END AS j, greatest(k / greatest(1, n), k / greatest(1, m)) AS c FROM p)"""


@query(f"""WITH {_AUDIT} SELECT l, r, round(2.0 * (l % 2 = 0)::INT + (l % 3 = 0)::INT + j, 6) AS duplicate, round(5 * j + 1.5 * (l % 2 = 0)::INT + (l % 3 = 0)::INT + j, 6) AS interchangeable,
round(3 * c + 1.5 * (l % 5 = 0)::INT + (l % 3 = 0)::INT + j, 6) AS contains, round(2 * j + (j BETWEEN 0.25 AND 0.75)::INT + 0.5 * (l % 5 = 0)::INT, 6) AS boundary FROM j""")
def audit_scores(spark, sf):
    """Each item with the next one; flags by its number."""
    items = table(spark, sf, "benchmark").select("item_id", text.audit_tokens(F.col("text")).alias("ws"))
    rows = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("ws").alias("vs")), "item_id").withColumns({"j": text.jaccard(F.col("ws"), F.col("vs")), "c": text.containment(F.col("ws"), F.col("vs"))})
    i, no = F.col("item_id"), F.lit(False)
    made = reviews.audit_scores(F.col("j"), F.col("j"), F.col("c"), no, no, i % 2 == 0, i % 5 == 0, no, i % 3 == 0, F.col("j"))
    return rows.select(i.alias("l"), (i + 1).alias("r"), *[F.round(v, 6).alias(k) for k, v in made.items()])


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS source, count(*) FILTER (n >= 3) AS eligible, sum(n) FILTER (n >= 3) AS apis, CAST(max(n) AS BIGINT) AS most FROM t""")
def task_set_metrics(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return t.agg(F.count(F.lit(1)).alias("source"), F.count_if(F.col("n") >= 3).alias("eligible"), F.sum(F.when(F.col("n") >= 3, F.col("n"))).alias("apis"), F.max("n").alias("most"))


@query("""SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT user_id FROM events)) AS either, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events)) AS both, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events)) AS left_only""")
def set_overlap(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "events").select(F.col("user_id").alias("id"))
    marked = a.withColumn("side", F.lit(1)).union(b.withColumn("side", F.lit(2))).groupBy("id").agg(F.bit_or("side").alias("side"))
    return marked.agg(F.count(F.lit(1)).alias("either"), F.count_if(F.col("side") == 3).alias("both"), F.count_if(F.col("side") == 1).alias("left_only"))


@query("SELECT id, p_brand AS cluster_id FROM (SELECT c_custkey AS id FROM customer UNION SELECT user_id FROM events) LEFT JOIN part ON p_partkey = id AND p_size > 10")
def key_union_clusters(spark, sf):
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, sf, "events").select(F.col("user_id").alias("id"))).distinct()
    return keys.join(table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster_id")), "id", "left")


_SIDES = f"d AS ({oracle.SQL['qos_donor_pool']}), g AS ({oracle.SQL['qos_profiles']}), x AS (SELECT 'pool' AS side, latency_ms AS v FROM d UNION ALL SELECT 'generated', base_latency_ms FROM g)"


@query(f"WITH {_SIDES} SELECT side, count(*) AS n, round(min(v), 2) AS least, round(max(v), 2) AS most, round(avg(v), 2) AS mean, round(median(v), 2) AS median FROM x GROUP BY 1")
def pool_against_generated(spark, sf):
    side = lambda name, df, c: df.select(F.lit(name).alias("side"), F.col(c).alias("v"))
    rows = side("pool", base.qos_donor_pool(spark, sf), "latency_ms").unionByName(side("generated", base.qos_profiles(spark, sf), "base_latency_ms"))
    parts = {"least": F.min("v"), "most": F.max("v"), "mean": F.avg("v"), "median": F.percentile("v", F.lit(0.5))}
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"), *[F.round(v, 2).alias(k) for k, v in parts.items()])


_ABOVE = """above(task_id, node_id, ancestor_id, distance) AS (SELECT conv_id, turn, turn, 0 FROM conversations UNION ALL SELECT task_id, node_id, (ancestor_id - 1) // 2, distance + 1 FROM above WHERE ancestor_id > 0)"""


@query(f"WITH RECURSIVE {_ABOVE} SELECT task_id, node_id, bool_or(ancestor_id = 1) AS pruned FROM above GROUP BY 1, 2")
def pruned_nodes(spark, sf):
    nodes = base.conversation_nodes(spark, sf)
    return trajectory.prune(nodes, nodes.where("node_id = 1").select("task_id", "node_id")).select("task_id", "node_id", "pruned")


@query(f"""WITH RECURSIVE {_ABOVE}, m AS (SELECT conv_id AS task_id, max(turn) AS node_id FROM conversations GROUP BY 1),
p AS (SELECT a.*, sum((c.role = 'user')::INT) OVER (PARTITION BY a.task_id ORDER BY distance) - (c.role = 'user')::INT AS passed FROM above a JOIN m USING (task_id, node_id) JOIN conversations c ON c.conv_id = a.task_id AND c.turn = a.ancestor_id)
SELECT conv_id AS task_id, turn AS node_id, EXISTS (SELECT 1 FROM p WHERE p.task_id = conv_id AND p.ancestor_id = turn AND passed <= 1) AS finished FROM conversations""")
def finished_nodes(spark, sf):
    nodes = base.conversation_nodes(spark, sf)
    last = nodes.groupBy("task_id").agg(F.max("node_id").alias("_last"))
    marked = nodes.join(last, "task_id").select("task_id", "node_id", "parent_id", "role", (F.col("node_id") == F.col("_last")).alias("finished"))
    return trajectory.propagate_finish(marked, "role", 1, last="user").select("task_id", "node_id", "finished")


@query(f"""WITH RECURSIVE {_ABOVE}, p AS (SELECT conv_id AS task_id, max(turn) AS left_id, max(turn) - 1 AS right_id FROM conversations GROUP BY 1 HAVING max(turn) > 0)
SELECT p.*, max(a.ancestor_id) AS ancestor_id FROM p JOIN above a ON a.task_id = p.task_id AND a.node_id = left_id JOIN above b ON b.task_id = p.task_id AND b.node_id = right_id AND a.ancestor_id = b.ancestor_id GROUP BY ALL""")
def common_ancestors(spark, sf):
    nodes = base.conversation_nodes(spark, sf)
    pairs = nodes.groupBy("task_id").agg(F.max("node_id").alias("left_id")).where("left_id > 0").withColumn("right_id", F.col("left_id") - 1)
    return trajectory.common_ancestor(nodes, pairs)


@query("""WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT c.conv_id AS task_id, coalesce(string_agg(role || turn, ',' ORDER BY turn) FILTER (turn <= last AND (turn % 3 <> 1 OR turn = last)), '') AS messages FROM conversations c LEFT JOIN l USING (conv_id) GROUP BY 1""")
def training_messages(spark, sf):
    rows = trajectory.train_messages(base.conversation_nodes(spark, sf).withColumn("ok", F.col("node_id") % 3 != 1), "node_id", "role", "ok")
    return rows.select("task_id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], x["at"].cast("string"))), ",").alias("messages"))


@query("SELECT conv_id AS task_id, turn AS node_id, CAST(row_number() OVER (PARTITION BY conv_id, (turn - 1) // 2 ORDER BY length(text) DESC, turn) - 1 AS INT) AS place FROM conversations WHERE turn > 0")
def child_order(spark, sf):
    nodes = base.conversation_nodes(spark, sf).withColumn("score", F.length("text"))
    return trajectory.child_order(nodes, "score").select("task_id", "node_id", "place")


@query(f"""WITH leaf AS (SELECT conv_id AS task_id, turn AS node_id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn > 0 AND (d.turn - 1) // 2 = c.turn))
SELECT task_id, node_id FROM leaf QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY {oracle._sha(repr(str(SEED)), 'task_id', 'node_id')}, node_id) = 1""")
def give_up_nodes(spark, sf):
    return trajectory.give_up_node(base.conversation_nodes(spark, sf), SEED)


@query("SELECT 'c' || c_custkey AS pair_id, 'r' || n_regionkey || '>n' || n_nationkey || ',n' || n_nationkey || '>c' || c_custkey AS path FROM customer JOIN nation ON n_nationkey = c_nationkey")
def supporting_paths(spark, sf):
    """From its region to every customer."""
    nation = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("source"))
    pairs = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("pair_id"), "source", F.concat(F.lit("c"), "c_custkey").alias("target"))
    edges = base.hierarchy(spark, sf).withColumn("decision_id", F.concat_ws(">", "source", "target"))
    return graph.supporting_paths(pairs, edges).select("pair_id", F.array_join("path", ",").alias("path"))


@query(f"WITH {oracle._DECISIONS} SELECT CASE WHEN decision_source = 'human' AND relation = 'interchangeable' THEN 0 WHEN decision_source = 'human' THEN 1 ELSE 2 END AS priority, relation, count(*) AS n FROM decisions GROUP BY 1, 2")
def seed_priorities(spark, sf):
    return base.decisions(spark, sf).groupBy(graph.seed_priority(F.col("relation"), F.col("decision_source")).alias("priority"), "relation").agg(F.count(F.lit(1)).alias("n"))
