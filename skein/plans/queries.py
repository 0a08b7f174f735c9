"""Queries over the test tables, each of which applies an operator to all rows of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import classify, graph, qos, quality, retrieval, sampling, tasks, trajectory, validation

#: Seed of all draws, and the cosine from which two vectors count as interchangeable.
SEED, SAME = 42, 0.55
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def normalize_ids(spark, sf):
    api = ids.api_id(F.col("p_brand"), F.col("p_type"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", api.alias("api_id"), ids.tool_key(api).alias("tool_key"))


@query
def hash_ids(spark, sf):
    d, s = F.col("doc_id"), F.col("source")
    return table(spark, sf, "documents").select("doc_id", ids.stable_id("decision_", d, s).alias("decision_id"), ids.pair_id(d, d + 1).alias("pair_id"), ids.stable_seed(d, s).alias("seed"), F.round(ids.uniform(SEED, d, "outcome"), 9).alias("draw"))


@query
def catalog_flatten_stats(spark, sf):
    used = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("calls"))
    rows = table(spark, sf, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left")
    n, with_calls = F.count(F.lit(1)), F.count("calls")
    return rows.groupBy(F.col("p_brand").alias("category")).agg(n.alias("apis"), F.countDistinct("p_type").alias("tools"), with_calls.alias("apis_with_calls"), F.round(quality.ratio(with_calls, n), 6).alias("coverage"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))


@query
def candidate_filter_reasons(spark, sf):
    marks = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf, "documents").join(marks, "doc_id", "left")
    first = docs.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min("doc_id").alias("first"))
    rows = docs.withColumn("h", F.xxhash64("text")).withColumn("n", F.length("text")).join(first, ["h", "n"])
    reason = F.when(F.col("n") < 50, "missing_description").when(F.col("quality").isNull(), "incomplete_labels").when(F.col("toxic") == 1, "toxic").when(F.col("doc_id") != F.col("first"), "duplicate")
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def semantic_text(spark, sf):
    made = text.semantic_text(Language=F.col("lang"), Source=F.col("source"), Text=F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(made, 256).alias("digest"))


@query
def param_signature(spark, sf):
    names = F.array("p_brand", "p_type", F.lit(" Size "))
    types = F.array(F.lit("string"), F.lit(" "), F.when(F.col("p_size") > 25, "number"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.parameter_signature(names, types), ",").alias("signature"))


@query
def lexical_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.lexical_tokens(F.col("text"))).alias("n_tokens"), F.size(text.audit_tokens(F.col("text"))).alias("n_audit"))


@query
def bm25_topk(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25_topk(queries, table(spark, sf, "documents"), k=10)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query
def dense_knn_global(spark, sf):
    return retrieval.dense_topk(vectors(spark, sf), k=10)


@query
def dense_knn_by_group(spark, sf):
    return retrieval.dense_topk(vectors(spark, sf), k=5, group=F.col("label"))


@query
def dense_knn_other_tools(spark, sf):
    return retrieval.dense_topk(vectors(spark, sf), k=5, exclude=F.col("label"))


#: Neighbours that each method puts into the pool.
POOLED = 30


@query
def pair_pool(spark, sf):
    """Entities with one number: an item's text by BM25 among the items, its vector by cosine among the vectors."""
    items = table(spark, sf, "benchmark")
    lexical = retrieval.bm25_topk(items.select(F.col("item_id").alias("query_id"), "text"), items.select(F.col("item_id").alias("doc_id"), "text"), k=POOLED, exclude_self=True)
    lexical = lexical.select(F.col("query_id").alias("source"), F.col("doc_id").alias("neighbor"), "score", "rank", F.lit("bm25").alias("method"))
    return retrieval.pool_pairs(retrieval.dense_topk(vectors(spark, sf), k=POOLED).withColumn("method", F.lit("dense")).unionByName(lexical))


@query
def pair_features_strata(spark, sf):
    rows = retrieval.pair_features(pair_pool(spark, sf))
    return rows.fillna(0, ["dense_best_rank", "dense_best_score", "lexical_best_rank"])


@query
def stratified_sample(spark, sf):
    rows = graph.cut(pair_features_strata(spark, sf).select("pair_id", "stratum"))
    return sampling.stratified_sample(rows, "stratum", "pair_id", 200, SEED)


@query
def interleave_strata(spark, sf):
    return sampling.interleave(table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["doc_id"])


@query
def greedy_audit_select(spark, sf):
    c = F.col
    rows = pair_features_strata(spark, sf).select("pair_id", c("dense_reciprocal").cast("int").alias("r"), F.coalesce("dense_best_score", F.lit(0.0)).alias("s"), c("lexical_present").cast("int").alias("g"))
    scorers = [("duplicate", 5 * c("g") + c("r") + c("s")), ("interchangeable", 2 * c("s") + c("r")), ("contains", 3 * c("g") - c("s")), ("boundary", -F.abs(c("s") - 0.5))]
    return sampling.greedy_select(rows, "pair_id", scorers, 25).select("pair_id", "target", "score")


@query
def jaccard_pairs(spark, sf):
    left = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.audit_tokens(F.col("text")).alias("a"))
    right = table(spark, sf, "documents").select("doc_id", text.audit_tokens(F.col("text")).alias("b"))
    rows = bm25_topk(spark, sf).select("query_id", "doc_id").join(left, "query_id").join(right, "doc_id")
    return rows.select("query_id", "doc_id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(text.containment(F.col("a"), F.col("b")), 6).alias("containment"), text.scope_contrast(F.col("a"), F.col("b")).alias("scope_contrast"))


@query
def latest_event_wins(spark, sf):
    return sampling.latest_by(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct pairs of near vectors with the labels of both sides. They are written before anything joins or reads them twice: a second search costs as much again."""
    near = dense_knn_global(spark, sf)
    a, b = F.col("source"), F.col("neighbor")
    pairs = graph.cut(near.groupBy(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")).agg(F.max("score").alias("score")))
    v = vectors(spark, sf)
    left, right = (v.select(F.col("id").alias(f"{s}_id"), F.col("label").alias(f"{s}_label")) for s in ("left", "right"))
    return pairs.join(left, "left_id").join(right, "right_id").withColumn("pair_id", ids.pair_id(F.col("left_id"), F.col("right_id")))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of those pairs: near ones interchangeable, a seeded tenth of the others contain, the rest differ."""
    seed = ids.stable_seed(F.col("pair_id"))
    rows = _pairs(spark, sf).withColumn("decision_id", ids.stable_id("decision_", F.col("pair_id")))
    relation = F.when(F.col("score") >= SAME, "interchangeable").when(seed % 10 == 0, "contains").otherwise("different_capability")
    direction = F.when(F.col("relation") != "contains", "none").when(seed % 20 == 0, "left_contains_right").otherwise("right_contains_left")
    source = F.when(seed % 7 == 0, "inferred").when(seed % 7 == 1, "human").when(seed % 7 == 2, "migrated_seed").otherwise("llm")
    return rows.withColumn("relation", relation).withColumn("direction", direction).withColumn("decision_source", source)


@query
def override_transitions(spark, sf):
    review = F.when(F.col("left_label") == F.col("right_label"), "exact_duplicate").otherwise("uncertain")
    rows = decisions(spark, sf).select("relation", graph.canonical_relation(review).alias("human"))
    return rows.groupBy(F.concat_ws("->", "relation", "human").alias("transition")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relation") == F.col("human")).alias("confirmed"))


@query
def direct_decision_filter(spark, sf):
    rows = decisions(spark, sf)
    s = F.col("decision_source")
    return rows.groupBy("relation").agg(F.count_if(s.isin("llm", "migrated_seed")).alias("expand"), F.count_if(s.isin("llm", "migrated_seed", "human")).alias("export"), F.count_if(s == "llm").alias("migrate"))


@query
def review_queue(spark, sf):
    from pyspark.sql import Window

    rows = decisions(spark, sf).where(F.col("decision_source").isin("llm", "migrated_seed") & F.col("relation").isin("interchangeable", "contains"))
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("left_id")).distinct()
    flagged = F.col("left_label") != F.col("right_label")
    left = rows.join(done, "left_id", "left_anti").select("pair_id", flagged.alias("flagged"), "score")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("flagged").orderBy("score", "pair_id")))


@query
def unordered_pair_regression(spark, sf):
    rows = decisions(spark, sf)
    # Expected cases name the sides the other way round.
    case = rows.where("relation = 'contains'").select(F.col("right_id").alias("c_left"), F.col("left_id").alias("c_right"), F.lit("contains").alias("wanted"), F.lit("left_contains_right").alias("wanted_direction"))
    joined = case.join(rows, (F.least("c_left", "c_right") == rows["left_id"]) & (F.greatest("c_left", "c_right") == rows["right_id"]))
    direction = F.when(F.col("left_id") != F.col("c_left"), graph.reverse_direction(F.col("direction"))).otherwise(F.col("direction"))
    status = F.when((F.col("relation") == F.col("wanted")) & (direction == F.col("wanted_direction")), "PASS").otherwise("FAIL")
    return joined.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def component_labels(spark: SparkSession, sf: str, pairs: DataFrame | None = None) -> DataFrame:
    """Components of near pairs; `pairs` are those that were found before."""
    pairs = _pairs(spark, sf) if pairs is None else pairs
    return graph.components(vectors(spark, sf).select("id"), pairs.where(F.col("score") >= SAME).select("left_id", "right_id"))


@query
def components_clusters(spark, sf):
    return graph.clusters(component_labels(spark, sf)).drop("members")


@query
def cluster_statistics(spark, sf):
    return graph.cluster_statistics(component_labels(spark, sf))


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """region over nation over supplier and customer."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nation = table(spark, sf, "nation").select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"))
    supplier = table(spark, sf, "supplier").select(name("n", "s_nationkey").alias("source"), name("s", "s_suppkey").alias("target"))
    customer = table(spark, sf, "customer").select(name("n", "c_nationkey").alias("source"), name("c", "c_custkey").alias("target"))
    return nation.unionByName(supplier).unionByName(customer)


@query
def contains_closure(spark, sf):
    return graph.closure(hierarchy(spark, sf))


@query
def cluster_edges(spark, sf):
    rows = graph.cut(decisions(spark, sf))
    found = graph.cluster_edges(graph.project(rows, component_labels(spark, sf, rows)))
    return found.select("relation", "source_root", "target_root", "support_count", F.array_join("support", ",").alias("support"))


@query
def infer_relations(spark, sf):
    rows = graph.cut(decisions(spark, sf))
    labels = component_labels(spark, sf, rows)
    direct = rows.where("decision_source <> 'inferred'")
    pairs = rows.where("decision_source = 'inferred'").select("pair_id", "left_id", "right_id")
    return graph.infer(pairs, labels, graph.cluster_edges(graph.project(direct, labels))).select("pair_id", "inferred_relation", "inferred_direction", "rule")


@query
def candidate_coverage(spark, sf):
    found = infer_relations(spark, sf)
    return found.groupBy(F.coalesce("inferred_relation", F.lit("unknown")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query
def graph_diagnostics(spark, sf):
    rows = graph.cut(decisions(spark, sf))
    projected = graph.project(rows, component_labels(spark, sf, rows))
    return graph.diagnostics(projected, graph.cluster_edges(projected))


def _wrong() -> Column:
    return F.col("left_label") != F.col("right_label")


@query
def histogram_relation_error(spark, sf):
    return quality.histogram(decisions(spark, sf), "score", "relation", ["interchangeable", "contains", "different_capability"], edges=[0.0, 0.3, 0.4, 0.5, 0.6, 1.0000001], wrong=_wrong())


@query
def confidence_cumulative(spark, sf):
    return quality.cumulative_error(decisions(spark, sf), "score", _wrong(), [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.8, 1.0])


@query
def confidence_exact(spark, sf):
    rows = decisions(spark, sf).groupBy(F.round("score", 2).alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.count_if(_wrong()).alias("errors"))
    return rows.withColumn("rate", F.round(quality.ratio(F.col("errors"), F.col("n")), 6))


@query
def threshold_recall(spark, sf):
    return quality.threshold_for_recall(decisions(spark, sf), "score", ~_wrong())


@query
def threshold_sensitivity(spark, sf):
    return quality.threshold_sensitivity(decisions(spark, sf), "score", ~_wrong(), [0.3, 0.4, 0.5, 0.6])


@query
def score_by_relation_upper_median(spark, sf):
    return quality.upper_median(decisions(spark, sf), "score", "relation")


@query
def numeric_summary(spark, sf):
    return quality.numeric_summary(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus")


@query
def length_quantiles(spark, sf):
    return quality.quantiles(table(spark, sf, "documents"), "n_chars", "lang")


@query
def token_length_stats(spark, sf):
    n, most = F.col("n"), 512
    rows = table(spark, sf, "documents").select("lang", F.size(text.lexical_tokens(F.col("text"))).alias("n"))
    parts = [F.round(F.percentile(n, F.lit(p / 100)), 6).alias(f"p{p}") for p in (50, 90, 95, 99)]
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.count_if(n > most).alias("truncated"), F.round(F.avg((n > most).cast("int")), 6).alias("truncated_ratio"), F.sum(F.greatest(F.lit(0), n - most)).alias("tokens_lost"), *parts)


@query
def fingerprint(spark, sf):
    """Digests of runs of 1000 ids, then of the digests of each source's runs: no text waits for all others."""
    row = F.sha2(F.concat_ws(ids.UNIT, F.col("doc_id").cast("string"), F.col("text")), 256)
    rows = table(spark, sf, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 1000).alias("run"), row.alias("h"))
    sorted_join = lambda key, h: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, h))), lambda x: x[h]), "")
    runs = rows.groupBy("source", "run").agg(F.sha2(sorted_join("doc_id", "h"), 256).alias("d"))
    return runs.groupBy("source").agg(F.sha2(sorted_join("run", "d"), 256).alias("fingerprint"))


def donors(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("d"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.avg("l_extendedprice").alias("p"))
    rows = table(spark, sf, "supplier").join(line, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return qos.donor_pool(rows.select(F.col("s_suppkey").alias("api_id"), F.col("s_nationkey").alias("tool_id"), (100 - 100 * F.col("d")).alias("service_level"), (100 - 50 * F.col("r")).alias("success_rate"), (F.col("p") / 100).alias("latency_ms")))


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "part").select(F.col("p_partkey").alias("api_id"), (F.col("p_size") % 25).alias("tool_id"))
    return qos.baseline(qos.assign_donors(targets, donors(spark, sf), SEED), SEED)


def _late(df: DataFrame, **digits: int) -> DataFrame:
    """Rounded to fewer digits, as engines differ in the last ones."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _cut(df: DataFrame, **digits: int) -> DataFrame:
    """Cut to fewer digits than they were rounded to before."""
    return df.withColumns({c: F.floor(F.col(c) * 10.0**d) / 10.0**d for c, d in digits.items()})


@query
def qos_donor_pool(spark, sf):
    return _late(donors(spark, sf), service_level=5, success_rate=5, latency_ms=4)


@query
def qos_profiles(spark, sf):
    return _cut(profiles(spark, sf), base_success=6, base_latency_ms=3, cost_units=7, latency_log_sigma=6)


@query
def qos_scenarios(spark, sf):
    return _cut(qos.scenarios(profiles(spark, sf)), success_rate=6, expected_latency_ms=2, cost_units=7, latency_log_sigma=6)


def calls(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("api_id"))
    normal = qos.scenarios(profiles(spark, sf)).where("scenario = 'normal'")
    return qos.simulate(qos.call_index(events, "api_id", ["event_id"]), normal, SEED)


@query
def qos_simulate_calls(spark, sf):
    return _cut(calls(spark, sf), latency_ms=2, cost_units=7, success_rate=6)


@query
def qos_call_summary(spark, sf):
    return _late(qos.call_summary(calls(spark, sf), "profile_found"), mean_latency=1, median_latency=1, p95_latency=1, total_cost=4).drop("configured_rate")


@query
def task_expansion(spark, sf):
    members = table(spark, sf, "part").select(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("cluster_id"), F.col("p_partkey").alias("api_id"))
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("api_id"))
    return tasks.expand_by_cluster(used, members)


@query
def all_or_nothing_lookup(spark, sf):
    wanted = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("api_id"))
    known = table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("api_id"))
    return tasks.all_found(wanted, known, "task_id", "api_id")


@query
def paraphrase_variants(spark, sf):
    make = lambda x: [F.lower(x), F.concat(F.lit("Please: "), x), F.lower(x), F.lit(" ")]
    return tasks.variants(table(spark, sf, "benchmark"), "item_id", "text", make)


@query
def cache_gap_plan(spark, sf):
    return tasks.gap_plan(table(spark, sf, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("api"), F.col("props").alias("input")))


@query
def cache_overlay(spark, sf):
    pick = lambda kind: table(spark, sf, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("value").alias("value"))
    return tasks.overlay(pick("view"), pick("click"), ["user_id"], "value")


@query
def few_shot_examples(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("api"), F.col("event_id").alias("seq"), F.col("props").alias("input"), F.col("event_type").alias("response"))
    return tasks.few_shot(rows, rows.select(F.col("seq").alias("request_id"), "api", "input"))


@query
def error_classify(spark, sf):
    found = classify.classify_error(F.col("text"))
    rows = table(spark, sf, "conversations").select(found.alias("e"), classify.acceptable(F.col("text")).alias("acceptable"))
    return rows.groupBy(F.col("e.error").alias("error"), F.col("e.save_cache").alias("save_cache"), F.col("e.switch").alias("switch"), classify.status_code(F.col("e.error")).alias("status"), "acceptable").agg(F.count(F.lit(1)).alias("n"))


@query
def page_classify(spark, sf):
    found = classify.classify_error(F.col("html"))
    return table(spark, sf, "pages").select("page_id", found["error"].alias("error"), classify.status_code(found["error"]).alias("status"), classify.acceptable(F.col("html")).alias("acceptable"))


@query
def react_parse(spark, sf):
    made = F.concat(F.lit("Thought: "), F.col("role"), F.lit("\nAction: act_"), F.col("turn").cast("string"), F.lit("\nAction Input: {\"k\": "), F.col("conv_id").cast("string"), F.lit("}"))
    parts = text.react_parts(made)
    return table(spark, sf, "conversations").select("conv_id", "turn", parts["thought"].alias("thought"), parts["action"].alias("action"), F.get_json_object(parts["action_input"], "$.k").alias("k"), F.length(text.truncate(F.col("text"), 200)).alias("shown"))


@query
def code_fence_parse(spark, sf):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", tasks.canonical_input(text.strip_fence(fenced)).alias("canonical"))


def conversation_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn below the one at half its number: a binary tree."""
    up = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("node_id"), up.cast("long").alias("parent_id"), "role", "text")


@query
def tree_metrics(spark, sf):
    return trajectory.tree_metrics(conversation_nodes(spark, sf))


@query
def trajectory_chain(spark, sf):
    return trajectory.chain_text(conversation_nodes(spark, sf), "node_id", "role")


@query
def tournament_scores(spark, sf):
    return tasks.tournament(table(spark, sf, "documents"), F.col("n_chars"), "source", "doc_id")


@query
def call_index(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id")
    return qos.call_index(rows, "user_id", ["event_id"])


@query
def stream_call_index(spark, sf):
    from ..streaming import calls as streaming

    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select(F.col("user_id").alias("api_id"), F.col("event_id").alias("seq"))
    return streaming.run_available(spark, streaming.number_calls(stream), streaming.scratch_folder(spark))


@query
def annotation_validation(spark, sf):
    seed = ids.stable_seed(F.col("pair_id"))
    answer = F.struct("relation", "direction", F.when(seed % 11 == 0, F.lit(1.5)).otherwise(F.col("score")).alias("confidence"), F.when(seed % 5 == 0, F.lit(" ")).otherwise(F.lit("because")).alias("reasoning"), F.array(F.lit("e")).alias("evidence"), (seed % 2 == 0).alias("needs_human_review"))
    output = F.concat(F.lit("```json\n"), F.to_json(answer), F.lit("\n```"))
    rows = decisions(spark, sf).select(validation.annotation_error(output).alias("error"))
    return rows.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query
def function_schemas(spark, sf):
    kind = "array<struct<name:string,type:string,description:string,default:string>>"
    one = F.array(F.struct(F.lit("Size Of").alias("name"), F.lit("NUMBER").alias("type"), F.col("p_type").alias("description"), F.col("p_size").cast("string").alias("default"))).cast(kind)
    made = validation.function_schema(F.col("p_name"), ids.standardize(F.col("p_brand")), F.col("p_type"), one, F.lit(None).cast(kind))
    return table(spark, sf, "part").select("p_partkey", made["name"].alias("name"), made["description"].alias("description"), F.concat_ws("|", made["properties"][0]["name"], made["properties"][0]["type"], made["properties"][0]["example_value"]).alias("property"))


@query
def migration_split(spark, sf):
    return graph.migrate(decisions(spark, sf)).groupBy("relation", "decision_source", "fate").agg(F.count(F.lit(1)).alias("n"))


@query
def human_overrides(spark, sf):
    rows = decisions(spark, sf)
    told = rows.where(ids.stable_seed(F.col("pair_id")) % 3 == 0)
    human = F.when(F.col("left_label") == F.col("right_label"), "exact_duplicate").otherwise("uncertain")
    first = told.select("pair_id", F.lit(1).alias("seq"), F.lit("contains").alias("human_relation"), F.lit("left_contains_right").alias("human_direction"))
    last = told.select("pair_id", F.lit(2).alias("seq"), human.alias("human_relation"), F.lit(None).cast("string").alias("human_direction"))
    return graph.override(rows, first.unionByName(last)).select("pair_id", "relation", "direction", "decision_source", F.coalesce("review", F.lit("none")).alias("review"))


@query
def elo_shares(spark, sf):
    rows = tasks.softmax_bias(table(spark, sf, "events").select("event_id", "user_id", "value"), "value", "user_id")
    return rows.select("event_id", F.round("share", 6).alias("share"))


@query
def first_event_per_user(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return sampling.first_by(rows, ["user_id"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query
def request_budget(spark, sf):
    """Requests by day over decisions and errors, with zero-safe error ratios."""
    e = table(spark, sf, "events")
    failed = F.col("event_type") == "error"
    rows = e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("errors"), F.countDistinct("user_id").alias("users"))
    return rows.withColumn("day", F.col("day").cast("string")).withColumn("error_ratio", F.round(quality.ratio(F.col("errors"), F.col("requests")), 6))
