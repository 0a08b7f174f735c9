"""Agent trajectories as node tables (task_id, node_id, parent_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depths(nodes: DataFrame) -> DataFrame:
    """task_id, node_id, root_id, depth: by pointer doubling, so a chain of n nodes takes log2(n) rounds.

    No chain has more nodes than the table; where one doesn't end in so many, parents form a cycle, which is an error.
    """
    from .graph import cut

    has = F.col("parent_id").isNotNull()
    table = cut(nodes.select("task_id", "node_id", F.coalesce("parent_id", "node_id").alias("up"), has.cast("int").alias("depth")))
    for _ in range(table.count().bit_length() + 1):
        above = table.select(F.col("task_id").alias("_t"), F.col("node_id").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        new = cut(table.join(above, (F.col("task_id") == F.col("_t")) & (F.col("up") == F.col("_n")), "left").select("task_id", "node_id", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), (F.coalesce("_d", F.lit(0)) > 0).alias("_moved")))
        table = new.drop("_moved")
        if not new.where("_moved").limit(1).count():
            break
    else:
        raise ValueError("parent_id leads in a cycle")
    return table.select("task_id", "node_id", F.col("up").alias("root_id"), "depth")


def tree_metrics(nodes: DataFrame) -> DataFrame:
    """task_id, n_nodes, max_depth, n_leaves, max_children."""
    deep = depths(nodes).groupBy("task_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("max_depth"))
    children = nodes.where("parent_id is not null").groupBy("task_id", "parent_id").agg(F.count(F.lit(1)).alias("_c"))
    inner = children.groupBy("task_id").agg(F.count(F.lit(1)).alias("_inner"), F.max("_c").alias("_most"))
    rows = deep.join(inner, "task_id", "left")
    return rows.select("task_id", "n_nodes", "max_depth", (F.col("n_nodes") - F.coalesce("_inner", F.lit(0))).alias("n_leaves"), F.coalesce("_most", F.lit(0)).alias("max_children"))


def chain_text(nodes: DataFrame, order: str, text: str) -> DataFrame:
    """task_id, n_steps, trace: a task's texts in order, each after its number. A trace grows with its own task."""
    rows = nodes.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_steps"))
    lines = F.transform("_steps", lambda x: F.concat_ws(": ", x[order].cast("string"), x[text]))
    return rows.select("task_id", F.size("_steps").alias("n_steps"), F.array_join(lines, "\n").alias("trace"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(task_id, node_id, ancestor_id, distance) for every node and each node above it, itself at distance 0. Paths double each round."""
    from .graph import cut

    known = cut(nodes.where("parent_id is not null").select("task_id", "node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).cast("long").alias("distance")))
    reach = 1
    while True:
        far = known.where(F.col("distance") == reach).select("task_id", "node_id", F.col("ancestor_id").alias("_via"))
        up = known.select("task_id", F.col("node_id").alias("_via"), "ancestor_id", (F.col("distance") + reach).alias("distance"))
        grown = cut(far.join(up, ["task_id", "_via"]).select("task_id", "node_id", "ancestor_id", "distance"))
        if not grown.limit(1).count():
            break
        if grown.where("node_id = ancestor_id").limit(1).count():
            raise ValueError("parent_id leads in a cycle")
        known, reach = cut(known.unionByName(grown)), 2 * reach
    return known.unionByName(nodes.select("task_id", "node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).cast("long").alias("distance")))


def prune(nodes: DataFrame, cut_at: DataFrame) -> DataFrame:
    """`nodes` with `pruned`: whether they are in `cut_at` (task_id, node_id) or below one of these."""
    gone = ancestors(nodes).join(cut_at.select("task_id", F.col("node_id").alias("ancestor_id")).distinct(), ["task_id", "ancestor_id"], "left_semi").select("task_id", "node_id").distinct()
    return nodes.join(gone.withColumn("pruned", F.lit(True)), ["task_id", "node_id"], "left").withColumn("pruned", F.coalesce("pruned", F.lit(False)))


def propagate_finish(nodes: DataFrame, kind: str, steps: int, last: str = "Action Input") -> DataFrame:
    """`nodes` (finished) with `finished` also where a finished node is at most `steps` nodes of kind `last` further down."""
    kinds = nodes.select("task_id", F.col("node_id").alias("_mid"), (F.col(kind) == last).cast("int").alias("_is"))
    above = ancestors(nodes).join(nodes.where("finished").select("task_id", "node_id"), ["task_id", "node_id"], "left_semi")
    between = above.select("task_id", F.col("node_id").alias("_end"), F.col("ancestor_id").alias("_mid"), F.col("distance").alias("_d")).join(kinds, ["task_id", "_mid"])
    from pyspark.sql import Window

    # A path is as long as its own tree is deep.
    passed = F.sum("_is").over(Window.partitionBy("task_id", "_end").orderBy("_d")) - F.col("_is")
    reached = between.withColumn("_passed", passed).where(F.col("_passed") <= steps).select("task_id", F.col("_mid").alias("node_id")).distinct()
    return nodes.drop("finished").join(reached.withColumn("finished", F.lit(True)), ["task_id", "node_id"], "left").withColumn("finished", F.coalesce("finished", F.lit(False))).select(*nodes.columns)


def common_ancestor(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """`pairs` (task_id, left_id, right_id) and `ancestor_id`, the lowest node above both or one of them itself."""
    above = ancestors(nodes)
    left = above.select("task_id", F.col("node_id").alias("left_id"), "ancestor_id", F.col("distance").alias("_l"))
    right = above.select("task_id", F.col("node_id").alias("right_id"), "ancestor_id")
    both = pairs.join(left, ["task_id", "left_id"]).join(right, ["task_id", "right_id", "ancestor_id"])
    return both.groupBy(*pairs.columns).agg(F.min_by("ancestor_id", "_l").alias("ancestor_id"))


def train_messages(nodes: DataFrame, order: str, role: str, valid: str | None = None) -> DataFrame:
    """(task_id, messages) of each task's turns in order up to the last one of the assistant; of invalid ones only a last one stays."""
    rows = nodes.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(role).alias("role"), (F.col(valid) if valid else F.lit(True)).alias("valid")))).alias("_all"))
    last = F.array_max(F.transform(F.filter("_all", lambda x: x["role"] == "assistant"), lambda x: x["at"]))
    kept = F.filter("_all", lambda x: (x["at"] <= F.col("_last")) & (x["valid"] | (x["at"] == F.col("_last"))))
    return rows.withColumn("_last", last).withColumn("messages", F.coalesce(kept, F.array().cast(rows.schema["_all"].dataType))).select("task_id", "messages")


def child_order(nodes: DataFrame, score: str) -> DataFrame:
    """Adds `place` from 0 of each node among its parent's children: the highest score first, then the smallest id."""
    from pyspark.sql import Window

    rows = nodes.where("parent_id is not null")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("task_id", "parent_id").orderBy(F.desc(score), "node_id")) - 1)


def give_up_node(nodes: DataFrame, seed: int) -> DataFrame:
    """(task_id, node_id): a leaf of each task, drawn by seed, for tasks that have no answer."""
    from .sampling import seeded_order

    parents = nodes.where("parent_id is not null").select("task_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = nodes.select("task_id", "node_id").join(parents, ["task_id", "node_id"], "left_anti")
    draw = seeded_order(seed, F.col("task_id").cast("string"), F.col("node_id"))
    return leaves.groupBy("task_id").agg(F.min_by("node_id", F.struct(draw, "node_id")).alias("node_id"))
