"""Near-duplicate documents by the Jaccard similarity of their word shingles, with a token-group matrix.

1. Documents with equal sets form a class, of which one goes on.
2. Signatures of parts of its set (see shingles.Partition) say which others a document may link with. Each document is
   compared with the hub of the signatures it shares, once; the links found make groups of similar documents.
3. The token-group matrix holds the union of the shingles of each group. It bounds how many shingles of a document a group
   can contain; only groups that reach what a link needs are opened: a row for each of their members, which bounds by sizes,
   lone shingles and parity bits leave or drop before sets are compared.
Groups that the document is in already are never opened, which keeps thousands of near copies from being compared in pairs,
and no link between groups is lost. What is left to grow is the number of documents near a group and in no link with it,
times that group's members.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, release, scratch, session, slices
from .shingles import Partition, mix, shingle_sets

#: Up to so many ids (8 bytes each) are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of text that a worker hashes at once; its arrays take about fifty times as much.
SLICE = 1 << 18
#: Classes of equal sets with more documents than this are joined by broadcast; there are fewer of them than rows by so many.
HOT_ROWS = 1_000_000


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _bounds(lengths: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _size(meta: str) -> Column:
    return F.col(meta).bitwiseAND(F.lit((1 << 30) - 1))


def _filled(meta: str) -> Column:
    return F.shiftright(meta, 30).bitwiseAND(F.lit((1 << 26) - 1))


def needed(percent: int, meta: str, other: str | None = None) -> Column:
    """How many signatures of one class a document shares with the `other` if they link, or with anyone it can link with."""
    total = _size(meta) + (_size(other) if other else F.floor(_size(meta) * 100 / percent))
    filled = F.greatest(_filled(meta), _filled(other)) if other else _filled(meta)
    return F.greatest(F.lit(1), filled - F.floor(total * (100 - percent) / (100 + percent)))


def overlap(percent: int, total: Column) -> Column:
    """How many elements two sets that link have in common, if they have `total` together."""
    return F.ceil(total * percent / (100 + percent))


#: What tells sets of shingles apart.
KEY = ["n_shingles", "h1", "h2"]


def _hashes(sets: list[np.ndarray]) -> list[np.ndarray]:
    """h1 and h2 of sets."""
    return [np.array([mix(x ^ np.uint64(c)).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64) for c in (0x1234567, 0x89ABCDEF)]


def set_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (hashes of the set), parts, for every row; texts are read once.

    A part has the signatures of a class, and `meta`: from the highest byte on, the class, how many parts aren't empty (26
    bits) and the size of the set (30 bits).
    """
    names = ["doc_id", "n_shingles", "h1", "h2", "parts"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = Partition(percent)
        for batch in slices(batches, most=SLICE):
            sets = shingle_sets([x or "" for x in batch.column(1).to_pylist()], n)
            sizes = np.array([len(x) for x in sets], np.int64)
            h1, h2 = _hashes(sets)
            sigs = partition.signatures(sets)
            jobs = [x for own in sigs for x in own]
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *[x[2] for x in jobs]]).view(np.int64))
            inner = pa.ListArray.from_arrays(_bounds([len(x[2]) for x in jobs]), flat)
            meta = [c << 56 | filled << 30 | len(x) for x, own in zip(sets, sigs, strict=True) for c, filled, _ in own]
            structs = pa.StructArray.from_arrays([pa.array(meta, pa.int64()), inner], names=["meta", "sigs"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(_bounds([len(x) for x in sigs]), structs)], names=names)

    return _narrow(docs).mapInArrow(work, "doc_id long, n_shingles long, h1 long, h2 long, parts array<struct<meta: long, sigs: array<long>>>")


def node_table(classes: DataFrame) -> DataFrame:
    """n_shingles, h1, h2, rep, node: an id for each class, which is `rep` but for further classes with the same `rep`."""
    low = classes.groupBy("rep").agg(F.min(F.struct(*KEY)).alias("_low"))
    rows, seed = classes.join(low, "rep"), 0
    while True:
        node = F.when(F.struct(*KEY) == F.col("_low"), F.col("rep")).otherwise(F.xxhash64("rep", *KEY, F.lit(seed)))
        nodes = scratch(rows.select(*KEY, "rep", node.alias("node")), "nodes")
        if not nodes.groupBy("node").count().where("count > 1").limit(1).count():
            return nodes
        seed += 1


def tokens_of(docs: DataFrame, wanted: DataFrame, n: int, nodes: DataFrame | None = None) -> DataFrame:
    """(doc, toks, parity) of the documents, or of the `nodes` if given, whose ids are in `wanted` (doc): their sets of shingles.

    parity: 256 bits, of which each says whether an odd number of shingles falls to it. Two sets differ in as many shingles as
    their parities differ in bits, at least.
    """

    keyed = nodes is not None

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            sets = shingle_sets([x or "" for x in batch.column(1).to_pylist()], n)
            odd = [np.packbits(np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64) for x in sets]
            columns = [pa.array([x.view(np.int64) for x in part], pa.list_(pa.int64())) for part in (sets, odd)]
            key = [pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, _hashes(sets))] if keyed else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *key], names=["doc", "toks", "parity", *KEY[: len(key)]])

    if keyed:
        own = nodes.join(wanted, F.col("node") == F.col("doc"), "left_semi")
        made = _narrow(docs).join(own.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(work, "doc long, toks array<long>, parity array<long>, n_shingles long, h1 long, h2 long")
        return made.withColumnRenamed("doc", "rep").join(own, ["rep", *KEY]).select(F.col("node").alias("doc"), "toks", "parity").dropDuplicates(["doc"])
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return _narrow(docs).join(ids, F.col("doc_id") == F.col("doc"), "left_semi").mapInArrow(work, "doc long, toks array<long>, parity array<long>")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets have 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("doc").alias(c), F.col("toks").alias(f"toks_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    n_a, n_b, shared = F.size("toks_a"), F.size("toks_b"), F.size(F.array_intersect("toks_a", "toks_b"))
    may = (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a)
    return both.where(may & (100 * shared >= percent * (n_a + n_b - shared))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp): the smallest document that each one of the edges (a, b) reaches.

    Labels go to neighbours and then to what they point to, until none changes; every round is written, so lineage stays
    short and lost executors cost one round at most.
    """
    both = scratch(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("doc")).groupBy(F.col("a").alias("_doc")).agg(F.min("comp").alias("_near"))
        step = labels.join(near, F.col("doc") == F.col("_doc")).select("doc", F.col("comp").alias("was"), F.least("comp", "_near").alias("comp"))
        heads = labels.select(F.col("doc").alias("_head"), F.col("comp").alias("_far"))
        new = scratch(step.join(heads, F.col("comp") == F.col("_head"), "left").select("doc", "was", F.least("comp", "_far").alias("comp")), "labels")
        changed = new.where("comp <> was").limit(1).count()
        labels = new.select("doc", "comp")
        if not changed:
            return labels


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs` (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets of shingles of `n` words. A component's
    id is the smallest doc_id that links reach. Texts without words, null ones included, link with nothing. Rows with one
    doc_id count as one document, which has the links of all its texts. A null doc_id links with nothing and has a null
    component.
    """
    table = scratch(set_table(docs, n, percent), "shingle-sets")
    rows = scratch(table.select("doc_id", "n_shingles", "h1", "h2"), "shingle-rows")
    known = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = scratch(known.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")

    # Equal sets are one class; its other members have no signatures of their own. Where rows share a doc_id, classes have ids
    # of their own as nodes, and those of one doc_id are joined.
    nodes = edges = None
    if rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").limit(1).count():
        nodes = node_table(classes)
        own = scratch(known.join(nodes.drop("rep"), KEY).select("doc_id", "node").distinct(), "document-nodes")
        least = own.groupBy("doc_id").agg(F.min("node").alias("b"))
        edges = scratch(own.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b"), "links")
        named = table.join(nodes.withColumnRenamed("rep", "doc_id"), ["doc_id", *KEY]).dropDuplicates(["node"]).select(F.col("node").alias("doc"), "parts")
    else:
        # Keys are unique here, whatever the classes' sizes.
        extra = scratch(known.select("doc_id").join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_anti").select(F.col("doc_id").alias("doc")), "copies")
        away = F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra
        named = table.where(F.col("doc_id").isNotNull()).join(away, F.col("doc_id") == F.col("doc"), "left_anti").select(F.col("doc_id").alias("doc"), "parts")
    first = named.select("doc", F.explode("parts").alias("p")).select("doc", "p.meta", F.explode("p.sigs").alias("sig"))
    shared = scratch(met(first.select("sig", "meta", "doc")), "shared-signatures")
    drop(table)
    release(session(docs))

    # Who shares fewer signatures with all others together than a link needs has none.
    enough = shared.groupBy("doc", "meta").count().where(F.col("count") >= needed(percent, "meta")).select("doc", "meta")
    shared = scratch(shared.join(enough, ["doc", "meta"]), "likely-signatures")
    sets = scratch(tokens_of(docs, scratch(shared.select("doc").distinct(), "candidates"), n, nodes), "candidate-sets")

    # A shingle that no other candidate has is in no intersection; what is left of a set bounds all of them.
    lone = sets.select("doc", F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("_n"), F.min("doc").alias("doc")).where("_n = 1").groupBy("doc").agg(F.count(F.lit(1)).alias("_lone"))
    common = _size("meta") - F.coalesce("_lone", F.lit(0))
    shared = scratch(shared.join(lone, "doc", "left").withColumn("common", common).drop("_lone"), "bounded-signatures")
    release(session(docs))
    groups = shared.select("doc", F.col("doc").alias("comp")).distinct() if edges is None else components(edges)
    found = scratch(links(stars(shared, groups, percent), sets, percent), "links")
    edges = found if edges is None else edges.unionByName(found)
    groups = components(edges)
    more = scratch(open_groups(shared, groups, sets, percent), "links")
    release(session(docs))
    if more.limit(1).count():
        groups = components(edges.unionByName(more))

    if nodes is not None:
        placed = nodes.join(groups, F.col("node") == F.col("doc"), "left").select("node", "rep", F.coalesce("comp", "node").alias("grp"))
        least = placed.groupBy("grp").agg(F.min("rep").alias("component_id"))
        of_doc = own.join(placed, "node").join(least, "grp").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        return rows.join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    placed = classes.join(groups, F.col("rep") == F.col("doc"), "left").select(*KEY, "n", F.coalesce("comp", "rep").alias("component_id"))
    lone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # Copies of one text may be a third of all rows; such classes are few.
    large = classes.where(F.col("n") > HOT_ROWS).limit(1).count()
    if not large:
        return lone.unionByName(known.join(placed, KEY).select("doc_id", "n_shingles", "component_id"))
    hot, cold = F.broadcast(placed.where(F.col("n") > HOT_ROWS)), placed.where(F.col("n") <= HOT_ROWS)
    many, few = known.join(hot, KEY), known.join(hot.select(*KEY), KEY, "left_anti").join(cold, KEY)
    return lone.unionByName(many.select("doc_id", "n_shingles", "component_id")).unionByName(few.select("doc_id", "n_shingles", "component_id"))


def met(rows: DataFrame) -> DataFrame:
    """The rows of signatures (sig, doc, ...) that two documents or more have; a document has a signature once. Signatures are
    counted before they are joined back, so that one which a third of all documents have is no single task's."""
    # Nearly all signatures are distinct. The string, always empty, makes Spark aggregate by sorting, which the join needs anyway,
    # where a hash table of them would take several times the memory.
    seen = rows.groupBy("sig").agg(F.max(F.lit("")).alias("_sorted"), F.count(F.lit(1)).alias("_n"))
    keys = seen.where((F.col("_n") > 1) & F.col("_sorted").isNotNull()).select("sig")
    return rows.join(keys.hint("merge"), "sig", "left_semi")


def stars(shared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a document and the hub of a signature of its, if their groups differ.

    A hub is the document with the fewest shingles that no other has, as what copies were made from. Pairs only serve to make groups: half the signatures that a link needs are asked for.
    """
    own = shared.join(groups, "doc", "left").select("sig", "meta", "common", "doc", F.coalesce("comp", "doc").alias("grp"))
    order = F.struct(_size("meta") - F.col("common"), "doc")
    hubs = own.groupBy("sig").agg(F.min(F.struct(order.alias("o"), "doc", "grp", "meta", "common")).alias("hub"))
    # Hubs grow with signatures, so they are never broadcast.
    led = own.join(hubs.hint("merge"), "sig").where("grp <> hub.grp")
    led = led.where(F.least("common", "hub.common") >= overlap(percent, _size("meta") + _size("hub.meta")))
    counted = led.groupBy("doc", F.col("hub.doc").alias("hub"), "meta").count().where(2 * F.col("count") >= needed(percent, "meta"))
    return counted.select(*_ordered(F.col("doc"), F.col("hub"))).distinct()


def _near(percent: int, total: Column) -> Column:
    """Whether parities p0 to p3 and q0 to q3 differ in no more bits than two sets that link in shingles."""
    bits = F.lit(0)
    for k in range(4):
        bits = bits + F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}")))
    return bits <= F.floor(total * (100 - percent) / (100 + percent))


def open_groups(shared: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between documents of different groups."""
    own = shared.join(groups, "doc", "left").select("sig", "meta", "common", "doc", F.coalesce("comp", "doc").alias("grp"))
    open_sigs = own.groupBy("sig").agg(F.min("grp").alias("_low"), F.max("grp").alias("_high")).where("_low < _high").select("sig")
    own = own.join(open_sigs, "sig")
    size = own.select("grp", "doc").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    own = scratch(own.join(size, "grp"), "open-signatures")
    parity = sets.select("doc", *[F.col("parity")[k].alias(f"p{k}") for k in range(4)])
    members = scratch(own.select("grp", "doc", _size("meta").alias("size"), "common").distinct().join(parity, "doc"), "open-members")

    # Which groups share enough signatures with a document, by the distinct (signature, group) rows of the matrix. Of two
    # groups, the documents of the smaller one ask for the larger one, since a link between them has an end in each.
    shown = own.join(parity, "doc")
    matrix = shown.groupBy("sig", F.col("grp").alias("other"), F.col("members").alias("among")).agg(F.min(_size("meta")).alias("least"), F.max("common").alias("most"), *[F.min(f"p{k}").alias(f"q{k}") for k in range(4)])
    asking = F.struct("members", "grp") < F.struct(F.col("among").alias("members"), F.col("other").alias("grp"))
    asking = asking & (F.least("common", "most") >= overlap(percent, _size("meta") + F.col("least")))
    # A group of one has its document's parity.
    asking = asking & ((F.col("among") > 1) | _near(percent, _size("meta") + F.col("least")))
    asked = shown.join(matrix.hint("merge"), "sig").where(asking).groupBy("doc", "meta", "other", "among").count().where(F.col("count") >= needed(percent, "meta"))
    asked = scratch(asked.select("doc", "other", F.col("among").alias("members")).distinct(), "asked-groups")

    # The union of a group's shingles bounds its overlap with a document. A group of one is compared at once.
    large = asked.where("members > 1").select("doc", "other")
    wanted = large.select(F.col("other").alias("grp")).distinct()
    union = members.join(wanted, "grp").join(sets, "doc").select("grp", F.explode("toks").alias("tok")).distinct()
    need = F.ceil(F.size("toks") * percent / 100).alias("need")
    query = large.join(sets, "doc").select("doc", "other", need, F.explode("toks").alias("tok"))
    inside = query.join(union, (query["other"] == union["grp"]) & (query["tok"] == union["tok"])).groupBy("doc", "other", "need").agg(F.count(F.lit(1)).alias("inside"))
    reach = inside.where("inside >= need").select("doc", "other").unionByName(asked.where("members = 1").select("doc", "other"))

    # A row for each document and member of a group that it opens, before sets are compared.
    mine = reach.join(members.drop("grp"), "doc")
    theirs = members.select(F.col("grp").alias("other"), F.col("doc").alias("_doc"), F.col("size").alias("_size"), F.col("common").alias("_common"), *[F.col(f"p{k}").alias(f"q{k}") for k in range(4)])
    total = F.col("size") + F.col("_size")
    may = (F.least("common", "_common") >= overlap(percent, total)) & _near(percent, total)
    opened = mine.join(theirs, "other").where(may)
    return links(opened.select(*_ordered(F.col("doc"), F.col("_doc"))).distinct(), sets, percent)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose doc_id is that of their component, with their own columns; rows with null ids stay. Of rows
    repeated with the same doc_id and text, one stays."""
    found = scratch(near_duplicates(docs, n, percent), "components")
    gone = scratch(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
    away = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = docs.join(away, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
    again = scratch(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "repeated-ids")
    many = again.count()
    if not many:
        return kept
    again = F.broadcast(again) if many <= BROADCAST_ROWS else again
    same = F.col("doc_id").cast("long") == F.col("_again")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


#: The same rows for shingles of 4 words and 85 percent, for tables small enough to join all shingles.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.c + b.c - k)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
walk(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT w.id, b.y FROM walk w JOIN both_ways b ON b.x = w.other)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, c.root AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS root FROM walk GROUP BY 1) c ON c.id = d.doc_id
"""
