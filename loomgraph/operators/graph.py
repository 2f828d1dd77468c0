"""The knowledge graph: collapse of merged mentions, incremental merge, statistics.

nodes: name, type, description, text_unit_ids, frequency, node_ord
edges: u, v, weight, description, text_unit_ids, edge_ord (u <= v; undirected)
The order of first appearance, which decides who wins, is a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import extraction
from loomgraph.sources.scratch import Scratch

MIN_WEIGHT = 1.0
_NODE = ("type", "description", "text_unit_ids", "frequency")
_EDGE = ("weight", "description", "text_unit_ids")


def collapse_nodes(merged: DataFrame, *by: str, union_types: bool = False) -> DataFrame:
    """One row per title: of its (title, type) groups the last to appear gives all
    attributes; with union_types the lists of all are kept, in order."""
    whole = F.struct(*_NODE)
    if union_types:
        lists = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", c))), lambda x: x[c]))
        aggs = [F.max_by("type", "first_seq").alias("type"), lists("description").alias("description"), lists("text_unit_ids").alias("text_unit_ids"), F.sum("frequency").alias("frequency")]
        return merged.groupBy(*by, F.col("title").alias("name")).agg(*aggs, F.min("first_seq").alias("node_ord"))
    best = merged.groupBy(*by, F.col("title").alias("name")).agg(F.max_by(whole, "first_seq").alias("w"), F.min("first_seq").alias("node_ord"))
    return best.select(*by, "name", *[F.col(f"w.{c}").alias(c) for c in _NODE], "node_ord")


def collapse_edges(merged: DataFrame, *by: str, min_weight: float = MIN_WEIGHT, sum_directions: bool = False) -> DataFrame:
    """One row per unordered pair among directed groups of at least min_weight (NaN
    passes): the last to appear gives all attributes; with sum_directions weights add up.
    merged may have the pairs already, as u and v."""
    kept = merged.where(F.isnan("weight") | (F.col("weight") >= min_weight))
    pair = [*by, *(("u", "v") if {"u", "v"} <= set(merged.columns) else _pair())]
    total = F.sum("weight") if sum_directions else F.max_by("weight", "first_seq")
    best = kept.groupBy(*pair).agg(F.max_by(F.struct(*_EDGE), "first_seq").alias("w"), total.alias("total"), F.min("first_seq").alias("edge_ord"))
    return best.select(*by, "u", "v", F.col("total").alias("weight"), *[F.col(f"w.{c}").alias(c) for c in _EDGE[1:]], "edge_ord")


def _pair():
    return [F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")]


#: Names without a node that are sent to all edges.
FEW = 200_000


def build(ents: DataFrame, rels: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All mentions merged and collapsed, and edges without a node at one end left out:
    nodes, edges, written. Mentions are dealt once, by title or by pair, and lists never:
    what merges them by type or direction finds them in one place."""
    merged = extraction.merge_entities(ents.repartition("title"))
    nodes = scratch.table(collapse_nodes(merged), "nodes", many_groups=True)
    rels = rels.where("source is not null and target is not null")  # least and greatest would leave a null out
    rels = rels.select("*", *_pair()).repartition("u", "v")
    edges = scratch.table(collapse_edges(extraction.merge_relations(rels, "u", "v")), "edges", many_groups=True)
    ends = edges.select(F.col("u").alias("name")).unionAll(edges.select("v")).distinct()
    lost = scratch.table(ends.join(nodes.select("name"), "name", "left_anti"), "lost")
    if n := lost.count():
        lost = F.broadcast(lost) if n <= FEW else lost
        for end in ("u", "v"):
            edges = edges.join(lost.withColumnRenamed("name", end), end, "left_anti")
        edges = scratch.table(edges.select("u", "v", *_EDGE, "edge_ord"), "held")
    return nodes, edges


def _tail(lists, first):
    """Values of later lists that the first lacks, once each, in order."""
    return F.array_distinct(F.filter(F.flatten(F.slice(lists, 2, 1 << 30)), lambda x: ~F.coalesce(F.array_contains(first, x), F.lit(False))))


def _by_batch(c: str):
    return F.transform(F.array_sort(F.collect_list(F.struct("batch_id", c))), lambda x: x[c])


def merge_nodes(batches: DataFrame) -> DataFrame:
    """Nodes of many batches (batch_id) as folding them one after another leaves them:
    the first batch's type and lists, later lists' new values appended; the frequency
    is the number of ids unless one batch alone has the node."""
    rows = batches.groupBy("name").agg(
        F.min_by("type", "batch_id").alias("type"), _by_batch("description").alias("d"), _by_batch("text_unit_ids").alias("t"),
        F.min_by("frequency", "batch_id").alias("f"), F.min(F.struct("batch_id", "node_ord")).alias("node_ord"),
    )
    rows = rows.withColumn("description", F.concat(F.col("d")[0], _tail(F.col("d"), F.col("d")[0])))
    rows = rows.withColumn("text_unit_ids", F.concat(F.col("t")[0], _tail(F.col("t"), F.col("t")[0])))
    frequency = F.when(F.size("t") == 1, F.col("f")).otherwise(F.size("text_unit_ids")).cast("long")
    return rows.select("name", "type", "description", "text_unit_ids", frequency.alias("frequency"), "node_ord")


def merge_edges(batches: DataFrame) -> DataFrame:
    """As merge_nodes, with the weights of all batches summed in their order, an absent
    one as 0."""
    rows = batches.groupBy("u", "v").agg(_by_batch("weight").alias("w"), _by_batch("description").alias("d"), _by_batch("text_unit_ids").alias("t"), F.min(F.struct("batch_id", "edge_ord")).alias("edge_ord"))
    return rows.select(
        "u", "v", F.when(F.size("w") == 1, F.col("w")[0]).otherwise(F.aggregate("w", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).alias("weight"),
        F.concat(F.col("d")[0], _tail(F.col("d"), F.col("d")[0])).alias("description"),
        F.concat(F.col("t")[0], _tail(F.col("t"), F.col("t")[0])).alias("text_unit_ids"), "edge_ord",
    )


def degrees(nodes: DataFrame, edges: DataFrame, *also: str) -> DataFrame:
    """name, degree, node_ord and other columns of the nodes; a self-loop counts twice,
    an isolated node has 0."""
    ends = reduce(DataFrame.unionAll, (edges.select(F.col(c).alias("name")) for c in ("u", "v"))).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("name", "node_ord", *also).join(ends, "name", "left").select("name", F.coalesce("degree", F.lit(0)).alias("degree"), "node_ord", *also)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, avg_degree, max_degree_node (the first to appear of equals)."""
    deg = degrees(nodes, edges).withColumn("neg", -F.col("degree"))
    top = deg.agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("a"), F.min_by("name", F.struct("neg", "node_ord")).alias("max_degree_node"))
    n_edges = edges.agg(F.count(F.lit(1)).alias("edges"))
    return top.join(F.broadcast(n_edges), F.lit(True)).select("nodes", "edges", F.coalesce("a", F.lit(0.0)).alias("avg_degree"), "max_degree_node")


def covered(nodes: DataFrame) -> DataFrame:
    """Chunk ids that some node comes from."""
    return nodes.select(F.explode("text_unit_ids").alias("id")).distinct()


def pending(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks not yet processed."""
    return chunks.join(done.select("id").distinct(), "id", "left_anti")
