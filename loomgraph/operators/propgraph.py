"""Property-graph tables: labelled nodes, typed relationships, upserts, batches."""

from __future__ import annotations

from itertools import groupby, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.labels import DEFAULT_REL, label_of, no_nulls, rel_type_of
from loomgraph.operators.scan import prefix_sums
from loomgraph.sources.scratch import Scratch, exists, replace_by


def node_table(nodes: DataFrame) -> DataFrame:
    return nodes.select(label_of(F.col("type")).alias("label"), "name", F.coalesce("type", F.lit("UNKNOWN")).alias("type"), no_nulls(F.col("description")).alias("description"), F.coalesce("frequency", F.lit(1)).alias("frequency"), no_nulls(F.col("text_unit_ids")).alias("text_unit_ids"), "node_ord")


def rel_table(nodes: DataFrame, edges: DataFrame, rel_type: str = DEFAULT_REL) -> DataFrame:
    """Each undirected edge once, from the end that appeared first."""
    ends = [nodes.select(F.col("name").alias(c), F.struct("name", label_of(F.col("type")).alias("label"), "node_ord").alias(f"{c}_end")) for c in ("u", "v")]
    rows = edges.join(ends[0], "u").join(ends[1], "v")
    first = F.col("u_end.node_ord") <= F.col("v_end.node_ord")
    src, tgt = F.when(first, F.col("u_end")).otherwise(F.col("v_end")), F.when(first, F.col("v_end")).otherwise(F.col("u_end"))
    return rows.select(src["label"].alias("src_label"), rel_type_of(F.lit(rel_type)).alias("rel_type"), tgt["label"].alias("tgt_label"), src["name"].alias("source_name"), tgt["name"].alias("target_name"), F.coalesce("weight", F.lit(1.0)).alias("weight"), no_nulls(F.col("description")).alias("description"), no_nulls(F.col("text_unit_ids")).alias("text_unit_ids"), "edge_ord")


def batched(rows: DataFrame, by: list[str], order: str, size: int = 1000) -> DataFrame:
    """Adds `batch`: rows of a group in order, `size` at a time. A group may hold most of
    the rows: narrow rows are numbered by ranges, over all groups, and a group's own
    numbers begin with its first."""
    keyed = rows.withColumn("__group", F.struct(*by))
    narrow = prefix_sums(keyed.select("__group", order, F.lit(1).alias("__one")), ["__group", order], "__one", "__n")
    first = narrow.groupBy("__group").agg(F.min("__n").alias("__first"))
    numbers = narrow.drop("__one").join(first, "__group").select("__group", order, F.floor((F.col("__n") - F.col("__first")) / size).cast("long").alias("batch"))
    return keyed.join(numbers, ["__group", order]).select(*rows.columns, "batch")


def upsert(base: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; where both have one the new row's values stand."""
    rows = new.withColumn("__v", F.lit(1))
    if base is not None:
        rows = base.withColumn("__v", F.lit(0)).unionByName(rows)
    values = [c for c in new.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "__v").alias("w")).select(*keys, "w.*")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness; empty if the constraint holds."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


NODE_KEYS = ["label", "name"]
REL_KEYS = ["src_label", "rel_type", "tgt_label", "source_name", "target_name"]


def with_ends(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """nodes, and bare ones for ends of relationships that are not among them."""
    ends = rels.select(F.col("src_label").alias("label"), F.col("source_name").alias("name")).unionAll(rels.select("tgt_label", "target_name")).distinct()
    return nodes.unionByName(ends.join(nodes, NODE_KEYS, "left_anti"), allowMissingColumns=True)


def write(nodes: DataFrame, rels: DataFrame, path: str, clear: bool = False) -> dict[str, int]:
    """Upserts both tables into Parquet under path; returns the rows given. Ends of
    relationships become nodes if they are none. The new version is written beside the
    old one, which it replaces."""
    spark, out = nodes.sparkSession, {}
    nodes = Scratch(spark, "export").table(nodes, "nodes")
    rels = Scratch(spark, "export").table(rels, "rels")
    for name, rows, keys in (("nodes", nodes, NODE_KEYS), ("relationships", rels, REL_KEYS)):
        at = f"{path}/{name}"
        old = spark.read.parquet(at) if not clear and exists(spark, at) else None
        whole = upsert(old, rows, keys)
        whole = with_ends(whole, rels) if name == "nodes" else whole
        whole.write.mode("overwrite").parquet(f"{path}/.{name}-new")
        replace_by(spark, at, f"{path}/.{name}-new")
        out[name] = rows.count()
    return out


def send(nodes: DataFrame, rels: DataFrame, server, batch: int = 1000, clear: bool = False, tasks: int = 4) -> dict[str, int]:
    """Sends both tables to a graph server, nodes before relationships, `batch` rows of
    one label (or one kind of relationship) at a time; returns the rows sent.

    server is a picklable object whose `session()` is a context with clear(),
    unique(label), nodes(label, rows) and relationships(src, type, tgt, rows); these
    upsert, so a task that is run again does no harm. `tasks` tasks send at once; a label
    that most nodes have is dealt to all of them.
    """
    with server.session() as s:
        if clear:
            s.clear()
        for row in nodes.select("label").distinct().toLocalIterator():
            s.unique(row["label"])

    def sending(keys: list[str], put):
        def run(rows) -> None:
            with server.session() as s:
                for group, members in groupby((r.asDict() for r in rows), key=lambda r: tuple(r[k] for k in keys)):
                    while part := [{k: v for k, v in r.items() if k not in keys} for r in islice(members, batch)]:
                        getattr(s, put)(*group, part)

        return run

    for rows, names, keys, put in ((nodes.drop("node_ord"), NODE_KEYS, NODE_KEYS[:1], "nodes"), (rels.drop("edge_ord"), REL_KEYS, REL_KEYS[:3], "relationships")):
        rows.repartition(tasks, *names).sortWithinPartitions(*names).foreachPartition(sending(keys, put))
    return {"nodes": nodes.count(), "relationships": rels.count()}
