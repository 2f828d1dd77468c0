"""Plan pieces over the example tables that the registered queries share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import extraction, graph, walks
from loomgraph.operators.scan import spread
from loomgraph.sources import completions
from loomgraph.sources.scratch import Scratch

#: Batches of the registered queries that merge graphs, and the walks of those that
#: have SQL: as many candidates as walks in a round, so further rounds are needed.
BATCHES = 4
WALKS = walks.WalkConfig(num_walks=500, max_retries=4, surplus=1.0)
_full: ContextVar[bool] = ContextVar("full", default=False)


@contextmanager
def full_walks() -> Iterator[None]:
    """Plans made inside generate walks with the operator's own parameters."""
    token = _full.set(True)
    try:
        yield
    finally:
        _full.reset(token)


def walk_config() -> walks.WalkConfig:
    return walks.WalkConfig() if _full.get() else WALKS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus records; some have a title, some no id."""
    d = F.col("doc_id")
    return documents(spark, sf_dir).select(
        F.lit(0).alias("file_seq"), d.alias("line_no"), "text", "source",
        F.when(d % 3 == 0, F.concat(F.lit("Doc "), d.cast("string"))).otherwise("").alias("title"),
        F.when(d % 5 != 0, d.cast("string")).alias("base_id"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one chunk each."""
    docs = documents(spark, sf_dir)
    return docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), "text", F.lit("").alias("title"), "source", F.col("doc_id").alias("chunk_seq"))


def mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entity and relationship mentions, through rendered and parsed completions."""
    parsed = Scratch(spark, "mentions").table(extraction.parse(completions.rule(chunks(spark, sf_dir))), "records")
    return extraction.entities(parsed), extraction.relations(parsed)


def knowledge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph of all mentions: nodes, edges."""
    return graph.build(*mentions(spark, sf_dir), Scratch(spark, "graph"))


def batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Graphs of `BATCHES` batches of chunks: nodes, edges with batch_id."""
    ents, rels = (m.withColumn("batch_id", F.pmod("chunk_seq", F.lit(BATCHES))) for m in mentions(spark, sf_dir))
    ents, rels = extraction.merge_entities(ents, "batch_id"), extraction.merge_relations(rels, "batch_id")
    nodes = graph.collapse_nodes(ents, "batch_id")
    kept = extraction.without_orphans(rels, nodes.withColumnRenamed("name", "title"), "batch_id")
    return nodes, graph.collapse_edges(kept, "batch_id")


def bipartite(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts and suppliers, linked by line items; no node of it is rare."""
    line = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey")).alias("part"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("supp"), "l_quantity", "l_orderkey")
    ends = line.select(F.col("part").alias("name")).unionAll(line.select("supp"))
    nodes = ends.groupBy("name").agg(F.count(F.lit(1)).alias("frequency")).withColumn("node_ord", F.col("name"))
    edges = line.groupBy(F.col("part").alias("u"), F.col("supp").alias("v")).agg(F.sum("l_quantity").alias("weight"))
    return nodes, edges


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its turns as from/value pairs."""
    sender = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", sender.alias("from"), F.coalesce("text", F.lit("")).alias("value")))).alias("x"))
    return rows.select("conv_id", F.transform("x", lambda m: F.struct(m["from"].alias("from"), m["value"].alias("value"))).alias("conversations"))
