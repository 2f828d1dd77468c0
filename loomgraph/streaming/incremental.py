"""Incremental graph building over a folder of chunk files.

Each micro-batch takes chunks not yet in the ledger, completes and parses them, and
appends their mentions with a batch id; the ledger is written last. The graph is a
view of the mention log: the closed form of folding batch after batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators import extraction, graph
from loomgraph.sources.completions import table_or_none
from loomgraph.sources.scratch import Scratch


LEDGER = "id string, failed boolean, batch_id long"
ENTITIES = "title string, type string, description string, source_id string, chunk_seq long, rec_seq int, batch_id long"
RELATIONS = "source string, target string, description string, weight double, source_id string, chunk_seq long, rec_seq int, batch_id long"


def absorb(chunks: DataFrame, batch_id: int, log: str, complete) -> None:
    """One batch of a stream: chunks that other batches have taken are left out."""
    done = table_or_none(chunks.sparkSession, f"{log}/ledger", LEDGER).where(F.col("batch_id") != batch_id)
    log_batch(chunks.join(done.select("id"), "id", "left_anti").dropDuplicates(["id"]), batch_id, log, complete)


def log_batch(chunks: DataFrame, batch_id: int, log: str, complete) -> None:
    """Logs one batch; run again, it overwrites its own rows only. The ledger, written
    last, says which chunks' calls failed."""
    said = complete(chunks)
    failed = F.col("failed") if "failed" in said.columns else F.lit(False)
    said = Scratch(chunks.sparkSession, "absorb").table(said.withColumn("failed", failed), "said")
    found = extraction.parse(said)
    ledger = said.select(F.col("chunk_id").alias("id"), "failed")
    for name, rows in (("entities", extraction.entities(found)), ("relations", extraction.relations(found)), ("ledger", ledger)):
        rows.write.mode("overwrite").parquet(f"{log}/{name}/batch_id={batch_id}")


def whole_batches(spark: SparkSession, log: str) -> dict[int, int]:
    """Batches without failed chunks, and how many chunks each has."""
    rows = table_or_none(spark, f"{log}/ledger", LEDGER).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("lost"))
    return {r["batch_id"]: r["n"] for r in rows.where("lost = 0").collect()}  # a row for each call of absorb


def tables(spark: SparkSession, log: str, min_weight: float = graph.MIN_WEIGHT, base: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph of all batches logged, and of a base graph before them: nodes, edges."""
    ents = extraction.merge_entities(table_or_none(spark, f"{log}/entities", ENTITIES), "batch_id")
    rels = extraction.merge_relations(table_or_none(spark, f"{log}/relations", RELATIONS), "batch_id")
    nodes = graph.collapse_nodes(ents, "batch_id")
    kept = extraction.without_orphans(rels, nodes.withColumnRenamed("name", "title"), "batch_id")
    edges = graph.collapse_edges(kept, "batch_id", min_weight=min_weight)
    if base is not None:
        order = lambda c: F.struct(F.lit(-1).cast("long").alias("chunk_seq"), F.col(c).cast("long").alias("rec_seq"))
        nodes = nodes.unionByName(base[0].withColumn("batch_id", F.lit(-1).cast("long")).withColumn("node_ord", order("node_ord")))
        edges = edges.unionByName(base[1].withColumn("batch_id", F.lit(-1).cast("long")).withColumn("edge_ord", order("edge_ord")))
    return graph.merge_nodes(nodes), graph.merge_edges(edges)


def run(spark: SparkSession, source: str, log: str, complete, files_per_batch: int = 1):
    """Takes all chunk files there are, in micro-batches, and ends. The chunks' order
    in a batch is that of their ids."""
    stream = spark.readStream.schema(f"{schemas.CHUNK}, chunk_seq long").option("maxFilesPerTrigger", files_per_batch).json(source)
    query = stream.writeStream.foreachBatch(lambda rows, i: absorb(rows, i, log, complete)).option("checkpointLocation", f"{log}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
