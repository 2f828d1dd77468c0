"""The pipeline's steps as whole plans: what the command line runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import templates
from loomgraph.functions.text import strip
from loomgraph.operators import chunking, graph, qa
from loomgraph.operators.extraction import ENTITY_TYPES
from loomgraph.operators.scan import running_total
from loomgraph.sources import completions, corpus
from loomgraph.sources.completions import Backend, message, table_or_none
from loomgraph.sources.scratch import Scratch, drop, exists, replace_by
from loomgraph.streaming import incremental


def prepare(spark: SparkSession, source: str, target: str, size: int = 512, overlap: int = 64) -> dict:
    """Files to chunks; refuses a folder without any usable file. Says how many chunks
    there are, and how many JSONL lines were skipped, by reason, if any were."""
    one = corpus._is_file(spark, source)
    if not one and corpus.files(spark, source, *corpus.SUFFIXES).isEmpty():
        raise ValueError(f"no .txt, .md or .jsonl files under {source}")
    chunks = Scratch(spark, "prepare").table(chunking.chunk(corpus.read_corpus(spark, source), size, overlap), "chunks")
    corpus.write_json(chunks.orderBy("chunk_seq").select("id", "text", "title", "source"), target)
    out: dict = {"chunks": chunks.count()}
    if not one or source.lower().endswith(".jsonl"):
        lost = corpus.skipped(corpus.json_lines(spark, source)).groupBy("status").agg(F.sum("n").alias("n")).collect()
        if lost:
            out["skipped"] = {r["status"]: r["n"] for r in lost}
    return out


def gleaned(backend: Backend, rounds: int = 0, ask: Backend | None = None, types: tuple[str, ...] = ENTITY_TYPES) -> Backend:
    """An extraction backend: the base call and up to `rounds` continuations, each on
    the conversation so far; the answers are glued together. Between continuations
    `ask` is asked whether records are missing; only a Y goes on. Every answer is
    written before its use. A chunk any of whose calls failed has no result."""

    def run(chunks: DataFrame) -> DataFrame:
        scratch = Scratch(chunks.sparkSession, "glean")

        def called(rows: DataFrame, call: Backend, name: str) -> DataFrame:
            rows = call(rows).withColumn("said", F.coalesce("completion", F.lit("")))
            return scratch.table(rows.withColumn("failed", F.col("failed") | F.col("error").isNotNull()).drop("completion", "error"), name)

        def more(rows: DataFrame, text: str) -> DataFrame:
            return rows.withColumn("messages", F.concat("messages", message("user", F.lit(text))))

        start = message("user", templates.extraction_prompt(F.col("text"), types))
        rows = chunks.select("id", "chunk_seq", start.alias("messages"), F.lit(False).alias("failed"))
        rows = called(rows, backend, "0").withColumn("result", F.col("said"))
        done: list[DataFrame] = []
        for i in range(rounds):
            rows = more(rows.withColumn("messages", F.concat("messages", message("assistant", F.col("said")))).drop("said"), templates.CONTINUE)
            rows = called(rows, backend, f"more-{i}").withColumn("result", F.concat("result", "said"))
            if i < rounds - 1 and ask is not None:
                asked = more(rows.withColumn("messages", F.concat("messages", message("assistant", F.col("said")))).withColumnRenamed("said", "before"), templates.MORE)
                rows = called(asked, ask, f"ask-{i}")
                goes_on = F.upper(strip(F.col("said"))) == "Y"
                done.append(rows.where(~goes_on).drop("said", "before"))
                rows = rows.where(goes_on).withColumn("messages", F.slice("messages", 1, F.size("messages") - 2)).drop("said").withColumnRenamed("before", "said")
        rows = rows.drop("said")
        for part in done:
            rows = rows.unionByName(part)
        return rows.select(F.col("id").alias("chunk_id"), "chunk_seq", F.when(~F.col("failed"), F.col("result")).alias("result"), "failed")

    return run


def numbered(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch_id: rows in order, `size` at a time."""
    rows = running_total(rows.withColumn("__all", F.lit(0)).withColumn("__one", F.lit(1)), "__all", order, "__one", "__n")
    return rows.withColumn("batch_id", F.floor(F.col("__n") / size).cast("long")).drop("__all", "__one", "__n")


def build_graph(chunks: DataFrame, complete: Backend, out: str, batch: int = 1000, min_weight: float = graph.MIN_WEIGHT, base: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Chunks to a graph at `out`, in batches of `batch` chunks; a base graph is batch
    -1, and chunks it covers are skipped. Also returns how many chunks were lost.

    Each batch is logged beside the graph (`out`.log) as it is done: a run that was cut
    off goes on after its last whole batch, and batches with failed calls are done
    again. The log goes once nothing failed.
    """
    spark, log = chunks.sparkSession, f"{out.rstrip('/')}.log"
    if base is not None:
        chunks = graph.pending(chunks, graph.covered(base[0]))
    scratch = Scratch(spark, "build")
    todo = scratch.table(numbered(chunks, "chunk_seq", batch), "todo")
    have = incremental.whole_batches(spark, log)
    sizes = {r["batch_id"]: r["n"] for r in todo.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each batch of calls
    for b in sorted(sizes):
        if have.get(b) != sizes[b]:
            incremental.log_batch(todo.where(F.col("batch_id") == b).drop("batch_id"), b, log, complete)
    nodes, edges = incremental.tables(spark, log, min_weight, base)
    nodes, edges = scratch.table(nodes, "nodes"), scratch.table(edges, "edges")
    corpus.write_graph(nodes, edges, out)
    lost = sum(sizes.values()) - sum(incremental.whole_batches(spark, log).get(b, 0) for b in sizes)
    if not lost:
        drop(spark, log)
    return nodes, edges, lost


def inter_backends(backend: Backend, judge: Backend) -> tuple[Backend, Backend]:
    """The two calls of a multi-hop sample, each written before its result is used."""

    def complete(rows: DataFrame) -> DataFrame:
        prompt = templates.fill(templates.INTER, target=F.col("target"), path=F.col("path_text"), passages=F.col("chunks_text"))
        return Scratch(rows.sparkSession, "inter").table(backend(rows.withColumn("messages", message("user", prompt))).drop("messages"), "first")

    def check(rows: DataFrame) -> DataFrame:
        prompt = templates.fill(templates.CHECK, target=F.col("target"), question=F.col("sample.question"), reasoning=F.col("sample.reasoning"), passages=F.col("chunks_text"))
        said = judge(rows.drop("completion").withColumn("messages", message("user", prompt))).drop("messages")
        return Scratch(rows.sparkSession, "inter").table(said.withColumnRenamed("completion", "verdict"), "second")

    return complete, check


def intra_backend(backend: Backend) -> Backend:
    def complete(rows: DataFrame) -> DataFrame:
        prompt = templates.fill(templates.INTRA, text=F.col("text"))
        return Scratch(rows.sparkSession, "intra").table(backend(rows.withColumn("messages", message("user", prompt))).drop("messages"), "only")

    return complete


_META = {
    "inter": "struct<type:string,walk_nodes:array<string>,chunk_ids:array<string>,chunks_crossed:int,target_node:string>",
    "intra": "struct<type:string,chunk_id:string,title:string>",
}


def ledger_schema(kind: str) -> str:
    return f"key string, status string, conversations array<struct<`from`:string,value:string>>, meta {_META[kind]}"


def samples(rows: DataFrame, key: str, order: str, make: Backend, out: str, kind: str, batch: int = 500) -> dict[str, int]:
    """Makes samples of rows, `batch` at a time, and returns this run's counts by status.

    The ledger beside the output has a row for every input done, with its sample: a run
    that was cut off goes on after its last batch, and repeats no input, whatever became
    of it, but those whose calls failed. The output is what the ledger accepts.
    """
    spark, ledger = rows.sparkSession, f"{out}.ledger"
    done = table_or_none(spark, ledger, ledger_schema(kind)).select(F.col("key").alias(key))
    todo = Scratch(spark, "samples").table(numbered(rows.join(done, key, "left_anti"), order, batch), "todo")
    counts: dict[str, int] = {}
    for r in todo.select("batch_id").distinct().orderBy("batch_id").collect():  # a row for each batch of calls
        one = Scratch(spark, "samples").table(make(todo.where(F.col("batch_id") == r["batch_id"]).drop("batch_id")), "made")
        for status in qa.metrics(one).collect():
            counts[status["status"]] = counts.get(status["status"], 0) + status["n"]
        kept = one.where("status <> 'error'").select(F.col(key).alias("key"), "status", "conversations", F.col("meta").cast(_META[kind]).alias("meta"))
        kept.write.mode("append").parquet(ledger)
    if exists(spark, ledger):
        corpus.write_json(accepted(spark.read.schema(ledger_schema(kind)).parquet(ledger)), f"{out}.new")
        replace_by(spark, out, f"{out}.new")
    return counts


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'ok'").select("conversations", "meta")
