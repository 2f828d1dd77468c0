"""python -m loomgraph.cli prepare | build-kg | walk | gen-qa | export | train"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.operators import graph, propgraph, qa, training, walks
from loomgraph.plans import pipeline
from loomgraph.sources import completions, corpus, graphdb
from loomgraph.sources.scratch import Scratch, drop, exists, write_text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomgraph")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, **flags) -> None:
        p = sub.add_parser(name)
        for flag, spec in flags.items():
            kind, default = spec if isinstance(spec, tuple) else (spec, None)
            dashed = "--" + flag.replace("_", "-")
            names = [dashed] if name != "train" else ["--" + flag, *([dashed] if dashed != "--" + flag else [])]
            if kind is bool:
                p.add_argument(*names, action="store_true")
            elif kind is list:
                p.add_argument(*names, nargs="*", default=[])
            else:
                p.add_argument(*names, type=kind, default=default)

    model = {"base_url": str, "api_key": str, "model": str}
    command("prepare", input=str, output=str, chunk_size=(int, 512), chunk_overlap=(int, 64))
    command("build-kg", input=str, output=str, config=(str, "config.yaml"), limit=int, merge=bool, checkpoint_every=int, extra_urls=list, **model)
    command("walk", graph=str, output=str, config=(str, "config.yaml"), num_walks=int, seed=(int, 42))
    command("gen-qa", walks=str, chunks=str, config=(str, "config.yaml"), type=(str, "inter"), output_dir=(str, "data"), limit=int, intra_limit=int, temperature=(float, 0.7), max_tokens=int, seed=(int, 42), checkpoint_every=int, inter_output=str, intra_output=str, **model)
    command("export", graph=str, output=str, uri=(str, os.environ.get("NEO4J_URI")), user=(str, os.environ.get("NEO4J_USER", "neo4j")), password=(str, os.environ.get("NEO4J_PASSWORD", "password")), database=(str, os.environ.get("NEO4J_DATABASE", "neo4j")), rel_type=(str, "RELATED"), batch_size=(int, 1000), clear=bool)
    command("train", stage=(int, 0), model_path=str, data_path=str, output_dir=str, run_name=str, num_epochs=(int, 4), per_device_batch_size=(int, 4), grad_accum=(int, 8), max_seq_len=(int, 2048), lr=float, warmup_steps=(int, 100), lora_rank=(int, 8), lora_alpha=(int, 16), lora_dropout=(float, 0.05), template=str)
    return top


def caller(settings: dict, a: argparse.Namespace, memory: str, more: list[str] | None = None):
    """Makes backends (tokens, temperature) that remember their answers under `memory`."""
    at = config.endpoint(settings.get("llm", {}), a.base_url, a.api_key, a.model, more)

    def call(tokens: int, heat: float) -> completions.Backend:
        known = json.dumps([at["model"], tokens, heat])
        return completions.remembered(completions.http(at["urls"], at["model"], at["api_key"], tokens, heat, at["concurrency"]), memory, known)

    return call


def build_kg(spark: SparkSession, a: argparse.Namespace, settings: dict) -> dict:
    llm, out = settings.get("llm", {}), config.pick(a.output, settings.get("output", {}).get("graph_path"), "data/knowledge_graph.json")
    call = caller(settings, a, f"{out}.calls", a.extra_urls)
    rounds = settings.get("extraction", {}).get("max_gleanings", 1)
    heat = llm.get("temperature") or 0.0
    complete = pipeline.gleaned(call(config.pick(llm.get("max_tokens"), 4096), heat), rounds, call(4, 0.0), config.entity_types(settings))
    base = corpus.read_graph(spark, out) if a.merge and exists(spark, out) else None
    if base is not None:  # the new graph takes its place
        kept = Scratch(spark, "base")
        base = kept.table(base[0], "nodes"), kept.table(base[1], "edges")
    least = settings.get("graph", {}).get("min_edge_weight", 1.0)
    every = config.pick(a.checkpoint_every, llm.get("checkpoint_every"), 1000)
    nodes, edges, lost = pipeline.build_graph(corpus.read_chunks(spark, a.input, a.limit), complete, out, every, least, base)
    if not lost:
        drop(spark, f"{out}.calls")
    found = graph.stats(nodes, edges).first().asDict()
    return {"nodes": found["nodes"], "edges": found["edges"], "avg_degree": round(found["avg_degree"], 2), **({"lost_batches_of": lost} if lost else {})}


def walk(spark: SparkSession, a: argparse.Namespace, settings: dict) -> dict:
    cfg = config.walk_config(settings, a.num_walks, a.seed)
    nodes, edges = corpus.read_graph(spark, a.graph)
    found = Scratch(spark, "walk").table(walks.generate(nodes, edges, cfg), "found")
    out = config.pick(a.output, settings.get("output", {}).get("walks_path"), "data/walks.jsonl")
    corpus.write_json(walks.with_attributes(found, nodes, edges).orderBy("cand").drop("cand"), out)
    starts = walks.eligible(walks.start_weights(nodes, edges, cfg)).first()["eligible"]
    return {**walks.summary(found).first().asDict(), "eligible": starts}


def gen_qa(spark: SparkSession, a: argparse.Namespace, settings: dict) -> dict:
    llm, paths = settings.get("llm", {}), settings.get("output", {})
    chunks, out = Scratch(spark, "chunks").table(corpus.read_chunks(spark, a.chunks), "chunks"), {}
    every = config.pick(a.checkpoint_every, settings.get("sft", {}).get("checkpoint_every"), 500)

    def kind(name: str, given: str | None, tokens: int) -> tuple:
        target = given or f"{a.output_dir}/{paths.get(f'sft_{name}_path') or f'sft_{name}.jsonl'}"
        return target, caller(settings, a, f"{target}.calls"), config.pick(a.max_tokens, llm.get("sft_max_tokens"), tokens)

    def settled(target: str, counts: dict) -> dict:
        if "error" not in counts:
            drop(spark, f"{target}.calls")
        return counts

    if a.type in ("inter", "both"):
        if not a.walks:
            raise ValueError("--walks is needed for samples over several chunks")
        rows = corpus.read_walks(spark, a.walks)
        rows = rows.where(F.col("cand") < a.limit) if a.limit else rows
        rows = rows.withColumn("key", F.md5(F.to_json(F.struct("nodes", "chunk_ids")).cast("binary")))
        target, call, tokens = kind("inter", a.inter_output, 2048)
        first, second = pipeline.inter_backends(call(tokens, a.temperature), call(5, 0.0))
        make = lambda part: qa.inter(part, chunks, first, second).join(part.select("cand", "key"), "cand")
        out["inter"] = settled(target, pipeline.samples(rows, "key", "cand", make, target, "inter", every))
    if a.type in ("intra", "both"):
        n = a.intra_limit or a.limit
        rows = chunks.where(F.col("chunk_seq") < n) if n else chunks
        target, call, tokens = kind("intra", a.intra_output, 1024)
        make = lambda part: qa.intra(part, pipeline.intra_backend(call(tokens, a.temperature)))
        out["intra"] = settled(target, pipeline.samples(rows, "id", "chunk_seq", make, target, "intra", every))
    return out


def export(spark: SparkSession, a: argparse.Namespace) -> dict:
    """To a graph server if a uri is given, else to Parquet tables at the output."""
    nodes, edges = corpus.read_graph(spark, a.graph)
    table, rels = propgraph.node_table(nodes), propgraph.rel_table(nodes, edges, a.rel_type)
    if not propgraph.duplicates(table, ["label", "name"]).isEmpty():
        raise ValueError("a name occurs twice under one label")
    if a.uri:
        return propgraph.send(table, rels, graphdb.Bolt(a.uri, a.user, a.password, a.database), a.batch_size, a.clear)
    return propgraph.write(table.drop("node_ord"), rels.drop("edge_ord"), a.output, a.clear)


def train(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The training table (messages, rendered text, spans the loss counts) and the manifest of the run."""
    parts = [corpus.read_samples(spark, p.strip()) for p in a.data_path.split(",")]
    rows = training.mix([p.withColumn("key", F.md5(F.to_json("conversations").cast("binary"))) for p in parts], "key")
    template, eos = training.template_of(a.model_path) if a.template is None else (a.template, "</s>")
    msgs = training.messages(F.col("conversations"))
    rows.select(msgs.alias("messages"), training.rendered(msgs, template, eos).alias("rendered")).write.mode("overwrite").json(a.output_dir)
    plan = training.schedule(a.stage, a.per_device_batch_size, a.grad_accum, int(os.environ.get("WORLD_SIZE", 1)), a.lr)
    more = {k: getattr(a, k) for k in ("model_path", "data_path", "num_epochs", "max_seq_len", "warmup_steps", "lora_rank", "lora_alpha", "lora_dropout")}
    plan |= {"run_name": a.run_name or training.RUN_NAMES[a.stage], "template": template, **more}
    write_text(spark, f"{a.output_dir}/_manifest.json", json.dumps(plan, indent=1))
    return plan


def run(argv: list[str], spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomgraph").getOrCreate()
    settings = config.load(getattr(a, "config", None))
    if a.command == "prepare":
        return pipeline.prepare(spark, a.input, a.output, a.chunk_size, a.chunk_overlap)
    if a.command in ("export", "train"):
        return {"export": export, "train": train}[a.command](spark, a)
    return {"build-kg": build_kg, "walk": walk, "gen-qa": gen_qa}[a.command](spark, a, settings)


if __name__ == "__main__":
    print(json.dumps(run(sys.argv[1:])))
