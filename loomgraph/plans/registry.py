"""The registered queries of the graph engine, each with its SQL for DuckDB."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import labels, text
from loomgraph.operators import chunking, extraction, graph, propgraph, qa, training, walks
from loomgraph.plans import fixtures as fx
from loomgraph.plans import oracles as sql
from loomgraph.plans import pipeline
from loomgraph.sources import completions, corpus
from loomgraph.sources.scratch import Scratch
from loomgraph.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _order(c: str):
    return (F.col(f"{c}.chunk_seq") * 1_000_000 + F.col(f"{c}.rec_seq")).alias(c)


def _joined(c: str):
    return F.array_join(c, "|").alias(c)


# ---- chunking and reading


@query(sql.CHUNK_WORDS)
def chunk_words(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(text.windows(text.words(F.col("text")), 128, 16)).alias("i", "piece"))


@query(sql.CHUNK_COUNTS)
def chunk_counts_by_lang(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select("lang", F.size(text.windows(text.words(F.col("text")))).alias("n"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("chunks"))


@query(sql.CHUNK_IDS)
def chunk_ids(spark, sf_dir):
    return chunking.chunk(fx.records(spark, sf_dir), 128, 16).select("id", "chunk_seq", "source")


@query(sql.CHUNK_TITLES)
def chunk_emit_titles(spark, sf_dir):
    return chunking.chunk(fx.records(spark, sf_dir), 128, 16).select("chunk_seq", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(sql.BLANK)
def blank_filter(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    spoiled = F.when(F.col("doc_id") % 7 == 0, " \t　\n").otherwise(F.col("text"))
    return docs.select("doc_id", spoiled.alias("text")).where(~text.is_blank(F.col("text"))).select("doc_id")


def _lines(spark, sf_dir):
    """A JSONL line of each document, of eight kinds."""
    docs = fx.documents(spark, sf_dir)
    kind, own = F.col("doc_id") % 8, F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    put = lambda **k: F.to_json(F.struct(*[v.alias(n) for n, v in k.items()]))
    line = (
        F.when(kind == 0, put(text=own, id=F.col("doc_id")))
        .when(kind == 1, put(text=F.lit("  "), content=own, id=own))
        .when(kind == 2, put(body=own, title=F.lit("T"), id=F.lit(0)))
        .when(kind == 3, F.concat(F.lit('"'), own, F.lit('"')))
        .when(kind == 4, F.lit("17"))
        .when(kind == 5, F.lit("{bad json"))
        .when(kind == 6, put(paragraph=F.lit(0), paragraph_text=own, id=F.lit("0")))
        .otherwise(F.lit("   "))
    )
    return docs.select(F.lit(1).alias("file_seq"), F.col("doc_id").alias("line_no"), F.lit("f").alias("source"), line.alias("value"))


@query(sql.FALLBACK)
def text_key_fallback(spark, sf_dir):
    return corpus.json_records(_lines(spark, sf_dir)).select("line_no", "text", "title", F.coalesce("base_id", F.lit("none")).alias("base_id"))


@query(sql.SKIPPED)
def json_skips(spark, sf_dir):
    return corpus.skipped(_lines(spark, sf_dir))


@query(sql.FILES)
def chunk_files(spark, sf_dir):
    """Chunks written as files of rising and falling sizes, read back and batched."""
    root, chunks = Scratch(spark, "files").path, fx.chunks(spark, sf_dir)
    low, high = chunks.agg(F.min("chunk_seq"), F.max("chunk_seq")).first()
    cuts = [low - 1, *[low + (high - low) * k // 100 for k in (1, 5, 45, 90, 97)], high]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = chunks.where((F.col("chunk_seq") > a) & (F.col("chunk_seq") <= b)).orderBy("chunk_seq")
        corpus.write_json(part.select("id", "text", "title", "source"), f"{root}/part{i}")
    read = corpus.read_chunks(spark, f"{root}/*")
    return pipeline.numbered(read, "chunk_seq", 40).select("id", "chunk_seq", "batch_id")


@query(sql.HEAD)
def head_limit(spark, sf_dir):
    return fx.chunks(spark, sf_dir).orderBy("chunk_seq").limit(25).select("id", "chunk_seq")


@query(sql.OFFSET)
def resume_offset(spark, sf_dir):
    return fx.chunks(spark, sf_dir).orderBy("chunk_seq").offset(10).limit(20).select("id", "chunk_seq")


# ---- extraction


@query(sql.ENTITIES)
def parse_entities(spark, sf_dir):
    return fx.mentions(spark, sf_dir)[0].select("title", "type", "description", "source_id")


@query(sql.RELATIONS)
def parse_relationships(spark, sf_dir):
    return fx.mentions(spark, sf_dir)[1].select("source", "target", "description", "weight", "source_id")


@query(sql.GLEAN)
def glean_concat_parse(spark, sf_dir):
    """A first turn that ends in the marker, and a continuation glued to it."""
    rows = fx.documents(spark, sf_dir).select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_seq"))
    turns = F.array(F.lit('("entity"<|>A<|>model<|>first)##("entity"<|>B<|>model<|>second)\n<|COMPLETE|>'), F.lit('("entity"<|>C<|>model<|>glued)##("entity"<|>\'"D"\'<|>model<|>kept)##'))
    rows = rows.select("chunk_id", "chunk_seq", extraction.join_turns(turns, 1).alias("result"))
    return extraction.entities(extraction.parse(rows)).select("source_id", "title", "type", "description")


@query(sql.WEIGHTS)
def weight_parse(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES ('3'), ('2.5'), ('1_000'), ('1d'), (''), ('nan'), ('-Infinity'), (' 4e2 '), ('0x10'), ('.5'), ('5.'), ('1__0') AS t(raw)")
    return rows.select("raw", text.to_float(F.col("raw")).cast("string").alias("weight"))


@query(sql.MERGED_ENTITIES)
def merge_entities(spark, sf_dir):
    rows = extraction.merge_entities(fx.mentions(spark, sf_dir)[0])
    return rows.select("title", "type", _joined("description"), _joined("text_unit_ids"), "frequency", _order("first_seq"))


@query(sql.MERGED_RELATIONS)
def merge_relationships(spark, sf_dir):
    rows = extraction.merge_relations(fx.mentions(spark, sf_dir)[1])
    return rows.select("source", "target", _joined("description"), _joined("text_unit_ids"), "weight", _order("first_seq"))


@query(sql.ORPHANS)
def orphan_filter(spark, sf_dir):
    ents, rels = fx.mentions(spark, sf_dir)
    return extraction.without_orphans(extraction.merge_relations(rels), ents.where("length(title) % 3 <> 0")).select("source", "target", "weight")


# ---- graph


@query(sql.MIN_WEIGHT)
def edge_min_weight(spark, sf_dir):
    rows = extraction.merge_relations(fx.mentions(spark, sf_dir)[1])
    return graph.collapse_edges(rows, min_weight=6.0).select("u", "v", "weight")


@query(sql.NODES)
def graph_nodes(spark, sf_dir):
    return fx.knowledge(spark, sf_dir)[0].select("name", "type", _joined("description"), _joined("text_unit_ids"), "frequency", _order("node_ord"))


@query(sql.EDGES)
def graph_edges(spark, sf_dir):
    return fx.knowledge(spark, sf_dir)[1].select("u", "v", "weight", _joined("description"), _joined("text_unit_ids"), _order("edge_ord"))


@query(sql.STATS)
def graph_stats(spark, sf_dir):
    return graph.stats(*fx.knowledge(spark, sf_dir))


@query(sql.DEGREES)
def node_degree(spark, sf_dir):
    return graph.degrees(*fx.knowledge(spark, sf_dir)).select("name", "degree")


@query(sql.BIPARTITE_DEGREES)
def node_degree_bipartite(spark, sf_dir):
    return graph.degrees(*fx.bipartite(spark, sf_dir)).select("name", "degree")


@query(sql.FOLDED_NODES)
def graph_merge_nodes(spark, sf_dir):
    return graph.merge_nodes(fx.batches(spark, sf_dir)[0]).select("name", "type", _joined("description"), _joined("text_unit_ids"), "frequency")


@query(sql.FOLDED_EDGES)
def graph_merge_edges(spark, sf_dir):
    return graph.merge_edges(fx.batches(spark, sf_dir)[1]).select("u", "v", "weight", _joined("description"), _joined("text_unit_ids"))


@query(sql.COVERED)
def covered_chunks(spark, sf_dir):
    return graph.covered(fx.knowledge(spark, sf_dir)[0])


@query(sql.PENDING)
def pending_chunks(spark, sf_dir):
    nodes = fx.batches(spark, sf_dir)[0].where("batch_id < 3")
    return graph.pending(fx.chunks(spark, sf_dir), graph.covered(nodes)).select("id", "chunk_seq")


# ---- walks


@query(sql.START_RARE)
def start_weights_rare(spark, sf_dir):
    return walks.start_weights(*fx.knowledge(spark, sf_dir), fx.walk_config()).select("name", "degree", "weight")


@query(sql.ELIGIBLE)
def start_eligible(spark, sf_dir):
    return walks.eligible(walks.start_weights(*fx.knowledge(spark, sf_dir), fx.walk_config()))


@query(sql.START_DEGREE)
def start_weights_degree(spark, sf_dir):
    return walks.start_weights(*fx.knowledge(spark, sf_dir), walks.WalkConfig(rare_start=False)).select("name", "weight")


@query(sql.START_FALLBACK)
def start_fallback(spark, sf_dir):
    return walks.start_weights(*fx.bipartite(spark, sf_dir), fx.walk_config()).select("name", "weight")


@query(sql.START_SAMPLE)
def start_sample(spark, sf_dir):
    intervals = walks.cumulative(walks.start_weights(*fx.knowledge(spark, sf_dir), fx.walk_config()))
    cands = spark.range(1000).select(F.col("id").alias("cand"))
    return walks.draw_starts(cands, intervals, fx.walk_config().seed)


def _starts(spark, sf_dir):
    nodes, edges = fx.knowledge(spark, sf_dir)
    intervals = walks.cumulative(walks.start_weights(nodes, edges, fx.walk_config()))
    cands = spark.range(int(fx.walk_config().num_walks * fx.walk_config().surplus)).select(F.col("id").alias("cand"))
    return walks.draw_starts(cands, intervals, fx.walk_config().seed), nodes, edges


@query(sql.WALK_HOP1)
def walk_hop1(spark, sf_dir):
    starts, nodes, edges = _starts(spark, sf_dir)
    front = starts.select("cand", F.lit(0).alias("attempt"), F.lit(3).alias("target"), F.array("start").alias("path"), F.array(F.lit("c0")).alias("chunks"), F.lit(True).alias("live"))
    return walks.hop(front, walks.adjacency(nodes, edges), 1, fx.walk_config()).select("cand", F.array_join("path", ">").alias("path"))


@query(sql.WALKS_RAW)
def walks_raw(spark, sf_dir):
    starts, nodes, edges = _starts(spark, sf_dir)
    scratch = Scratch(spark, "raw")  # both tables are read again at each hop
    starts, adj = scratch.table(starts, "drawn"), scratch.table(walks.adjacency(nodes, edges), "adjacency")
    rows = walks.attempts(starts, nodes, adj, 0, fx.walk_config().max_retries, fx.walk_config(), scratch)
    return rows.select("cand", "attempt", F.array_join("path", ">").alias("path"), "accepted")


@query(sql.WALKS_ACCEPTED)
def walks_accepted(spark, sf_dir):
    rows = walks.generate(*fx.knowledge(spark, sf_dir), fx.walk_config())
    return rows.select("cand", "attempt", F.array_join("path", ">").alias("path"), F.array_join("chunks", ">").alias("chunks"))


@query(sql.WALK_SUMMARY)
def walk_summary(spark, sf_dir):
    return walks.summary(walks.generate(*fx.knowledge(spark, sf_dir), fx.walk_config()))


def _walks(spark, sf_dir):
    nodes, edges = fx.knowledge(spark, sf_dir)
    return walks.with_attributes(walks.generate(nodes, edges, fx.walk_config()), nodes, edges)


@query(sql.PATH_TEXT)
def path_text(spark, sf_dir):
    rows = _walks(spark, sf_dir)
    return rows.select("cand", qa.path_text(F.col("nodes"), F.col("node_descriptions"), F.col("edges")).alias("path_text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_text(spark, sf_dir)


@query(sql.PASSAGES)
def passages_text(spark, sf_dir):
    found = qa.passages(_walks(spark, sf_dir), fx.chunks(spark, sf_dir))
    return found.select("cand", F.length("chunks_text").alias("n"), F.md5(F.col("chunks_text").cast("binary")).alias("md5"))


# ---- samples


def _completed(rows: DataFrame) -> DataFrame:
    """Completions of eight kinds, by candidate: what a model might say."""
    k, target = F.col("cand") % 8, F.col("target")
    told = F.concat(F.lit("Step 1: start at "), target, F.lit("\nStep 2: go on to "), F.get("nodes", F.lit(1)))
    asked = F.concat(F.lit("Which one is number "), F.col("cand").cast("string"), F.lit("?"))
    put = lambda head, why, q: F.concat(F.lit(head), why, F.lit("\n\nQuestion: "), q, F.lit("\n\nFinal Answer:  "), target, F.lit(" \n"))
    said = (
        F.when(k == 1, put("Reasoning:\n", told, F.concat(F.lit("Is it "), F.upper(target), F.lit("?"))))
        .when(k == 2, put("Reasoning: ", F.lit("Too short to keep."), asked))
        .when(k == 3, F.lit(" skip: too generic"))
        .when(k == 4, F.concat(F.lit("Reasoning: "), told, F.lit("\nQuestion: "), asked))
        .when(k == 6, put("Description: ", told, asked))
        .when(k == 7, put("Reasoning: ", told, F.lit("SKIP")))
        .otherwise(put("Reasoning:\n", told, asked))
    )
    return rows.withColumn("completion", said)


def _judged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("verdict", F.when(F.col("cand") % 8 == 5, "FAIL").otherwise(" pass.\n"))


def _inter(spark, sf_dir):
    return qa.inter(_walks(spark, sf_dir), fx.chunks(spark, sf_dir), _completed, _judged)


@query(sql.QA_PARSE)
def qa_parse(spark, sf_dir):
    rows = _completed(_walks(spark, sf_dir).withColumn("target", F.col("nodes")[0])).withColumn("s", qa.parsed(F.col("completion")))
    return rows.select("cand", F.coalesce("s.question", F.lit("-")).alias("question"), F.coalesce("s.reasoning", F.lit("-")).alias("reasoning"), F.coalesce("s.answer", F.lit("-")).alias("answer"))


@query(sql.QA_GATES)
def qa_gates(spark, sf_dir):
    return _inter(spark, sf_dir).select("cand", "status")


@query(sql.QA_INTER)
def qa_inter(spark, sf_dir):
    rows = _inter(spark, sf_dir).where("status = 'ok'")
    return rows.select("cand", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"), "meta.target_node", F.array_join("meta.chunk_ids", ">").alias("chunk_ids"), "meta.chunks_crossed")


@query(sql.QA_INTRA)
def qa_intra(spark, sf_dir):
    def complete(rows: DataFrame) -> DataFrame:
        name = F.regexp_extract("text", completions.NAME, 0)
        said = F.concat(F.lit("Description: It begins with "), name, F.lit("\nQuestion: What begins "), F.col("id"), F.lit("?\nFinal Answer: "), name)
        return rows.withColumn("completion", F.when(name != "", said))

    return qa.intra(fx.chunks(spark, sf_dir), complete).where("status = 'ok'").select("id", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"), "meta.type")


@query(sql.QA_YIELD)
def qa_yield(spark, sf_dir):
    return qa.metrics(_inter(spark, sf_dir))


# ---- property graph


@query(sql.LABELS)
def labels_of_types(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES ('ORGANIZATION'), ('BIG_MODEL'), ('3D'), (''), ('big model'), ('x-y') AS t(type)")
    return rows.select("type", labels.label_of(F.col("type")).alias("label"))


@query(sql.REL_TYPES)
def rel_types(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES ('related to'), ('RELATED'), ('2nd'), (''), (' cites ') AS t(type)")
    return rows.select("type", labels.rel_type_of(F.col("type")).alias("rel_type"))


@query(sql.PG_NODES)
def propgraph_nodes(spark, sf_dir):
    rows = propgraph.node_table(fx.knowledge(spark, sf_dir)[0])
    return rows.select("label", "name", "type", _joined("description"), "frequency", _joined("text_unit_ids"))


@query(sql.PG_RELS)
def propgraph_rels(spark, sf_dir):
    rows = propgraph.rel_table(*fx.knowledge(spark, sf_dir), "mentioned with")
    return rows.select("src_label", "rel_type", "tgt_label", "source_name", "target_name", "weight", _joined("text_unit_ids"))


@query(sql.PG_BATCHES)
def export_batches(spark, sf_dir):
    rows = propgraph.batched(propgraph.node_table(fx.knowledge(spark, sf_dir)[0]), ["label"], "node_ord", 100)
    return rows.groupBy("label", "batch").agg(F.count(F.lit(1)).alias("n"))


@query(sql.PG_UPSERT)
def propgraph_upsert(spark, sf_dir):
    """The nodes of all batches, upserted one batch after the other."""
    nodes = fx.batches(spark, sf_dir)[0].select(labels.label_of(F.col("type")).alias("label"), "name", "frequency", "batch_id")
    nodes = Scratch(spark, "upsert").table(nodes, "nodes")
    done = None
    for b in range(fx.BATCHES):
        done = propgraph.upsert(done, nodes.where(F.col("batch_id") == b).drop("batch_id"), ["label", "name"])
    return done


# ---- training


@query(sql.MESSAGES)
def chat_messages(spark, sf_dir):
    rows = fx.conversations(spark, sf_dir).select("conv_id", F.posexplode(training.messages(F.col("conversations"))).alias("i", "m"))
    return rows.select("conv_id", "i", "m.role", F.md5(F.col("m.content").cast("binary")).alias("content_md5"))


@query(sql.MIX)
def train_mix(spark, sf_dir):
    rows = fx.conversations(spark, sf_dir)
    return training.mix([rows.where("conv_id % 2 = 0"), rows.where("conv_id % 2 = 1")], "conv_id").select("conv_id", "order")


def _rendered(spark, sf_dir, template: str):
    rows = fx.conversations(spark, sf_dir)
    return rows.select("conv_id", training.rendered(training.messages(F.col("conversations")), template).alias("r"))


@query(sql.PLAIN)
def render_plain(spark, sf_dir):
    return _rendered(spark, sf_dir, "plain").select("conv_id", F.length("r.text").alias("n"), F.md5(F.col("r.text").cast("binary")).alias("md5"))


@query(sql.IM)
def render_im(spark, sf_dir):
    return _rendered(spark, sf_dir, "im").select("conv_id", F.length("r.text").alias("n"), F.md5(F.col("r.text").cast("binary")).alias("md5"))


@query(sql.SPANS)
def assistant_spans(spark, sf_dir):
    rows = _rendered(spark, sf_dir, "plain").select("conv_id", F.posexplode("r.spans").alias("k", "s"))
    return rows.select("conv_id", "k", "s.start", "s.end")


@query(sql.STREAMED)
def stream_incremental(spark, sf_dir):
    """Chunk files that arrive in batches, taken by a stream into the mention log, and
    the graph of it."""
    root, chunks = Scratch(spark, "stream").path, fx.chunks(spark, sf_dir)
    for b in range(fx.BATCHES):
        chunks.where(F.pmod("chunk_seq", F.lit(fx.BATCHES)) == b).write.mode("append").json(f"{root}/in")
        incremental.run(spark, f"{root}/in", f"{root}/log", completions.rule, files_per_batch=1_000_000)
    nodes, _ = incremental.tables(spark, f"{root}/log")
    return nodes.select("name", "frequency", F.size("text_unit_ids").alias("ids"))


# ---- the operator's own number of walks, retries and rounds: too slow as SQL

FULL = ("walk_hop1", "walks_accepted", "walk_summary", "path_text", "qa_yield")


def _with_full_walks(f: Query) -> Query:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with fx.full_walks():
            return f(spark, sf_dir)

    return run


QUERIES |= {f"{name}_full": _with_full_walks(QUERIES[name]) for name in FULL}
