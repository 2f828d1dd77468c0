"""Readers, writers and the command line, over small files and a local endpoint."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from loomgraph import cli
from loomgraph.sources import corpus


#: What the endpoint was asked, and after how many calls it is down.
CALLS: list[dict] = []
DOWN: list[int] = []


@pytest.fixture(autouse=True)
def fresh():
    CALLS.clear()
    DOWN.clear()


@pytest.fixture(scope="module")
def endpoint():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked = body["messages"][-1]["content"]
            CALLS.append(body)
            if DOWN and len(CALLS) > DOWN[0]:
                self.send_response(503)
                self.end_headers()
                return
            if "Answer Y or N" in asked:
                said = "N"
            elif "One word only." in asked:
                said = "PASS"
            elif "Final Answer:" in asked:
                said = "Reasoning: " + "because it is so " * 4 + "\nQuestion: what is meant?\nFinal Answer: it"
            else:
                said = '("entity"<|>Alpha<|>concept<|>first)##("entity"<|>Beta<|>model<|>second)##("relationship"<|>Alpha<|>Beta<|>near<|>5)##<|COMPLETE|>'
            body = json.dumps({"choices": [{"message": {"content": said}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("Title text é".encode() + b"\xff tail")
    (tmp_path / "b.TXT").write_text("  \n")
    (tmp_path / "skip.csv").write_text("x")
    lines = ['"bare"', "17", "{bad", '{"text": " ", "content": "used", "id": 0}', "", '{"body": "b", "id": 7, "title": "T"}']
    (tmp_path / "sub/c.jsonl").write_text("\n".join(lines))
    rows = corpus.read_corpus(spark, str(tmp_path)).orderBy("file_seq", "line_no").collect()
    assert [(r.text, r.title, r.base_id) for r in rows] == [("Title text é tail", "a", None), ("bare", "", None), ("used", "", None), ("b", "T", "7")]


def test_pipeline(spark, tmp_path, endpoint):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(" ".join(f"w{i}" for i in range(30)))
    model = ["--base-url", endpoint, "--model", "m", "--config", "none"]
    at = lambda name: str(tmp_path / name)
    assert cli.run(["prepare", "--input", at("in"), "--output", at("chunks"), "--chunk-size", "10", "--chunk-overlap", "2"], spark) == {"chunks": 4}
    assert cli.run(["build-kg", "--input", at("chunks"), "--output", at("graph"), "--checkpoint-every", "2", *model], spark) == {"nodes": 2, "edges": 1, "avg_degree": 1.0}
    nodes, edges = corpus.read_graph(spark, at("graph"))
    # two answers a chunk, glued at the marker, which loses the second Alpha; the first batch lists
    # every mention, merging appends each new chunk once and counts the list
    assert {r.name: r.frequency for r in nodes.collect()} == {"Alpha": 4, "Beta": 6}
    assert edges.first().weight == 8 * 5
    assert cli.run(["export", "--graph", at("graph"), "--output", at("pg")], spark) == {"nodes": 2, "relationships": 1}
    assert cli.run(["export", "--graph", at("graph"), "--output", at("pg")], spark) == {"nodes": 2, "relationships": 1}
    assert spark.read.parquet(at("pg/nodes")).count() == 2
    walk = {"nodes": ["Alpha", "Beta"], "node_descriptions": ["a", "b"], "chunk_ids": [spark.read.json(at("chunks")).first().id, ""], "chunks_crossed": 2, "edges": [{"weight": 5.0, "description": ["near"], "text_unit_ids": []}]}
    (tmp_path / "walks.jsonl").write_text(json.dumps(walk) + "\n")
    assert cli.run(["gen-qa", "--walks", at("walks.jsonl"), "--chunks", at("chunks"), "--type", "both", "--output-dir", at("qa"), *model], spark) == {"inter": {"ok": 1}, "intra": {"ok": 4}}
    assert cli.run(["gen-qa", "--walks", at("walks.jsonl"), "--chunks", at("chunks"), "--type", "both", "--output-dir", at("qa"), *model], spark) == {"inter": {}, "intra": {}}
    out = cli.run(["train", "--stage", "2", "--data_path", f"{at('qa/sft_inter.jsonl')},{at('qa/sft_intra.jsonl')}", "--output_dir", at("sft")], spark)
    assert out["lr"] == 1e-5 and out["effective_batch"] == 32 and spark.read.json(at("sft")).count() == 5
    assert cli.run(["walk", "--graph", at("graph"), "--output", at("walks"), "--num-walks", "3", "--config", "none"], spark)["walks"] == 0


def test_gleaning(spark, endpoint):
    """Two continuations allowed, but the endpoint says N after the first; each call
    has the conversation so far."""
    from loomgraph.plans import pipeline
    from loomgraph.sources import completions

    chunks = spark.createDataFrame([("c1", "text", 1)], "id string, text string, chunk_seq long")
    call = completions.http([endpoint], "m", concurrency=1)
    said = pipeline.gleaned(call, 2, call, ("BIRD", "TREE"))(chunks).first().result
    assert said.count("Alpha") == 4
    assert [[m["role"] for m in c["messages"]] for c in CALLS] == [["user"], ["user", "assistant", "user"], ["user", "assistant", "user", "assistant", "user"]]
    assert "BIRD,TREE" in CALLS[0]["messages"][0]["content"]
    assert pipeline.gleaned(call, 2)(chunks).first().result.count("Alpha") == 6


def chunk_file(path, n):
    path.write_text("".join(json.dumps({"id": f"c{i}", "text": f"text {i}", "title": "", "source": "s"}) + "\n" for i in range(n)))


def test_resume(spark, tmp_path, endpoint):
    """The endpoint goes down half way; the second run makes only the calls that are
    left, and the result is that of a run without trouble."""
    chunk_file(tmp_path / "chunks.jsonl", 12)
    (tmp_path / "config.yaml").write_text("extraction:\n  max_gleanings: 0\n")
    at = lambda name: str(tmp_path / name)
    build = ["build-kg", "--input", at("chunks.jsonl"), "--checkpoint-every", "4", "--base-url", endpoint, "--model", "m", "--config", at("config.yaml")]
    DOWN.append(6)
    broken = cli.run([*build, "--output", at("graph.json")], spark)
    assert broken["lost_batches_of"] == 8
    made = 6
    DOWN.clear()
    CALLS.clear()
    assert "lost_batches_of" not in cli.run([*build, "--output", at("graph.json")], spark)
    assert len(CALLS) == 12 - made
    assert (tmp_path / "graph.json").is_file() and not (tmp_path / "graph.json.log").exists()
    cli.run([*build, "--output", at("again")], spark)
    rows = lambda g: sorted(map(str, [*g[0].collect(), *g[1].collect()]))
    assert rows(corpus.read_graph(spark, at("graph.json"))) == rows(corpus.read_graph(spark, at("again")))

    DOWN.append(len(CALLS) + 5)
    ask = ["gen-qa", "--chunks", at("chunks.jsonl"), "--type", "intra", "--checkpoint-every", "4", "--base-url", endpoint, "--model", "m", "--config", "none", "--intra-output", at("qa")]
    before = len(CALLS)
    assert cli.run(ask, spark) == {"intra": {"ok": 5, "error": 7}}
    DOWN.clear()
    CALLS.clear()
    assert before and cli.run(ask, spark) == {"intra": {"ok": 7}} and len(CALLS) == 7
    assert spark.read.json(at("qa")).count() == 12


def test_merge(spark, tmp_path, endpoint):
    """--merge without a graph yet, then again: covered chunks are not asked again."""
    chunk_file(tmp_path / "chunks.jsonl", 3)
    at = lambda name: str(tmp_path / name)
    build = ["build-kg", "--input", at("chunks.jsonl"), "--output", at("graph.json"), "--merge", "--base-url", endpoint, "--model", "m", "--config", "none"]
    first = cli.run(build, spark)
    CALLS.clear()
    assert cli.run(build, spark) == first and not CALLS
    chunk_file(tmp_path / "chunks.jsonl", 4)
    cli.run(build, spark)
    assert len({c["messages"][0]["content"] for c in CALLS}) == 1


def test_config(spark, tmp_path, endpoint):
    """Every documented key is heard."""
    at = lambda name: str(tmp_path / name)
    chunk_file(tmp_path / "chunks.jsonl", 3)
    (tmp_path / "config.yaml").write_text(f"""
llm: {{base_url: "{endpoint}", api_key: k, model: some-model, max_tokens: 99, temperature: 0.25, concurrent_requests: 3, extra_base_urls: ["{endpoint}"]}}
extraction: {{entity_types: [FISH, FOWL], max_gleanings: 0}}
graph: {{min_edge_weight: 100.0, cross_chunk_multiplier: 2.0}}
walk: {{num_walks: 7, min_hops: 1, max_hops: 1, min_chunks_crossed: 1, max_retries: 2, rare_start: false, rare_frequency_threshold: 5}}
sft: {{checkpoint_every: 2}}
output: {{graph_path: {at('out/graph.json')}, walks_path: {at('out/walks')}, sft_inter_path: inter, sft_intra_path: intra}}
""")
    from loomgraph import config

    settings = config.load(at("config.yaml"))
    cfg = config.walk_config(settings, seed=1)
    assert (cfg.num_walks, cfg.min_hops, cfg.max_hops, cfg.max_retries, cfg.rare_start, cfg.rare_frequency_threshold, cfg.cross_chunk_alpha) == (7, 1, 1, 2, False, 5, 2.0)
    found = config.endpoint(settings["llm"], None, None, None)
    assert found["urls"] == [endpoint, endpoint] and found["concurrency"] == 3 and found["model"] == "some-model"
    assert cli.run(["build-kg", "--input", at("chunks.jsonl"), "--config", at("config.yaml")], spark) == {"nodes": 2, "edges": 0, "avg_degree": 0.0}
    assert len(CALLS) == 3 and {(c["model"], c["max_tokens"], c["temperature"]) for c in CALLS} == {("some-model", 99, 0.25)} and "FISH,FOWL" in CALLS[0]["messages"][0]["content"]
    assert (tmp_path / "out/graph.json").is_file()
    assert cli.run(["walk", "--graph", at("out/graph.json"), "--config", at("config.yaml")], spark)["walks"] == 0 and (tmp_path / "out/walks").exists()
    assert cli.run(["gen-qa", "--chunks", at("chunks.jsonl"), "--type", "intra", "--output-dir", at("qa"), "--config", at("config.yaml")], spark) == {"intra": {"ok": 3}} and (tmp_path / "qa/intra").exists()
    (tmp_path / "empty.yaml").write_text("llm:\n")
    assert config.load(at("empty.yaml")) == {"llm": {}} and config.load("none") == {}


def test_odd_files(spark, tmp_path):
    """U+FFFD that a text holds stays, only bytes that are no UTF-8 go; folders sort
    before files of a longer name; a single file counts whatever its suffix."""
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/z.txt").write_text("first")
    (tmp_path / "in/a.txt").write_bytes("a\ufffdb\U0010ffff".encode() + b"\xff\xc3")
    rows = corpus.read_corpus(spark, str(tmp_path / "in")).orderBy("file_seq", "line_no").collect()
    assert [(r.title, r.text) for r in rows] == [("z", "first"), ("a", "a\ufffdb\U0010ffff")]
    (tmp_path / "notes.log").write_text("kept")
    assert [(r.title, r.text) for r in corpus.read_corpus(spark, str(tmp_path / "notes.log")).collect()] == [("notes", "kept")]
    lines = tmp_path / "lines.jsonl"
    lines.write_text('{"text": "x"}\n{"no": 1}\n[1]\n{oops\n\n')
    assert cli.run(["prepare", "--input", str(lines), "--output", str(tmp_path / "out")], spark) == {"chunks": 1, "skipped": {"empty": 1, "kind": 1, "invalid": 1}}


def test_order_of_files(spark, tmp_path):
    """Chunks count by file and line, however Spark packs the files."""
    k = 0
    for f, n in enumerate((5, 20_000, 40_000)):
        (tmp_path / f"f{f}.jsonl").write_text("".join(json.dumps({"id": f"f{f}-{i}", "text": "t" * (i % 7)}) + "\n" for i in range(n)))
    got = corpus.read_chunks(spark, str(tmp_path)).orderBy("chunk_seq").collect()
    assert [r.chunk_seq for r in got] == list(range(60_005))
    for f, n in enumerate((5, 20_000, 40_000)):
        assert [r.id for r in got[k : k + n]] == [f"f{f}-{i}" for i in range(n)]
        k += n
    assert [r.id for r in corpus.read_chunks(spark, str(tmp_path), 3).orderBy("chunk_seq").collect()] == ["f0-0", "f0-1", "f0-2"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        corpus.read_chunks(spark, str(tmp_path / "none"))


def test_graph_server(spark, tmp_path):
    from loomgraph.operators import propgraph

    class Recorder:
        """A graph server that writes the statements it gets to files."""

        def __init__(self, folder):
            self.folder = folder

        def session(self):
            import uuid
            from contextlib import contextmanager

            from loomgraph.sources.graphdb import Statements

            @contextmanager
            def opened():
                with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                    yield Statements(lambda text, given=(): f.write(json.dumps([text, given]) + "\n"))

            return opened()

    nodes = spark.createDataFrame([("A`b" if i % 3 else "C", f"n{i}", "t", ["d"], 1, ["c"], i) for i in range(10)], "label string, name string, type string, description array<string>, frequency long, text_unit_ids array<string>, node_ord int")
    rels = spark.createDataFrame([("C", "R", "C", "n0", "n3", 2.0, ["d"], ["c"], 0), ("C", "R", "D", "n0", "elsewhere", 2.0, ["d"], ["c"], 1)], "src_label string, rel_type string, tgt_label string, source_name string, target_name string, weight double, description array<string>, text_unit_ids array<string>, edge_ord int")
    assert propgraph.send(nodes, rels, Recorder(str(tmp_path)), batch=2, clear=True, tasks=2) == {"nodes": 10, "relationships": 2}
    said = [json.loads(line) for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    put = [(t, g) for t, g in said if "UNWIND" in t]
    assert sum("DETACH" in t for t, _ in said) == 1 and sum("UNIQUE" in t for t, _ in said) == 2
    assert sorted(g["name"] for t, rows in put for g in rows if "values" in g and "name" in g) == sorted(f"n{i}" for i in range(10))
    assert all(len(rows) <= 2 for _, rows in put) and any("`A``b`" in t for t, _ in put) and sum("(x)-[z:`R`]->(y)" in t for t, _ in put) == 2
    out = propgraph.write(nodes.drop("node_ord"), rels.drop("edge_ord"), str(tmp_path / "pg"))
    assert out == {"nodes": 10, "relationships": 2} and spark.read.parquet(str(tmp_path / "pg/nodes")).where("label = 'D' and name = 'elsewhere'").count() == 1


def test_absent_weights(spark, tmp_path):
    """An absent weight merges as 0 and walks as 1; only a number is a frequency."""
    from loomgraph.operators import graph, walks

    doc = {"nodes": [{"id": "a", "frequency": "7"}, {"id": "b", "frequency": 3}, {"id": "c", "frequency": 2.9}], "links": [{"source": "b", "target": "a"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = corpus.read_graph(spark, str(tmp_path / "g.json"))
    assert {r.name: r.frequency for r in nodes.collect()} == {"a": 1, "b": 3, "c": 2}
    assert edges.first().weight is None and {r.weight for r in walks.adjacency(nodes, edges).collect()} == {1.0}
    from pyspark.sql import functions as F

    both = edges.withColumn("batch_id", F.lit(0)).unionByName(edges.withColumn("batch_id", F.lit(1)).withColumn("weight", F.lit(4.0)))
    assert graph.merge_edges(both).first().weight == 4.0


def test_train(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text(json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}) + "\n")
    (tmp_path / "model").mkdir()
    run = ["train", "--stage", "1", "--data_path", str(tmp_path / "qa.jsonl"), "--output_dir", str(tmp_path / "out"), "--model_path", str(tmp_path / "model")]
    assert cli.run(run, spark)["run_name"] == "stage-1" and spark.read.json(str(tmp_path / "out")).first().rendered.text.endswith("a</s>")
    (tmp_path / "model/tokenizer_config.json").write_text(json.dumps({"chat_template": "x", "eos_token": {"content": "<e>"}}))
    assert cli.run([*run, "--run_name", "mine"], spark)["run_name"] == "mine"
    assert "<|im_start|>user" in spark.read.json(str(tmp_path / "out")).first().rendered.text
    assert json.loads((tmp_path / "out/_manifest.json").read_text())["lora_rank"] == 8


def test_nothing_to_read(spark, tmp_path):
    with pytest.raises(ValueError):
        cli.run(["prepare", "--input", str(tmp_path), "--output", str(tmp_path / "out")], spark)
