"""Golden rows of the scalar operators and properties of the graph operators."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import labels, text
from loomgraph.operators import extraction, graph, qa, training, walks


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_windows(spark):
    ten = " ".join("abcdefghij")
    assert column(spark, [ten, " a b ", "  ", None, "a　b"], lambda c: text.windows(text.words(c), 4, 1)) == [["a b c d", "d e f g", "g h i j"], ["a b"], [], [], ["a b"]]
    assert column(spark, [" ".join("abcd")], lambda c: text.windows(text.words(c), 4, 1)) == [["a b c d"]]
    assert column(spark, ["a b c"], lambda c: text.windows(text.words(c), 2, 5)) == [["a b", "b c"]]


def test_clean_and_float(spark):
    assert column(spark, ['" a "', "'\"a\"'", " x \n", ""], text.clean) == [" a ".strip(), '"a"', "x", ""]
    got = column(spark, ["nan", "inf", "1_000", "1d", "", "-2.5e1"], text.to_float)
    assert math.isnan(got[0]) and got[1:] == [math.inf, 1000.0, 1.0, 1.0, -25.0]


def test_labels(spark):
    assert column(spark, ["ORGANIZATION", "BIG_MODEL", "3D", None, "模型"], labels.label_of) == ["Organization", "Big_model", "T_3d", "Entity", "__"]


def parse(spark, result, **options):
    rows = spark.createDataFrame([("c1", 1, result)], "chunk_id string, chunk_seq long, result string")
    return extraction.parse(rows, **options)


def test_parse(spark):
    out = '("entity"<|>A<|>m<|>d)##("entity"<|>B<|>m)##("Entity"<|>C<|>m<|>d)##("relationship"<|>A<|>B<|>why<|>x<|>7)##("entity"<|>Z<|>m<|>lost)\n<|COMPLETE|>'
    assert [r.title for r in extraction.entities(parse(spark, out)).collect()] == ["A"]
    assert [r.title for r in extraction.entities(parse(spark, out, strip_done=True)).collect()] == ["A", "Z"]
    assert [(r.description, r.weight) for r in extraction.relations(parse(spark, out)).collect()] == [("why", 7.0)]
    assert extraction.entities(parse(spark, None)).collect() == []


def test_one_pass(spark):
    """Fields are cleaned in one pass over a completion, not by regular expressions for
    each of them, and the lists of a group are gathered once."""
    out = '\u3000("entity"<|>\'"A"\'<|> m\x1c<|>)\n##\n(##()##x##("relationship"<|>"A"<|>B\x85<|>why<|>7 )'
    found = parse(spark, out)
    assert [(r.rec_seq, r.parts) for r in found.collect()] == [(0, ["entity", '"A"', "m", ""]), (3, ["x"]), (4, ["relationship", "A", "B", "why", "7"])]
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    plan = extraction.merge_entities(extraction.entities(found))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
    many = "##".join(f"(entity<|>T{i}<|>m<|>d)" for i in range(2 * extraction.HELD + 1))
    assert [r.rec_seq for r in parse(spark, many).orderBy("rec_seq").collect()] == list(range(2 * extraction.HELD + 1))


def test_collapse(spark):
    rows = [("A", "B", ["x"], ["1"], 5.0, (1, 0)), ("B", "A", ["y"], ["2"], 2.0, (2, 0)), ("A", "C", ["z"], ["1"], 0.5, (3, 0)), ("D", "D", ["s"], ["1"], 9.0, (4, 0))]
    rels = spark.createDataFrame(rows, "source string, target string, description array<string>, text_unit_ids array<string>, weight double, first_seq struct<chunk_seq:long,rec_seq:long>")
    assert sorted((r.u, r.v, r.weight) for r in graph.collapse_edges(rels).collect()) == [("A", "B", 2.0), ("D", "D", 9.0)]
    assert sorted((r.u, r.weight) for r in graph.collapse_edges(rels, sum_directions=True).collect()) == [("A", 7.0), ("D", 9.0)]
    nodes = spark.createDataFrame([("D", 1), ("E", 2)], "name string, node_ord int")
    edges = graph.collapse_edges(rels).where("u = 'D'")
    assert sorted((r.name, r.degree) for r in graph.degrees(nodes, edges).collect()) == [("D", 2), ("E", 0)]


def test_hop_odds(spark):
    """Equal weights, one neighbour in another chunk: odds of three to one."""
    adj = spark.createDataFrame([("s", "near", 1.0, "c1"), ("s", "far", 1.0, "c2")], "a string, b string, weight double, b_chunk string")
    front = spark.range(8000).select(F.col("id").alias("cand"), F.lit(0).alias("attempt"), F.lit(3).alias("target"), F.array(F.lit("s")).alias("path"), F.array(F.lit("c1")).alias("chunks"), F.lit(True).alias("live"))
    far = walks.hop(front, adj, 1, walks.WalkConfig()).where("path[1] = 'far'").count()
    assert abs(far / 8000 - 0.75) < 0.02


def test_few_walks_go_to_neighbours(spark, monkeypatch):
    """Steps of few walks do not deal the neighbours anew; of many they do. Same walks."""
    from loomgraph.sources.scratch import Scratch

    nodes = spark.createDataFrame([(f"n{i}", [f"c{i % 3}"]) for i in range(9)], "name string, text_unit_ids array<string>")
    adj = spark.createDataFrame([(f"n{i}", f"n{(i + k) % 9}", 1.0, f"c{(i + k) % 9 % 3}") for i in range(9) for k in (1, 2, 4)], "a string, b string, weight double, b_chunk string")
    starts = spark.range(20).select(F.col("id").alias("cand"), F.concat(F.lit("n"), F.col("id") % 9).alias("start"))
    seen, found, whole = [], [], walks.hop
    monkeypatch.setattr(walks, "hop", lambda front, adj, i, cfg, few=False: seen.append(few) or whole(front, adj, i, cfg, few))
    for most in (walks.FEW, 39):
        monkeypatch.setattr(walks, "FEW", most)
        found.append(sorted(walks.attempts(starts, nodes, adj, 0, 2, walks.WalkConfig(), Scratch(spark, "few")).collect()))
    assert found[0] == found[1] and len(found[0]) == 40
    assert seen == [True] * 5 + [False] * 5


def test_walks_hold(spark):
    names = [f"n{i}" for i in range(30)]
    nodes = spark.createDataFrame([(n, "T", [f"d{n}"], [f"c{i % 7}"], 1 + i % 3, i) for i, n in enumerate(names)], "name string, type string, description array<string>, text_unit_ids array<string>, frequency long, node_ord int")
    pairs = sorted({tuple(sorted((f"n{i}", f"n{(i * k + k) % 30}"))) for i in range(30) for k in (1, 2, 5) if i != (i * k + k) % 30})
    edges = spark.createDataFrame([(a, b, 1.0 + i % 4, ["r"], ["c0"], i) for i, (a, b) in enumerate(pairs)], "u string, v string, weight double, description array<string>, text_unit_ids array<string>, edge_ord int")
    cfg = walks.WalkConfig(num_walks=40)
    found = walks.generate(nodes, edges, cfg).collect()
    assert len(found) == 40
    for w in found:
        assert len(set(w.path)) == len(w.path) and 4 <= len(w.path) <= 6 and len(set(w.chunks)) >= 2
        assert all(tuple(sorted(p)) in pairs for p in zip(w.path, w.path[1:], strict=False))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    again = walks.generate(nodes.repartition(5), edges, cfg).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [w.path for w in again] == [w.path for w in found]
    assert walks.generate(nodes.limit(0), edges.limit(0), cfg).collect() == []


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("skip it", None),
        ("Question: SKIP", None),
        ("Question: SKIP\nFinal Answer: x", ("SKIP", "", "x")),
        ("Reasoning: a\nb\nQuestion: q?\nFinal Answer:  y \nmore", ("q?", "a\nb", "y")),
        ("Description: d\n\nQuestion: q\nand\n\nFinal Answer: z", ("q\nand", "d", "z")),
        ("Question: q\nFinal Answer:   ", None),
    ],
)
def test_qa_parse(spark, said, want):
    (got,) = column(spark, [said], qa.parsed)
    assert (tuple(got) if got else None) == want


def test_gates_and_chat(spark):
    rows = spark.createDataFrame([("Rome", ("in ROME?", "r" * 40, "Rome")), ("Rome", ("where?", "r" * 29, "Rome")), ("Rome", ("where?", "r" * 30, "Rome"))], "t string, s struct<question:string,reasoning:string,answer:string>")
    assert [r.g for r in rows.select(qa.gate(F.col("t"), F.col("s")).alias("g")).collect()] == ["leak", "short", None]
    assert column(spark, [" pass.", "FAIL", None], qa.passed) == [True, False, False]


def test_passages_and_path(spark):
    w = spark.createDataFrame([(1, ["c1", "missing", "c2", "c1", ""])], "cand long, chunk_ids array<string>")
    chunks = spark.createDataFrame([("c1", "one"), ("c2", "two")], "id string, text string")
    assert qa.passages(w, chunks).first().chunks_text == "[Passage 1]\none\n\n[Passage 3]\ntwo"
    row = spark.createDataFrame([(["A", "B", "C"], ["x", "", "z"], [(["", "r"],), ([],)])], "n array<string>, d array<string>, e array<struct<description:array<string>>>")
    assert row.select(qa.path_text(F.col("n"), F.col("d"), F.col("e")).alias("t")).first().t == "1. A\n   (x)\n   → r\n2. B\n   → related to\n3. C\n   (z)"


def test_rendering(spark):
    msgs = spark.createDataFrame([([("human", "hi"), ("gpt", "yo"), ("tool", "x")],)], "c array<struct<from:string,value:string>>").select(training.messages(F.col("c")).alias("m"))
    plain = msgs.select(training.rendered(F.col("m")).alias("r")).first().r
    assert plain.text == "### Human: hi\n\n### Assistant: yo</s>" and [plain.text[s.start : s.end] for s in plain.spans] == ["yo"]
    im = msgs.select(training.rendered(F.col("m"), "im").alias("r")).first().r
    assert im.text.startswith("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nhi") and [im.text[s.start : s.end] for s in im.spans] == ["yo"]


def test_neighbours_are_read_once_a_hop(spark, monkeypatch):
    """Few walks take all attempts, of more than one round, in one pass of hops; of more
    than `ONCE`, later attempts follow the first. Same walks."""
    nodes = spark.createDataFrame([(f"n{i}", "T", [f"d{i}"], [f"c{i % 2}"], 1 + i % 3, i) for i in range(24)], "name string, type string, description array<string>, text_unit_ids array<string>, frequency long, node_ord int")
    pairs = sorted({tuple(sorted((f"n{i}", f"n{(i + k) % 24}"))) for i in range(24) for k in (1, 2)} - {("n3", "n4"), ("n3", "n5")})
    edges = spark.createDataFrame([(a, b, 1.0 + i % 4, ["r"], ["c0"], i) for i, (a, b) in enumerate(pairs)], "u string, v string, weight double, description array<string>, text_unit_ids array<string>, edge_ord int")
    cfg = walks.WalkConfig(num_walks=40, surplus=1.0, min_hops=5, max_hops=5, min_chunks_crossed=2, max_retries=3, seed=7)
    hops, found, whole = [], [], walks.hop
    monkeypatch.setattr(walks, "hop", lambda front, adj, i, cfg, few=False: hops.append(i) or whole(front, adj, i, cfg, few))
    for most in (walks.ONCE, 0):
        monkeypatch.setattr(walks, "ONCE", most)
        found.append([tuple(w) for w in walks.generate(nodes, edges, cfg).collect()])
        hops.append(None)
    assert found[0] == found[1] and len(found[0]) == 40
    assert hops[: hops.index(None)] == [1, 2, 3, 4, 5]
    plan = walks.hop(spark.createDataFrame([(0, 0, 3, ["n1"], ["c1"], True)], "cand long, attempt int, target int, path array<string>, chunks array<string>, live boolean"), walks.adjacency(nodes, edges), 1, cfg)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 0


def test_graph_is_dealt_once(spark, monkeypatch):
    """Mentions to a graph: what merging, leaving out orphans and collapsing in turn give;
    lists are gathered where the mentions were dealt to."""
    from loomgraph.sources.scratch import Scratch

    ents = spark.createDataFrame([(f"n{i % 5}", f"T{i % 3}", f"d{i}", f"c{i % 4}", i % 4, i) for i in range(40)], "title string, type string, description string, source_id string, chunk_seq long, rec_seq int")
    rels = spark.createDataFrame([(f"n{i % 7}" if i % 11 else None, f"n{i * 3 % 6}", f"r{i}", 0.25 * (i % 9), f"c{i % 4}", i % 4, i) for i in range(80)], "source string, target string, description string, weight double, source_id string, chunk_seq long, rec_seq int")
    merged = extraction.merge_entities(ents)
    want = [graph.collapse_nodes(merged), graph.collapse_edges(extraction.without_orphans(extraction.merge_relations(rels), merged))]
    plans, write = {}, Scratch.table

    def table(self, df, name, *a, **k):
        out = write(self, df, name, *a, **k)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(Scratch, "table", table)
    for few in (graph.FEW, 0):
        monkeypatch.setattr(graph, "FEW", few)
        got = graph.build(ents, rels, Scratch(spark, "built"))
        for g, w in zip(got, want, strict=True):
            assert sorted(map(str, g.collect())) == sorted(map(str, w.select(*g.columns).collect()))
    for name in ("nodes", "edges"):
        assert plans[name].count("Exchange hashpartitioning") == 1
    assert any(r.name in ("n5", "n6") for r in rels.selectExpr("source AS name").collect())


def test_rule_says(spark, monkeypatch):
    """What the rule backend says of odd texts, in one pass, a few characters at a time."""
    from loomgraph.sources import completions

    texts = ["Abcd efgh Ijklm ABCDEfgh Éclair Ab Abc Wxyz", "", None, "none", "Only", "Same Same"]
    rows = spark.createDataFrame([(f"c{i}", t, i) for i, t in enumerate(texts)], "id string, text string, chunk_seq long").coalesce(1)
    end, types = "\n##\n<|COMPLETE|>", extraction.ENTITY_TYPES
    ent = lambda t, i: f'("entity"<|>{t}<|>{types[(len(t) + i) % 8]}<|>{t} at {i})'
    rel = lambda a, b: f'("relationship"<|>{a}<|>{b}<|>{a} then {b}<|>{len(a) % 10 + 1})'
    want = ["\n##\n".join([ent("Abcd", 0), ent("Ijklm", 1), ent("Efgh", 2), ent("Wxyz", 3), rel("Abcd", "Ijklm"), rel("Ijklm", "Efgh"), rel("Efgh", "Wxyz")]) + end, end, end, end, ent("Only", 0) + end, "\n##\n".join([ent("Same", 0), ent("Same", 1), rel("Same", "Same")]) + end]
    assert [r.t for r in rows.select("chunk_seq", completions.rule_text(F.col("text")).alias("t")).orderBy("chunk_seq").collect()] == want
    monkeypatch.setattr(completions, "HELD", 40)
    said = completions.rule(rows)
    assert [(r.chunk_id, r.result) for r in said.orderBy("chunk_seq").collect()] == [(f"c{i}", w) for i, w in enumerate(want)]
    assert "lambda" not in said._jdf.queryExecution().optimizedPlan().toString()


def test_samples_look_up_named_chunks_once(spark):
    """Chunks no walk names are neither dealt nor looked up, and prompts are made and
    calls are asked once, however many uses their answers have."""
    from loomgraph.operators import qa as q

    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    told = F.udf(count, "string").asNondeterministic()
    edge = [(1.0, ["r"], ["c0"])]
    w = spark.createDataFrame([(i, ["A", "B"], ["x", "y"], [f"c{i}", f"c{i + 1}", ""], edge, 2) for i in range(4)], "cand long, nodes array<string>, node_descriptions array<string>, chunk_ids array<string>, edges array<struct<weight:double,description:array<string>,text_unit_ids:array<string>>>, chunks_crossed int")
    chunks = spark.range(400).select(F.concat(F.lit("c"), F.col("id") % 200).alias("id"), F.concat(F.lit("text "), "id").alias("text"), F.col("id").alias("chunk_seq"))
    said = f"Reasoning: {'r' * 40}\nQuestion: q?\nFinal Answer: z"
    got = {}

    def complete(rows):
        got["prompt"] = {r.cand: r.chunks_text for r in rows.collect()}
        return rows.withColumn("completion", told(F.when(F.col("cand") < 3, said).otherwise("SKIP")))

    out = q.inter(w, chunks, complete, lambda rows: rows.withColumn("verdict", F.lit("PASS")))
    assert sorted((r.cand, r.status) for r in out.collect()) == [(0, "ok"), (1, "ok"), (2, "ok"), (3, "unparsed")]
    assert seen.value == 4
    assert got["prompt"][0] == "[Passage 1]\ntext 200\n\n[Passage 2]\ntext 201"
