"""Readers and writers of the pipeline's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions.text import bound, is_blank, strip
from loomgraph.operators.scan import prefix_sums, running_total
from loomgraph.sources.scratch import exists, replace_by

SUFFIXES = ("txt", "md", "jsonl")
#: The fields of a record that may hold its text, in this order.
TEXT_FIELDS = ("text", "content", "paragraph", "paragraph_text", "body")
_FALSY = ("0", "0.0", "-0", "-0.0", "false", "[]", "{}")


def _field(name: str, record: str = "v") -> str:
    """A field of a variant as text, null where it is empty, zero, false or null."""
    text, kind = f"try_variant_get({record}, '$.{name}', 'string')", f"schema_of_variant(try_variant_get({record}, '$.{name}', 'variant'))"
    falsy = ", ".join(f"'{x}'" for x in _FALSY)
    return f"if({kind} = 'STRING', nullif({text}, ''), if({text} in ({falsy}), null, {text}))"


def json_status(lines: DataFrame) -> DataFrame:
    """lines (file_seq, line_no, source, value) with status: why a line is skipped
    (invalid: no JSON; kind: neither text nor an object; empty: no text), or "ok" and
    the record's text, title and base_id. Blank lines are no lines."""
    rows = lines.where(~is_blank(F.col("value"))).withColumn("v", F.try_parse_json(strip(F.col("value"))))
    rows = rows.withColumn("kind", F.schema_of_variant("v"))
    fields = F.when(F.col("kind") == "STRING", F.array(F.try_variant_get("v", "$", "string"))).otherwise(F.array(*[F.expr(_field(f)) for f in TEXT_FIELDS]))
    text = bound(F.filter(fields, lambda x: x.isNotNull() & ~is_blank(x)), lambda x: F.get(x, F.lit(0)))
    rows = rows.select("file_seq", "line_no", "source", "v", "kind", text.alias("text"), F.expr(_field("title")).alias("t"), F.expr(_field("id")).alias("i"))
    known = (F.col("kind") == "STRING") | F.startswith("kind", F.lit("OBJECT"))
    status = F.when(F.col("v").isNull(), "invalid").when(~known, "kind").when(F.col("text").isNull(), "empty").otherwise("ok")
    whole = F.col("kind") != "STRING"
    return rows.select("file_seq", "line_no", "source", status.alias("status"), "text", F.when(whole, F.coalesce("t", F.lit(""))).otherwise("").alias("title"), F.when(whole, F.col("i")).alias("base_id"))


def json_records(lines: DataFrame) -> DataFrame:
    """The usable lines as records: file_seq, line_no, text, title, source, base_id."""
    return json_status(lines).where("status = 'ok'").select("file_seq", "line_no", "text", "title", "source", "base_id")


def skipped(lines: DataFrame) -> DataFrame:
    """source, status, n: how many lines of each file are skipped, and why."""
    return json_status(lines).where("status <> 'ok'").groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


def _order(path: Column) -> Column:
    """A text that sorts as paths do, folder by folder."""
    return F.translate(path, "/", "\x01")


def _place() -> Column:
    """A row's place in its file: the start of its block and its row there, which only
    grows along a file (a task holds no more rows than bytes)."""
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _any_case(*suffixes: str) -> str:
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in suffixes) + "}"


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def files(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """path of the files under a folder with one of the suffixes (in any case); no
    file's content is read."""
    return _reader(spark, path, "binaryFile", *suffixes).select("path")


def _reader(spark: SparkSession, path: str, kind: str, *suffixes: str) -> DataFrame:
    reader = spark.read.format(kind).option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", _any_case(*suffixes)) if suffixes else reader).load(path)


def valid_text(raw: Column) -> Column:
    """Text without the bytes that are no UTF-8; U+FFFD written as such stays, so it is
    set apart (by a noncharacter, itself set apart) while Spark marks bad bytes with it."""
    apart = F.replace(F.replace(raw, F.lit("\U0010ffff"), F.lit("\U0010ffff0")), F.lit("\ufffd"), F.lit("\U0010ffff1"))
    clean = F.replace(F.make_valid_utf8(apart), F.lit("\ufffd"), F.lit(""))
    back = F.replace(F.replace(clean, F.lit("\U0010ffff1"), F.lit("\ufffd")), F.lit("\U0010ffff0"), F.lit("\U0010ffff"))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(back)


def _paths(path: Column) -> list[Column]:
    source = F.regexp_replace(path, "^file:/+", "/")
    return [_order(source).alias("file_seq"), source.alias("source")]


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all JSONL files: file_seq, line_no, source, value."""
    kind = () if _is_file(spark, path) else ("jsonl",)
    raw = _reader(spark, path, "text", *kind).select(*_paths(F.col("_metadata.file_path")), _place().alias("line_no"), valid_text(F.col("value")).alias("value"))
    return raw


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Records of all text, Markdown and JSONL files: one for each text file (title:
    the file's stem; invalid bytes dropped) and one for each usable line of JSONL. A
    path that is a file counts whatever its suffix. file_seq sorts as the paths do. A
    text file is one row, so it must be below 2 GB; JSONL files may have any size.
    """
    one = _is_file(spark, path)
    lines = one and path.lower().endswith(".jsonl")
    if lines:
        return json_records(json_lines(spark, path))
    content = _reader(spark, path, "binaryFile", *(() if one else ("txt", "md"))).select("path", valid_text(F.col("content").cast("string")).alias("text"))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    order, source = _paths(F.col("path"))
    whole = content.where(~is_blank(F.col("text"))).select(order, F.lit(0).cast("long").alias("line_no"), "text", stem.alias("title"), source, F.lit(None).cast("string").alias("base_id"))
    return whole if one else whole.unionByName(json_records(json_lines(spark, path)))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows with the columns __file and __line numbered from 0 in that order."""
    return running_total(rows.withColumn("__one", F.lit(1)), "__file", "__line", "__one", name).drop("__one", "__file", "__line")


def _in_order(spark: SparkSession, path: str, schema: str, name: str, **options: str) -> DataFrame:
    rows = spark.read.schema(schema).options(**options).json(path)
    return _numbered(rows.select("*", _order(F.col("_metadata.file_path")).alias("__file"), _place().alias("__line")), name)


def read_chunks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Chunks of one or several JSONL files, numbered by file and line whatever the
    files' sizes; malformed lines fail, and so does a path without chunks. A limit of
    0 is none."""
    rows = _in_order(spark, path, schemas.CHUNK, "chunk_seq", mode="FAILFAST")
    if rows.isEmpty():
        raise ValueError(f"no chunks in {path}")
    return rows.where(F.col("chunk_seq") < limit) if limit else rows


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    return _in_order(spark, path, schemas.WALK, "cand")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TURN).json(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: Parquet tables in a folder, or a node-link document. An absent
    weight stays null: merging counts it as 0, walks and exports as 1."""
    if graph_tables(spark, path):
        return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    doc = spark.read.schema(schemas.GRAPH).option("multiLine", "true").json(path)
    empty = F.array().cast("array<string>")
    frequency = F.coalesce(F.try_variant_get(F.col("n.frequency"), "$", "double").cast("long"), F.lit(1))
    frequency = F.when(F.schema_of_variant("n.frequency") == "STRING", 1).otherwise(frequency)  # only a number counts
    nodes = doc.select(F.posexplode("nodes").alias("node_ord", "n")).select(F.col("n.id").alias("name"), F.coalesce("n.type", F.lit("UNKNOWN")).alias("type"), F.coalesce("n.description", empty).alias("description"), F.coalesce("n.text_unit_ids", empty).alias("text_unit_ids"), frequency.cast("long").alias("frequency"), "node_ord")
    edges = doc.select(F.posexplode("links").alias("edge_ord", "l")).select(F.least("l.source", "l.target").alias("u"), F.greatest("l.source", "l.target").alias("v"), F.col("l.weight").alias("weight"), F.coalesce("l.description", empty).alias("description"), F.coalesce("l.text_unit_ids", empty).alias("text_unit_ids"), "edge_ord")
    return nodes, edges


def graph_tables(spark: SparkSession, path: str) -> bool:
    """Whether a path holds a graph as Parquet tables."""
    return exists(spark, f"{path}/nodes") and exists(spark, f"{path}/edges")


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the node-link JSON text: for interchange of graphs that fit a file."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("node_ord", F.struct(F.col("name").alias("id"), "type", "description", "text_unit_ids", "frequency").alias("x")))).alias("n"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("edge_ord", F.struct(F.col("u").alias("source"), F.col("v").alias("target"), "weight", "description", "text_unit_ids").alias("x")))).alias("l"))
    both = n.join(e, F.lit(True))
    return both.select(F.to_json(F.struct(F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), F.struct().alias("graph"), F.transform("n", lambda x: x["x"]).alias("nodes"), F.transform("l", lambda x: x["x"]).alias("links"))).alias("value"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """As a node-link document in one file if the path ends in .json, for graphs that
    fit one; as Parquet tables of nodes and edges otherwise. Either is written beside
    the old graph, which it then replaces."""
    spark, fresh = nodes.sparkSession, f"{path.rstrip('/')}.new"
    if path.endswith(".json"):
        graph_document(nodes, edges).coalesce(1).write.mode("overwrite").text(fresh)
        replace_by(spark, path, fresh, part=True)
        return
    for name, rows, order in (("nodes", nodes, "node_ord"), ("edges", edges, "edge_ord")):
        numbered = prefix_sums(rows.withColumn("__one", F.lit(1)), [order], "__one", "__n")
        numbered.withColumn(order, F.col("__n").cast("long")).drop("__one", "__n").write.mode("overwrite").parquet(f"{fresh}/{name}")
    replace_by(spark, path, fresh)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)
