"""Completions to entity and relationship mentions, and their merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import to_float

#: The delimiters of the completion format and the default types.
FIELD, RECORD, DONE = "<|>", "##", "<|COMPLETE|>"
ENTITY_TYPES = ("CONCEPT", "MODEL", "METHOD", "DATASET", "METRIC", "PAPER", "ORGANIZATION", "PERSON")


def join_turns(turns, rounds: int | None = None):
    """A completion and its continuations as one text, glued without a separator."""
    return F.array_join(turns if rounds is None else F.slice(turns, 1, rounds + 1), "")


#: Records of one batch of `parse`.
HELD = 20_000


def parse(completions: DataFrame, strip_done: bool = False) -> DataFrame:
    """completions (chunk_id, chunk_seq, result) to records (chunk_id, chunk_seq,
    rec_seq, tag, parts: the cleaned fields). A record that holds the completion marker
    is lost with all its text, unless strip_done takes the marker out first.

    One pass in Python, `HELD` records at a time: a regular expression or a lambda for
    every field of every record costs some ten times as much.
    """
    held, field, mark, done = HELD, FIELD, RECORD, DONE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(["chunk_id", "chunk_seq"])
            rows, seqs, flat, ends = [], [], [], [0]

            def out() -> pa.RecordBatch:
                values, offsets = pa.array(flat, pa.string()), pa.array(ends, pa.int32())
                parts = pa.ListArray.from_arrays(offsets, values)
                made = [pa.array(seqs, pa.int32()), values.take(offsets[:-1]), parts]
                return pa.RecordBatch.from_arrays([*keys.take(pa.array(rows, pa.int64())).columns, *made], ["chunk_id", "chunk_seq", "rec_seq", "tag", "parts"])

            for i, said in enumerate(batch.column("result")):
                text = said.as_py() or ""
                for seq, raw in enumerate((text.replace(done, "") if strip_done else text).split(mark)):
                    record = raw.strip().removeprefix("(").removesuffix(")")
                    if record and done not in record:
                        flat.extend([part.strip().strip('"').strip("'").strip() for part in record.split(field)])
                        ends.append(len(flat))
                        rows.append(i)
                        seqs.append(seq)
                        if len(rows) == held:
                            yield out()
                            rows, seqs, flat, ends = [], [], [], [0]
            if rows:
                yield out()

    given = completions.select("chunk_id", "chunk_seq", "result")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    return given.mapInArrow(run, f"chunk_id {kinds['chunk_id']}, chunk_seq {kinds['chunk_seq']}, rec_seq int, tag string, parts array<string>")


def entities(records: DataFrame) -> DataFrame:
    p = F.col("parts")
    kept = records.where((F.col("tag") == "entity") & (F.size("parts") >= 4))
    return kept.select(p[1].alias("title"), F.upper(p[2]).alias("type"), p[3].alias("description"), F.col("chunk_id").alias("source_id"), "chunk_seq", "rec_seq")


def relations(records: DataFrame) -> DataFrame:
    """The weight is the last field, whatever their number; not a number means 1."""
    p = F.col("parts")
    kept = records.where((F.col("tag") == "relationship") & (F.size("parts") >= 5))
    weight = to_float(F.element_at(p, -1))
    return kept.select(p[1].alias("source"), p[2].alias("target"), p[3].alias("description"), weight.alias("weight"), F.col("chunk_id").alias("source_id"), "chunk_seq", "rec_seq")


def _seq():
    return F.struct(F.col("chunk_seq").cast("long").alias("chunk_seq"), F.col("rec_seq").cast("long").alias("rec_seq"))


def _listed(mentions: DataFrame, keys: list[str], *aggs) -> DataFrame:
    """One row per key: `aggs`, first_seq, and descriptions and chunk ids in order of
    mention, which are gathered and sorted together, once."""
    one = F.struct(_seq().alias("s"), "description", F.col("source_id").alias("text_unit_ids"))
    rows = mentions.groupBy(*keys).agg(F.collect_list(one).alias("x"), *aggs, F.min(_seq()).alias("first_seq"))
    rows = rows.withColumn("x", F.sort_array("x"))
    return rows.withColumns({c: F.col("x").getField(c) for c in ("description", "text_unit_ids")}).drop("x")


def merge_entities(mentions: DataFrame, *by: str) -> DataFrame:
    """One row per (title, type), lists in order of mention, with duplicates."""
    keys = [*by, "title", "type"]
    return _listed(mentions, keys, F.count("source_id").alias("frequency")).select(*keys, "description", "text_unit_ids", "frequency", "first_seq")


def merge_relations(mentions: DataFrame, *by: str) -> DataFrame:
    """One row per directed pair; weights are summed, NaN left out."""
    keys = [*by, "source", "target"]
    weight = F.coalesce(F.sum(F.when(~F.isnan("weight"), F.col("weight"))), F.lit(0.0))
    return _listed(mentions, keys, weight.alias("weight")).select(*keys, "description", "text_unit_ids", "weight", "first_seq")


def without_orphans(rels: DataFrame, ents: DataFrame, *by: str) -> DataFrame:
    """Relationships both of whose ends are entities (of the same `by`)."""
    titles = ents.select(*by, "title").distinct()
    for end in ("source", "target"):
        rels = rels.join(titles.withColumnRenamed("title", end), [*by, end], "left_semi")
    return rels
