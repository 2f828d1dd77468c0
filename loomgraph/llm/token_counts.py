"""Token counts of the documents in flat token files that have no index.

A flat file is token ids of fixed width, one document after another, each ended by
the end-of-document id; where documents begin is not recorded. Files are read in
blocks cut anywhere. Each block is searched for the separator in one vectorised
comparison, giving its length and the places of its separators. A prefix scan over
the blocks then gives every block its position, the documents before it and the last
separator before it, which is all it takes to close the document that runs over its
border. The scan has two levels, runs of blocks and the totals of runs, and carries
three numbers a block, never the separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch
from loomgraph.llm.tokenizing import default_path, encoder, text_blocks

BLOCK_TOKENS = 1 << 18
END_OF_TEXT = 50256
#: Blocks whose numbers are summed in one window.
RUN = 4096
BLOCKS = "file_id long, block_no long, tokens binary"


def width_of(path: str) -> int:
    """Bytes of an id: two where all ids of the tokenizer fit."""
    return 2 if encoder(path, True).library.get_vocab_size() <= 1 << 16 else 4


def _writing(path: str, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file, block, done = encoder(path, True), TaskContext.get().partitionId(), 0, 0
        kind = f"<u{width_of(path)}"
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def out(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, names, block, done
            flat = np.concatenate(held) if held else np.zeros(0, kind)
            upto = len(flat) if whole else len(flat) // size * size
            for i in range(0, upto, size):
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([flat[i : i + size].tobytes()], pa.binary()), pa.array([done]), pa.array([names], pa.list_(pa.int64()))], ["file_id", "block_no", "tokens", "first_doc", "doc_ids"])
                block, done, names = block + 1, done + len(names), []
            held = [flat[upto:].copy()] if upto < len(flat) else []

        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in text_blocks(texts):
                ids, bounds = own.encode(texts[a:b])
                if len(ids) and int(ids.max()) >= 1 << 8 * np.dtype(kind).itemsize:
                    raise ValueError("an id is wider than the file's ids")
                held.append(np.insert(ids, bounds[1:], end).astype(kind))
                names += docs[a:b]
                yield from out(False)
        yield from out(True)

    return run


def flat_files(docs: DataFrame, scratch: Scratch, path: str | None = None, end: int = END_OF_TEXT, size: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Writes the documents as flat token files, one for each partition, in blocks;
    returns the blocks and, apart from them, which documents were written:
    file_id, doc_no, doc_id. Names of special tokens in a text are text, so only
    separators have the id `end`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = scratch.table(rows.mapInArrow(_writing(path or default_path(), end, size), f"{BLOCKS}, first_doc long, doc_ids array<long>"), "tokens")
    names = made.select("file_id", "first_doc", F.posexplode("doc_ids").alias("i", "doc_id"))
    return made.select("file_id", "block_no", "tokens"), names.select("file_id", (F.col("first_doc") + F.col("i")).alias("doc_no"), "doc_id")


def read_flat(spark: SparkSession, path: str, width: int = 2, size: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of the flat files under a path; file_id is a hash of the file's path.
    Files may have any size: only their names and lengths are listed, and each block
    is a range of bytes that a task reads by itself (on any file system that
    pyarrow.fs opens)."""
    import pyarrow.fs

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, name in zip(*(batch.column(c).to_pylist() for c in ("file_id", "block_no", "path")), strict=True):
                system, at = pyarrow.fs.FileSystem.from_uri(name)
                with system.open_input_file(at) as f:
                    data = f.read_at(width * size, block * width * size)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([bytes(data)], pa.binary())], ["file_id", "block_no", "tokens"])

    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    blocks = files.select(F.xxhash64("path").alias("file_id"), "path", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / (width * size)))).alias("block_no"))
    return blocks.repartition("file_id", "block_no").mapInArrow(read, BLOCKS)


def _scanning(end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, places = [], []
            for block in batch.column("tokens"):
                ids = np.frombuffer(block.as_buffer() or b"", f"<u{width}") if block.is_valid else np.zeros(0, np.uint8)
                length.append(len(ids))
                places.append(np.flatnonzero(ids == end))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("block_no"), pa.array(length, pa.int64()), pa.array(places, pa.list_(pa.int64()))], ["file_id", "block_no", "length", "places"])

    return run


def scanned(blocks: DataFrame) -> DataFrame:
    """blocks (file_id, block_no, length, seps, last: the place of the last separator)
    with what lies before each in its file: base (tokens), doc_no (separators) and
    prior (the last one's place, -1 for none); and whether it is the file's last."""
    rows = blocks.withColumn("run", F.floor(F.col("block_no") / RUN))
    inside = Window.partitionBy("file_id", "run").orderBy("block_no")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = rows.withColumn("own_base", upto("length", before)).withColumn("own_seps", upto("seps", before))
    rows = rows.withColumn("own_prior", F.max(F.col("own_base") + F.col("last")).over(before))
    totals = rows.groupBy("file_id", "run").agg(F.sum("length").alias("n"), F.sum("seps").alias("k"), F.max(F.col("own_base") + F.col("last")).alias("z"), F.max("block_no").alias("final_no"))
    order = Window.partitionBy("file_id").orderBy("run")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("run_base", upto("n", earlier)).withColumn("run_seps", upto("k", earlier))
    totals = totals.withColumn("run_prior", F.max(F.col("run_base") + F.col("z")).over(earlier)).withColumn("ends", F.lead("run").over(order).isNull())
    both = rows.join(totals, ["file_id", "run"])
    base = F.col("run_base") + F.col("own_base")
    prior = F.coalesce(F.col("run_base") + F.col("own_prior"), F.col("run_prior"), F.lit(-1))
    return both.select("file_id", "block_no", base.alias("base"), (F.col("run_seps") + F.col("own_seps")).alias("doc_no"), prior.alias("prior"), (F.col("ends") & (F.col("block_no") == F.col("final_no"))).alias("final"))


def count(blocks: DataFrame, end: int = END_OF_TEXT, width: int = 2) -> DataFrame:
    """One row per document: file_id, doc_no (from 0 in its file), start (its first
    token's place), n_tokens (without the separator), closed.

    blocks has file_id, block_no and tokens (little-endian ids of `width` bytes); a
    null or empty block holds nothing. Neighbouring separators make a document of
    no tokens, and one document may run over any number of blocks. Tokens after a
    file's last separator are a document with closed = false. Extra columns are
    ignored; no rows in, no rows out.
    """
    found = blocks.select("file_id", "block_no", "tokens").mapInArrow(_scanning(end, width), "file_id long, block_no long, length long, places array<long>")
    found = Scratch(blocks.sparkSession, "scan").table(found, "found")
    numbers = found.select("file_id", "block_no", "length", F.size("places").alias("seps"), F.try_element_at("places", F.lit(-1)).alias("last"))
    rows = found.join(scanned(numbers), ["file_id", "block_no"])
    one = rows.select("file_id", "doc_no", "base", "prior", "places", F.posexplode("places").alias("i", "place"))
    start = F.when(F.col("i") == 0, F.col("prior")).otherwise(F.col("base") + F.get("places", F.col("i") - 1)) + 1
    one = one.select("file_id", (F.col("doc_no") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("base") + F.col("place") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    begun = F.coalesce(F.col("base") + F.try_element_at("places", F.lit(-1)), F.col("prior")) + 1
    tail = rows.where("final").select("file_id", (F.col("doc_no") + F.size("places")).alias("doc_no"), begun.alias("start"), (F.col("base") + F.col("length") - begun).alias("n_tokens"), F.lit(False).alias("closed"))
    return one.unionByName(tail.where("n_tokens > 0"))


def document_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document: written as flat token files, counted by
    the scan, and named by the order in which they were written.

    Null and empty texts have no tokens; a very long text runs over as many blocks as
    it needs; names of special tokens in a text are counted as text. Repeated rows are
    counted each on its own, null ids too; extra columns are ignored; no rows in, no
    rows out.
    """
    path = path or default_path()
    blocks, names = flat_files(docs, Scratch(docs.sparkSession, "flat"), path)
    return count(blocks, width=width_of(path)).where("closed").join(names, ["file_id", "doc_no"]).select("doc_id", "n_tokens")
