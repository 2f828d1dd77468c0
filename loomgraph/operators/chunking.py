"""Records to chunks: overlapping word windows with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import generated_id, is_blank, window_count, windows, word_count, words
from loomgraph.operators.scan import running_total


def first_text(*candidates: Column) -> Column:
    """The first candidate that is not blank, else the empty text."""
    return F.coalesce(*[F.when(~is_blank(c), c) for c in candidates], F.lit(""))


def meaningful_id(c: Column) -> Column:
    """A record's id; zero, false and the empty text count as missing."""
    text = c.cast("string")
    return F.when(~F.coalesce(text, F.lit("")).isin("", "0", "0.0", "-0.0", "false"), text)


def chunk(records: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """records (file_seq, line_no, text, title, source, base_id) to chunks: id, text,
    title, source, chunk_seq (the running number over all records). file_seq may be any
    value that sorts as the files do.

    A base id names the only piece itself and several with their numbers; without
    one the id comes from source, title, piece and the running number. The title
    heads the first piece. Blank records give none.
    """
    title = F.coalesce("title", F.lit(""))
    n = window_count(word_count(F.col("text")), size, overlap)
    rows = records.select("file_seq", "line_no", "source", title.alias("title"), "base_id", "text", n.alias("n"))  # blank ones explode to nothing; a filter would count words again
    rows = running_total(rows, "file_seq", "line_no", "n", "base")
    rows = rows.select("source", "title", "base_id", "n", "base", F.posexplode(windows(words(F.col("text")), size, overlap)).alias("i", "piece"))
    seq = F.col("base") + F.col("i")
    made = generated_id(F.col("source"), F.concat_ws("_", "title", F.col("i").cast("string")), seq)
    named = F.when(F.col("n") == 1, F.col("base_id")).otherwise(F.concat_ws("_", "base_id", F.col("i").cast("string")))
    text = F.when((F.col("i") == 0) & (F.col("title") != ""), F.concat("title", F.lit("\n\n"), "piece")).otherwise(F.col("piece"))
    return rows.select(F.when(F.col("base_id").isNotNull(), named).otherwise(made).alias("id"), text.alias("text"), "title", "source", seq.cast("long").alias("chunk_seq"))
