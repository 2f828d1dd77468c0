"""Queries over whole tables against brute force."""

import collections
import re

from loomgraph.plans import registry

SF = "/root/testdata/sf0.001"


def mentioned(spark):
    """Titles and how often each is mentioned, in documents of every language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len({r.lang for r in docs}) > 1
    return collections.Counter(t for r in docs for t in re.findall("[A-Z][a-z]{3,}", r.text or ""))


def test_every_mention(spark):
    want = mentioned(spark)
    assert collections.Counter(r.title for r in registry.QUERIES["parse_entities"](spark, SF).collect()) == want
    assert {r.name for r in registry.QUERIES["graph_nodes"](spark, SF).collect()} == set(want)


def test_every_chunk_streams(spark):
    assert {r.name for r in registry.QUERIES["stream_incremental"](spark, SF).collect()} == set(mentioned(spark))


def test_full_walks(spark):
    """The operator's own number of walks."""
    assert registry.QUERIES["walk_hop1_full"](spark, SF).select("cand").distinct().count() == 15_000


def test_long_texts(spark):
    """Windows and completions of a text ten times as long take about ten times as long,
    not a hundred times."""
    import time

    from pyspark.sql import functions as F

    from loomgraph.functions import text
    from loomgraph.sources import completions

    def took(n):
        rows = spark.range(20).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("Word Abcd"), (i % 97).cast("string"))), " ").alias("t"))
        rows.cache().count()
        start = time.time()
        rows.select(F.size(text.windows(text.words(F.col("t")), 128, 16)), F.length(completions.rule_text(F.col("t")))).write.format("noop").mode("overwrite").save()
        rows.unpersist()
        return time.time() - start

    took(100)
    assert took(20_000) < 30 * max(took(2_000), 0.1)
