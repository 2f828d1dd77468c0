"""Prefix sums and running numbers that no single task gathers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.scratch import Scratch


def spread(rows: DataFrame) -> DataFrame:
    """rows, a scan, for work that costs far more than reading. A table of less than a
    full split for each core may lie in fewer row groups than there are cores, each of
    them one task: it is dealt anew. Larger tables stay as they are, so no more than
    that size is ever shuffled."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * split else rows


def prefix_sums(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows before each, in `order` (which tells all
    rows apart). rows should be narrow: they are dealt by range and written once.

    Each range sums its own rows; the sums of the ranges, as many as there are shuffle
    partitions, are summed in one task. An empty table gives an empty one.
    """
    dealt = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    dealt = Scratch(rows.sparkSession, "scan").table(dealt, "ranges")
    totals = dealt.groupBy("__range").agg(F.sum(value).alias("__n"))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__range", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(totals), "__range")  # a row for each shuffle partition at most
    return out.withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__range", "__base")


#: Minors that one window of running_total may hold.
RUN = 250


def running_total(rows: DataFrame, major: str, minor: str, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows before each, in the order (major, minor).

    Rows are summed by runs of `RUN` minors; the runs, narrow rows, get their prefix
    sums, and only rows of one run meet in a window. So wide rows are dealt once.
    `value` is worked out for both, so it should be cheap.
    """
    keyed = rows.withColumn("__run", F.floor(F.col(minor) / RUN))
    runs = keyed.groupBy(major, "__run").agg(F.sum(value).alias("__n"))
    runs = prefix_sums(runs, [major, "__run"], "__n", "__from").drop("__n")
    inside = Window.partitionBy(major, "__run").orderBy(minor).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(runs, [major, "__run"]).withColumn(name, F.col("__from") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("__run", "__from")
