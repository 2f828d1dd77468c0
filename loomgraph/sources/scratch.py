"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that shuffle files go as the query that made them ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting that lists are gathered in a hash table, which after 128 groups is
#: given up for a sort, in front of the shuffle and after it.
HASHED = "spark.sql.execution.useObjectHashAggregateExec"
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where the session has none
    and runs on this machine alone, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Deletes through Spark's own file system layer."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def replace_by(spark: SparkSession, path: str, fresh: str, part: bool = False) -> None:
    """What is at `fresh` (or, with part, its only part file) takes the place of what is
    at `path`. The old one is moved aside and deleted last, so one of them is whole
    at any time."""
    new = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    source = fs.globStatus(new(f"{fresh}/part-*"))[0].getPath() if part else new(fresh)
    old = f"{path.rstrip('/')}.old"
    if fs.exists(new(path)):
        fs.delete(new(old), True)
        fs.rename(new(path), new(old))
    if not fs.rename(source, new(path)):
        raise OSError(f"{path} could not be written; what was there before is at {old}")
    fs.delete(new(old), True)
    if part:
        fs.delete(new(fresh), True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, through Spark's own file system layer."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


class Scratch:
    """Tables that cut lineage: a lost executor costs only the tasks it ran."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/loomgraph/{name}-{uuid.uuid4().hex[:12]}"
        _made.append((spark, self.path))

    def table(self, df: DataFrame, name: str, compression: str = "zstd", many_groups: bool = False) -> DataFrame:
        """df, written and read again. The files of the shuffles that made it go at once:
        they serve nothing else. With many_groups, lists are gathered from sorted rows."""
        path, conf = f"{self.path}/{name}", self.spark.conf
        put = {CLEAN: "true"} | ({HASHED: "false"} if many_groups else {})
        before = {c: conf.get(c, None) for c in put}
        for c, v in put.items():
            conf.set(c, v)
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            for c, v in before.items():
                conf.unset(c) if v is None else conf.set(c, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        drop(self.spark, f"{self.path}/{name}")


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # the application's JVM may have gone first
            break
