"""Completion backends: what turns prompts into text.

Each is a function DataFrame -> DataFrame that adds columns. `rule` needs no model;
`replay` joins stored completions; `http` calls chat endpoints from the workers;
`remembered` stores what another backend answers and replays it.
"""

from __future__ import annotations

import json
import re
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.extraction import DONE, ENTITY_TYPES, FIELD, RECORD
from loomgraph.sources.scratch import Scratch, exists

Backend = Callable[[DataFrame], DataFrame]
NAME = "[A-Z][a-z]{3,}"


def _saying(types: tuple[str, ...]) -> Callable[[str | None], str]:
    """A text to what `rule` says about it."""
    find, n, glue, last, field = re.compile(NAME).findall, len(types), f"\n{RECORD}\n", f"\n{RECORD}\n{DONE}", FIELD

    def said(text: str | None) -> str:
        names = find(text or "")
        records = [f'("entity"{field}{t}{field}{types[(len(t) + i) % n]}{field}{t} at {i})' for i, t in enumerate(names)]
        records += [f'("relationship"{field}{a}{field}{b}{field}{a} then {b}{field}{len(a) % 10 + 1})' for a, b in zip(names, names[1:])]  # noqa: B905
        return glue.join(records) + last

    return said


def rule_text(text: Column, types: tuple[str, ...] = ENTITY_TYPES) -> Column:
    """Capitalised words as entities, neighbours as relationships, in the completion format."""
    said = _saying(types)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([said(t) for t in texts.to_pylist()], pa.string())

    return run(text)


#: Characters of completions that one batch of `rule` holds, but for the last of them.
HELD = 1 << 24


def rule(chunks: DataFrame) -> DataFrame:
    """chunks (id, text, chunk_seq) to completions (chunk_id, chunk_seq, result), as
    `rule_text` says. One pass in Python, `HELD` characters at a time: lambdas over the
    words of a text cost some ten times as much."""
    said, held = _saying(ENTITY_TYPES), HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, start, size, out = batch.select(["chunk_id", "chunk_seq"]), 0, 0, []
            for i, text in enumerate(batch.column("text")):
                out.append(said(text.as_py()))
                size += len(out[-1])
                if size >= held or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*keys.slice(start, len(out)).columns, pa.array(out, pa.string())], ["chunk_id", "chunk_seq", "result"])
                    start, size, out = i + 1, 0, []

    given = chunks.select(F.col("id").alias("chunk_id"), "chunk_seq", "text")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    return given.mapInArrow(run, f"chunk_id {kinds['chunk_id']}, chunk_seq {kinds['chunk_seq']}, result string")


#: A conversation so far, as a column.
MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


def prompt_key(messages: Column, model: Column) -> Column:
    """What a call is known by: the model with its settings, and all messages."""
    return F.md5(F.concat_ws("\n", model, F.to_json(messages)).cast("binary"))


def replay(stored: DataFrame, key: str, out: str = "completion") -> Backend:
    """Completions stored by key (a table of key and text); none found: null."""
    return lambda rows: rows.join(stored.select(key, F.col("text").alias(out)), key, "left")


STORED = "key string, text string"


def remembered(call: Backend, path: str, settings: str) -> Backend:
    """A backend on messages that asks `call` only what the table at `path` does not
    know yet, and adds the answers to it before they are used: a run that was cut off,
    or had failed calls, makes only the calls that are left. Equal prompts are asked once.
    """

    def backend(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        keyed = rows.withColumn("key", prompt_key(F.col("messages"), F.lit(settings)))
        known = table_or_none(spark, path, STORED)
        todo = keyed.select("key", "messages").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
        said = Scratch(spark, "calls").table(call(todo).select("key", F.col("completion").alias("text"), "error"), "said")
        said.where("error is null").select("key", "text").write.mode("append").parquet(path)
        both = known.withColumn("error", F.lit(None).cast("string")).unionByName(said)
        answers = both.select("key", F.col("text").alias("completion"), "error")
        return keyed.join(answers, "key", "left").drop("key")

    return backend


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows where there is none yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def http(urls: list[str], model: str, api_key: str = "EMPTY", max_tokens: int = 4096, temperature: float = 0.0, concurrency: int = 8, timeout: float = 600.0, tasks: int | None = None) -> Backend:
    """Calls chat endpoints with each row's messages and adds completion and error.

    `concurrency` calls run at once over all: rows are dealt to `tasks` tasks (as many
    as there are cores, at most one for each call at once), each with its share. A
    conversation's first message says which of the urls it goes to, so its turns go to
    one. A failed call gives null and its error. Spark may run a task again, so calls
    are at least once: write the result before using it (`remembered` does).
    """

    def ask(messages: list[dict]) -> tuple[str | None, str | None]:
        body = {"model": model, "messages": messages, "max_tokens": max_tokens, "temperature": temperature}
        url = urls[zlib.crc32((messages[0]["content"] or "").encode()) % len(urls)] if messages else urls[0]
        request = urllib.request.Request(url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"] or "", None
        except Exception as e:  # noqa: BLE001  a failed call loses its item only
            return None, repr(e)[:500]

    def calling(share: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(share) as pool:
                for batch in batches:
                    for start in range(0, batch.num_rows, 16 * share):
                        part = batch.slice(start, 16 * share)
                        found = list(pool.map(ask, part.column("messages").to_pylist()))
                        columns = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
                        yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "completion", "error"])

        return run

    def backend(rows: DataFrame) -> DataFrame:
        n = tasks or max(1, min(rows.sparkSession.sparkContext.defaultParallelism, concurrency))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.repartition(n).mapInArrow(calling(max(1, -(-concurrency // n))), f"{fields}, completion string, error string")

    return backend
