"""Training tables: messages, mixing, rendered chats and assistant spans."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role names and the markers of the two chat formats.
ROLES = {"human": "user", "gpt": "assistant"}
SYSTEM = "You are a helpful assistant."
LEARNING_RATES = {0: 2e-5, 1: 2e-5, 2: 1e-5}
RUN_NAMES = {0: "mix", 1: "stage-1", 2: "stage-2"}


def role(c: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), ROLES.items(), F.when(F.lit(False), c)).otherwise(c)


def messages(conversations: Column) -> Column:
    return F.transform(conversations, lambda m: F.struct(role(m["from"]).alias("role"), m["value"].alias("content")))


def mix(parts: list[DataFrame], key: str, seed: int = 42) -> DataFrame:
    """One part as it is; several as one, ordered by a hash of seed and key."""
    if len(parts) == 1:
        return parts[0]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("order", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))).orderBy("order", key)


def _pieces(msgs: Column, template: str, eos: str) -> Column:
    """The rendered text as pieces: text, learn (whether the loss counts it)."""
    piece = lambda text, learn=False: F.struct(text.alias("text"), F.lit(learn).alias("learn"))
    if template == "plain":
        def of(m: Column) -> Column:
            user = F.array(piece(F.concat(F.lit("### Human: "), m["content"], F.lit("\n\n### Assistant: "))))
            said = F.array(piece(m["content"], True), piece(F.lit(eos)))
            return F.when(m["role"].isin("user", "human"), user).when(m["role"].isin("assistant", "gpt"), said)

        return F.flatten(F.filter(F.transform(msgs, of), lambda x: x.isNotNull()))

    def of(m: Column) -> Column:
        head = F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"))
        user = F.array(piece(F.concat(head, m["content"], F.lit("<|im_end|>\n"))))
        said = F.array(piece(head), piece(m["content"], True), piece(F.lit("<|im_end|>\n")))
        return F.when(m["role"] == "user", user).when(m["role"] == "assistant", said)

    own = F.get(msgs, F.lit(0))
    system = F.when(own["role"] == "system", own["content"]).otherwise(F.lit(SYSTEM))
    first = F.array(piece(F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n"))))
    return F.concat(first, F.flatten(F.filter(F.transform(msgs, of), lambda x: x.isNotNull())))


def rendered(msgs: Column, template: str = "plain", eos: str = "</s>") -> Column:
    """text and spans (start, end: characters the loss counts) of a conversation."""
    pieces = _pieces(msgs, template, eos)
    spans = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["text"])).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p["text"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.struct(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"), spans.alias("spans"))


def template_of(model_path: str | None) -> tuple[str, str]:
    """The chat format for a model folder, and its end-of-text token: the plain one if
    the tokenizer has no chat template of its own (or there is none to read), else the
    one with markers."""
    try:
        with open(os.path.join(model_path or "", "tokenizer_config.json"), encoding="utf-8") as f:
            found = json.load(f)
    except OSError:
        return "plain", "</s>"
    eos = found.get("eos_token") or "</s>"
    return ("im" if found.get("chat_template") else "plain"), eos["content"] if isinstance(eos, dict) else eos


def schedule(stage: int, per_device: int = 4, accumulate: int = 8, world: int = 1, lr: float | None = None) -> dict:
    """A stage's numbers for the trainer; a learning rate of 0 counts as not given."""
    return {"stage": stage, "effective_batch": per_device * accumulate * world, "lr": lr or LEARNING_RATES[stage]}
