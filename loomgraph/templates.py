"""Prompts, in our own words, that ask for the formats the parsers read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.operators.extraction import DONE, ENTITY_TYPES, FIELD, RECORD

EXTRACT = f"""List what the text below speaks of and how those things relate, in the text's own language.

Write one record for each thing of a kind in [{{types}}]:
("entity"{FIELD}NAME{FIELD}KIND{FIELD}what the text says of it, in a sentence)
and one for each pair of them that the text connects:
("relationship"{FIELD}NAME{FIELD}NAME{FIELD}how they are connected{FIELD}strength from 1 to 10)

Put {RECORD} after every record, also the last, and finish with {DONE}

Text:
{{text}}
"""
CONTINUE = f"Some records are still missing. Add them in the same format, {RECORD} after each, and finish with {DONE}"
MORE = "Are there records still missing? Answer Y or N."
INTER = """The answer to a question shall be: {target}

A path that leads to it:
{path}

What is known:
{passages}

First reason from the passages, step by step, to the answer, using nothing else. Then ask one short, natural question with just the clues that single the answer out; never name it. If that cannot be done, ask SKIP.

Reasoning:
Step 1: ...
Step 2: ...

Question: ...

Final Answer: {target}
"""
CHECK = """Someone wrote a question whose answer is {target}.

Question: {question}

Reasoning:
{reasoning}

Passages:
{passages}

Say FAIL if the reasoning states what no passage does, goes in a circle or hangs on chance likenesses, if the question names the answer, fits others too, or merely retells the reasoning. Otherwise say PASS. One word only.
"""
INTRA = """Pick the most specific thing that the text below tells of. Describe it in plain statements with all the text says; then ask one short, natural question that it answers, without naming it. If nothing is specific enough, ask SKIP.

Description: ...
Question: ...
Final Answer: ...

Text:
{text}
"""


def fill(template: str, **parts: Column) -> Column:
    """The template with columns in its places, whatever braces they hold."""
    out: list[Column] = []
    rest = template
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in parts if "{" + k + "}" in rest), default=None)
        if at is None:
            out.append(F.lit(rest))
            break
        out += [F.lit(rest[: at[0]]), F.coalesce(parts[at[1]], F.lit(""))]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*out)


def extraction_prompt(text: Column, types: tuple[str, ...] = ENTITY_TYPES) -> Column:
    return fill(EXTRACT, types=F.lit(",".join(types)), text=text)
